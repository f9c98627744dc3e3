"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from ledgerline.llm.chat_format import PROBE, Template
from ledgerline.llm.quality_rules import COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_SHAPE_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, N_CLASSES, N_COMMON, N_FINE, OTHER, REFERENCES, SHAPES

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

NEAR_DEDUP = f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all({FOLD}, {WORD}) AS w FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
        FROM words
    ), shingles AS (
        SELECT doc_id, len(g) AS n, unnest(g) AS h FROM sets
    ), links AS (
        SELECT a.doc_id AS a, b.doc_id AS b
        FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
    ), reach AS (
        SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON other = a
    ), least_id AS (
        SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
    )
    SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_id USING (doc_id)
"""

EXACT_DEDUP = f"""
    WITH d AS (SELECT doc_id, {FOLD} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM d WINDOW g AS (PARTITION BY t)
"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _distance(p: str, q: str, n: int) -> str:
    a, b = f"({p}[k] / greatest(list_sum({p}), 1)::DOUBLE)", f"({q}[k] / greatest(list_sum({q}), 1)::DOUBLE)"

    def part(x: str, y: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

    return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda k: ({part(a, b)} + {part(b, a)}) / 2))))"


def _counted(pattern: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))"


QUALITY_RELATIVE = rf"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{c}'" for c in COMMON_WORDS)}) THEN lang ELSE '{OTHER}' END AS language FROM documents
    ), w AS (
        SELECT *, regexp_extract_all(text, {WORD}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
            CASE language {" ".join(f"WHEN '{c}' THEN {_list(v)}" for c, v in COMMON_WORDS.items())} ELSE {_list(COMMON_WORDS["en"])} END AS c FROM d
    ), windows AS (
        SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM (
            SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM w)
    ), repeated AS (
        SELECT doc_id, sum(least(8, coalesce(next_p - p, 8)))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next_p FROM windows WHERE n > 1) GROUP BY 1
    ), m AS (
        SELECT doc_id, language, length(text) AS n_chars, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_counted('[#*$%&|<>]')}::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, {_counted('\\p{Ll}')} AS n_lower, {_counted('\\p{Lu}')} AS n_upper, {_counted('\\p{Nd}')} AS n_digits,
            list_transform(c, lambda y: len(list_filter(w, lambda x: lower(x) = y))) AS hits FROM w
    ), h AS (
        SELECT *, [n_lower, n_upper, n_digits, n_symbols, n_chars - word_chars, word_chars - n_lower - n_upper - n_digits - n_symbols] AS classes,
            list_append(hits, n_words - list_sum(hits)) AS common FROM m
    ), refs AS (
        SELECT language, [{", ".join(f"sum(classes[{k}])" for k in range(1, N_CLASSES + 1))}] AS ref_classes, [{", ".join(f"sum(common[{k}])" for k in range(1, N_COMMON + 2))}] AS ref_common FROM h GROUP BY 1
    ), j AS (
        SELECT h.*, coalesce(n_repeat_words, 0) AS n_repeat_words, {_distance("classes", "ref_classes", N_CLASSES)} AS class_distance, {_distance("common", "ref_common", N_COMMON + 1)} AS word_distance
        FROM h JOIN refs USING (language) LEFT JOIN repeated USING (doc_id)
    ), v AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            (n_chars >= {MIN_CHARS} AND class_distance > {MAX_CLASS_DISTANCE}) OR (n_words >= {MIN_WORDS} AND word_distance > {MAX_WORD_DISTANCE}) AS odd FROM j
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT odd AS kept,
        round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM v
"""


_REFS = ", ".join(f"('{c}', {list(q[0])}, {list(q[1])}, {list(q[2])}, {_list(COMMON_WORDS[c])})" for c, q in REFERENCES.items())

QUALITY_RULES = rf"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{c}'" for c in COMMON_WORDS)}) THEN lang ELSE '{OTHER}' END AS language FROM documents
    ), w AS (
        SELECT *, regexp_extract_all(text, {WORD}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
    ), windows AS (
        SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM (
            SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM w)
    ), repeated AS (
        SELECT doc_id, sum(least(8, coalesce(next_p - p, 8)))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next_p FROM windows WHERE n > 1) GROUP BY 1
    ), m AS (
        SELECT doc_id, language, w, length(text) AS n_chars, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_counted('[#*$%&|<>]')}::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, {_counted('\\p{Ll}')} AS n_lower, {_counted('\\p{Lu}')} AS n_upper, {_counted('\\p{Nd}')} AS n_digits,
            {_counted('[|]')} AS n_bars, {_counted('[.,;:?!]')} AS n_sentence,
            list_transform(w, lambda x, i: CASE WHEN NOT regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN 's' WHEN i > 1 AND w[i - 1] = x THEN 'r' WHEN regexp_matches(x, '[#*$%&|<>]') THEN 'y'
                WHEN NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '\p{{Lu}}\P{{Lu}}*\p{{Lu}}') THEN 'u' ELSE 'p' END) AS codes FROM w
    ), h AS (
        SELECT *, [n_lower, n_upper, n_digits, n_bars, n_symbols - n_bars, n_chars - word_chars, n_sentence, word_chars - n_lower - n_upper - n_digits - n_symbols - n_sentence] AS classes,
            [{", ".join(f"len(list_filter(codes, lambda x: x = '{c}'))" for c in SHAPES)}] AS shapes FROM m
    ), refs(c, q_classes, q_common, q_shapes, listed) AS (VALUES {_REFS}
    ), pairs AS (
        SELECT doc_id, classes, shapes, q_classes, q_common, q_shapes, list_append(hits, n_words - list_sum(hits)) AS common
        FROM (SELECT *, list_transform(listed, lambda y: len(list_filter(w, lambda x: lower(x) = y))) AS hits FROM h JOIN refs ON language = c OR language = '{OTHER}')
    ), far AS (
        SELECT doc_id, {_distance("classes", "q_classes", N_FINE)} AS class_distance, {_distance("common", "q_common", N_COMMON + 1)} AS word_distance, {_distance("shapes", "q_shapes", len(SHAPES))} AS shape_distance FROM pairs
    ), nearest AS (
        SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY word_distance, class_distance, shape_distance) = 1
    ), v AS (
        SELECT h.*, coalesce(n_repeat_words, 0) AS n_repeat_words, class_distance, word_distance, shape_distance, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
            (n_chars >= {MIN_CHARS} AND class_distance > {MAX_CLASS_DISTANCE}) OR (language <> '{OTHER}' AND n_words >= {MIN_WORDS} AND word_distance > {MAX_WORD_DISTANCE}) OR shape_distance > {MAX_SHAPE_DISTANCE} AS odd
        FROM h JOIN nearest USING (doc_id) LEFT JOIN repeated USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT odd AS kept,
        round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, round(shape_distance, 6) AS shape_distance FROM v
"""

SECRET_COUNTS = r"""
    SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

SHARD_SUMS = """
    SELECT sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, count(*) AS n_rows, 8::BIGINT AS shards, true AS gapless, true AS even FROM documents
"""

#: Sum of the digits as the check digit has it: every second digit from the right counts twice, less 9 above 9.
_LUHN = "list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN (length(x) - k) % 2 = 0 THEN x[k]::INT WHEN x[k]::INT > 4 THEN 2 * x[k]::INT - 9 ELSE 2 * x[k]::INT END)) % 10 = 0"
PII_COUNTS = rf"""
    SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
        len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INT), 256) > 255)) = 0)) AS n_ip,
        len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')), lambda x: length(x) BETWEEN 16 AND 19 AND {_LUHN})) AS n_card,
        len(list_filter(list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 8 AND 15)) AS n_phone
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

FILTER_AUDIT = rf"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
    ), l AS (
        SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
    ), m AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
        FROM d LEFT JOIN l USING (doc_id)
    ), cells AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
    ), letters(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
    ), orders AS (
        SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ), steps AS (
        SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
    ), told AS (
        SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
            coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
            coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
        FROM cells, steps GROUP BY ALL
    )
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
        toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told
"""

_ASSIGNED = """a{k} AS (
        SELECT vec_id, p, any_value(x) AS x, arg_min(e, dist * 256 + e) AS e, min(dist) AS dist
        FROM (SELECT vec_id, p, x, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM parts JOIN c{k} USING (p)) GROUP BY 1, 2
    )"""
#: Entry by component: floor(sum / count) in integers.
_MOVED = """c{k} AS (
        SELECT p, e, list(coalesce(m, y) ORDER BY i) AS y FROM (SELECT p, e, unnest(range(1, len(y) + 1)) AS i, unnest(y) AS y FROM c{before})
        LEFT JOIN (SELECT p, e, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
            FROM (SELECT p, e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM a{before}) GROUP BY 1, 2, 3) USING (p, e, i) GROUP BY 1, 2
    )"""
VECTOR_CODES = f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS (
        SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)
    ), c0 AS (
        SELECT p, e, x AS y FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256) USING (vec_id)
    ), {", ".join(_ASSIGNED.format(k=k) + ", " + _MOVED.format(k=k + 1, before=k) for k in range(4))}, {_ASSIGNED.format(k=4)}, coded AS (
        SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a4 GROUP BY 1
    ), books AS (
        SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c4
    )
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escapes(text: str) -> str:
    """How many backslashes escaping adds: places where control strings begin, of which no two of the default template overlap."""
    return " + ".join(f"(length({text}) - length(replace({text}, {_quoted(c)}, ''))) // {len(c)}" for c in ("\\", *Template().controls))


def _chat_sql() -> str:
    t = Template()
    heads = " ".join(f"WHEN {_quoted(r)} THEN {len(h)}" for r, h in t.headers.items())
    named = len(t.other) + len(t.named)
    return f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), {_quoted(PROBE)}
    ), c AS (
        SELECT *, (CASE role {heads} ELSE {named} + length(role) + {_escapes("role")} + (length(role) - length(replace(role, {_quoted(t.named)}, ''))) // {len(t.named)} END)
            + length(text) + {_escapes("text")} + {len(t.close)} AS chars,
            coalesce(lag(role) OVER w, 'start') || ' ' || role AS met, CASE WHEN lead(role) OVER w IS NULL THEN role || ' end' END AS last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
    ), f AS (
        SELECT *, (met NOT IN ({", ".join(f"'{a} {b}'" for a, after in t.follows.items() for b in after)}) OR coalesce(last <> 'assistant end', false))::INT AS fault FROM c
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(chars)::BIGINT AS formatted_chars, sum(fault)::BIGINT AS n_faults FROM f GROUP BY 1
"""


SQL = {
    "op1_near_dedup": NEAR_DEDUP, "op5_exact_dedup": EXACT_DEDUP, "op7_quality_rules": QUALITY_RULES, "op7_quality_relative": QUALITY_RELATIVE,
    "op3_secret_counts": SECRET_COUNTS, "op6_shard_sums": SHARD_SUMS, "op10_pii_counts": PII_COUNTS,
    "op11_filter_audit": FILTER_AUDIT, "op12_vector_codes": VECTOR_CODES, "op13_chat_format": _chat_sql(),
}
