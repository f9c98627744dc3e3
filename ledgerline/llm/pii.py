"""Personal data: patterns, and information-theoretic sanitisation of the terms that give it away.

Patterns find the protected entities (addresses, numbers). Then the corpus says how strongly a term
reveals one of them: over all different texts, with t near e in n(t,e) texts, t in n(t) and e in n(e) of
N, the share n(t,e) / n(t) and the pointwise mutual information log2(n(t,e) N / (n(t) n(e))). The same is
asked of each kind of entity, e being any value of it. Terms that exceed both thresholds in enough texts are
taken out: a term that reveals a value is removed like the entity itself, one that only reveals a kind is
generalised to its shape.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.batches import texts
from ledgerline.llm.skew import salted_join
from ledgerline.llm.staging import stage

KINDS = ("email", "ip", "card", "phone")
#: Terms that reveal a value, and terms that reveal a kind only.
TERM, HINT = "term", "hint"
ALL_KINDS = (*KINDS, TERM, HINT)

#: Words on either side of an entity that count as near it.
NEAR = 5
#: Different texts in which a term must be near an entity. Copies of a text are one text.
MIN_TEXTS = 2
#: Stands for any value, in the entity of a kind.
ANY = "*"
MIN_SHARE, MIN_PMI = 0.5, 3.0

#: The patterns below match exactly where the plain ones would, but never look at a character twice:
#: a run of digits or of name characters is entered at its first character only.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NAME_END = re.compile(r"[^A-Za-z0-9._%+-]")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
#: The same words for the JVM.
WORD_SQL = "[\\p{L}\\p{Nl}\\p{No}]{3,}"


def emails(text: str) -> list[tuple[int, int]]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in NAME_CHARS:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of kind, start, end) in code points, by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def words_of(text: str, spans: list[tuple[int, int, int]]) -> list[re.Match]:
    """Words of a text that no span touches."""
    inside = sorted((a, b) for _, a, b in spans)
    ends = [0]
    for _, b in inside:
        ends.append(max(ends[-1], b))
    # Of the spans that begin before a word ends, the furthest end must not reach into it.
    return [m for m in WORD.finditer(text) if ends[bisect_left(inside, (m.end(), 0))] <= m.start()]


def pairs_of(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[str, str]]:
    """(entity, term) for the NEAR words on either side of each span; entities are kind:value and kind:*."""
    words = words_of(text, spans)
    starts = [m.start() for m in words]
    found = set()
    for rank, start, end in spans:
        value = re.sub(r"[\x20().-]", "", text[start:end]) if rank > 1 else text[start:end].lower()
        left, right = bisect_left(starts, start), bisect_left(starts, end)
        for m in words[max(0, left - NEAR) : left] + words[right : right + NEAR]:
            found |= {(f"{KINDS[rank]}:{value}", m[0].lower()), (f"{KINDS[rank]}:{ANY}", m[0].lower())}
    return found


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("key"), text.alias("text"))


def near_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (hash of the text), entity, term, for every entity and the words near it in every document.

    Each word of a document with entities also has a row whose entity is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                if spans:
                    out += [(key, *x) for x in pairs_of(text, spans)]
                    out += [(key, None, x) for x in {m[0].lower() for m in WORD.finditer(text)}]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["key", "entity", "term"])

    return _rows(docs, text_col).mapInArrow(run, "key bigint, entity string, term string")


def _candidates(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: pairs (term, entity, n_both) that may exceed the thresholds, n_entity of each entity, and
    the different texts (key) each candidate term occurs in. Texts with entities are cut into words once for what is near, all texts once more for the candidates."""
    rows = stage(near_entities(docs, text_col).distinct(), "near")
    near = rows.filter("entity IS NOT NULL")
    both = near.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= MIN_TEXTS)
    # A term stands in no fewer texts than those with entities that have it anywhere: where these alone
    # push the share below the threshold, the corpus need not be asked.
    n_least = rows.filter("entity IS NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))
    both = stage(both.join(n_least, "term").filter(F.col("n_both") >= MIN_SHARE * F.col("n_least")).drop("n_least"), "both")
    n_entity = near.select("entity", "key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    terms = stage(both.select("term").distinct(), "candidate-terms")
    found = F.transform(F.regexp_extract_all("text", F.lit(WORD_SQL), F.lit(0)), lambda w: F.lower(w))
    words = _rows(docs, text_col).select("key", F.explode(F.array_distinct(found)).alias("term"))
    return both, n_entity, stage(salted_join(words, terms, "term").distinct(), "occurrences")


def _judged(docs: DataFrame, text_col: str, both: DataFrame, n_entity: DataFrame, occurrences: DataFrame) -> DataFrame:
    total = _rows(docs, text_col).select("key").distinct().count()
    n_term = occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counted = both.join(n_term, "term")
    # Under a kind stand up to all candidate terms, so its four rows are broadcast; values go by salted keys.
    of_kind, n_entity = F.col("entity").endswith(f":{ANY}"), stage(n_entity, "entities")
    met = counted.filter(of_kind).join(F.broadcast(n_entity.filter(of_kind)), "entity").unionByName(salted_join(counted.filter(~of_kind), n_entity.filter(~of_kind), "entity"))
    judged = met.select(
        "term",
        "entity",
        "n_both",
        "n_term",
        "n_entity",
        (F.col("n_both") / F.col("n_term")).alias("share"),
        F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity"))).alias("pmi"),
    )
    return judged.filter((F.col("share") >= MIN_SHARE) & (F.col("pmi") >= MIN_PMI))


def revealing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, entity, n_both, n_term, n_entity, share, pmi for the terms that exceed the thresholds.

    An entity is kind:value, or kind:* for any value of the kind. Documents are counted by text, so
    copies of one text are one document; all counts are exact. The candidate terms are broadcast if their
    files are small, else words and copies of one text are dealt over salted keys.
    """
    return _judged(docs, text_col, *_candidates(docs, text_col))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans_of(text: str, terms: dict[str, bool]) -> list[tuple[int, int, int]]:
    """Base spans, then the revealing terms outside of them; terms say whether they reveal a value."""
    spans = base_spans(text)
    if terms:
        hits = [(len(KINDS) + (not terms[m[0].lower()]), *m.span()) for m in words_of(text, spans) if m[0].lower() in terms]
        spans += sorted(hits)
    return spans


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping ones, replaced by the name of its first kind, and hints by their shape."""
    out, at = [], 0
    for start, rank, end in sorted((a, rank, b) for rank, a, b in spans):
        if start >= at:
            name = ALL_KINDS[rank].upper() if ALL_KINDS[rank] != HINT else "Name" if text[start].isupper() else "word"
            out += [text[at:start], "[", name, "]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` in a struct ``doc``, with its text and revealing terms beside it.

    Null texts have no spans and stay null; so have empty ones. Ids play no part, so null ids
    and repeated rows are handled like all others, and columns of any name may be there. Empty tables
    give no rows. Texts are read whole. terms: those of the text, with whether they reveal a value.
    """
    both, n_entity, occurrences = _candidates(docs, text_col)
    judged = _judged(docs, text_col, both, n_entity, occurrences)
    terms = stage(judged.groupBy("term").agg(F.bool_or(~F.col("entity").endswith(f":{ANY}")).alias("value")), "revealing")
    in_doc = stage(occurrences.join(terms, "term").groupBy("key").agg(F.collect_list(F.struct("term", "value")).alias("terms")), "terms-of-doc")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("key"))
    return salted_join(rows, in_doc, "key", "left").select("doc", F.col("doc")[text_col].alias("text"), "terms")


def _as_dict(terms: list[dict] | None) -> dict[str, bool]:
    return {t["term"]: t["value"] for t in terms or ()}


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, terms = texts(batch.column(1)).to_pylist(), batch.column(2).to_pylist()
        spans = [spans_of(v, _as_dict(t)) for v, t in zip(values, terms)]
        named = [[{"kind": ALL_KINDS[r], "start": a, "end": b} for r, a, b in x] for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, SPANS_ARROW)], ["doc_id", "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of each row, under the rules of ``sanitise``.

    spans hold kind, start and end in code points, by kind (email, ip, card, phone, term, hint), then start.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = sanitise(narrow).select(F.col("doc.doc_id").alias("doc_id"), "text", "terms")
    return rows.mapInArrow(_spans, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the texts masked; all other columns as they were."""
    rows = sanitise(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, terms = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [v if v is None else masked(v, spans_of(v, _as_dict(t))) for v, t in zip(values, terms)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["doc", "text"])

    schema = T.StructType([rows.schema["doc"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select(*[F.col("text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
