import hashlib
import random
import re

from ledgerline.llm import secret_scan as S
from ledgerline.llm.staging import read

SCHEMA = "doc_id long, text string, spans string"


def brute(text):
    text = text or ""
    kinds = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    }
    spans = [(m.start(), k, m.end(), kind) for k, (kind, (p, flags, good)) in enumerate(kinds.items()) for m in re.finditer(p, text, flags) if good(m)]
    return {k: sum(s[3] == k for s in spans) for k in kinds}, ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def check(got, texts):
    for r in got:
        counts, listed = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(counts.values())
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_against_brute_force(spark, data):
    docs = read(spark, data, "documents")
    check(S.digest_columns(S.scan(docs)).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_random_texts(spark):
    random.seed(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abc", "a1b2c3d4e5", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "\n", "é", "🙂", "/", "."]
    texts = {k: "".join(random.choice(bits) for _ in range(random.randint(0, 30))) for k in range(3000)}
    texts |= {3000: None, 3001: "", 3002: "f" * 200_000, 3003: "secret: token: abcdefgh", 3004: "AKIA" * 40_000, 3005: "ak", 3006: "tok"}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], SCHEMA)
    got = S.digest_columns(S.scan(docs)).collect()
    assert len(got) == len(texts)
    check(got, texts)


def test_more_kinds_and_queries(spark):
    text = "x -----BEGIN RSA PRIVATE KEY----- y ghp_" + "a1" * 18 + " xoxb-1234567890ab eyJabcdefgh.eyJabcdefgh.abcdefghij"
    (row,) = S.scan(spark.createDataFrame([(1, text, "")], SCHEMA)).collect()
    assert {"private_key", "hosting_token", "chat_token", "web_token"} <= {s.kind for s in row.spans}
    assert S.trigram_query("[0-9a-f]+") == S.ANY
    assert S.trigram_query("ab") == S.ANY
    assert S.trigram_query("abcd") == {frozenset({"abc", "bcd"})}
    assert S.trigram_query("(abc|xyz+)q") == {frozenset({"abc"}), frozenset({"xyz"})} or S.ANY
    assert S.trigram_query("foo.*bar") == {frozenset({"foo", "bar"})}
    for rule in S.RULES:
        for text in ("password=hunter22", "AKIA" + "A" * 16, "-----BEGIN PRIVATE KEY-----", "gho_" + "a" * 36, "xoxp-1234567890", "eyJabcdefgh.eyJabcdefgh.abcdefghij"):
            if rule.compiled().search(text):
                assert any(all(g in text.lower() for g in way) for way in S.trigram_query(rule.pattern))


def brute_rules(text, rules):
    """Spans of any rules, without the index."""
    found = [(m.start(), k, m.end(), r.kind) for k, r in enumerate(rules) for m in r.compiled().finditer(text or "") if m.end(r.group) - m.start(r.group) >= r.least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_all_rules_against_brute_force(spark, data):
    random.seed(5)
    bits = ["-----BEGIN ", "PRIVATE KEY-----", "RSA ", "ghp_", "GHO_", "a1B2" * 9, "xoxb-", "xoxb-1234567890", "eyJ", "eyJabcdefgh", ".", "_", " ", "é", "clé=", "Clé=", "CLÉ=", "abcdefgh", "鍵", "鍵は", "token=", "ſ"]
    texts = [r.text for r in read(spark, data, "documents").limit(200).collect()] + ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    rules = (*S.RULES, S.Rule("accent", "clé=[a-z]{8}"), S.Rule("any_case", "clé=[a-z]{8}", any_case=True), S.Rule("wide", "鍵は?[a-z]+"), S.Rule("one_of", "[éè鍵]=?abc"))
    docs = spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], SCHEMA)
    got = S.scan(docs, rules=rules).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute_rules(texts[r.doc_id], rules)
    found = {s.kind for r in got for s in r.spans}
    assert {"accent", "any_case", "wide", "one_of", "private_key", "hosting_token", "chat_token"} <= found


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "password=hunter22", ""), (7, "password=hunter22", ""), (7, "password=hunter22", ""), (None, None, ""), (8, "", None)]
    got = S.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, len(r.spans)) for r in got), key=repr) == sorted([(None, 1), (7, 1), (7, 1), (None, 0), (8, 0)], key=repr)


def test_empty_table(spark):
    assert S.scan(spark.createDataFrame([], SCHEMA)).count() == 0
