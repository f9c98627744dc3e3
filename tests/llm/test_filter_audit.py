import re
from collections import defaultdict
from itertools import permutations

import pytest

from ledgerline.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, filter string, row long"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"word{k}" for k in range(120))


def failed(doc_id, text, rows):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(w) < 100:
        out.add("A")
    if 100 * len(set(w)) < 80 * len(w):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang in rows:
        parts[lang or ""].append((failed(i, t or "", rows), i in good, i in toxic))
    out = {}
    for part, found in parts.items():
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in found if f in x[0] and not x[0] & before]
                shapley[f] += len(here)
                out[part, order, step] = (
                    sum(not x[0] & (before | {f}) for x in found), len(here), sum(f in x[0] and bool(x[0] & before) for x in found), sum(x[0] == {f} for x in found), sum(x[1] for x in here), sum(x[2] for x in here)
                )
        for (p, order, step), told in list(out.items()):
            if p == part:
                out[p, order, step] = (*told, shapley[order[step - 1]])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y", 5) for r in rows], DOCS)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


ROWS = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG + " $", "en"), (4, "A B", "en"), (5, None, None), (6, "", ""), (7, "the " * 300, "fr"), (8, LONG.upper() + " #", "en"),
    (9, "x\x0by\tz\r\n  w w", "en"), (None, LONG, "en"), (None, None, None), (10, "Ä" * 50 + "ABCDEF", "en"), (3, "short", "en"), (3, LONG + " $", "en"), (11, "x" * 200_000, None),
]


def test_against_brute_force(spark):
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1), (8, 1, 1)]
    assert run(spark, ROWS, labels) == brute(ROWS, labels)


def test_one_text_and_one_language_hold_a_third(spark):
    rows = [(k, f"{LONG} {k}", "en") for k in range(100)] + [(200 + k, LONG, "en") for k in range(100)] + [(400 + k, f"few {k % 9} |", None) for k in range(100)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 500, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_no_row_fails_and_no_labels(spark):
    got = run(spark, [(1, LONG, "en")], [])
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}


def test_empty_table(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}


def test_each_filter_has_an_id_table(spark):
    docs = spark.createDataFrame([(*r, "x", "y", 5) for r in ROWS], DOCS)
    rows, fails = filter_audit.id_tables(docs, spark.createDataFrame([], LABELS))
    folders = {re.search("filter=([A-E])/", f).group(1) for f in fails.inputFiles()}
    assert folders == set("ABCDE") and rows.count() == len(ROWS)
    assert fails.filter("filter = 'E'").count() == 2


def test_prefixes_are_paired_after_the_shuffle(spark):
    docs = spark.createDataFrame([(*r, "x", "y", 5) for r in ROWS], DOCS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        counts = filter_audit.prefix_counts(*filter_audit.id_tables(docs, spark.createDataFrame([], LABELS)), "ABCDE")
        plan = counts._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(row" in line or "Exchange hashpartitioning(_row" in line]
        # Rows, candidates and ids: none of them below a second exchange for the join.
        assert exchanges and all("REPARTITION_BY_COL" in line for line in exchanges)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_other_rules(spark):
    rows = [(1, "aa", "en"), (2, "ab", "en"), (3, "bb", "en"), (4, "bb", "en")]
    docs = spark.createDataFrame([(*r, "x", "y", 5) for r in rows], DOCS)
    rules = {"x": lambda text, _: text.contains("a"), "y": lambda text, _: text.contains("b")}
    got = filter_audit.audit(docs, spark.createDataFrame([], LABELS), rules, "z").collect()
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got}
    assert len(found) == 18
    assert found["xyz", 1] == (2, 2, 0, 1, 9) and found["xyz", 2] == (0, 2, 1, 1, 12) and found["xyz", 3] == (0, 0, 1, 0, 3)


@pytest.mark.parametrize("text", ["", " ", "a", " a  b\t\x0b\x0c\r\nc ", " a b"])
def test_words(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(filter_audit.words(filter_audit.F.col("t"))).first()[0]
    assert got == re.findall(r"[^\x20\x09-\x0D]+", text)
