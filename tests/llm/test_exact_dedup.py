import hashlib
import re

from ledgerline.llm import exact_dedup
from ledgerline.llm.exact_dedup import LOWER, UPPER

SCHEMA = "doc_id long, text string, digest string, row string"


def brute(rows):
    def fold(t):
        return (t or "").translate(str.maketrans(UPPER, LOWER))

    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[fold(t)] if x is not None]
        out.append((i, max(ids) if ids else None, len(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "a b"), (7, "x" * 100_000), (8, "X" * 100_000), (9, "one"), (9, "one"), (None, "lone")]


def test_marks_against_brute_force(spark):
    # The clashing names "digest" and "row" are the operator's own inside.
    rows = ROWS + [(100 + k, "hot") for k in range(60)]
    got = exact_dedup.mark_copies(spark.createDataFrame([(*r, "d", "r") for r in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in got}) == len(kept) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_drop_keeps_columns_and_one_row_each(spark):
    rows = ROWS + [(100 + k, "hot") for k in range(60)] + [(159, "hot")]
    docs = spark.createDataFrame([(*r, "d", "r") for r in rows], SCHEMA)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    texts = [r.text.lower() if r.text and r.text.isascii() else r.text or "" for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").lower() if (t or "").isascii() else t for _, t in rows})
    assert {r.doc_id for r in got.collect() if r.text == "hot"} == {159}


def test_rows_of_one_id_are_told_apart_by_their_spelling(spark):
    for copies in (1, 40):
        rows = [(9, "One Text"), (9, "one text"), (3, "ONE TEXT")] * copies
        left = {exact_dedup.drop_copies(spark.createDataFrame([(*r, "d", "r") for r in part], SCHEMA)).collect()[0].text for part in (rows, rows[::-1])}
        assert len(left) == 1 and left <= {"One Text", "one text"}


def test_repeats_of_a_frequent_row_leave_one(spark):
    rows = [(9, "Same"), (None, "alone")] * 300 + [(8, "same"), (1, "x")]
    got = exact_dedup.drop_copies(spark.createDataFrame([(*r, "d", "r") for r in rows], SCHEMA))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "alone"), (1, "x"), (9, "Same")]
    # Each task sends one row of a group.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search("WindowGroupLimit.*Partial", plan) and re.search("WindowGroupLimit.*Final", plan)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.mark_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
