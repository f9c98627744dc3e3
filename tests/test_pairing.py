"""Pairs of unmatched rows that differ in one column."""

import random
from collections import Counter

from ledgerline.operators.pairing import row_changes

SCHEMA = "a string, b int, c string"


def changes(spark, source, target):
    got = row_changes(spark.createDataFrame(source, SCHEMA), spark.createDataFrame(target, SCHEMA)).collect()
    pairs = sorted(((r.column_name, r.source_value, r.target_value, r.n) for r in got if r.column_name), key=repr)
    return pairs, sum(r.n for r in got if r.target_h is None), sum(r.n for r in got if r.source_h is None), got


def test_one_column_each_and_leftovers(spark):
    source = [("x", 1, "p"), ("y", 2, "q"), ("z", None, "r"), ("gone", 9, "s"), ("same", 5, None)]
    target = [("x", 1, "P"), ("y", 3, "q"), ("z", 0, "r"), ("new", 8, "t"), ("same", 5, None)]
    pairs, lost, extra, _ = changes(spark, source, target)
    assert pairs == [("b", "2", "3", 1), ("b", None, "0", 1), ("c", "p", "P", 1)]
    assert (lost, extra) == (1, 1)


def test_counts_of_repeated_rows(spark):
    pairs, lost, extra, _ = changes(spark, [("x", 1, "p")] * 5 + [("k", 1, "k")], [("x", 1, "q")] * 3 + [("k", 1, "k")] * 2)
    assert pairs == [("c", "p", "q", 3)] and (lost, extra) == (2, 1)


def test_a_row_is_paired_once_by_the_first_column(spark):
    # ("x", 1, "p") could become either; the other source row takes what is left.
    pairs, lost, extra, _ = changes(spark, [("x", 1, "p"), ("w", 2, "p")], [("x", 2, "p"), ("v", 1, "p")])
    assert pairs == [("a", "w", "x", 1), ("a", "x", "v", 1)] and (lost, extra) == (0, 0)
    pairs, lost, extra, _ = changes(spark, [("x", 1, "p"), ("x", 1, "q")], [("y", 1, "p"), ("x", 2, "p"), ("x", 3, "q")])
    assert pairs == [("a", "x", "y", 1), ("b", "1", "3", 1)] and (lost, extra) == (0, 1)


def test_one_group_holds_all_rows(spark):
    # Only the numbering differs: all rows meet in a single group.
    source = [("x", k, "p") for k in range(500)]
    target = [("x", 1000 + k, "p") for k in range(490)]
    pairs, lost, extra, _ = changes(spark, source, target)
    assert len(pairs) == 490 and (lost, extra) == (10, 0)
    assert {p[0] for p in pairs} == {"b"} and len({p[1] for p in pairs}) == len({p[2] for p in pairs}) == 490


def test_random_tables_add_up(spark):
    rng = random.Random(3)
    source = [(rng.choice("xyz"), rng.randrange(4), rng.choice(["p", None])) for _ in range(60)]
    target = [(rng.choice("xyz"), rng.randrange(4), rng.choice(["p", None])) for _ in range(50)]
    pairs, lost, extra, got = changes(spark, source, target)
    a, b = Counter(source), Counter(target)
    assert sum(p[3] for p in pairs) + lost == sum((a - b).values()) and sum(p[3] for p in pairs) + extra == sum((b - a).values())
    assert max(Counter(r.source_h for r in got if r.column_name).values(), default=0) <= 1


def test_equal_and_empty(spark):
    assert changes(spark, [("x", 1, "p")], [("x", 1, "p")])[:3] == ([], 0, 0)
    assert changes(spark, [], [])[:3] == ([], 0, 0)
    assert changes(spark, [], [("x", 1, None)])[:3] == ([], 0, 1)
