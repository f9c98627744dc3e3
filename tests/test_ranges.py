"""Digests of key ranges with borders from the source."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ranges

SCHEMA = "a string, b int, v string"


def brute(source, target, chunk_rows):
    def order(r):
        return tuple((x is not None, x if x is not None else 0) for x in r[:2])

    keys = sorted(map(order, source))
    cuts = {keys[p]: p // chunk_rows for p in range(chunk_rows, len(keys), chunk_rows)}
    borders = sorted(cuts)
    found = {}
    for side, rows in enumerate((source, target)):
        for r in rows:
            at = bisect.bisect_right(borders, order(r))
            found.setdefault(cuts[borders[at - 1]] if at else 0, ([], []))[side].append(r)
    return sorted((c, len(a), len(b)) for c, (a, b) in found.items() if sorted(map(repr, a)) != sorted(map(repr, b)))


def diff(spark, source, target, chunk_rows, **options):
    a, b = (spark.createDataFrame(rows, SCHEMA) for rows in (source, target))
    got = ranges.range_checksum_diff(a, b, ["a", "b"], chunk_rows, **options).collect()
    return sorted((r.chunk, r.source_rows, r.target_rows) for r in got)


def rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["é", "a", "b", "B", "", None]), rng.choice([None, *range(40)]), str(k % 7)) for k in range(n)]


@pytest.mark.parametrize("fan_out", [2, 3, 256])
def test_composite_keys_with_nulls_and_repeats(spark, fan_out):
    source = rows(300, 1)
    target = source[5:] + [("zz", 1, "new"), (None, None, "new")] + source[100:103]
    target[50] = (*target[50][:2], "other")
    assert diff(spark, source, target, 10, fan_out=fan_out) == brute(source, target, 10)


def test_one_row_more_in_front_marks_one_chunk(spark):
    source = [("k", k, "v") for k in range(1000)]
    assert diff(spark, source, [("j", 0, "v"), *source], 50, fan_out=4) == [(0, 50, 51)]
    assert diff(spark, source, [*source, ("l", 0, "v")], 50, fan_out=4) == [(19, 50, 51)]
    assert diff(spark, source, source[::-1], 50) == []


def test_hot_key_and_empty_sides(spark):
    source = [("hot", 1, str(k)) for k in range(200)] + rows(50, 2)
    target = [*source[1:]]
    assert diff(spark, source, target, 20, fan_out=3) == brute(source, target, 20)
    assert diff(spark, [], [], 10) == []
    assert diff(spark, [], source, 10) == [(0, 0, 250)]
    assert diff(spark, source, [], 300) == [(0, 250, 0)]


def test_names_and_types_of_the_target_may_differ(spark):
    a = spark.createDataFrame([(k, "x") for k in range(100)], "Id bigint, v string")
    b = spark.createDataFrame([(k, "x" if k != 55 else "y") for k in range(100)], "ID int, v string")
    got = ranges.range_checksum_diff(a, b, ["Id"], 10, fan_out=2).collect()
    assert [(r.chunk, r.source_rows, r.target_rows, r.lo.Id) for r in got] == [(5, 10, 10, 50)]


def test_only_nodes_that_differ_are_descended(spark, monkeypatch):
    seen = []
    compared = ranges._compared
    monkeypatch.setattr(ranges, "_compared", lambda r: seen.append(r.count()) or compared(r))
    source = [("k", k, "v") for k in range(1000)]
    target = [("k", k, "v" if k != 500 else "w") for k in range(1000)]
    assert diff(spark, source, target, 10, fan_out=10) == [(50, 10, 10)]
    assert seen == [2000, 200]
    seen.clear()
    diff(spark, source, source, 10, fan_out=10)
    assert seen == [2000]


def test_large_border_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("ledgerline.operators.skew.BROADCAST_BYTES", -1)
    source = rows(200, 3)
    target = source[7:]
    assert diff(spark, source, target, 10, fan_out=4) == brute(source, target, 10)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9])
def test_binary_search(spark, n):
    borders = [2 * k for k in range(n)]
    got = spark.range(-1, 2 * n + 1).select("id", ranges.borders_until(F.array(*map(F.lit, borders)) if n else F.array().cast("array<int>"), F.col("id"), 9).alias("at")).collect()
    assert all(r.at == bisect.bisect_right(borders, r.id) for r in got)
