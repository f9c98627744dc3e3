import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    width = -(-width // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    w = width // parts

    def cut(v, p):
        return v[p * w : (p + 1) * w]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in ordered] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    found = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in kept]
    totals = defaultdict(int)
    for _, label, n in found:
        totals[label] += sum(d for d, _ in n)
    return sorted(((i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), totals[label], digest) for i, label, n in found), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    got = vector_codes.compress(df, **options).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=repr)


def vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread) for _ in range(width)] for _ in range(n)]


def test_against_brute_force(spark):
    rows = [(k * 7 % 400, v, k % 3 or None) for k, v in enumerate(vectors(400, 20, 1))]
    assert run(spark, rows, entries=24) == brute(rows, entries=24)


def test_nulls_repeats_ties_and_a_hot_label(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, v, 1) for k, v in enumerate(vectors(60, 8, 2, 0.01))]
    rows += [(3, [0.0] * 8, None), (3, [0.0] * 8, None), (None, [0.5] * 8, 2), (None, [-0.5] * 8, None), (70, None, 1), (71, [nan] * 8, 1), (72, [0.0, None] * 4, 1), (73, [inf] + [0.0] * 7, 1), (74, [-inf] + [0.0] * 7, None)]
    # Coarse values tie often.
    rows += [(100 + k, [round(x * 50) / 1024 for x in v], 5) for k, v in enumerate(vectors(60, 8, 3))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, entries=16) == brute(rows, entries=16)


def test_lengths_that_are_no_multiple_and_shorter_vectors(spark):
    rows = [(k, v[: 3 + k % 4], k % 2) for k, v in enumerate(vectors(50, 6, 4))] + [(90, [], 1)]
    assert run(spark, rows, entries=8) == brute(rows, entries=8)


def test_large_components_stay_exact(spark):
    rows = [(k, [x * 2.0**44 for x in v], 0) for k, v in enumerate(vectors(30, 8, 5))]
    got, want = run(spark, rows, entries=8), brute(rows, entries=8)
    assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want]
    assert all(g[2] == (w[2] if w[2] < 1 << 63 else None) for g, w in zip(got, want, strict=True))
    with pytest.raises(Exception, match="out of range"):
        run(spark, [(1, [1e300] * 4, 0)])


def test_empty_tables_and_empty_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []
    assert run(spark, [(1, [], 1)]) == [(1, "00000000", 0, 0, hashlib.sha256(b"").hexdigest())]


def test_decode_gives_the_entries_back(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(40, 8, 6))]
    df = vector_codes.stage(vector_codes.integer_vectors(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)), "test-vectors")
    books = vector_codes.codebooks_of(df, entries=8)
    coded = vector_codes.encode(df, books)
    joined = coded.join(df.select("vec_id", "vec"), "vec_id").select("error", "vec", vector_codes.decode(coded["code"], books).alias("near")).collect()
    assert len(joined) == 40 and all(sum((a - b) ** 2 for a, b in zip(r.vec, r.near, strict=True)) == r.error for r in joined)


@pytest.mark.parametrize("size", [1, 2, 4, 8, 16, 64])
def test_hadamard_rows_are_orthogonal_and_in_sequency_order(size):
    h = vector_codes.hadamard(size)
    assert (h @ h.T == size * np.eye(size, dtype=np.int64)).all()
    assert ((np.diff(h, axis=1) != 0).sum(axis=1) == np.arange(size)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 19), st.integers(1, 30), st.integers(1, 40), st.sampled_from([1, 3, 1000, 1 << 30, 1 << 61]), st.integers(0, 1 << 30))
def test_nearest_equals_a_full_search(width, n, k, spread, seed):
    rng = random.Random(seed)
    x = np.array([[rng.randint(-spread, spread) for _ in range(width)] for _ in range(n)], np.int64)
    c = np.array([[rng.randint(-spread, spread) for _ in range(width)] for _ in range(k)], np.int64)
    index, error = vector_codes.nearest(x, c)
    for row, i, e in zip(x.tolist(), index, error, strict=True):
        assert (int(e), int(i)) == min((sum((a - b) ** 2 for a, b in zip(row, y, strict=True)), j) for j, y in enumerate(c.tolist()))


def test_entries_go_early(monkeypatch):
    """On clustered data most pairs are dropped before their last coefficient."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-1000, 1000, (64, 16))
    x = centres[rng.integers(0, 64, 500)] + rng.integers(-5, 6, (500, 16))
    seen = []
    true = np.nonzero

    def counted(a):
        out = true(a)
        seen.append(len(out[0]))
        return out

    monkeypatch.setattr(vector_codes.np, "nonzero", counted)
    vector_codes.nearest(x, centres)
    assert sum(seen) < 500 * 64 / 10
