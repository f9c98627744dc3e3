import random
import re
from itertools import combinations

import pytest

from ledgerline.llm import near_dedup
from ledgerline.llm.components import components
from ledgerline.llm.exact_dedup import LOWER, UPPER
from ledgerline.llm.staging import read

SCHEMA = "doc_id long, text string, key string, n string, digest string"


def shingles(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def brute(texts, words=3, percent=85):
    sets = {k: shingles(t, words) for k, t in texts.items()}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {k: (len(sets[k]), top(k), top(k) == k) for k in texts}


def check(spark, texts, words=3, percent=85):
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in texts.items()], SCHEMA)
    got = near_dedup.near_duplicates(docs, words=words, percent=percent).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts, words, percent)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_given_documents(spark, data):
    check(spark, {r.doc_id: r.text for r in read(spark, data, "documents").collect()})


@pytest.mark.parametrize("hot,block,size", [(64, 150_000, 1 << 24), (3, 900, 0)])
def test_groups_passages_and_chains(spark, monkeypatch, hot, block, size):
    """Small limits send the same rows through hot lists, several blocks and joins that are shuffled."""
    from ledgerline.llm import skew

    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", size)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", size)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(70)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    texts = {k: edited(rng, base, rng.randrange(6)) for k in range(60)}
    texts |= {100 + k: " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(3, 80))]) for k in range(80)}
    long = [rng.choice(vocabulary) for _ in range(600)]
    texts |= {200 + k: edited(rng, long, 8 * (k % 3)) for k in range(12)}
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for k in range(15):
        texts[300 + k] = " ".join(chain)
        chain = chain[2:] + [rng.choice(vocabulary), rng.choice(vocabulary)]
    texts |= {400: None, 401: "", 402: " \n\t", 403: "one", 404: "ONE", 405: "one two", 406: "one two three", 407: "a b c d e f g h", 408: "a b c d e f g h i"}
    texts |= {500 + k: " ".join(passage) for k in range(20)} | {530: " ".join(base), 531: " ".join(base).upper() + "  "}
    check(spark, texts)


def test_five_words(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(999)}" for _ in range(200)]
    check(spark, {k: edited(rng, base, k % 9) for k in range(30)}, words=5, percent=80)


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text, "", "", ""), (5, text + " x", "", "", ""), (5, text + " x", "", "", ""), (7, text, "", "", ""), (None, "alone here", "", "", ""), (9, "z " * 200_000, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (9, 9, True)], key=repr)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([None, 5, 9], key=repr)
    # One id over texts of two components, and a component whose ids are all null.
    other, third = (" ".join(f"{c}{k}" for k in range(40)) for c in "vu")
    rows = [(5, text, "a", "", ""), (4, text + " x", "b", "", ""), (5, other, "c", "", ""), (None, third, "d", "", ""), (None, third + " x", "e", "", ""), (None, "", "f", "", ""), (None, None, "g", "", "")]
    left = {r.key for r in near_dedup.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {"b", "c", "f", "g"} <= left and len(left & {"d", "e"}) == 1 and len(left) == 5


def test_a_large_group_and_what_lies_beside_it(spark, monkeypatch):
    """A group over many blocks: the rest of its cluster is found by the second round."""
    monkeypatch.setattr(near_dedup, "BLOCK", 500)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    texts = {k: edited(rng, base, rng.randrange(7)) for k in range(150)}
    chain = list(base)
    for k in range(200, 240):
        chain = chain[1:] + [f"w{rng.randrange(5000)}"]
        texts[k] = " ".join(chain)
    check(spark, texts)


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(1000, k) for k in range(500, 600)] + [(7, 7), (2000, 2000), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 500 for k in [*range(500, 600), 1000]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
