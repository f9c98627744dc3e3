from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from ledgerline.llm import token_counts
from ledgerline.llm.staging import read

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(lengths):
    out = {}
    for size, n in Counter(lengths).items():
        longer = [x for x in lengths if x >= size]
        out[size] = (n, len(longer), sum(longer), sum(min(x, size) for x in lengths), len(lengths), sum(lengths))
    return out


def check(spark, docs, lengths):
    sums = token_counts.suffix_sums(token_counts.histogram(docs, PATH)).cache()
    got = {r.n_tokens: (r.n_docs, r.docs_from, r.tokens_from, r.truncated_total, r.total_docs, r.total_tokens) for r in sums.collect()}
    assert got == brute(lengths)
    for r in sums.collect():
        assert r.lost_tokens == r.total_tokens - r.truncated_total
        assert abs(r.share_within - sum(x <= r.n_tokens for x in lengths) / len(lengths)) < 1e-12
    for limit in (0, 1, 100, 2048, 10**6):
        assert token_counts.truncated_total(sums, limit).first().tokens == sum(min(x, limit) for x in lengths)
    ordered = sorted(lengths)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        need = next(x for k, x in enumerate(ordered) if (k + 1) / len(ordered) >= r.share and (k + 1 == len(ordered) or ordered[k + 1] > x))
        assert r.n_tokens == next(x for x in ordered if sum(y <= x for y in ordered) / len(ordered) >= r.share) == need


def test_against_brute_force(spark, data):
    docs = read(spark, data, "documents")
    library = Tokenizer.from_file(PATH)
    check(spark, docs, [len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()])


def test_edge_texts(spark):
    rows = [(1, None, "n"), (2, "", "n"), (3, "a b", "n"), (3, "a b", "n"), (None, "c", "n"), (4, "a" + " b" * 5000, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    check(spark, docs, [0, 0, 2, 2, 1, 5001])
    empty = token_counts.suffix_sums(token_counts.histogram(docs.limit(0), PATH))
    assert empty.count() == 0 and token_counts.truncated_total(empty, 5).first().tokens == 0
