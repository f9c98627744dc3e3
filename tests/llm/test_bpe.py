import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import bpe
from ledgerline.llm.staging import read

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    random.seed(5)
    letters = "ab cdeE'stvm 019²½\t\n\r\x0b\x1c\x85\xa0　é日本語🙂ñߣ#%..,!|aaaaaſK​́"
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(n)]


def test_same_ids_as_the_library(library):
    texts = random_texts(5000) + ["<|endoftext|>a<|endoftext|><|endoftext|> b <|endoftext", "", "a" * 5000, "ab" * 3001, " " * 300, "x" * 7 + "\n\n\n  y"]
    words = bpe.Vocabulary(PATH)
    assert list(words.encode(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = [[random.randrange(50257) for _ in range(9)] for _ in range(2000)]
    assert [words.decode(x) for x in ids] == library.decode_batch(ids, skip_special_tokens=False)
    assert words.decode([10**9, -1]) == ""


def test_round_trip_and_operators(spark, data, library):
    docs = read(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.round_trip(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    encoded = bpe.encode(docs.limit(50), PATH)
    for r in bpe.decode(encoded, PATH).collect():
        assert r.text == texts[r.doc_id]


def test_nulls_repeats_long_and_clashing_names(spark):
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "x y", "a", "b"), (3, "x y", "a", "b"), (None, "z", "a", "b"), (4, "word " * 60_000, "a", "b")]
    got = bpe.round_trip(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert len(got) == 6
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (1, 2)} == {(0, empty, empty)}
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_small_cache(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "PART", 200)
    texts = random_texts(500)
    assert list(bpe.Vocabulary(PATH).encode(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
