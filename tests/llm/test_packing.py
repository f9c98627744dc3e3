import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerline.llm import packing
from ledgerline.llm.staging import read

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check(got, texts, length):
    library = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids, at = ids_of(library, texts[doc_id]), 0
        for r in sorted(own, key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.length == len(part) > 0
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    assert set(sequences) == set(range(len(sequences)))
    for k, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or k == len(sequences) - 1 and 0 < at <= length


def test_given_documents(spark, data):
    docs = read(spark, data, "documents")
    check(packing.pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, 2048)


def test_edge_texts(spark):
    texts = {1: None, 2: "", 3: "one two", None: "null id", 4: "word " * 9000, 5: "x" * 3000, 6: "<|startoftext|> Hi<|endoftext|>"}
    docs = spark.createDataFrame([(k, t, "a", "b") for k, t in texts.items()], "doc_id long, text string, key string, part string")
    check(packing.pack(docs, PATH, length=64).collect(), texts, 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_repeated_rows_all_get_packed(spark):
    docs = spark.createDataFrame([(7, "same text here")] * 500, "doc_id long, text string")
    got = packing.pack(docs, PATH, length=32).collect()
    assert sum(r.length for r in got) == 500 * len(ids_of(Tokenizer.from_file(PATH), "same text here"))


def test_same_ids_as_the_library():
    library, words = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    random.seed(8)
    letters = "ab cdeE'stvm 019²½\t\n\r\x0b\x1c\x85\xa0　éÉé日本語🙂ñߣΣς#%..,!|İıſK​ǅﬁ"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(5000)] + ["<|endoftext|>A", "ΑΣ ΣΑΣ", "it's IT'S 'S"]
    got = [ids.tolist() for ids in words.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_caches_that_start_anew_and_parts_of_any_size(monkeypatch):
    library = Tokenizer.from_file(PATH)
    random.seed(9)
    texts = [" ".join(random.choice(["one", "two,", "thr33", "ünï", "x" * 20, "", "\n", "<|endoftext|>"]) + str(random.randrange(40)) * random.randrange(2) for _ in range(random.randrange(30))) for _ in range(400)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for part, cache in ((1, 10), (200, 60), (1 << 20, 1 << 20)):
        monkeypatch.setattr(packing, "PART", part)
        monkeypatch.setattr(packing, "CACHE", cache)
        assert [ids.tolist() for ids in packing.Encoder(PATH).encode(texts)] == expected


def test_hilbert_is_a_curve():
    """All cells once, and neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()
