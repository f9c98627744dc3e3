"""Packing along a space-filling curve.

Each document's token ids become a hashed vector, projected to a few dimensions; its Hilbert key orders
the documents so that neighbours on the curve are alike. The corpus is range-sorted by that key, every
partition counts its tokens, and the running totals of the partitions (one row each) give each document
its place in one long stream. Sequences are cuts of that stream, so only the very last one is padded,
and no partition waits for another.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from ledgerline.llm.batches import texts
from ledgerline.llm.staging import stage

#: Tokens of a full sequence, and the id that ends each document.
LENGTH, END = 2048, 1
#: Hash buckets of a document vector, dimensions it is projected to, bits of the key for each.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 8
#: Code points of text encoded at a time, and parts kept before the cache starts anew.
PART, CACHE = 1 << 22, 800_000

#: Fixed value: how the word-level vocabulary cuts a text, after NFC and lower case, into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Lists:
    """Short lists of integers, one after the other in a flat array that grows by whole batches."""

    def __init__(self, kind: np.dtype) -> None:
        self.flat, self.sizes, self.starts = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements of these lists in order, and how many each has."""
        sizes = self.sizes[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.flat[at], sizes


class Encoder:
    """Ids of texts by the tokenizers library, which sees each different word once per task.

    Texts are cut into parts at spaces, parts into words, and words into ids. Different parts get a number
    by an Arrow dictionary; only parts and words that are new are looked at one by one, and all else is
    gathered from flat arrays.
    """

    def __init__(self, path: str) -> None:
        # The words that reach the library are normalised and cut already: its normaliser and its pattern go.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(WORDS)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: Whether a token ends a word.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[k for t, k in data["model"]["vocab"].items() if t.endswith(data["model"]["end_of_word_suffix"])]] = True
        self.forget()
        rng = np.random.default_rng(7)
        directions = rng.standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
        ids = np.arange(self.tokenizer.get_vocab_size(), dtype=np.uint64)
        self.direction = directions[(ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % BUCKETS]

    def spaced(self, text: str) -> str:
        """A normalised text whose parts, which no word spans, lie between spaces; special tokens are parts of their own."""
        if "<" in text and any(s in text for s in self.special):
            return " ".join(p if p in self.special else self._normal(p) for p in self.cut.split(text))
        return self._normal(text)

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Each letter is lowered by itself; str.lower() would look at what stands around a capital sigma.
        return text.replace("Σ", "σ").lower().replace("\n", " ")

    def forget(self) -> None:
        """Start the caches anew: rows of parts in ``part_words`` (rows of words), and of words in ``word_ids``."""
        self.part_row: dict[str, int] = {}
        self.part_words = Lists(np.dtype(np.int64))
        self.word_row = {p: k for k, p in enumerate(self.special)}
        self.word_ids = Lists(self.kind)
        self.word_ids.add(np.array(list(self.special.values()), np.int64), np.ones(len(self.special), np.int64))

    def learn(self, parts: list[str]) -> np.ndarray:
        """Rows of different parts; the library encodes the words in them that are new."""
        new = [p for p in parts if p not in self.part_row]
        if len(self.part_row) + len(new) > CACHE:
            self.forget()
            new = parts
        words = [[p] if p.isalpha() or p in self.special else self.words.findall(p) for p in new]
        flat = list(chain.from_iterable(words))
        plain = list(dict.fromkeys(w for w in flat if w not in self.word_row))
        if plain:
            (coded,) = self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)
            ids = np.array(coded.ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the vocabulary does not mark the ends of words")
            self.word_row.update(zip(plain, range(len(self.word_row), len(self.word_row) + len(plain))))
            self.word_ids.add(ids, np.diff(ends, prepend=0))
        if new:
            self.part_row.update(zip(new, range(len(self.part_row), len(self.part_row) + len(new))))
            rows = np.fromiter(map(self.word_row.__getitem__, flat), np.int64, len(flat))
            self.part_words.add(rows, np.fromiter(map(len, words), np.int64, len(words)))
        return np.fromiter(map(self.part_row.__getitem__, parts), np.int64, len(parts))

    def encode_flat(self, values: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of runs of texts, one after the other, and how many each text has."""
        at = 0
        while at < len(values):
            cut, size = [], 0
            while at < len(values) and (not cut or size + len(values[at]) <= PART):
                cut.append(self.spaced(values[at]))
                size += len(values[at])
                at += 1
            lists = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
            parts = lists.values.dictionary_encode()
            rows = self.learn(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
            words, per_part = self.part_words.take(rows)
            ids, per_word = self.word_ids.take(words)
            edges = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(per_part)])][lists.offsets.to_numpy()]
            yield ids, np.diff(edges)

    def encode(self, values: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for ids, sizes in self.encode_flat(values):
            yield from np.split(ids, np.cumsum(sizes)[:-1])

    def key(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hilbert key of each document's projected mean vector; documents without ids lie at the middle."""
        point = np.zeros((len(sizes), DIMENSIONS), np.float32)
        full = sizes > 0
        if full.any():
            starts = (np.cumsum(sizes) - sizes)[full]
            point[full] = np.add.reduceat(self.direction[ids], starts, axis=0) / sizes[full, None]
        cells = np.minimum((1 + np.tanh(3 * point)) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
        return hilbert(cells, BITS)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative coordinates below 2**bits (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for axis in x:
            turned = (axis >> b & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(turned, below, swap)
            axis ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> b & 1
    return key


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (with the id that ends a document), key and ids (bytes, without that id) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            at = 0
            for ids, sizes in words.encode_flat(texts(batch.column(1)).to_pylist()):
                edges = np.concatenate([[0], np.cumsum(sizes)]) * words.kind.itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids)])
                columns = [batch.column(0).slice(at, len(sizes)), pa.array(sizes + 1, pa.int64()), pa.array(words.key(ids, sizes), pa.int64()), blobs.cast(pa.binary())]
                at += len(sizes)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "key", "ids"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, key bigint, ids binary")


def along_curve(tokens: DataFrame) -> DataFrame:
    """Documents in the order of the curve, with the tokens before each: part, before, and the columns given.

    Range sorting deals rows of one key over several partitions where there are many of them.
    """
    ordered = tokens.repartitionByRange("key", "row").sortWithinPartitions("key", "row").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            counts = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
            ends = total + np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - counts, pa.int64())], [*batch.schema.names, "before"])

    ordered = ordered.select("doc_id", "n_tokens", "ids", "part")
    sized = stage(ordered.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in ordered.dtypes)}, before bigint"), "curve", "zstd")
    totals = sized.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    return sized.join(F.broadcast(bases), "part").withColumn("before", F.col("base") + F.col("before")).drop("base")


def pack(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with END. Pieces fill sequences of ``length`` ids without gaps; only the last
    sequence of all may be shorter. Null and empty texts are documents of the one id END. Null ids and
    repeated rows are packed like all others. An empty table gives no pieces; other columns are
    ignored. Texts are encoded whole.
    """
    tokens = stage(tokenise(docs, path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens", "zstd")
    kind = encoder(path).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, starts, sizes, sums, totals, sequences, offsets = [], [], [], [], [], [], []
            for k, (before, total, blob) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                ids = np.empty(total, "<u4")
                ids[:-1], ids[-1] = np.frombuffer(blob, kind), END
                start = 0
                while start < total:
                    sequence, offset = divmod(before + start, length)
                    size = min(total - start, length - offset)
                    places.append(k)
                    starts.append(start)
                    sizes.append(size)
                    sums.append(zlib.crc32(ids[start : start + size].tobytes()))
                    totals.append(total)
                    sequences.append(sequence)
                    offsets.append(offset)
                    start += size
            columns = [pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals, sequences, offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places, pa.int64())), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    rows = along_curve(tokens).select("doc_id", "before", "n_tokens", "ids")
    return rows.mapInArrow(
        run,
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
