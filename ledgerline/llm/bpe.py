"""Byte-level BPE encoding and decoding, with batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks all neighbouring pairs up by binary
search over the sorted pair keys, finds the lowest rank of every word, merges the pairs that have it
and drops the words that are done. Words are merged once per task and then kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.batches import texts

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points of text cut into words at a time, and words kept before the cache starts anew.
PART, CACHE = 1 << 20, 400_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    spare = iter(range(0x100, 0x200))
    return letters | {b: chr(next(spare)) for b in range(256) if b not in letters}


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        letters = byte_letters()
        byte_of = {letter: b for b, letter in letters.items()}
        self.bytes_of = [b""] * self.size
        for token, k in ids.items():
            self.bytes_of[k] = bytes(byte_of[c] for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.first = np.array([ids[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.decimal = [str(k) for k in range(self.size)]
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (none of them empty)."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(flat):
            rank = np.full(len(flat), NONE)
            if len(flat) > 1:
                keys = flat[:-1] * self.size + flat[1:]
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                known = (self.keys[at] == keys) & (owner[:-1] == owner[1:])
                rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(flat)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = lowest != NONE
            done.append((owner[~open_], flat[~open_]))
            hit = (rank == lowest)[open_]
            flat, owner, rank = flat[open_], owner[open_], rank[open_]
            if not len(flat):
                break
            # Of hits that overlap (a a a), every second one counts, from the left.
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.repeat(at[run] * 0 + run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            flat[at] = self.merged[rank[at]]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            flat, owner = flat[keep], owner[keep]
        owner = np.concatenate([o for o, _ in done])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        return np.split(np.concatenate([f for _, f in done])[order], np.cumsum(counts)[:-1])

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special tokens stand as words of their own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        return list(chain.from_iterable([part] if part in self.special else self.words.findall(part) for part in self.cut.split(text)))

    def learn(self, words: set[str]) -> None:
        """Put the ids of these words into the cache."""
        new = sorted(w for w in words if w not in self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = sorted(words)
        plain = [w for w in new if w not in self.special]
        if plain:
            self.cache.update(zip(plain, (tuple(x.tolist()) for x in self.merge([w.encode() for w in plain]))))
        self.cache.update({w: (self.special[w],) for w in new if w in self.special})

    def encode(self, values: list[str]) -> Iterator[list[int]]:
        """Token ids of each text."""
        at = 0
        while at < len(values):
            cut, size = [], 0
            while at < len(values) and (not cut or size + len(values[at]) <= PART):
                cut.append(self.pieces(values[at]))
                size += len(values[at])
                at += 1
            self.learn(set().union(*cut))
            look = self.cache.__getitem__
            for words in cut:
                yield list(chain.from_iterable(map(look, words)))

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        look = self.bytes_of
        if ids and not 0 <= min(ids) <= max(ids) < self.size:
            ids = [k for k in ids if 0 <= k < self.size]
        return b"".join(map(look.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text, for the vocabulary file at ``path``.

    Null and empty texts have no ids. Rows with null ids and repeated rows are encoded like all others.
    Empty tables give no rows; other columns are ignored. Special tokens in a text become their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            ids = pa.array(list(words.encode(texts(batch.column(1)).to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            text = [words.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    narrow = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the decoded text).

    The same encoding and decoding as in ``encode`` and ``decode``, with the same rules, digested where
    they are made, so that ids do not travel between Python and the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for ids in words.encode(texts(batch.column(1)).to_pylist()):
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(words.decimal.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(words.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return _narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each row, under the rules of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            counts = [len(ids) for ids in words.encode(texts(batch.column(1)).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
