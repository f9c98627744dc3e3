"""Product codes of vectors in exact integer arithmetic: k-means codebooks for consecutive parts, and codes by their nearest entries.

Nearest entries are found in the domain of the Walsh-Hadamard transform. It multiplies every squared
distance by the padded length, so comparisons stay exact in integers. Squared differences are added
in sequency order; an entry goes as soon as its sum exceeds the whole distance of the entry that led after the first
coefficients. Entries that tie are never dropped early, so the lowest index wins as in a full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.skew import split_join
from ledgerline.llm.staging import stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors compared at a time, and coefficients added between two looks at the sums.
ROWS, STRIDE = 1024, 4
#: Components from here on do not fit the stored integers.
LIMIT = 1 << 62
LONG = (1 << 63) - 1


def hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows in order of their changes of sign."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((np.diff(matrix, axis=1) != 0).sum(axis=1), kind="stable")]


def transform(parts: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two and transformed; squared distances grow by the padded length."""
    width = parts.shape[1]
    size = 1 << max(0, width - 1).bit_length()
    return parts @ hadamard(size)[:, :width].T.astype(parts.dtype)


def exact_type(*arrays: np.ndarray) -> type:
    """int64 where all sums of squares fit into it, else Python's integers."""
    largest = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    width = 1 << max(0, arrays[0].shape[1] - 1).bit_length()
    return np.int64 if 4 * (largest * width) ** 2 <= LONG else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row, ties to the lower index."""
    kind = exact_type(parts, entries)
    x, c = transform(parts.astype(kind)), transform(entries.astype(kind))
    size, c_by_coefficient = x.shape[1], np.ascontiguousarray(c.T)
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), kind)
    for begin in range(0, len(x), ROWS):
        some = x[begin : begin + ROWS]
        by_coefficient = np.ascontiguousarray(some.T)
        sums = np.zeros((len(some), len(c)), kind)
        for k in range(min(STRIDE, size)):
            sums += (by_coefficient[k][:, None] - c_by_coefficient[k][None, :]) ** 2
        bound = ((some - c[np.argmin(sums, axis=1)]) ** 2).sum(axis=1)
        row, entry = np.nonzero(sums <= bound[:, None])
        sums = sums[row, entry]
        for k in range(STRIDE, size):
            sums = sums + (by_coefficient[k][row] - c_by_coefficient[k][entry]) ** 2
            if (k + 1) % STRIDE == 0 or k + 1 == size:
                live = sums <= bound[row]
                row, entry, sums = row[live], entry[live], sums[live]
        # The leader of each row is left at least; rows and entries are in order.
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(sums, first)
        best = np.flatnonzero(sums == least[row])
        best = best[np.r_[True, row[best][1:] != row[best][:-1]]]
        index[begin : begin + len(some)], error[begin : begin + len(some)] = entry[best], least // size
    return index, error


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 x), exactly."""
    if len(values) and np.abs(values).max() >= LIMIT // SCALE:
        raise ValueError(f"components of {LIMIT // SCALE} or more are out of range")
    return np.floor(values * SCALE).astype(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, vec (array of long) of the vectors without null or non-finite components."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = scaled(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["vec_id", "label", "vec"])

    vec = F.col(vector_col)
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec")).filter(F.col("vec").isNotNull() & ~odd)
    types = dict(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label")).dtypes)
    return rows.mapInArrow(convert, f"vec_id {types['vec_id']}, label {types['label']}, vec array<bigint>")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, those shorter than others padded with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _sums(codebooks: list[np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each task: part, entry, position, how many of its parts are nearest to the entry, and their sum there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_width = width // len(codebooks)
        totals = [np.zeros((len(c), part_width), object) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        for b in batches:
            matrix = _matrix(b.column(0), width)
            for p, entries in enumerate(codebooks):
                own = matrix[:, p * part_width : (p + 1) * part_width]
                index, _ = nearest(own, entries)
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                # Sums of a batch fit 64 bits or are added as Python's integers.
                fits = own.size == 0 or int(np.abs(own).max()) * len(own) <= LONG
                totals[p][used] += np.add.reduceat(own[order] if fits else own[order].astype(object), first, axis=0).astype(object)
                counts[p] += np.bincount(index, minlength=len(entries))
        for p in range(len(codebooks)):
            used = np.flatnonzero(counts[p])
            entry, position = np.repeat(used, part_width), np.tile(np.arange(part_width), len(used))
            texts = [str(v) for v in totals[p][used].ravel()]
            columns = [pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(position.astype(np.int32)), pa.array(np.repeat(counts[p][used], part_width)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "n", "total"])

    return run


def codebooks_of(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, from the stored rows of ``integer_vectors``; at most ``entries`` vectors come to the driver."""
    if entries > 256:
        raise ValueError("an index is a byte: 256 entries at most")
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    begin = _matrix(pa.array([r.vec for r in first], pa.list_(pa.int64())), width)
    books = [part.copy() for part in np.split(begin, parts, axis=1)]
    for _ in range(rounds if len(begin) and width else 0):
        sums = rows.select("vec").mapInArrow(_sums(books, width), "part int, entry int, position int, n bigint, total string")
        sums = sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        # As many rows as the codebooks have components.
        found = sums.select("part", "entry", "position", "n", F.col("total").cast("string")).toArrow()
        for p, entry, position, n, total in zip(*[c.to_pylist() for c in found.columns], strict=True):
            books[p][entry, position] = int(total) // n
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (indexes of the nearest entries as bytes) and error (squared distance to them; null where it exceeds a long)."""
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix = _matrix(b.column(2), width)
            found = [nearest(part, book) for part, book in zip(np.split(matrix, len(books), axis=1), books, strict=True)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = sum(e.astype(object) for _, e in found)
            error = pa.array([int(e) if e <= LONG else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), error], names=["vec_id", "label", "code", "error"])

    types = dict(rows.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code binary, error bigint"
    if width == 0:
        return rows.select("vec_id", "label", F.lit(bytes(len(books))).alias("code"), F.lit(0).cast("bigint").alias("error"))
    return rows.select("vec_id", "label", "vec").mapInArrow(run, schema)


def decode(code: Column, books: list[np.ndarray]) -> Column:
    """The vector of integers that a code stands for."""
    parts = []
    for p, book in enumerate(books):
        entries = F.array(*[F.array(*[F.lit(int(v)) for v in entry]) for entry in book])
        parts.append(F.element_at(entries, F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int") + 1))
    return F.concat(*parts)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each vector kept: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or have null, NaN or infinite components are dropped. Components are floor(1024 x); those of 2^52 or
    more raise an error. Vectors are expected to be of one length; shorter ones are padded with zeros at their end, and
    all are up to a multiple of ``parts``; so an empty vector is all zeros, and nothing else is dropped. The first codebooks are the
    vectors with the smallest vec_ids; repeated ids are ordered by their vector, null ids come last; with fewer vectors than
    ``entries``, codebooks are as small. Repeated rows count each. Null labels are one label. An error that exceeds a long is null
    and left out of label_error. Tables without rows give none. Other columns are ignored, whatever their names.
    """
    rows = stage(integer_vectors(vectors, id_col, vector_col, label_col), "codes-vectors")
    books = codebooks_of(rows, parts, entries, rounds)
    coded = stage(encode(rows, books), "codes").withColumn("_label", F.struct("label"))
    errors = stage(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels")
    both = split_join(coded, errors, "_label", coded.count())
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
