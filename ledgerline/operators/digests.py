"""Row hashes as tables: counts, digests of tables, buckets and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.hashing import column_texts, half_bucket, hash_bucket, hash_halves, hashable_columns, text_columns, texts_hash
from ledgerline.functions.md5_state import Md5
from ledgerline.operators.chunks import position_chunks
from ledgerline.session import stored

#: Hashes that one task takes for an exact digest, about.
PART_ROWS = 1_000_000


def hashed(df: DataFrame, other: DataFrame | None = None, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The columns ``keep`` and ``h``, the row hash over the columns that both sides can hash."""
    names = hashable_columns(df, other, exclude=options.pop("exclude", ()), float_digits=options.get("float_digits"))
    style = options.pop("style", "safe")
    # Columns of their own, as an expression that is used twice is not merged into the next projection, and so is worked out once.
    texts = {f"_text_{k}": text for k, text in enumerate(column_texts(df, names, text_columns(df, other), **options))}
    staged = df.select(*keep, *[text.alias(c) for c, text in texts.items()])
    return staged.select(*keep, texts_hash([F.col(c) for c in texts], style).alias("h"))


def hash_counts(df: DataFrame, **options) -> DataFrame:
    """h and n: how many rows have each hash."""
    return hashed(df, **options).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def list_digest(h: Column) -> Column:
    """MD5 of sorted hashes joined by commas."""
    return F.md5(F.array_join(F.sort_array(F.collect_list(h)), ","))


def sums_line(bucket: str = "bucket") -> Column:
    """Text of a bucket's count and order-free sums, ``bucket:n:s1:s2:s3``, where n is n_rows or n."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in (bucket, "n", "s1", "s2", "s3")])


def hash_sums(*halves: Column) -> list[Column]:
    """Count, and sums of the hex digits 1 to 15, 16 to 30 and 31 to 32, as aggregates over the hashes h, or over their ``hash_halves`` where a projection has worked them out.

    The long ones are summed as two halves of 30 bits, which are plain integers up to 2^33 rows; decimals take several times as long.
    """
    hi, lo = halves or hash_halves("h")
    mask = (1 << 30) - 1
    digits = [
        (F.shiftrightunsigned(hi, 34), F.shiftrightunsigned(hi, 4).bitwiseAND(mask)),
        (F.shiftleft(hi.bitwiseAND(15), 26).bitwiseOR(F.shiftrightunsigned(lo, 38)), F.shiftrightunsigned(lo, 8).bitwiseAND(mask)),
    ]
    sums = [F.count(F.lit(1)).alias("n")]
    for k, (high, low) in enumerate(digits):
        sums.append((F.sum(high).cast("decimal(19,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.sum(low)).cast("decimal(30,0)").alias(f"s{k + 1}"))
    return [*sums, F.sum(lo.bitwiseAND(255)).cast("decimal(30,0)").alias("s3")]


def bucket_sums(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, n, s1, s2, s3 of the hashes h: each is read as two integers once, for its bucket and its sums."""
    return rows.select(*hash_halves("h")).groupBy(half_bucket("hi", buckets).alias("bucket")).agg(*hash_sums(F.col("hi"), F.col("lo")))


def _continued(state: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The state of an MD5 after the sorted hashes of one part, each n times, that were joined by commas to those before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = Md5(state)
        pieces = (f",{h}" * min(left, 1000) for b in batches for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for left in range(n, 0, -1000))
        while text := "".join(islice(pieces, 1000)):
            md5.update(text[md5.empty :].encode())
        yield pa.RecordBatch.from_pydict({"state": pa.array([md5.state], pa.binary())})

    return run


def chained_digest(rows: DataFrame, n_rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """n_rows and digest, the ``list_digest`` of the hashes h, of any number of rows.

    Equal hashes are counted together, and lie in parts by their first bits, which are spread evenly. MD5 takes its text in order, so the parts come one
    after the other, each in a task of its own that goes on from the state, 92 bytes, in which the one before left it.
    """
    bits = ((max(n_rows, 1) - 1) // part_rows).bit_length()
    first = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    parts = stored(counts.withColumn("part", F.shiftright(first, 32 - bits)).repartition(1 << bits, "part"), by=["part"])
    md5 = Md5()
    for part in range(1 << bits):
        one = parts.filter(F.col("part") == part).select("h", "n").coalesce(1).sortWithinPartitions("h")
        left = one.mapInArrow(_continued(md5.state), "state binary").first()
        # Without any file there is no task.
        md5 = Md5(bytes(left["state"])) if left else md5
    return rows.sparkSession.createDataFrame([(n_rows, md5.hexdigest())], "n_rows bigint, digest string")


def table_digest(df: DataFrame, exact: bool = False, buckets: int = 4096, part_rows: int = PART_ROWS, **options) -> DataFrame:
    """One row: n_rows and digest. Equal tables, as multisets of rows, have equal digests.

    Two levels: counts and order-free sums of the hashes per bucket, then MD5 over the buckets in their
    order, so that a task sends no more than one row for each bucket. exact: MD5 of all sorted hashes, in one
    array up to ``part_rows`` rows, else part by part (``chained_digest``).
    """
    rows = hashed(df, **options)
    if exact:
        n_rows = df.count()
        if n_rows > part_rows:
            return chained_digest(rows, n_rows, part_rows)
        return rows.agg(F.count(F.lit(1)).alias("n_rows"), list_digest(F.col("h")).alias("digest"))
    return digest_of(bucket_sums(rows, buckets))


def digest_sums(df: DataFrame, buckets: int = 4096, **options) -> DataFrame:
    """bucket, n, s1, s2, s3: what ``table_digest`` is made of. Sums of two tables add up to those of both together."""
    return bucket_sums(hashed(df, **options), buckets)


def digest_of(parts: DataFrame) -> DataFrame:
    """One row, n_rows and digest, from the sums of all buckets."""
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", sums_line().alias("line")))), lambda x: x["line"]), ",")).alias("digest"),
    )


def bucket_digests(df: DataFrame, buckets: int = 100, exact: bool = False, **options) -> DataFrame:
    """bucket, n_rows, digest for each hash bucket: MD5 of order-free sums, or with ``exact`` of the sorted hashes, which then fill one array a bucket."""
    if not exact:
        sums = bucket_sums(hashed(df, **options), buckets)
        return sums.select("bucket", F.col("n").alias("n_rows"), F.md5(sums_line()).alias("digest"))
    return hashed(df, **options).groupBy(hash_bucket("h", buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), list_digest(F.col("h")).alias("digest"))


def chunk_digests(df: DataFrame, keys: list[str], chunk_rows: int = 50_000, **options) -> DataFrame:
    """chunk, n_rows, digest for chunks of ``chunk_rows`` rows in the order of the keys."""
    rows = position_chunks(hashed(df, keep=tuple(keys), **options), [*keys, "h"], chunk_rows)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), list_digest(F.col("h")).alias("digest"))


def placed_hashes(df: DataFrame, keys: list[str], chunk_rows: int = 50_000, **options) -> DataFrame:
    """hi, lo and chunk of every row, stored, for the chunks of ``chunk_digests``.

    Rows are hashed once: what is ranged, sampled and stored again holds the keys and two integers. Their order without signs is that of the hashes.
    """
    order = [F.col(half).bitwiseXOR(F.lit(-1 << 63)) for half in ("hi", "lo")]
    names = [f"_key_{k}" for k in range(len(keys))]
    rows = stored(hashed(df, keep=tuple(keys), **options).select(*[F.col(key).alias(name) for key, name in zip(keys, names)], *hash_halves("h")))
    return position_chunks(rows, [*names, *order], chunk_rows).select("hi", "lo", "chunk")


def chunk_sums(rows: DataFrame) -> DataFrame:
    """chunk, n, s1, s2, s3 of ``placed_hashes``: sums combine before the exchange, where sorted hashes would all be sent and listed."""
    return rows.groupBy("chunk").agg(*hash_sums(F.col("hi"), F.col("lo")))
