"""Near-duplicate classes from bottom-k sketches of one hash function.

1. Each text becomes the set of its distinct word shingles, hashed to 64 bits; the KEEP smallest hashes
   are its sketch. Texts with one and the same set form a class; from here on each class counts once.
2. Values that more than HOT classes retain are hot (frequent passages, large groups of copies). The
   first INDEXED cold values of a sketch enter inverted lists, whose length is at most HOT. Classes that
   meet in a list and have like set sizes are compared by the sketch of their union.
3. Classes whose sketches are mainly hot would be missed by that. Those, and only those, are also put
   together by their hot values, each with the smallest class of the list, not pair by pair.
4. What so hangs together is a cluster. Clusters, ordered by set size, are cut into blocks, which are compared
   exactly on full sets; a block pair returns a spanning forest of its links, so its rows never exceed the
   classes in it. First each block meets itself and the leading block of its range of sizes. Of a cluster of
   several blocks, what then is not in its largest component, and only that, meets all other blocks whose
   sizes admit a link; so a large group of near copies takes time in proportion to its size.
5. The links' connected components are the result.

Two linked sets differ in at most 15 of 100 elements of their union. They are missed only if too few
indexed values are common for the estimate (3 or less of 16), which for the least similar linked sets has
a probability of about 1e-8, and at a similarity of 0.8 of about 2e-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.batches import texts, utf8
from ledgerline.llm.components import components
from ledgerline.llm.skew import BROADCAST_BYTES, PARTS, small, split_join, stored_bytes
from ledgerline.llm.staging import stage

#: Words of a shingle and the least similarity, in hundredths, of a link.
WORDS, PERCENT = 3, 85
#: Values in a sketch; cold (and hot) values of it that are indexed; length of a list from which its value is hot.
KEEP, INDEXED, HOT = 32, 16, 64
#: Share of a sketch that must be cold for its cold values to suffice, and share of common values that makes a candidate.
COLD_ENOUGH, COMMON = 0.625, 0.25
#: Set elements in a block of exact comparisons.
BLOCK = 150_000
#: Bytes of text that are shingled at a time.
PART = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ``data`` are bytes of the texts, each from its start on."""
    data = LOWER[data]
    n = len(data)
    if not n:
        return [np.zeros(0, np.int64)] * (len(starts) - 1)
    power, inverse = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power, dtype=_U)])
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    letter = ~SPACE[data]
    first = np.flatnonzero(letter & (np.r_[True, ~letter[:-1]] | edge[:-1]))
    last = np.flatnonzero(letter & (np.r_[~letter[1:], True] | edge[1:])) + 1
    word = _mix((total[last] - total[first]) * inverse[first])
    bounds = np.searchsorted(first, starts)
    odd = [_mix(np.array([k + 1], _U))[0] | _U(1) for k in range(words)]
    padded = np.concatenate([word, np.zeros(words, _U)])
    joined = _mix(sum((padded[k : k + len(word)] * odd[k] for k in range(words)), np.zeros(len(word), _U))).view(np.int64)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(joined[lo : hi - words + 1]))
        elif hi > lo:
            own = np.zeros(1, _U)
            for k in range(hi - lo):
                own = own + word[lo + k : lo + k + 1] * odd[k]
            out.append(_mix(own).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    data, starts = utf8(texts(column))
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PART, "right")) - 1)
        yield from shingle_sets(data[starts[at] : starts[to]], starts[at : to + 1] - starts[at], words)
        at = to


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, key (hash of the text), n (size of the set), digest (of the set) and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, kept = [], [], []
            for s in sets_of(batch.column(2), words):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                kept.append(s[:KEEP])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "digest", "sketch"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, key bigint, n bigint, digest binary, sketch array<bigint>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def candidates(marked: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of classes whose indexed cold values say they may be linked, each pair once."""
    rows = marked.select("node", "n", F.slice("cold", 1, INDEXED).alias("own")).filter("size(own) > 0")
    rows = rows.select(F.explode("own").alias("value"), "node", "n", "own").repartition("value").sortWithinPartitions("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            value = table.column(0).to_numpy()
            rest = table.slice(int(np.searchsorted(value, value[-1]))) if len(value) else rest
            yield from _pairs(table, value)

    def _pairs(table: pa.RecordBatch, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, size, own = table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(3)
        filled = np.diff(own.offsets.to_numpy())
        matrix = np.full((len(value), INDEXED), np.iinfo(np.int64).max)
        matrix[np.repeat(np.arange(len(value)), filled), np.concatenate([np.arange(k) for k in filled.tolist()] or [np.zeros(0, np.int64)])] = own.flatten().to_numpy()
        for d in range(1, HOT + 1):
            left = np.flatnonzero(value[:-d] == value[d:]) if d < len(value) else np.zeros(0, np.int64)
            if not len(left):
                return
            right = left + d
            low, high = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
            alike = (100 * low >= percent * high) & (node[left] != node[right])
            left, right = left[alike], right[alike]
            for at in range(0, len(left), 50_000):
                i, j = left[at : at + 50_000], right[at : at + 50_000]
                both = np.sort(np.concatenate([matrix[i], matrix[j]], axis=1), axis=1)
                common = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.iinfo(np.int64).max)
                # The lists' first common value emits the pair; the others know it does.
                here = both[np.arange(len(i)), common.argmax(1)] == value[i]
                least = np.minimum(filled[i], filled[j])
                rank = np.arange(both.shape[1] - 1) - np.cumsum(common, axis=1) + common
                shared = (common & (rank < least[:, None])).sum(1)
                good = here & (shared >= np.maximum(1, np.ceil(COMMON * least)))
                i, j = i[good], j[good]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def hot_stars(marked: DataFrame, total: int) -> DataFrame:
    """Edges a, b from each class that is mainly hot to the smallest such class of each of its hot values; ``total``: rows with hot values, or more."""
    rows = marked.filter(F.size("cold") < COLD_ENOUGH * (F.size("cold") + F.size("hot"))).select("node", F.explode(F.slice("hot", 1, INDEXED)).alias("value"))
    least = rows.groupBy("value").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n"))
    return split_join(rows, least, "value", total).select(F.col("node").alias("a"), "b")


def blocked(members: DataFrame, label: str) -> DataFrame:
    """Stored classes of clusters (root, node, n, ...) with the block each is in.

    Members are range-sorted by cluster and size, and neighbours with BLOCK set elements in all form a
    block.
    """
    ordered = members.repartitionByRange("root", "n", "node").sortWithinPartitions("root", "n", "node").withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, T.StructField("upto", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            ends = total + np.cumsum(batch.column(batch.schema.get_field_index("n")).to_numpy())
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.int64())], [*batch.schema.names, "upto"])

    # Blocks run on from one partition to the next, so their number does not depend on the partitions'.
    counted = stage(ordered.mapInArrow(run, schema), f"{label}-counted")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.groupBy("part").agg(F.sum("n").alias("elements")).select("part", F.coalesce(F.sum("elements").over(earlier), F.lit(0)).alias("base"))
    block = F.floor((F.col("base") + F.col("upto")) / BLOCK).cast("long")
    return stage(counted.join(F.broadcast(bases), "part").withColumn("block", block).drop("part", "upto", "base"), label)


def _bounds(rows: DataFrame, percent: int) -> DataFrame:
    """root, block, sizes (low, high) and band of each block of a cluster; sizes of one band may be linked with its own and the next band's."""
    step = math.log(100 / percent)
    return rows.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")).withColumn("band", F.floor(F.log("low") / F.lit(step)).cast("long"))


def _tasks(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both sides for each pair (root, i, j): blocks i of the left, j of the right."""
    a = left.join(pairs.withColumn("block", F.col("i")), ["root", "block"]).withColumn("side", F.lit(0))
    b = right.join(pairs.withColumn("block", F.col("j")), ["root", "block"]).withColumn("side", F.lit(1))
    return a.unionByName(b).drop("block")


def first_tasks(rows: DataFrame, percent: int) -> DataFrame:
    """Each block against itself, and against the leading blocks of its own band of sizes and of the band below."""
    parts = _bounds(rows, percent)
    leaders = parts.groupBy("root", "band").agg(F.min("block").alias("i"))
    near = parts.select("root", F.col("block").alias("j"), F.explode(F.array("band", F.col("band") - 1)).alias("band")).join(leaders, ["root", "band"])
    pairs = near.filter("i < j").select("root", "i", "j").distinct()
    own = rows.withColumn("i", F.col("block")).withColumn("j", F.col("block")).withColumn("side", F.lit(0)).drop("block")
    return own.unionByName(_tasks(rows, rows, stage(pairs, "leader-pairs")))


def rest_of(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of clusters of several blocks that are not in their cluster's largest component so far (node, root)."""
    placed = rows.join(roots.withColumnRenamed("root", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("root", "component").agg(F.count(F.lit(1)).alias("size"), F.min("block").alias("low"), F.max("block").alias("high"))
    largest = sizes.groupBy("root").agg(
        F.sum("size").alias("n"), F.max_by("component", F.struct("size", "component")).alias("largest"), (F.min("low") < F.max("high")).alias("several")
    )
    judged = split_join(placed, largest.filter("several"), "root", rows.count())
    return judged.filter("component <> largest").drop("component", "largest", "several", "block")


def rest_tasks(rows: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Blocks of ``rest`` against all blocks of their cluster whose sizes admit a link."""
    a, b = _bounds(rest, percent), _bounds(rows, percent)
    a = a.select("root", F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    b = b.select("root", F.col("block").alias("j"), "low", "high")
    alike = (100 * F.col("high") >= percent * F.col("low_i")) & (100 * F.col("high_i") >= percent * F.col("low"))
    return _tasks(rest, rows, stage(a.join(b, "root").filter(alike).select("root", "i", "j"), "rest-pairs"))


def with_sets(docs: DataFrame, tasks: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """i, j, side, root, node and set (bytes) of each row of ``tasks``, from the text that stands for the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            new = []
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if row not in seen:
                    seen.add(row)
                    new.append(k)
            batch = batch.take(pa.array(new, pa.int64()))
            sets = [s.tobytes() for s in sets_of(batch.column(5), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.binary())], ["i", "j", "side", "root", "node", "set"])

    tasks = small(stage(tasks.withColumnRenamed("doc_id", "rep_id").withColumnRenamed("key", "rep_key"), "tasks"))
    rows = keyed(docs, id_col, text_col).join(tasks, (F.col("key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    return rows.select("i", "j", "side", "root", "node", "text").mapInArrow(run, "i bigint, j bigint, side int, root bigint, node bigint, set binary")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning forests, one for each block pair, of the exact links between its classes."""

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        side, root, node, blobs = (table.column(c).to_pylist() for c in ("side", "root", "node", "set"))
        rows = {}
        for k, key in enumerate(zip(side, node)):
            rows.setdefault(key, k)
        rows = sorted(rows.values(), key=lambda k: (root[k], side[k], node[k]))
        parent = {k: k for k in rows}

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and root[rows[to]] == root[rows[at]]:
                to += 1
            own = rows[at:to]
            at = to
            if len(own) < 2:
                continue
            sets = [np.frombuffer(blobs[k], np.int64) for k in own]
            sizes = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            sides = np.array([side[k] for k in own])
            across = sides.any()
            for x, s in enumerate(sets):
                if across and sides[x]:
                    continue
                lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
                counts = hi - lo
                spots = np.repeat(hi - np.cumsum(counts), counts) + np.arange(counts.sum())
                shared = np.bincount(owner[spots], minlength=len(own))
                linked = 100 * shared >= percent * (sizes + sizes[x] - shared)
                linked &= sides == 1 if across else np.arange(len(own)) > x
                for y in np.flatnonzero(linked & (sizes > 0)).tolist():
                    p, q = top(own[x]), top(own[y])
                    if p != q:
                        parent[p] = q
                        found.append((node[own[x]], node[own[y]]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return sets.groupBy("i", "j").applyInArrow(run, "a bigint, b bigint")


def _flagged(able: DataFrame, hot: DataFrame, total: int) -> DataFrame:
    """node, n and value of ``able``, with is_hot where the value is in the stored table ``hot``, whose classes sum to ``total``."""
    if stored_bytes(hot) <= BROADCAST_BYTES:
        return able.join(F.broadcast(hot.select("value", "is_hot")), "value", "left")
    found = split_join(able, hot.withColumnRenamed("classes", "n"), "value", total)
    # What is not hot occurs HOT times at most, so this join has no hot key.
    very = hot.filter(F.col("classes") > max(1, total // PARTS)).select("value")
    rest = able.join(F.broadcast(very), "value", "left_anti").join(hot.select("value"), "value", "left_anti")
    return found.unionByName(rest.withColumn("is_hot", F.lit(None).cast("boolean")))


def _resolved(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored sketches of all rows; and digest, root and component_id of each set that is not empty, with the number of its rows (n)."""
    rows = stage(sketches(docs, id_col, text_col, words).withColumn("row", F.monotonically_increasing_id()), "sketches")
    full = rows.filter("n > 0")
    classes = stage(
        full.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.min_by(F.struct("doc_id", "key", "n", "sketch"), "row").alias("rep"), F.count(F.lit(1)).alias("copies")).select(
            "digest", "node", "least_id", "copies", "rep.*"
        ),
        "classes",
    )
    # Different sets with fewer elements than this have no link.
    able = classes.filter(F.col("n") * (100 - percent) >= percent).select("node", "n", F.explode("sketch").alias("value"))
    hot = stage(able.groupBy("value").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") > HOT).withColumn("is_hot", F.lit(True)), "hot")
    total = hot.agg(F.coalesce(F.sum("classes"), F.lit(0))).first()[0]
    marked = stage(
        _flagged(able, hot, total)
        .groupBy("node", "n")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("is_hot").isNull(), F.col("value")))).alias("cold"),
            F.sort_array(F.collect_list(F.when(F.col("is_hot"), F.col("value")))).alias("hot"),
        ),
        "marked",
    )
    clusters = components(candidates(marked, percent).unionByName(hot_stars(marked, total)))
    members = blocked(clusters.join(classes.select("node", "n", "doc_id", "key"), "node"), "blocks")
    edges = stage(links(with_sets(docs, first_tasks(members, percent), id_col, text_col, words), percent), "links")
    roots = components(edges)
    rest = rest_of(members, roots)
    if not rest.isEmpty():
        rest = blocked(rest, "rest")
        more = stage(links(with_sets(docs, rest_tasks(members, rest, percent), id_col, text_col, words), percent), "rest-links")
        # What is known hangs on its roots already, so the links of the rest are all there is to settle.
        roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    placed = classes.select("digest", "node", "least_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    labels = split_join(placed, least, "root", classes.count()).select("digest", "root", "component_id", F.col("copies").alias("n"))
    return rows, stage(labels, "labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with shingles, with root and component_id; a set that very many rows have is no hot key."""
    full = rows.filter("n > 0").select("doc_id", "key", "digest", F.col("n").alias("n_shingles"))
    return split_join(full, labels, "digest", rows.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id that links reach from the row, its own included; kept says whether
    that is its own. Null and empty texts, and those of white space, have no shingles and are linked with
    nothing. Rows with null ids take part; they never give the id of a component unless all of its ids are
    null, and then it is null. Repeated rows are equal and share their result. Empty tables give no rows;
    other columns are ignored. Texts are shingled whole.
    """
    rows, labels = _resolved(docs, id_col, text_col, words, percent)
    return (
        _labelled(rows, labels).select("doc_id", "n_shingles", "component_id")
        .unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns: that of the smallest id.

    Null ids rank above all others; rows of one id are told apart by the hash of their text, and of rows equal
    in both any one stays. Rows without shingles all stay. Empty tables give no rows, and columns of any
    names may be there. Texts are shingled whole.
    """
    rows, labels = _resolved(docs, id_col, text_col, words, percent)
    found = _labelled(rows, labels).groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    found = stage(found, "found")
    own = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    best = found.groupBy("root").agg(F.min(own).alias("best"), F.count(F.lit(1)).alias("n"))
    judged = split_join(found, best, "root", found.count()).withColumn("stays", own == F.col("best")).filter("copies > 1 OR NOT stays")
    judged = stage(judged.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "stays"), "judged")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    left = rows.join(small(judged), same, "left").filter("stays IS NULL OR stays")
    first = Window.partitionBy("id", "key").orderBy("key")
    single = left.filter("stays").withColumn("place", F.row_number().over(first)).filter("place = 1").select("doc.*")
    return left.filter("stays IS NULL").select("doc.*").unionByName(single)
