"""Updates that move rows: events and rows are worked out a fixed number of times."""

from pyspark.sql import functions as F

from ledgerline.streaming import changes as ch


def test_moved_rows_read_their_events_three_times(spark):
    n, seen = 200, spark.sparkContext.accumulator(0)

    def look(key):
        seen.add(1)
        return key

    base = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v")).repartition(2)
    text = F.col("id").cast("string")
    events = spark.range(n).select(
        (-F.col("id")).alias("lsn"), F.lit(0).alias("ordinal"), F.lit("update").alias("kind"), F.create_map(F.lit("k"), F.udf(look, "string")(text)).alias("key"),
        F.create_map(F.lit("k"), (F.col("id") + 1).cast("string")).alias("new"), F.array(F.lit("k")).alias("set_cols"),
    )
    got = ch.apply_changes(base, events, ["k"]).collect()
    assert sorted((r.k, r.v) for r in got) == [(k + 1, str(k % 7)) for k in range(n)]
    # What the feed holds, the keys that moves touch, and the fold.
    assert seen.value <= 3 * n
    # The first link of a chain and its last have one root.
    links = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (9, 9)], "id bigint, parent bigint")
    assert sorted(map(tuple, ch._origins(links).collect())) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (9, 9)]
