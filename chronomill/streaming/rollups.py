"""Cascaded rollups as chained event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.aggregates import mean_of, population_deviation
from ..functions.granularity import level

#: Late points within this time still count, as in-flight inserts do for the batch form.
MARGIN = "10 seconds"


def _window(g) -> str:
    return f"{level(g).seconds} seconds"


def chained(events: DataFrame, levels: list[str], margin: str = MARGIN) -> DataFrame:
    """stream_id, bucket, c, s, q, l, u, m, d, t_m, t_a, t_z of the last of `levels`, each level made from the one before.

    events: a streaming table of stream_id, ts, value. In append mode a bucket comes out when the watermark
    leaves it; empty buckets do not, since nothing wakes them. Spark has one watermark for all streams, where the batch form
    bounds each stream by itself. Mean times are cut to whole seconds at each level, as in the batch form.
    """
    first, *rest = levels
    present, second = F.col("value").isNotNull(), F.unix_seconds("ts")
    out = (
        events.withWatermark("ts", margin)
        .groupBy("stream_id", F.window("ts", _window(first)).alias("w"))
        .agg(
            F.count("value").alias("c"),
            F.sum("value").alias("s"),
            F.sum(F.col("value") * F.col("value")).alias("q"),
            F.min("value").alias("l"),
            F.max("value").alias("u"),
            F.sum(F.when(present, second)).alias("tw"),
            F.min(second).alias("t_a"),
            F.max(second).alias("t_z"),
        )
    )
    out = _with_mean_time(out, first)
    for name in rest:
        sums = [f(x).alias(x) for x, f in (("c", F.sum), ("s", F.sum), ("q", F.sum), ("l", F.min), ("u", F.max))]
        times = [F.sum(F.col("t_m") * F.col("c")).alias("tw"), F.min("t_a").alias("t_a"), F.max("t_z").alias("t_z")]
        out = out.groupBy("stream_id", F.window(F.window_time("w"), _window(name)).alias("w")).agg(*sums, *times)
        out = _with_mean_time(out, name)
    v = {x: F.col(x).cast("double") for x in "sq"}
    mean, deviation = mean_of(F.col("c"), v["s"]), population_deviation(F.col("c"), v["s"], v["q"])
    moments = [F.timestamp_seconds(x).alias(x) for x in ("t_m", "t_a", "t_z")]
    return out.select("stream_id", F.col("w.start").alias("bucket"), "c", "s", "q", "l", "u", mean.alias("m"), deviation.alias("d"), *moments)


def _with_mean_time(rows: DataFrame, name: str) -> DataFrame:
    middle = F.unix_seconds("w.start") + level(name).seconds // 2
    whole = F.floor(F.col("tw") / F.col("c")).cast("long")
    return rows.withColumn("t_m", F.when(F.col("c") > 0, whole).otherwise(middle)).drop("tw")


def into_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, appended to a Parquet table; started again on the same checkpoint, it goes on."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def monotonic_sink(engine, path_rejected: str, name: str = "sink"):
    """A foreachBatch function: rows in order are appended to the engine, those before a stream's newest
    stored point go to a table of rejects, by batch.

    A batch that comes again, as after a restart, changes nothing: the store knows the last number of the sink `name`, and the
    rejects of a batch that has not been committed are written anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        if engine.store.refresh().batches.get(name, -1) >= number:
            return
        heads = engine.catalog.heads().select("stream_id", "latest")
        judged = batch.join(heads, "stream_id", "left").withColumn("late", F.coalesce(F.col("ts") < F.col("latest"), F.lit(False)))
        judged.where("late").drop("late", "latest").write.mode("overwrite").parquet(f"{path_rejected}/batch={number}")
        engine.append_frame(judged.where("not late").drop("late", "latest"), batch=(name, number))

    return write
