"""Downsamplers that the registry names beyond the stored ones: median, frequencies and interval statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.granularity import Granularity, level
from .derive import with_previous


def _bucketed(rows: DataFrame, g: str | Granularity) -> DataFrame:
    return rows.withColumn("bucket", level(g).floor_column(F.col("ts")))


def median(raw: DataFrame, g: str | Granularity) -> DataFrame:
    """stream_id, bucket, median of the non-null values; always from raw rows, since it does not merge."""
    return _bucketed(raw, g).groupBy("stream_id", "bucket").agg(F.median("value").alias("median"))


def frequencies(raw: DataFrame, g: str | Granularity, value: str = "value_json") -> DataFrame:
    """stream_id, bucket, value, n: one row for each distinct value, so hot values are combined before the shuffle."""
    rows = _bucketed(raw, g).where(F.col(value).isNotNull())
    return rows.groupBy("stream_id", "bucket", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merged_frequencies(finer: DataFrame, g: str | Granularity) -> DataFrame:
    """Frequencies of a coarser level from those of a finer one."""
    g = level(g)
    rows = finer.withColumn("bucket", g.floor_column(F.col("bucket")))
    return rows.groupBy("stream_id", "bucket", "value").agg(F.sum("n").alias("n"))


def extremes(counts: DataFrame) -> DataFrame:
    """stream_id, bucket, most_often, least_often from frequencies; ties go to the smaller value."""
    most = F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value")))
    least = F.min_by("value", F.struct("n", "value"))
    return counts.groupBy("stream_id", "bucket").agg(most.alias("most_often"), least.alias("least_often"))


def interval_stats(raw: DataFrame, g: str | Granularity) -> DataFrame:
    """Statistics of the seconds between neighbouring rows of a stream, by the bucket of the later row:
    intervals_mean, _min, _max, _sum_squares, _std_dev (population)."""
    seen = with_previous(raw.select("stream_id", "ts", "seq"), ["ts"], ["ts", "seq"])
    gaps = seen.withColumn("gap", F.unix_seconds("ts") - F.unix_seconds("prev.ts")).where("gap is not null")
    n, s, q = F.count("gap"), F.sum("gap"), F.sum(F.col("gap") * F.col("gap"))
    variance = q / n - (s / n) * (s / n)
    return (
        _bucketed(gaps, g)
        .groupBy("stream_id", "bucket")
        .agg(
            (s / n).alias("intervals_mean"),
            F.min("gap").alias("intervals_min"),
            F.max("gap").alias("intervals_max"),
            q.alias("intervals_sum_squares"),
            F.sqrt(F.greatest(variance, F.lit(0.0))).alias("intervals_std_dev"),
        )
    )
