"""Tumbling rollups: first level, cascade, gap fill, bounds of closed buckets, and the on-read form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.granularity import Granularity, coarser, level

#: What a point table has beside other columns: stream_id, ts, seq, value, present, agg.
AGG = "struct<c:bigint,s:double,q:double,l:double,u:double,m:double,d:double>"
POINT_FIELDS = f"stream_id string, ts timestamp, seq bigint, value double, value_json string, agg {AGG}"


def points(df: DataFrame, stream: str | Column, ts: str | Column, value: str | Column, seq: str | Column | None = None) -> DataFrame:
    """A point table from any table: times cut to whole seconds, naive times being UTC."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        as_column(stream).cast("string").alias("stream_id"),
        F.timestamp_seconds(F.unix_seconds(as_column(ts).cast("timestamp"))).alias("ts"),
        (as_column(seq) if seq is not None else F.lit(0)).cast("long").alias("seq"),
        as_column(value).alias("value"),
        F.lit(None).cast("string").alias("value_json"),
        F.lit(None).cast(AGG).alias("agg"),
    )


def _packed(df: DataFrame, g: Granularity, kept: list[str]) -> DataFrame:
    """The columns of an aggregation as (stream_id, bucket, v, t)."""
    sums = df.withColumns({d.key: d.post("") for d in A.POSTED})
    keys = ("c", "s", "q", "l", "u", "m", "d")
    types = {"c": "long"}
    v = F.struct(*[F.col(k).cast(types.get(k, "double")).alias(k) for k in keys])
    mean = A.time_mean(F.col("_tw"), F.col("_w"), g.middle(F.col("bucket")))
    t = F.struct(mean.alias("m"), F.col("_a").alias("a"), F.col("_z").alias("z"))
    return sums.select(*kept, "bucket", v.alias("v"), t.alias("t"))


def first_level(raw: DataFrame, g: str | Granularity, exact_scale: int | None = None) -> DataFrame:
    """(stream_id, bucket, v, t) from points: one partial aggregation, one shuffle on (stream_id, bucket).

    Nulls count only for the first and last time. A pre-aggregated point adds its parts, and weighs 1 in the
    mean time. With `exact_scale` values are added as decimals of that scale, so the result does not
    depend on the order of rows.
    """
    g = level(g)
    value = F.col("value") if exact_scale is None else F.col("value").cast(f"decimal(18,{exact_scale})")
    if dict(raw.dtypes).get("value") == "string":
        value = F.lit(None).cast("double")
    present = F.col("value").isNotNull() | F.col("value_json").isNotNull()
    rows = raw.withColumns({"bucket": g.floor_column(F.col("ts")), "present": present})
    weight = F.when(F.col("agg").isNotNull(), 1).otherwise(F.col("present").cast("long"))
    grouped = rows.groupBy("stream_id", "bucket").agg(
        *[_double(d.first(_typed(value, exact_scale)), d.key).alias(d.key) for d in A.STORED],
        F.sum(F.unix_seconds("ts") * weight).alias("_tw"),
        F.sum(weight).alias("_w"),
        F.min("ts").alias("_a"),
        F.max("ts").alias("_z"),
    )
    return _packed(grouped, g, ["stream_id"])


def _typed(value: Column, exact_scale: int | None) -> Column:
    return value.cast("double") if exact_scale is None else value


def _double(total: Column, key: str) -> Column:
    return total if key == "c" else total.cast("double")


def merge_level(finer: DataFrame, g: str | Granularity) -> DataFrame:
    """(stream_id, bucket, v, t) from the rollup rows of a finer level; mean times weigh by v.c."""
    g = level(g)
    seconds = F.unix_seconds("t.m")
    grouped = (
        finer.withColumn("bucket", g.floor_column(F.col("bucket")))
        .groupBy("stream_id", "bucket")
        .agg(
            *[d.merge().alias(d.key) for d in A.STORED],
            F.sum(seconds * F.col("v.c")).alias("_tw"),
            F.sum("v.c").alias("_w"),
            F.min("t.a").alias("_a"),
            F.max("t.z").alias("_z"),
        )
    )
    return _packed(grouped, g, ["stream_id"])


def empty_v() -> Column:
    null = F.lit(None).cast("double")
    return F.struct(F.lit(0).cast("long").alias("c"), *[null.alias(k) for k in ("s", "q", "l", "u", "m", "d")])


def gap_filled(rollup: DataFrame, g: str | Granularity, bounds: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """`rollup` with a row for every bucket of each stream's span; empty ones have count 0 and mid-bucket times.

    bounds: stream_id, lo, hi (hi exclusive); by default, and where they are null, from a stream's first to its last bucket.
    With `whole` all bounds are given, so `rollup` is read once. Streams without rows in `rollup` stay without, unless `whole`.
    The spine is made day by day, and dealt by the rollup's own keys.
    """
    g = level(g)
    seconds = F.unix_seconds("bucket")
    if whole:
        spans = bounds.select("stream_id", F.unix_seconds("lo").alias("lo"), F.unix_seconds("hi").alias("hi"))
    else:
        spans = rollup.groupBy("stream_id").agg(F.min(seconds).alias("lo"), (F.max(seconds) + g.seconds).alias("hi"))
        if bounds is not None:
            given = bounds.select("stream_id", F.unix_seconds("lo").alias("g_lo"), F.unix_seconds("hi").alias("g_hi"))
            spans = spans.join(given, "stream_id").select("stream_id", F.coalesce("g_lo", "lo").alias("lo"), F.coalesce("g_hi", "hi").alias("hi"))
    day = 86_400
    days = F.explode(F.sequence(F.floor(F.col("lo") / day) * day, F.col("hi") - 1, F.lit(day).cast("long")))
    spine = spans.where("lo < hi").select("stream_id", "lo", "hi", days.alias("_day"))
    first, last = F.greatest("lo", "_day"), F.least(F.col("hi"), F.col("_day") + day)
    spine = spine.select("stream_id", F.explode(F.sequence(first, last - g.seconds, F.lit(g.seconds).cast("long"))).alias("_s"))
    spine = spine.select("stream_id", F.timestamp_seconds("_s").alias("bucket"))
    middle = g.middle(F.col("bucket"))
    empty_t = F.struct(middle.alias("m"), middle.alias("a"), middle.alias("z"))
    return spine.join(rollup, ["stream_id", "bucket"], "left").select(
        "stream_id", "bucket", F.coalesce("v", empty_v()).alias("v"), F.coalesce("t", empty_t).alias("t")
    )


def closed(rollup: DataFrame, g: str | Granularity, newest: DataFrame) -> DataFrame:
    """Rows of buckets that ended before each stream's newest moment (stream_id, newest)."""
    g = level(g)
    bounds = newest.select("stream_id", g.floor_column(F.col("newest")).alias("_hi"))
    return rollup.join(bounds, "stream_id").where(F.col("bucket") < F.col("_hi")).drop("_hi")


def cascade(raw: DataFrame, highest: str | Granularity = "seconds", gaps: bool = True, exact_scale: int | None = None) -> dict[str, DataFrame]:
    """All levels under `highest` for points without earlier rollups: each level reads the one before.

    A bucket is closed when the stream's newest point (first level) or the end of the level before
    has left it.
    """
    out: dict[str, DataFrame] = {}
    ends = raw.groupBy("stream_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    before = None
    for g in coarser(level(highest)):
        made = first_level(raw, g, exact_scale) if before is None else merge_level(before, g)
        ends = ends.select("stream_id", g.floor_column(F.col("lo")).alias("lo"), g.floor_column(F.col("hi")).alias("hi"))
        # The spine ends where closed buckets do, so each level is read once by the next.
        before = gap_filled(made, g, ends, whole=True) if gaps else closed(made, g, ends.withColumnRenamed("hi", "newest"))
        out[g.name] = before
    return out


def on_read(raw: DataFrame, g: str | Granularity, start=None, end=None, gaps: bool = True, exact_scale: int | None = None) -> DataFrame:
    """The second read path: buckets made at read time, the newest one included; sample deviation.

    The range is applied to points, so the first bucket may be partial. The mean time is the bucket's start.
    """
    g = level(g)
    if start is not None:
        raw = raw.where(F.col("ts") >= F.lit(start))
    if end is not None:
        raw = raw.where(F.col("ts") <= F.lit(end))
    made = first_level(raw, g, exact_scale)
    made = gap_filled(made, g) if gaps else made
    deviation = A.sample_deviation(F.col("v.c"), F.col("v.s"), F.col("v.q"))
    return made.select(
        "stream_id", "bucket", F.col("v").withField("d", deviation).alias("v"), F.struct(F.col("bucket").alias("m")).alias("t")
    )
