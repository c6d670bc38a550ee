"""Derived streams as plans over their sources: aligned sums, rates, counter resets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.granularity import Granularity, level


def with_previous(rows: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """`rows` and prev: a struct of `fields` of the row before, by `order` (ts first) within a stream; null for its first row.

    Rows are dealt by stream and day, so a hot stream is spread over as many tasks as it has days; from one day to the next
    goes only the last row of each, which is as many rows a stream as there are days.
    """
    own = F.struct(*fields)
    dealt = rows.withColumn("_day", F.floor(F.unix_seconds("ts") / 86_400))
    day = Window.partitionBy("stream_id", "_day").orderBy(*order)
    seen = dealt.withColumns({"prev": F.lag(own).over(day), "_last": F.lead(F.lit(True)).over(day).isNull()})
    lasts = seen.where("_last").select("stream_id", "_day", own.alias("_own"))
    carried = lasts.select("stream_id", "_day", F.lag("_own").over(Window.partitionBy("stream_id").orderBy("_day")).alias("_carried"))
    return seen.join(carried, ["stream_id", "_day"]).withColumn("prev", F.coalesce("prev", "_carried")).drop("_day", "_last", "_carried")


#: The rows that an operator looks at: each is measured from the one before.
MEASURED = {"derivative": "true", "counter_reset": "value is not null", "counter_derivative": "ord = 1 or value is null or value <> 0"}


def last_rows(rows: DataFrame, operator: str) -> DataFrame:
    """stream_id, last: the row (ord, ts, seq, value) of each target that its next one is measured from."""
    order, row = F.struct("ts", "ord", "seq"), F.struct("ord", "ts", "seq", "value")
    return rows.where(MEASURED[operator]).groupBy("stream_id").agg(F.max_by(row, order).alias("last"))


def tagged(sources: list[DataFrame], dst: str | None = None) -> DataFrame:
    """Points (stream_id, ts, seq, value) of all sources with ord, the source's place; stream_id is the target's."""
    parts = [
        s.select(F.lit(dst).alias("stream_id") if dst else "stream_id", "ts", "seq", F.col("value").cast("double").alias("value"), F.lit(i).alias("ord"))
        for i, s in enumerate(sources)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aligned_sum(rows: DataFrame, sources: int, g: str | Granularity) -> DataFrame:
    """Sum of all sources on equal floored times: in each bucket, in order, the last value of each source counts, and every time
    all are there a row comes out and the values are forgotten. Nulls are left out of a sum and make it null if all are.

    rows: stream_id (of the target), ts, seq, value, ord. A bucket with one row of each source is settled by a partial
    aggregation; only the rows of buckets where a source has more are put in order and folded.
    """
    g = level(g)
    at = rows.withColumn("bucket", g.floor_column(F.col("ts")))
    values = [F.max(F.when(F.col("ord") == i, F.col("value"))).alias(f"v{i}") for i in range(sources)]
    there = [F.max((F.col("ord") == i).cast("int")) for i in range(sources)]
    k = there[0]
    for t in there[1:]:
        k = k + t
    per = at.groupBy("stream_id", "bucket").agg(F.count(F.lit(1)).alias("n"), k.alias("k"), F.max("seq").alias("seq"), *values).where(F.col("k") == sources)
    total = F.lit(0.0)
    for i in range(sources):
        total = total + F.coalesce(f"v{i}", F.lit(0.0))
    some = F.coalesce(*[f"v{i}" for i in range(sources)]).isNotNull()
    plain = per.where(F.col("n") == sources).select("stream_id", F.col("bucket").alias("ts"), "seq", F.when(some, total).alias("value"))
    several = per.where(F.col("n") > sources).select("stream_id", "bucket")
    return plain.unionByName(_folded(at.join(several, ["stream_id", "bucket"], "left_semi"), sources))


def _folded(rows: DataFrame, sources: int) -> DataFrame:
    """`aligned_sum` of the rows (with bucket) of complete buckets, one after the other.

    A bucket goes through one task in order, batch by batch; beside a batch only the last row of each source is held.
    """
    fields = "stream_id string, bucket long, seq long, value double"
    types = pa.schema([("stream_id", pa.string()), ("bucket", pa.int64()), ("seq", pa.int64()), ("value", pa.float64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, bucket, there, every = None, None, 0, (1 << sources) - 1
        seqs, values = [None] * sources, [None] * sources
        for batch in batches:
            out: list[tuple] = []
            for s, b, i, seq, value in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "bucket", "ord", "seq", "value"))):
                if b != bucket or s != stream:
                    stream, bucket, there = s, b, 0
                seqs[i], values[i], there = seq, value, there | 1 << i
                if there == every:
                    some = [v for v in values if v is not None]
                    out.append((s, b, max((q for q in seqs if q is not None), default=None), reduce(add, some, 0.0) if some else None))
                    there = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [()] * 4, types)], schema=types)

    dealt = rows.repartition("stream_id", "bucket").sortWithinPartitions("stream_id", "bucket", "ts", "ord", "seq", "value")
    folded = dealt.select("stream_id", F.unix_micros("bucket").alias("bucket"), "ord", "seq", "value").mapInArrow(fold, fields)
    return folded.select("stream_id", F.timestamp_micros("bucket").alias("ts"), "seq", "value")


def derivative(rows: DataFrame) -> DataFrame:
    """Change per second since the previous row of a stream; a null comes out as null and starts anew.

    Two rows in one second give nothing, but the later one is what the next row is measured from.
    """
    seen = with_previous(rows, ["value", "ts"], ["ts", "seq"])
    dt = F.unix_seconds("ts") - F.unix_seconds("prev.ts")
    rate = (F.col("value") - F.col("prev.value")) / F.when(dt != 0, dt)
    kept = F.col("value").isNull() | (F.col("prev.value").isNotNull() & (dt != 0))
    return seen.where(kept).select("stream_id", "ts", "seq", rate.alias("value"))


def counter_reset(rows: DataFrame) -> DataFrame:
    """1 wherever a counter is lower than at its previous value; nulls are passed over."""
    seen = with_previous(rows.where(MEASURED["counter_reset"]), ["value"], ["ts", "seq"])
    return seen.where("prev.value > value").select("stream_id", "ts", "seq", F.lit(1.0).alias("value"))


def counter_derivative(rows: DataFrame, max_value: float | None = None) -> DataFrame:
    """Rate of a counter between its resets.

    rows have ord 0 for resets and 1 for data. A reset that is not 0 forgets the previous value; a null of either
    comes out as null and forgets it too. A value lower than the previous one without a reset has
    wrapped at `max_value`; without that bound it gives nothing.
    """
    seen = with_previous(rows.where(MEASURED["counter_derivative"]), ["ord", "value", "ts"], ["ts", "ord", "seq"])
    before = F.col("prev.value")
    dt = F.unix_seconds("ts") - F.unix_seconds("prev.ts")
    wrapped = F.lit(float(max_value)) - before + F.col("value") if max_value is not None else F.lit(None).cast("double")
    delta = F.when(F.col("value") < before, wrapped).otherwise(F.col("value") - before)
    rate = F.when(F.col("value").isNotNull(), delta / F.when(dt != 0, dt))
    usable = (F.col("ord") == 1) & (F.col("prev.ord") == 1) & before.isNotNull() & (dt != 0) & delta.isNotNull()
    return seen.where(F.col("value").isNull() | usable).select("stream_id", "ts", "seq", rate.alias("value"))


def from_rollup(rollup: DataFrame) -> DataFrame:
    """Rows of a coarser level as points for `sum`: s / c at the last time of each bucket; an empty bucket is null."""
    value = F.when(F.col("v.c") > 0, F.col("v.s") / F.col("v.c"))
    return rollup.select("stream_id", F.col("t.z").alias("ts"), F.lit(0).cast("long").alias("seq"), value.alias("value"))
