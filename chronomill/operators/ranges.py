"""Time bounds and projections of reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import TIME_KEYS, VALUE_KEYS
from ..functions.granularity import Granularity, as_utc, from_seconds, level, to_seconds

FIRST, LAST = from_seconds(0), from_seconds(2**31 - 1)


def check_bounds(start, end, start_exclusive, end_exclusive) -> None:
    """Exactly one start and at most one end."""
    if (start is None) == (start_exclusive is None):
        raise AttributeError("give either start or start_exclusive")
    if end is not None and end_exclusive is not None:
        raise AttributeError("give end or end_exclusive, not both")


def clamped(moment: dt.datetime) -> int:
    """Whole seconds, kept inside what can be stored; one second beyond for open bounds."""
    if moment.tzinfo is None:
        moment = max(dt.datetime(1969, 12, 31), min(moment, dt.datetime(2038, 1, 20)))
    return max(-1, min(to_seconds(as_utc(moment)), 2**31))


def in_range(df: DataFrame, g: str | Granularity, time: str, start=None, end=None, start_exclusive=None, end_exclusive=None) -> DataFrame:
    """Rows of level `g` between the bounds; starts are floored to the level, ends to the second.

    The bounds are literals, so they reach the scan; a range that cannot hold a row gives an empty plan.
    """
    check_bounds(start, end, start_exclusive, end_exclusive)
    g = level(g)
    floored = lambda m: clamped(m) // g.seconds * g.seconds
    low = floored(start) if start is not None else floored(start_exclusive) + 1
    high = clamped(end) if end is not None else clamped(end_exclusive) - 1 if end_exclusive is not None else 2**31
    if high < low or low > 2**31 - 1 or high < 0:
        return df.limit(0)
    # Seconds are integers, so "after the floored start" is "from one second later".
    keep: Column = F.col(time) >= F.lit(from_seconds(max(low, 0)))
    if high < 2**31 - 1:
        keep = keep & (F.col(time) <= F.lit(from_seconds(high)))
    return df.where(keep)


def projected(rollup: DataFrame, value_downsamplers=None, time_downsamplers=None) -> DataFrame:
    """Only the aggregates asked for; an empty list drops v or t. Nested columns are pruned down to the scan."""
    out = rollup
    for column, names, keys in (("v", value_downsamplers, VALUE_KEYS), ("t", time_downsamplers, TIME_KEYS)):
        if names is None:
            continue
        have = set(rollup.schema[column].dataType.names)
        chosen = [keys[n] for n in names if keys[n] in have]
        if chosen:
            out = out.withColumn(column, F.struct(*[F.col(f"{column}.{k}").alias(k) for k in chosen]))
        else:
            out = out.drop(column)
    return out
