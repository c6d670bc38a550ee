"""Downsamplers: how values and times of a bucket add up, at the first level and when merging levels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variances nearer to 0 than this are 0.
DEAD_BAND = 1e-6


@dataclass(frozen=True)
class Downsampler:
    """first: over raw rows (value, agg). merge: over rollup rows (v). post: from the other aggregates."""

    name: str
    key: str
    types: tuple[str, ...]
    first: Callable[[Column], Column] | None = None
    merge: Callable[[], Column] | None = None
    post: Callable[[str], Column] | None = None
    needs: tuple[str, ...] = ()


def counted_rows() -> Column:
    return F.sum(F.when(F.col("agg").isNotNull(), F.coalesce(F.col("agg.c"), F.lit(0))).otherwise(F.col("present").cast("long")))


def both(a: Column, b: Column) -> Column:
    """The sum of two totals, either of which may be null for want of rows."""
    return F.coalesce(a + b, a, b)


def population_deviation(c: Column, s: Column, q: Column) -> Column:
    """No values: null; one: 0; otherwise sqrt(q/c - (s/c)^2), a variance inside the dead band or below 0 being 0."""
    variance = q / c - (s / c) * (s / c)
    spread = F.when((F.abs(variance) < DEAD_BAND) | (variance < 0), F.lit(0.0)).otherwise(F.sqrt(variance))
    return F.when((c == 0) | s.isNull() | q.isNull(), F.lit(None).cast("double")).when(c == 1, F.lit(0.0)).otherwise(spread)


def sample_deviation(c: Column, s: Column, q: Column) -> Column:
    """The on-read path's deviation: over c - 1; one value gives 0."""
    variance = (q - s * s / c) / (c - 1)
    spread = F.when((F.abs(variance) < DEAD_BAND) | (variance < 0), F.lit(0.0)).otherwise(F.sqrt(variance))
    return F.when((c == 0) | s.isNull() | q.isNull(), F.lit(None).cast("double")).when(c == 1, F.lit(0.0)).otherwise(spread)


def mean_of(c: Column, s: Column) -> Column:
    return F.when((c > 0) & s.isNotNull(), s / c)


ALL, NUMERIC = ("numeric", "nominal", "graph"), ("numeric",)
VALUE_DOWNSAMPLERS = {
    d.name: d
    for d in (
        Downsampler("count", "c", ALL, lambda v: counted_rows(), lambda: F.sum("v.c")),
        Downsampler("sum", "s", NUMERIC, lambda v: both(F.sum(v).cast("double"), F.sum("agg.s")), lambda: F.sum("v.s")),
        Downsampler("sum_squares", "q", NUMERIC, lambda v: both(F.sum(v * v).cast("double"), F.sum("agg.q")), lambda: F.sum("v.q")),
        Downsampler("min", "l", NUMERIC, lambda v: F.least(F.min(v).cast("double"), F.min("agg.l")), lambda: F.min("v.l")),
        Downsampler("max", "u", NUMERIC, lambda v: F.greatest(F.max(v).cast("double"), F.max("agg.u")), lambda: F.max("v.u")),
        Downsampler("mean", "m", NUMERIC, post=lambda p: mean_of(F.col(f"{p}c"), F.col(f"{p}s")), needs=("count", "sum")),
        Downsampler(
            "std_dev",
            "d",
            NUMERIC,
            post=lambda p: population_deviation(F.col(f"{p}c"), F.col(f"{p}s"), F.col(f"{p}q")),
            needs=("count", "sum", "sum_squares"),
        ),
    )
}
STORED = [d for d in VALUE_DOWNSAMPLERS.values() if d.post is None]
POSTED = [d for d in VALUE_DOWNSAMPLERS.values() if d.post is not None]

# Names and keys of all downsamplers. Those without a definition above are extensions,
# offered by the functions of chronomill.operators.extras and refused by the engine.
VALUE_KEYS = {
    "mean": "m", "median": "n", "sum": "s", "min": "l", "max": "u", "sum_squares": "q", "std_dev": "d",
    "count": "c", "most_often": "o", "least_often": "r", "frequencies": "f",
}
TIME_KEYS = {
    "mean": "m", "first": "a", "last": "z", "intervals_mean": "i", "intervals_min": "l",
    "intervals_max": "u", "intervals_sum_squares": "q", "intervals_std_dev": "d",
}
TIME_STORED = ("mean", "first", "last")


def closure(names) -> list[str]:
    """`names`, count, and what the others are computed from."""
    wanted = {"count", *names}
    for n in list(wanted):
        wanted |= set(VALUE_DOWNSAMPLERS[n].needs) if n in VALUE_DOWNSAMPLERS else set()
    return [n for n in VALUE_KEYS if n in wanted]


def time_mean(weighted: Column, weight: Column, middle: Column) -> Column:
    """Weighted mean second, cut to whole seconds; the bucket's middle where nothing weighs."""
    whole = F.floor(weighted / weight).cast("long")
    return F.when(weight > 0, F.timestamp_seconds(whole)).otherwise(middle)
