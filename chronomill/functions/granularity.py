"""Rollup levels and their time arithmetic as Spark expressions."""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedGranularity

UTC = dt.timezone.utc


@functools.total_ordering
@dataclass(frozen=True)
class Granularity:
    """A level; finer levels compare as higher. All sizes divide a day, so floors are epoch floors."""

    name: str
    key: str
    seconds: int

    def __lt__(self, other: Granularity) -> bool:
        return self.seconds > other.seconds

    def floor(self, moment: dt.datetime) -> dt.datetime:
        return from_seconds(to_seconds(moment) // self.seconds * self.seconds)

    def floor_column(self, ts: Column) -> Column:
        return F.timestamp_seconds(self.floor_seconds(F.unix_seconds(ts)))

    def floor_seconds(self, seconds: Column) -> Column:
        """Integer arithmetic only: a division would pass through double."""
        return seconds - F.pmod(seconds, F.lit(self.seconds).cast("long"))

    def middle(self, bucket: Column) -> Column:
        return F.timestamp_seconds(F.unix_seconds(bucket) + F.lit(self.seconds // 2))


# Names, keys and sizes of the levels, finest first.
SECONDS = Granularity("seconds", "s", 1)
SECONDS10 = Granularity("10seconds", "S", 10)
MINUTES = Granularity("minutes", "m", 60)
MINUTES10 = Granularity("10minutes", "M", 600)
HOURS = Granularity("hours", "h", 3600)
HOURS6 = Granularity("6hours", "H", 21600)
DAYS = Granularity("days", "d", 86400)
LEVELS = (SECONDS, SECONDS10, MINUTES, MINUTES10, HOURS, HOURS6, DAYS)
_BY_NAME = {g.name: g for g in LEVELS}


def level(name: str | Granularity) -> Granularity:
    if isinstance(name, Granularity):
        return name
    if name not in _BY_NAME:
        raise UnsupportedGranularity(f"{name!r} is none of {', '.join(_BY_NAME)}")
    return _BY_NAME[name]


def coarser(than: Granularity) -> list[Granularity]:
    return [g for g in LEVELS if g < than]


def as_utc(moment: dt.datetime) -> dt.datetime:
    """Naive moments are UTC."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def to_seconds(moment: dt.datetime) -> int:
    return int((as_utc(moment) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(seconds=1))


def from_seconds(seconds: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=seconds)
