"""Lazy results of reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


class Datapoints:
    """Datapoints of one stream as an ordered plan. Nothing runs before a row or a count is asked for;
    slices and indexes become offset and limit of the plan."""

    def __init__(self, df: DataFrame, order: list, show: Callable):
        self.df, self._order, self._show = df, order, show

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self._order)

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def batch_size(self, rows: int) -> Datapoints:
        """Kept for callers that tune transfers; partitions are what is transferred here."""
        return self

    def __iter__(self) -> Iterator[dict]:
        return map(self._show, self.ordered().toLocalIterator(prefetchPartitions=True))

    def __getitem__(self, key):
        if isinstance(key, slice):
            if key.step not in (None, 1):
                raise ValueError("slices have no step")
            start = key.start or 0
            if start < 0 or (key.stop is not None and key.stop < 0):
                raise ValueError("slices count from the front")
            part = self.ordered().offset(start)
            if key.stop is not None:
                part = part.limit(max(0, key.stop - start))
            return Datapoints(part, self._order, self._show)
        if isinstance(key, bool) or not isinstance(key, int):
            raise TypeError("an index is an integer or a slice")
        if key < 0:
            raise IndexError("indexes count from the front")
        found = self.ordered().offset(key).limit(1).collect()
        if not found:
            raise IndexError(f"no datapoint {key}")
        return self._show(found[0])
