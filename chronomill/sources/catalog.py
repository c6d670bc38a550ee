"""Streams and their dependencies as versioned rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MultipleStreamsReturned, StreamNotFound
from ..functions.tags import contains, matches
from .store import Contended, Store

STREAM_FIELDS = (
    "stream_id string, ord long, tags string, value_type string, value_type_options string, highest_granularity string, "
    "value_downsamplers array<string>, pending_backprocess boolean, from_seq long, derive_op string, derive_args string, "
    "derived_from string, deleted boolean, version long"
)
#: `at`: when the batch was committed, in seconds.
HEAD_FIELDS = "stream_id string, earliest timestamp, latest timestamp, at double"
PROGRESS_FIELDS = "stream_id string, granularity string, until timestamp"
#: How far a derived stream is stored, and the row of its sources that the next one is measured from.
DERIVED_FIELDS = "stream_id string, until timestamp, ord int, ts timestamp, seq bigint, value double"


@dataclass(frozen=True)
class Source:
    """One input of a derived stream."""

    stream_id: str
    name: str | None
    granularity: str


@dataclass(frozen=True)
class Stream:
    stream_id: str
    ord: int
    tags: dict = field(default_factory=dict)
    value_type: str = "numeric"
    value_type_options: dict = field(default_factory=dict)
    highest_granularity: str = "seconds"
    value_downsamplers: tuple[str, ...] = ()
    pending_backprocess: bool = False
    from_seq: int = 0
    derive_op: str | None = None
    derive_args: dict = field(default_factory=dict)
    derived_from: tuple[Source, ...] = ()
    deleted: bool = False
    version: int = 0

    @classmethod
    def of(cls, row) -> Stream:
        kept = {k: row[k] for k in ("stream_id", "ord", "value_type", "highest_granularity", "pending_backprocess", "from_seq", "derive_op", "deleted", "version")}
        texts = {k: json.loads(row[k]) for k in ("tags", "value_type_options", "derive_args")}
        sources = tuple(Source(**s) for s in json.loads(row["derived_from"]))
        return cls(**kept, **texts, value_downsamplers=tuple(row["value_downsamplers"]), derived_from=sources)

    def row(self) -> tuple:
        text = lambda x: json.dumps(x, sort_keys=True)
        return (
            self.stream_id, self.ord, text(self.tags), self.value_type, text(self.value_type_options), self.highest_granularity,
            list(self.value_downsamplers), self.pending_backprocess, self.from_seq, self.derive_op, text(self.derive_args),
            text([asdict(s) for s in self.derived_from]), self.deleted, self.version,
        )


class Catalog:
    """A change writes a new version of a stream's row; the latest version counts."""

    #: Up to so many versions the catalog is held on the driver between changes; beyond, it stays a table.
    HELD = 10_000

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self._runs: tuple | None = None
        self._held: list | None = None
        self._derived: tuple[tuple, dict] | None = None

    def _rows(self) -> DataFrame:
        runs = tuple(self.store.runs("streams"))
        if runs != self._runs:
            rows = self.store.read("streams", STREAM_FIELDS).limit(self.HELD + 1).collect() if runs else []
            self._held = [tuple(r) for r in rows] if len(rows) <= self.HELD else None
            self._runs = runs
        return self.store.read("streams", STREAM_FIELDS) if self._held is None else self.store.local(self._held, STREAM_FIELDS)

    def table(self) -> DataFrame:
        rows = self._rows()
        latest = rows.groupBy("stream_id").agg(F.max_by(F.struct(*rows.columns), "version").alias("s"))
        return latest.select("s.*").where("not deleted")

    def put(self, *streams: Stream, kind: str = "catalog", since: int | None = None) -> None:
        """New versions of streams, in one commit; `since` is the version of the store that they were made from."""
        changed = [replace(s, version=s.version + 1).row() for s in streams]
        if changed:
            seen = self.store.refresh().version if since is None else since
            run = self.store.stage("streams", self.store.local(changed, STREAM_FIELDS).coalesce(1))
            try:
                self.store.commit(kind, {"streams": [run]}, since=seen)
            except Contended:
                self.store.discard({"streams": [run]})
                raise

    def latest(self) -> list[Stream] | None:
        """All streams, if they are held on the driver."""
        self._rows()
        if self._held is None:
            return None
        names = [f.split()[0] for f in STREAM_FIELDS.split(", ")]
        newest: dict[str, dict] = {}
        for r in self._held:
            row = dict(zip(names, r))
            if row["stream_id"] not in newest or row["version"] > newest[row["stream_id"]]["version"]:
                newest[row["stream_id"]] = row
        return sorted((Stream.of(r) for r in newest.values() if not r["deleted"]), key=lambda s: s.ord)

    def find(self, query: dict | None = None, with_id: bool = True, containment: bool = False) -> list[Stream]:
        """Streams in the order they were made. `stream_id` in a query is not a tag; without `with_id` it finds none.

        With `containment` a query is plain JSON that the tags must contain, without operators.
        """
        query = dict(query or {})
        wanted = query.pop("stream_id", None)
        if wanted is not None and not with_id:
            return []
        held = self.latest() if not query else None
        if held is not None:
            return [s for s in held if wanted is None or s.stream_id == wanted]
        rows = self.table().where((contains if containment else matches)(query, F.col("tags")))
        if wanted is not None:
            rows = rows.where(F.col("stream_id") == wanted)
        return [Stream.of(r) for r in rows.orderBy("ord").collect()]

    def get(self, stream_id: str) -> Stream:
        found = self.find({"stream_id": stream_id})
        if not found:
            raise StreamNotFound(f"no stream {stream_id!r}")
        if len(found) > 1:
            raise MultipleStreamsReturned(f"several streams {stream_id!r}")
        return found[0]

    def heads(self) -> DataFrame:
        """stream_id, earliest, latest: additive rows, so no version is needed."""
        return self.store.read("heads", HEAD_FIELDS).groupBy("stream_id").agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))

    def settled(self, margin: float, now: float) -> DataFrame:
        """stream_id, low, at: the seconds of each stream's first point, and up to which no point has come within the last `margin` seconds."""
        fresh = F.min(F.when(F.col("at") > F.lit(now - margin), F.unix_seconds("earliest")))
        rows = self.store.read("heads", HEAD_FIELDS).groupBy("stream_id")
        return rows.agg(F.unix_seconds(F.min("earliest")).alias("low"), F.least(F.unix_seconds(F.max("latest")), fresh).alias("at"))

    def progress(self) -> DataFrame:
        return self.store.read("progress", PROGRESS_FIELDS).groupBy("stream_id", "granularity").agg(F.max("until").alias("until"))

    def derived(self) -> dict[str, dict]:
        """The state of each derived stream that is stored to some point (DERIVED_FIELDS), one row a stream."""
        runs = tuple(self.store.runs("derived"))
        if self._derived is None or self._derived[0] != runs:
            rows = self.store.read("derived", DERIVED_FIELDS)
            newest = rows.groupBy("stream_id").agg(F.max_by(F.struct(*rows.columns), "until").alias("s")).select("s.*")
            self._derived = runs, {r["stream_id"]: r.asDict() for r in newest.collect()} if runs else {}
        return self._derived[1]
