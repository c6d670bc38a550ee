"""The engine: streams, appends, rollups, derived streams and reads over a folder of Parquet tables."""

from __future__ import annotations

import datetime as dt
import time
import uuid
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..functions import aggregates as A
from ..functions import tags as T
from ..functions.granularity import Granularity, as_utc, coarser, from_seconds, level, to_seconds
from ..operators import derive, ranges, rollup, values
from ..sources.catalog import DERIVED_FIELDS, HEAD_FIELDS, PROGRESS_FIELDS, STREAM_FIELDS, Catalog, Source, Stream
from ..sources.store import ROLLUP_FIELDS, Contended, Store
from .results import Datapoints

DERIVE_OPERATORS = ("sum", "derivative", "counter_reset", "counter_derivative")
RESULT_TYPES = {"sum": "numeric", "derivative": "numeric", "counter_reset": "nominal", "counter_derivative": "numeric"}
#: Attempts at a small change that another writer's commit has come before.
_ATTEMPTS = 4


class Engine:
    """Twelve operations on tagged streams.

    Derived streams are stored as far as `store_derived` has come, which every rollup run calls, and a plan over their sources from
    there on. `mode` is how rollups are read: "materialized" (closed buckets that downsample_streams has
    written) or "on_read" (buckets made when read, the newest included). Points committed within the last `margin`
    seconds hold a stream's rollups back; a rollup run of over `overrun` seconds warns.

    Each operation that changes something is one commit of the store (a rollup one a level), so several engines may share a
    folder: small changes that another writer's commit came before are made again, rollups and bulk appends raise.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "materialized", margin: float = 0.0, overrun: float = 120.0):
        if mode not in ("materialized", "on_read"):
            raise ValueError("mode is materialized or on_read")
        self.spark, self.mode, self.margin, self.overrun = spark, mode, margin, overrun
        self.use(root)

    @staticmethod
    def _again(change):
        """The result of `change`, made once more where another writer's commit came before its own."""
        for attempt in range(_ATTEMPTS):
            try:
                return change()
            except Contended:
                if attempt == _ATTEMPTS - 1:
                    raise

    def use(self, root: str) -> None:
        """Switch to another folder."""
        self.store = Store(self.spark, root)
        self.catalog = Catalog(self.store)

    # streams

    def ensure_stream(
        self,
        query_tags: dict | None,
        tags: dict | None,
        value_downsamplers,
        highest_granularity,
        derive_from=None,
        derive_op: str | None = None,
        derive_args: dict | None = None,
        value_type: str | None = None,
        value_type_options: dict | None = None,
        derive_backprocess: bool = True,
    ) -> str:
        T.check_tags(query_tags)
        T.check_tags(tags)
        granularity = level(highest_granularity)
        unknown = set(value_downsamplers) - set(A.VALUE_KEYS)
        if unknown:
            raise E.UnsupportedDownsampler(f"unknown downsamplers: {sorted(unknown)}")
        sources = None
        if derive_from is not None:
            sources = derive_from if isinstance(derive_from, (list, tuple)) else [derive_from]
        if derive_op is not None and derive_op not in DERIVE_OPERATORS:
            raise E.UnsupportedDeriveOperator(f"{derive_op!r} is none of {', '.join(DERIVE_OPERATORS)}")
        if (derive_op is None) != (sources is None):
            raise E.InvalidOperatorArguments("derive_from and derive_op go together")
        kind = value_type if value_type is not None else "numeric"
        if kind not in values.TYPES:
            raise E.UnsupportedValueType(f"{kind!r} is none of {', '.join(values.TYPES)}")
        options = value_type_options if value_type_options is not None else ({"high_accuracy": False} if kind == "numeric" else {})
        inputs = tuple(self._source(s, granularity) for s in sources or ())
        given = (query_tags, tags, list(value_downsamplers), granularity, derive_op, derive_args, kind, options, inputs, derive_backprocess)
        return self._again(lambda: self._ensured(*given))

    def _ensured(self, query_tags, tags, value_downsamplers, granularity, derive_op, derive_args, kind, options, inputs, derive_backprocess) -> str:
        since = self.store.refresh().version
        found = self.catalog.find(query_tags)
        if len(found) > 1:
            raise E.MultipleStreamsReturned(f"{len(found)} streams match {query_tags}")
        if found:
            return self._existing(found[0], query_tags, tags, kind, options, derive_op, inputs, since)
        for name in value_downsamplers:
            if name not in A.VALUE_DOWNSAMPLERS or kind not in A.VALUE_DOWNSAMPLERS[name].types:
                raise E.UnsupportedDownsampler(f"{name!r} is not defined for {kind} streams")
        pending = from_seq = 0
        if inputs:
            known = [self.catalog.get(s.stream_id) for s in inputs]
            self._check_sources(derive_op, inputs, known, granularity, kind, derive_args or {})
            if derive_backprocess:
                ids = [s.stream_id for s in inputs]
                pending = self.catalog.heads().where(F.col("stream_id").isin(ids)).limit(1).count() > 0
                pending = pending or any(s.pending_backprocess for s in known)
            else:
                from_seq = self._next_seq()
        stream = Stream(
            str(uuid.uuid4()), self._next_ord(), {**(query_tags or {}), **(tags or {})}, kind, options, granularity.name,
            tuple(A.closure(value_downsamplers)) if value_downsamplers else (), bool(pending), from_seq, derive_op, derive_args or {}, inputs,
        )
        self.catalog.put(stream, since=since)
        return stream.stream_id

    def _source(self, given, granularity: Granularity) -> Source:
        if isinstance(given, str):
            given = {"stream": given}
        name = given.get("granularity", granularity)
        return Source(str(given["stream"]), given.get("name"), level(name).name)

    def _existing(self, stream: Stream, query_tags, tags, kind, options, op, inputs, since: int) -> str:
        if kind != stream.value_type or options != stream.value_type_options:
            raise E.InconsistentStreamConfiguration("the value type of a stream cannot change")
        if op != stream.derive_op or {s.stream_id for s in inputs} != {s.stream_id for s in stream.derived_from}:
            raise E.InconsistentStreamConfiguration("what a stream is derived from cannot change")
        wanted = {**(query_tags or {}), **(tags or {})}
        if wanted != stream.tags:
            self.catalog.put(replace(stream, tags=wanted), since=since)
        return stream.stream_id

    def _check_sources(self, op, inputs, known, granularity, kind, args) -> None:
        if kind != RESULT_TYPES[op]:
            raise E.IncompatibleTypes(f"{op} makes {RESULT_TYPES[op]} streams")
        for s, stream in zip(inputs, known):
            if level(s.granularity) > level(stream.highest_granularity):
                raise E.IncompatibleGranularities(f"stream {s.stream_id} has nothing finer than {stream.highest_granularity}")
            if level(s.granularity) != granularity:
                raise E.IncompatibleGranularities("sources are read at the level of the derived stream")
        if op in ("derivative", "counter_reset") and len(inputs) != 1:
            raise E.InvalidOperatorArguments(f"{op} has one source")
        if op == "counter_derivative":
            if len(inputs) != 2 or inputs[0].name != "reset" or inputs[1].name is not None:
                raise E.InvalidOperatorArguments("counter_derivative has a source named reset and one without a name")
            if args.get("max_value") is not None:
                try:
                    float(args["max_value"])
                except (TypeError, ValueError) as wrong:
                    raise E.InvalidOperatorArguments("max_value is a number") from wrong
        checked = known[1:] if op == "counter_derivative" else known
        if any(s.value_type != "numeric" for s in checked):
            raise E.IncompatibleTypes(f"{op} works with numeric sources")

    def _next_ord(self) -> int:
        held = self.catalog.latest()
        if held is not None:
            return max([0, *(s.ord for s in held)]) + 1
        return (self.store.read("streams", "ord long").agg(F.max("ord")).first()[0] or 0) + 1

    def _next_seq(self) -> int:
        """Where the next batch's sequence numbers begin: behind all that were ever given, deleted streams' too."""
        return self.store.refresh().next_seq

    def get_tags(self, stream_id: str) -> dict:
        return self._described([self.catalog.get(stream_id)])[0]

    def _described(self, streams: list[Stream]) -> list[dict]:
        """Tags and state of streams: two jobs, however many they are."""
        wanted = self.store.local([(s.stream_id,) for s in streams], "stream_id string")
        heads = {r["stream_id"]: r for r in self.catalog.heads().join(wanted, "stream_id", "left_semi").collect()}
        until: dict[str, dict] = {}
        for r in self.catalog.progress().join(wanted, "stream_id", "left_semi").collect():
            until.setdefault(r["stream_id"], {})[r["granularity"]] = as_utc(r["until"])
        fed: dict[str, list] = {}
        for s in self.catalog.find():
            for x in s.derived_from:
                fed.setdefault(x.stream_id, []).append(s.stream_id)
        out = []
        for stream in streams:
            head = heads.get(stream.stream_id)
            shown = {
                **stream.tags,
                "stream_id": stream.stream_id,
                "value_downsamplers": list(stream.value_downsamplers),
                "time_downsamplers": list(A.TIME_STORED),
                "highest_granularity": stream.highest_granularity,
                "value_type": stream.value_type,
                "value_type_options": stream.value_type_options,
                "earliest_datapoint": as_utc(head["earliest"]) if head and head["earliest"] else None,
                "latest_datapoint": as_utc(head["latest"]) if head and head["latest"] else None,
                "pending_backprocess": stream.pending_backprocess,
                "downsampled_until": until.get(stream.stream_id, {}),
            }
            if stream.derive_op:
                shown |= {"derived_from": [s.stream_id for s in stream.derived_from], "derive_op": stream.derive_op, "derive_args": stream.derive_args}
            if stream.stream_id in fed:
                shown["contributes_to"] = fed[stream.stream_id]
            out.append(shown)
        return out

    def _retagged(self, stream_id: str, change) -> None:
        def put():
            since = self.store.refresh().version
            stream = self.catalog.get(stream_id)
            self.catalog.put(replace(stream, tags=change(stream.tags)), since=since)

        self._again(put)

    def update_tags(self, stream_id: str, tags: dict) -> None:
        T.check_tags(tags)
        self._retagged(stream_id, lambda own: T.merged(own, tags))

    def remove_tag(self, stream_id: str, tag) -> None:
        T.check_tags(tag if isinstance(tag, dict) else {tag: 1})
        self._retagged(stream_id, lambda own: T.without(own, tag))

    def clear_tags(self, stream_id: str) -> None:
        self._retagged(stream_id, lambda own: {})

    def find_streams(self, query_tags: dict | None = None, containment: bool = False) -> list[dict]:
        T.check_tags({k: v for k, v in (query_tags or {}).items() if k not in T.RESERVED}, reserved=False)
        return self._described(self.catalog.find(query_tags, with_id=False, containment=containment))

    def delete_streams(self, query_tags: dict | None = None) -> None:
        """Delete matching streams, or the whole store without a query; a stream that feeds one that stays cannot go.

        One commit takes the streams out of the catalog, and their rows, which no id leads to any more, go with the next `compact`.
        """
        if not query_tags:
            self.store.drop()
            return

        def delete():
            since = self.store.refresh().version
            going = self.catalog.find(query_tags)
            ids = {s.stream_id for s in going}
            if any(x.stream_id in ids for s in self.catalog.find() if s.stream_id not in ids for x in s.derived_from):
                raise E.OutstandingDependenciesError("other streams are derived from these")
            self.catalog.put(*[replace(s, deleted=True) for s in going], kind="delete", since=since)

        self._again(delete)

    def compact(self) -> None:
        """Make each table one run, without the rows of deleted streams, in one commit; readers of the old runs go on until `Store.vacuum`."""
        state = self.store.refresh()
        since, old = state.version, {t: list(r) for t, r in state.runs.items() if r}
        alive = self.catalog.table().select("stream_id")
        tables = {
            "heads": (HEAD_FIELDS, lambda df: df.groupBy("stream_id").agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"), F.max("at").alias("at"))),
            "derived": (DERIVED_FIELDS, lambda df: df.groupBy("stream_id").agg(F.max_by(F.struct(*df.columns), "until").alias("s")).select("s.*")),
            "progress": (PROGRESS_FIELDS, lambda df: df.groupBy("stream_id", "granularity").agg(F.max("until").alias("until"))),
            "streams": (STREAM_FIELDS, lambda df: df.groupBy("stream_id").agg(F.max_by(F.struct(*df.columns), "version").alias("s")).select("s.*").where("not deleted")),
        }
        new: dict[str, list[str]] = {}
        try:
            for table, runs in old.items():
                fields, combined = tables.get(table, (rollup.POINT_FIELDS if table == "points" else ROLLUP_FIELDS, None))
                rows = self.store.scan(table, runs, fields, "" if combined else "day date").join(alive, "stream_id", "left_semi")
                time_ = "ts" if table == "points" else "bucket"
                if combined:
                    new[table] = [self.store.stage(table, combined(rows).coalesce(1))]
                else:
                    dealt = rows.repartition(F.col("day"), F.pmod(F.xxhash64("stream_id", time_), F.lit(16)))
                    new[table] = [self.store.stage(table, dealt.sortWithinPartitions("day", "stream_id", time_), ["day"])]
            self.store.commit("compact", new, old, since=since)
        except Contended as other:
            self.store.discard(new)
            raise E.LockExpiredMidMaintenance(str(other)) from other

    # appends

    def append(self, stream_id: str, value, timestamp: dt.datetime | None = None, check_timestamp: bool = True) -> dict:
        return self._append([{"stream_id": stream_id, "value": value, "timestamp": timestamp}], check_timestamp)[0]

    def append_multiple(self, datapoints) -> list[dict]:
        return self._append(list(datapoints), True)

    def _append(self, given: list[dict], check: bool) -> list[dict]:
        """Points of a Python list, in order: one commit for all of them."""
        if not given:
            return []
        try:
            return self._again(lambda: self._appended(given, check))
        except Contended as other:
            raise E.StreamAppendContended(str(other)) from other

    def _appended(self, given: list[dict], check: bool) -> list[dict]:
        state = self.store.refresh()
        since, base = state.version, state.next_seq
        streams = {i: self.catalog.get(i) for i in {d["stream_id"] for d in given}}
        feeds: dict[str, set] = {}
        for s in self.catalog.find():
            for x in s.derived_from:
                feeds.setdefault(x.stream_id, set()).add(s.derive_op if x.name != "reset" else "reset")
        latest = {r["stream_id"]: to_seconds(r["latest"]) for r in self.catalog.heads().where(F.col("stream_id").isin(list(streams))).collect() if r["latest"]}
        rows, shown, late = [], [], {}
        for i, point in enumerate(given):
            stream = streams[point["stream_id"]]
            if stream.derive_op:
                raise E.AppendToDerivedStreamNotAllowed(f"stream {stream.stream_id} is derived")
            moment = as_utc(point.get("timestamp") or dt.datetime.now(dt.timezone.utc)).replace(microsecond=0)
            second, before = to_seconds(moment), latest.get(stream.stream_id)
            if not 0 <= second <= 2**31 - 1:
                raise E.InvalidTimestamp(f"{moment} cannot be stored")
            if before is not None and second < before:
                if check:
                    raise E.InvalidTimestamp(f"{moment} is before the stream's newest datapoint")
                late[stream.stream_id] = min(second, late.get(stream.stream_id, second))
            kept = values.stored_value(point["value"], stream.value_type, stream.value_type_options, list(stream.value_downsamplers))
            self._warn_of(kept, feeds.get(stream.stream_id, set()), second == before)
            latest[stream.stream_id] = second if before is None else max(second, before)
            agg = kept["agg"]
            packed = None if agg is None else {k: agg.get(k) for k in ("c", "s", "q", "l", "u", "m", "d")}
            rows.append((stream.stream_id, moment, base + i, kept["value"], kept["value_json"], packed))
            shown.append({"stream_id": stream.stream_id, "datapoint": {"t": moment, "v": point["value"]}})
        if late:
            self._warn_of_late(late)
        self._write(self.store.local(rows, rollup.POINT_FIELDS), base + len(rows), since, self._spans(rows))
        return shown

    @staticmethod
    def _warn_of(kept: dict, feeds: set, again: bool) -> None:
        """What derived streams will pass over: values that are no numbers, and a second value of one second where a rate is taken."""
        if kept["value_json"] is not None and feeds:
            try:
                float(kept["value_json"].strip('"'))
            except ValueError:
                warnings.warn(E.InvalidValueWarning("derived streams pass over a value that is no number"), stacklevel=5)
        if again and feeds & {"derivative", "counter_derivative"}:
            warnings.warn(E.InvalidValueWarning("no rate is taken between two values of one second"), stacklevel=5)

    def _warn_of_late(self, late: dict[str, int]) -> None:
        reached = self.catalog.progress().where(F.col("stream_id").isin(list(late))).collect()
        if any(late[r["stream_id"]] < to_seconds(r["until"]) for r in reached):
            warnings.warn(E.DownsampleConsistencyNotGuaranteed("rollups that are already written lack this datapoint"), stacklevel=5)

    def append_frame(self, points: DataFrame, check_timestamp: bool = True, batch: tuple[str, int] | None = None) -> bool:
        """The bulk form: a point table with stream_id, ts and value (and value_json, agg, seq from 0) of any size.

        Checked by aggregates only: known plain streams, times in range, and, with `check_timestamp`, no
        row before its stream's newest stored point. `batch` names a sink and the number of its batch: one that has
        been committed before, or an older one, is left out, and the result is False.
        """
        state = self.store.refresh()
        since, base = state.version, state.next_seq
        if batch is not None and batch[1] <= state.batches.get(batch[0], -1):
            return False
        names = set(points.columns)
        full = points.select(
            F.col("stream_id").cast("string").alias("stream_id"),
            F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("ts"),
            (F.col("seq") if "seq" in names else F.monotonically_increasing_id()).cast("long").alias("seq"),
            F.col("value").cast("double").alias("value"),
            (F.col("value_json") if "value_json" in names else F.lit(None)).cast("string").alias("value_json"),
            (F.col("agg") if "agg" in names else F.lit(None)).cast(rollup.AGG).alias("agg"),
        )
        # Without numbers of their own, rows are numbered by partition and place; both bounds come with the checks.
        part, place = (F.shiftrightunsigned("seq", 33), F.col("seq").bitwiseAND((1 << 33) - 1)) if "seq" not in names else (F.lit(0), F.col("seq"))
        bounds = [F.max(part).alias("parts"), F.max(place).alias("places"), F.min("seq").alias("low")]
        spans = full.groupBy("stream_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), *bounds)
        plain = self.catalog.table().select("stream_id", "derive_op")
        checked = spans.join(plain, "stream_id", "left").join(self.catalog.heads(), "stream_id", "left")
        unknown = plain.select("stream_id").withColumn("known", F.lit(True))
        wrong = checked.join(unknown, "stream_id", "left").agg(
            F.max(F.col("known").isNull()).alias("unknown"),
            F.max(F.col("derive_op").isNotNull()).alias("derived"),
            F.max((F.unix_seconds("lo") < 0) | (F.unix_seconds("hi") > 2**31 - 1)).alias("range"),
            F.max(F.col("lo") < F.col("latest")).alias("order"),
            F.max("parts").alias("parts"),
            F.max("places").alias("places"),
            F.min("low").alias("low"),
        ).first()
        if wrong["unknown"]:
            raise E.StreamNotFound("the table names streams that do not exist")
        if wrong["derived"]:
            raise E.AppendToDerivedStreamNotAllowed("the table names derived streams")
        if wrong["range"]:
            raise E.InvalidTimestamp("times out of range")
        if check_timestamp and wrong["order"]:
            raise E.InvalidTimestamp("times before a stream's newest datapoint")
        if wrong["low"] is not None and wrong["low"] < 0:
            raise ValueError("sequence numbers are not negative")
        room = (wrong["places"] or 0) + 1
        numbered = full.withColumn("seq", F.lit(base) + part.cast("long") * F.lit(room) + place)
        try:
            self._write(numbered, base + ((wrong["parts"] or 0) + 1) * room, since, batch=batch)
        except Contended as other:
            raise E.StreamAppendContended(str(other)) from other
        return True

    def _spans(self, rows: list[tuple]) -> DataFrame:
        """Earliest and latest time of each stream of a batch, and of those derived from them."""
        spans: dict[str, tuple] = {}
        for stream_id, moment, *_ in rows:
            low, high = spans.get(stream_id, (moment, moment))
            spans[stream_id] = (min(low, moment), max(high, moment))
        grown = True
        while grown:
            grown = False
            for s in self.catalog.find():
                own = [spans[x.stream_id] for x in s.derived_from if x.stream_id in spans]
                if own and s.stream_id not in spans:
                    spans[s.stream_id] = (min(x[0] for x in own), max(x[1] for x in own))
                    grown = True
        return self.store.local([(k, *v, time.time()) for k, v in spans.items()], HEAD_FIELDS)

    def _write(self, points: DataFrame, next_seq: int, since: int, spans: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
        """Points and the times that they reach, in one commit. Rows of a day and stream stand together, so a scan of a
        stream skips the row groups of others."""
        dealt, new = points.withColumn("day", F.to_date("ts")), {}
        try:
            if spans is not None:  # a list of the driver's: one sorted task
                new["points"] = [self.store.stage("points", dealt.coalesce(1).sortWithinPartitions("day", "stream_id", "ts", "seq"), ["day"])]
                new["heads"] = [self.store.stage("heads", spans.coalesce(1))]
            else:
                spread = dealt.repartition(F.col("day"), F.pmod(F.xxhash64("stream_id", "ts"), F.lit(16))).sortWithinPartitions("day", "stream_id", "ts", "seq")
                new["points"] = [self.store.stage("points", spread, ["day"])]
                written = self.store.scan("points", new["points"], rollup.POINT_FIELDS, "day date")
                heads = written.groupBy("stream_id").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
                new["heads"] = [self.store.stage("heads", self._with_derived_heads(heads))]
        except Exception as wrong:
            self.store.discard(new)
            raise E.StreamAppendFailed("the batch could not be written; nothing of it counts") from wrong
        try:
            self.store.commit("append", new, next_seq=next_seq, since=since, batch=None if batch is None else dict([batch]))
        except Contended:
            self.store.discard(new)
            raise

    def _with_derived_heads(self, heads: DataFrame) -> DataFrame:
        """Derived streams are as new as their sources, also where the operator had nothing to say."""
        streams = self.catalog.find()
        edges = [(s.stream_id, x.stream_id) for s in streams for x in s.derived_from]
        out, now = heads, heads
        for _ in range(len(streams) if edges else 0):
            links = self.store.local(edges, "dst string, src string")
            now = now.join(links, F.col("stream_id") == F.col("src")).groupBy("dst").agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
            now = now.withColumnRenamed("dst", "stream_id")
            if not now.limit(1).count():
                break
            out = out.unionByName(now)
        out = out.groupBy("stream_id").agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
        return out.withColumn("at", F.lit(time.time()))

    # derived streams

    def points(self, stream: Stream) -> DataFrame:
        """Points of a stream: what is stored, and of a derived one also what its sources have had since, through its operator."""
        stored = self.store.points().where(F.col("stream_id") == stream.stream_id)
        if not stream.derive_op:
            return stored
        state = self.catalog.derived().get(stream.stream_id)
        made = self._made(stream, state).withColumn("day", F.to_date("ts"))
        return made if state is None else stored.unionByName(made.select(*stored.columns))

    def _inputs(self, stream: Stream, state: dict | None) -> DataFrame:
        """Rows of a derived stream's sources, from where it is stored to, and the row before them that it goes on from."""
        inputs = []
        for s in stream.derived_from:
            source = self.catalog.get(s.stream_id)
            g = level(s.granularity)
            if g == level(source.highest_granularity):
                rows = self.points(source).where(F.col("seq") >= stream.from_seq)
                if state is not None:
                    rows = self._days(rows, source, start=as_utc(state["until"]))
                numeric = F.coalesce(F.col("value"), F.col("agg.m"), F.col("value_json").try_cast("double"))
                # A nominal value that is no number is passed over; only a null is a null.
                inputs.append(rows.where(F.col("value_json").isNull() | numeric.isNotNull()).withColumn("value", numeric))
            else:
                inputs.append(derive.from_rollup(self.store.rollups(g.name).where(F.col("stream_id") == s.stream_id)))
        rows = derive.tagged(inputs, stream.stream_id)
        if stream.pending_backprocess:
            rows = rows.limit(0)
        if state is not None:
            rows = rows.where(F.col("ts") >= F.lit(as_utc(state["until"])))
            if state["ts"] is not None:
                last = [(stream.stream_id, as_utc(state["ts"]), state["seq"], state["value"], state["ord"])]
                rows = rows.unionByName(self.store.local(last, "stream_id string, ts timestamp, seq long, value double, ord int"))
        return rows

    def _made(self, stream: Stream, state: dict | None) -> DataFrame:
        """Points that a derived stream has from where it is stored to."""
        rows, g = self._inputs(stream, state), stream.highest_granularity
        if stream.derive_op == "sum":
            made = derive.aligned_sum(rows, len(stream.derived_from), g)
        elif stream.derive_op == "derivative":
            made = derive.derivative(rows)
        elif stream.derive_op == "counter_reset":
            made = derive.counter_reset(rows)
        else:
            bound = stream.derive_args.get("max_value")
            made = derive.counter_derivative(rows, None if bound is None else float(bound))
        if state is not None:
            made = made.where(F.col("ts") >= F.lit(as_utc(state["until"])))
        text = F.col("value").cast("int").cast("string") if stream.value_type == "nominal" else F.lit(None).cast("string")
        return made.withColumns({"value_json": text, "agg": F.lit(None).cast(rollup.AGG)}).select("stream_id", "ts", "seq", "value", "value_json", "agg")

    def store_derived(self, query_tags: dict | None = None) -> int:
        """Store the points of derived streams as far as all their sources have come, so that reads and rollups go on from there.

        What is stored is final: points before a source's newest second cannot come any more, those that are appended
        unchecked excepted. Beside it is kept the one row that the next point is measured from, so a run reads only what
        is new. All streams are one commit. Gives the number of streams that have come further.
        """
        since = self.store.refresh().version
        streams = [s for s in self.catalog.find(query_tags) if s.derive_op and not s.pending_backprocess]
        if not streams:
            return 0
        ends = {r["stream_id"]: to_seconds(r["latest"]) for r in self.catalog.heads().collect() if r["latest"]}
        reached = {(r["stream_id"], r["granularity"]): to_seconds(r["until"]) for r in self.catalog.progress().collect()}
        states, until = self.catalog.derived(), {k: to_seconds(v["until"]) for k, v in self.catalog.derived().items()}
        parts, lasts, moved = [], [], {}
        for s in streams:  # sources were made before what is derived from them
            bounds = []
            for x in s.derived_from:
                source = self.catalog.get(x.stream_id)
                if level(x.granularity) != level(source.highest_granularity):
                    bounds.append(reached.get((x.stream_id, x.granularity)))
                else:
                    bounds.append(until.get(x.stream_id) if source.derive_op else ends.get(x.stream_id))
            if any(b is None for b in bounds):
                continue
            size = level(s.highest_granularity).seconds
            end = min(bounds) // size * size if s.derive_op == "sum" else min(bounds)
            if end <= until.get(s.stream_id, -1):
                continue
            state, limit = states.get(s.stream_id), F.lit(from_seconds(end))
            parts.append(self._made(s, state).where(F.col("ts") < limit))
            if s.derive_op != "sum":
                lasts.append(derive.last_rows(self._inputs(s, state).where(F.col("ts") < limit), s.derive_op))
            until[s.stream_id] = moved[s.stream_id] = end
        if not moved:
            return 0
        joined = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(joined(tables[1:]))
        held = {r["stream_id"]: r["last"] for r in joined(lasts).collect()} if lasts else {}
        rows = []
        for k, end in moved.items():
            last = held.get(k) or {"ord": None, "ts": None, "seq": None, "value": None}
            rows.append((k, from_seconds(end), *(last[c] for c in ("ord", "ts", "seq", "value"))))
        made = joined(parts).withColumn("day", F.to_date("ts"))
        spread = made.repartition(F.col("day"), F.pmod(F.xxhash64("stream_id", "ts"), F.lit(16))).sortWithinPartitions("day", "stream_id", "ts", "seq")
        new = {"points": [self.store.stage("points", spread, ["day"])]}
        new["derived"] = [self.store.stage("derived", self.store.local(rows, DERIVED_FIELDS).coalesce(1))]
        try:
            self.store.commit("rollup", new, since=since)
        except Contended as other:
            self.store.discard(new)
            raise E.LockExpiredMidMaintenance(str(other)) from other
        return len(moved)

    def backprocess_streams(self, query_tags: dict | None = None) -> None:
        """Let pending derived streams see the data that their sources had before them."""

        def settle():
            since = self.store.refresh().version
            todo = [s for s in self.catalog.find(query_tags) if s.pending_backprocess]
            done: dict[str, Stream] = {}
            while todo:
                s = todo.pop()
                if s.stream_id not in done:
                    done[s.stream_id] = replace(s, pending_backprocess=False)
                    todo += [x for x in map(self.catalog.get, (y.stream_id for y in s.derived_from)) if x.pending_backprocess]
            if done:
                self.store.write("heads", self._with_derived_heads(self.catalog.heads()), kind="append")
                self.catalog.put(*done.values(), since=since)

        self._again(settle)

    # rollups

    def downsample_streams(self, query_tags: dict | None = None, until: dt.datetime | None = None, return_datapoints: bool = False, filter_stream=None) -> list[dict]:
        """Roll up all buckets that have closed since the last run, level by level, for all streams in one job a level.

        A level's rows and how far they reach are one commit: a run that dies is taken up where it was, and no bucket is
        written twice; of two runs at once the slower one raises. On the on_read path there is nothing to do.
        """
        if self.mode == "on_read":
            return []
        began = time.time()
        self.store_derived(query_tags)
        since = self.store.refresh().version
        streams = [s for s in self.catalog.find(query_tags) if s.value_downsamplers]
        if filter_stream is not None:
            streams = [s for s, shown in zip(streams, self._described(streams)) if filter_stream(shown)]
        if not streams:
            return []
        made = []
        limit = 2**31 - 1 if until is None else to_seconds(as_utc(until))
        # The streams are on the driver already; so are their bounds, one number each.
        wanted = {s.stream_id for s in streams}
        heads = self.catalog.settled(self.margin, began).collect()
        ends = {r["stream_id"]: r["at"] for r in heads if r["stream_id"] in wanted and r["at"] is not None}
        begins = {r["stream_id"]: r["low"] for r in heads}
        done = {(r["stream_id"], r["granularity"]): as_utc(r["until"]) for r in self.catalog.progress().collect()}
        finest = min(coarser(level("seconds")), key=lambda g: g.seconds)
        for g in coarser(level("seconds")):
            firsts = [s for s in streams if self._level_under(s) == g]
            merges = [s.stream_id for s in streams if level(s.highest_granularity) > g and self._level_under(s) != g]
            if not firsts and not merges:
                continue
            his = {k: from_seconds(min(at, limit) // g.seconds * g.seconds) for k, at in ends.items()}
            # Only streams that have something between the last run's end and this one's.
            rows = [(k, done.get((k, g.name)), hi) for k, hi in his.items()]
            rows = [r for r in rows if r[2] > (r[1] or from_seconds(begins[r[0]]))]
            if not rows:
                self._next_level(streams, g, ends, done)
                continue
            # The bounds also say which streams a scan is of, however many they are.
            bounds = lambda ids: self.store.local([r for r in rows if r[0] in ids], "stream_id string, lo timestamp, hi timestamp")
            parts = [rollup.first_level(self._within(self.points(s), bounds({s.stream_id}), "ts"), g) for s in firsts if s.derive_op]
            plain = {s.stream_id for s in firsts if not s.derive_op}
            if plain:
                parts.append(rollup.first_level(self._within(self.store.points(), bounds(plain), "ts"), g))
            if merges:
                finer = max((x for x in coarser(level("seconds")) if x > g), key=lambda x: x.seconds) if g != finest else None
                parts.append(rollup.merge_level(self._within(self.store.rollups(finer.name), bounds(set(merges)), "bucket"), g))
            made_rows = parts[0]
            for p in parts[1:]:
                made_rows = made_rows.unionByName(p)
            table = f"rollups/{g.name}"
            filled = rollup.gap_filled(made_rows, g, bounds(wanted)).withColumn("day", F.to_date("bucket"))
            new = {table: [self.store.stage(table, filled.sortWithinPartitions("day", "stream_id", "bucket"), ["day"])]}
            written = self.store.scan(table, new[table], ROLLUP_FIELDS, "day date")
            reached = [r["stream_id"] for r in written.select("stream_id").distinct().collect()]
            if reached:
                new["progress"] = [self.store.stage("progress", self.store.local([(k, g.name, his[k]) for k in reached], PROGRESS_FIELDS).coalesce(1))]
                try:
                    self.store.commit("rollup", new, since=since)
                except Contended as other:
                    self.store.discard(new)
                    raise E.LockExpiredMidMaintenance(str(other)) from other
                since = self.store.state.version
                done |= {(k, g.name): his[k] for k in reached}
            else:
                self.store.discard(new)
            if return_datapoints and reached:
                kinds = {s.stream_id: s for s in streams}
                for r in written.orderBy("stream_id", "bucket").toLocalIterator():
                    made.append({"stream_id": r["stream_id"], "granularity": g.name, "datapoint": self._shown_rollup(r, kinds[r["stream_id"]])})
            self._next_level(streams, g, ends, done)
        if time.time() - began > self.overrun:
            warnings.warn(E.DownsampleConsistencyNotGuaranteed(f"the run took over {self.overrun:g} seconds"), stacklevel=2)
        return made

    @staticmethod
    def _next_level(streams: list[Stream], g: Granularity, ends: dict, done: dict) -> None:
        """A coarser level sees what this one has reached; streams that start at or under it keep their newest point."""
        for s in streams:
            if level(s.highest_granularity) > g and s.stream_id in ends:
                at = done.get((s.stream_id, g.name))
                if at is None:
                    del ends[s.stream_id]
                else:
                    ends[s.stream_id] = to_seconds(at)

    def _level_under(self, stream: Stream) -> Granularity:
        return coarser(level(stream.highest_granularity))[0] if coarser(level(stream.highest_granularity)) else level("seconds")

    @staticmethod
    def _within(df: DataFrame, bounds: DataFrame, time: str) -> DataFrame:
        at = df.join(bounds, "stream_id")  # one row a stream
        return at.where((F.col(time) < F.col("hi")) & (F.col("lo").isNull() | (F.col(time) >= F.col("lo")))).drop("lo", "hi")

    # reads

    def get_data(
        self, stream_id: str, granularity, start=None, end=None, start_exclusive=None, end_exclusive=None, reverse: bool = False, value_downsamplers=None, time_downsamplers=None
    ) -> Datapoints:
        ranges.check_bounds(start, end, start_exclusive, end_exclusive)
        g = level(granularity)
        for names, keys in ((value_downsamplers, A.VALUE_KEYS), (time_downsamplers, A.TIME_KEYS)):
            if names is not None and set(names) - set(keys):
                raise E.UnsupportedDownsampler(f"unknown downsamplers: {sorted(set(names) - set(keys))}")
        stream = self.catalog.get(stream_id)
        g = min(g, level(stream.highest_granularity))  # nothing is finer than what is stored
        limits = {"start": start, "end": end, "start_exclusive": start_exclusive, "end_exclusive": end_exclusive}
        way = F.desc if reverse else F.asc
        if g == level(stream.highest_granularity):
            rows = ranges.in_range(self._days(self.points(stream), stream, **limits), "seconds", "ts", **limits)
            return Datapoints(rows, [way("ts"), way("seq")], lambda r: {"t": as_utc(r["ts"]), "v": values.shown_value(r, stream.value_type, stream.value_type_options)})
        if not stream.value_downsamplers:
            rows = self.store.rollups(g.name).limit(0)
        elif self.mode == "on_read":
            rows = rollup.on_read(self._days(self.points(stream), stream, **limits), g)
            rows = ranges.in_range(rows, g, "bucket", **limits)
        else:
            rows = self._days(self.store.rollups(g.name).where(F.col("stream_id") == stream_id), stream, **limits)
            rows = ranges.in_range(rows, g, "bucket", **limits)
        have = [n for n in stream.value_downsamplers] if value_downsamplers is None else [n for n in value_downsamplers if n in stream.value_downsamplers]
        times = time_downsamplers
        return Datapoints(ranges.projected(rows, have, times), [way("bucket")], lambda r: self._shown_rollup(r, stream))

    @staticmethod
    def _days(rows: DataFrame, stream: Stream, start=None, end=None, start_exclusive=None, end_exclusive=None) -> DataFrame:
        """Bounds on the partition column, which a bound on the time alone would not prune."""
        if "day" not in rows.columns:
            return rows
        low, high = start if start is not None else start_exclusive, end if end is not None else end_exclusive
        day = lambda m: dt.date(1970, 1, 1) + dt.timedelta(seconds=min(max(ranges.clamped(m), 0), 2**31 - 1))
        rows = rows.where(F.col("day") >= F.lit(day(low)))
        return rows if high is None else rows.where(F.col("day") <= F.lit(day(high)))

    @staticmethod
    def _shown_rollup(row, stream: Stream) -> dict:
        fields, out = row.asDict(), {}
        if "t" in fields:
            out["t"] = {k: as_utc(v) for k, v in row["t"].asDict().items()}
        if "v" in fields:
            own = {A.VALUE_KEYS[n] for n in stream.value_downsamplers}
            v = row["v"].asDict()
            if v.get("c") and v.get("s") is not None and v.get("q") is not None and v["q"] / v["c"] - (v["s"] / v["c"]) ** 2 < -A.DEAD_BAND * max(1.0, v["q"] / v["c"]):
                warnings.warn(E.InternalInconsistencyWarning("a bucket's squares are too small for its sum"), stacklevel=2)
            out["v"] = {k: v for k, v in row["v"].asDict().items() if k in own}
        return out
