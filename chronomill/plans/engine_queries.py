"""Queries that go through the engine's public operations, from appends to deletions, each with the same in SQL."""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.granularity import from_seconds, to_seconds
from ..sources.scratch import scratch
from .engine import Engine
from .queries import EVN, SAMPLE, S, _at, _engine, _kinds, events, first_sql, nulled, query, shaped_sql

_KINDS = f"SELECT stream_id AS kind, count(*) AS n FROM ({EVN}) GROUP BY 1"


@query(
    "engine_tags",
    f"SELECT kind, CASE WHEN kind NOT IN ('click', 'view') THEN n ELSE 0 END AS n, CASE WHEN kind <> 'view' THEN 'x' END AS mark FROM ({_KINDS})",
)
def engine_tags(spark, sf_dir) -> DataFrame:
    """Tags set, merged, taken away one by one and all at once."""
    engine, ids = _engine(spark, sf_dir)
    for kind, i in ids.items():
        engine.update_tags(i, {"stats": {"n": len(engine.get_data(i, "seconds", start=_at(0)))}, "mark": "x"})
    engine.remove_tag(ids["click"], {"stats": {"n": ""}})
    engine.clear_tags(ids["view"])
    engine.update_tags(ids["view"], {"kind": "view"})
    tags = [engine.get_tags(i) for i in ids.values()]
    return engine.store.local([(t["kind"], t.get("stats", {}).get("n", 0), t.get("mark")) for t in tags], "kind string, n long, mark string")


@query("engine_find", f"SELECT kind, n > 0 AS many FROM ({_KINDS}) WHERE kind >= 'e' AND kind <> 'view'")
def engine_find(spark, sf_dir) -> DataFrame:
    """Streams found by operators on their tags, and one left out by its id, which is no tag."""
    engine, ids = _engine(spark, sf_dir)
    found = engine.find_streams({"kind": {"gte": "e", "ne": "view"}}) + engine.find_streams({"stream_id": ids["view"]})
    return engine.store.local([(s["kind"], s["latest_datapoint"] is not None) for s in found], "kind string, many boolean")


@query(
    "engine_append",
    f"""SELECT stream_id AS kind, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC, seq DESC) AS r FROM ({EVN})) WHERE r <= 8""",
)
def engine_append(spark, sf_dir) -> DataFrame:
    """The last eight events of each kind: seven in one list, then one by itself; an older one is refused."""
    rows = events(spark, sf_dir, value=nulled())
    engine = Engine(spark, scratch(spark, "engine"))
    out = []
    for kind in sorted(r["stream_id"] for r in rows.select("stream_id").distinct().collect()):
        last = rows.where(F.col("stream_id") == kind).orderBy(F.desc("ts"), F.desc("seq")).limit(8).select(S("ts").alias("s"), "value").collect()[::-1]
        stream = engine.ensure_stream({"kind": kind}, {}, [], "seconds")
        points = [{"stream_id": stream, "value": r["value"], "timestamp": from_seconds(r["s"])} for r in last]
        engine.append_multiple(points[:7])
        engine.append(stream, points[7]["value"], points[7]["timestamp"])
        try:
            engine.append(stream, 0.0, from_seconds(last[0]["s"] - 1))
        except E.InvalidTimestamp:
            out += [(kind, to_seconds(p["t"]), p["v"]) for p in engine.get_data(stream, "seconds", start=_at(0))]
    return engine.store.local(out, "kind string, ts long, value double")


_LOW, _HIGH = 1704672000, 1705104000
_BOUNDS = {
    "start and end": ({"start": _LOW, "end": _HIGH}, f"ts >= {_LOW} AND ts <= {_HIGH}"),
    "both exclusive": ({"start_exclusive": _LOW, "end_exclusive": _HIGH}, f"ts > {_LOW} AND ts < {_HIGH}"),
    "open": ({"start": _LOW}, f"ts >= {_LOW}"),
    "turned round": ({"start": _HIGH, "end": _LOW}, "false"),
    "one second": ({"start": _LOW, "end_exclusive": _LOW}, "false"),
    "everything": ({"start": 0, "end": 2**31 - 1}, "true"),
    "behind the end": ({"start_exclusive": 2**31 - 1}, "false"),
}


@query(
    "engine_bounds",
    " UNION ALL ".join(f"SELECT '{name}' AS bounds, stream_id AS kind, count(*) FILTER (WHERE {where}) AS n FROM ({EVN}) GROUP BY 2" for name, (_, where) in _BOUNDS.items())
    + f" UNION ALL SELECT 'finer than stored', stream_id, count(*) FROM ({EVN}) GROUP BY 2 UNION ALL SELECT 'no downsamplers', stream_id, 0 FROM ({EVN}) GROUP BY 2",
)
def engine_bounds(spark, sf_dir) -> DataFrame:
    """Lengths of reads between all sorts of bounds, at a level finer than stored, and at one that has no aggregates."""
    engine, ids = _engine(spark, sf_dir, "minutes")
    out = []
    for kind, i in ids.items():
        for name, (limits, _) in _BOUNDS.items():
            out.append((name, kind, len(engine.get_data(i, "minutes", **{k: from_seconds(v) for k, v in limits.items()}))))
        out.append(("finer than stored", kind, len(engine.get_data(i, "seconds", start=_at(0)))))
        out.append(("no downsamplers", kind, len(engine.get_data(i, "hours", start=_at(0)))))
    return engine.store.local(out, "bounds string, kind string, n long")


@query(
    "engine_index",
    f"""SELECT stream_id AS kind, r - 1 AS place, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, seq) AS r FROM ({EVN}))
        WHERE r IN (1, 4, 11) OR r BETWEEN 31 AND 35""",
)
def engine_index(spark, sf_dir) -> DataFrame:
    """Single datapoints by their place, and a slice read batch by batch."""
    engine, ids = _engine(spark, sf_dir)
    out = []
    for kind, i in ids.items():
        data = engine.get_data(i, "seconds", start=_at(0))
        found = [(p, data[p]) for p in (0, 3, 10)] + list(enumerate(data.batch_size(2)[30:35], 30))
        out += [(kind, p, to_seconds(x["t"]), x["v"]) for p, x in found]
    return engine.store.local(out, "kind string, place long, ts long, value double")


@query(
    "engine_on_read",
    f"""WITH r AS ({shaped_sql(first_sql(21600, EVN), 21600, SAMPLE)}), b AS (SELECT stream_id, unnest(generate_series(min(bucket), max(bucket), 21600)) AS bucket FROM r GROUP BY 1)
    SELECT b.stream_id AS kind, b.bucket, coalesce(c, 0) AS c, round(m, 9) AS m, round(d, 6) AS d FROM b LEFT JOIN r USING (stream_id, bucket)""",
)
def engine_on_read(spark, sf_dir) -> DataFrame:
    """Buckets made when read, the newest included, without bounds that a caller gives beyond the start."""
    engine, ids = _engine(spark, sf_dir, "10minutes", ("mean", "std_dev"))
    engine.mode = "on_read"
    parts = [engine.get_data(i, "6hours", start=_at(0)).df.withColumn("kind", F.lit(kind)) for kind, i in ids.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", S("bucket").alias("bucket"), "v.c", F.round("v.m", 9).alias("m"), F.round("v.d", 6).alias("d"))


@query(
    "engine_late",
    f"""WITH n AS (SELECT stream_id, min(ts) AS lo, max(ts) - max(ts) % 86400 AS hi FROM ({EVN}) GROUP BY 1)
    SELECT n.stream_id AS kind, count(*) + 1 AS raw, count(value) FILTER (WHERE ts < hi)::BIGINT AS rolled FROM n JOIN ({EVN}) e USING (stream_id) GROUP BY 1, hi, lo""",
)
def engine_late(spark, sf_dir) -> DataFrame:
    """A datapoint that comes after its rollup is stored, and the rollup stays; later runs add only what is new."""
    engine, ids = _engine(spark, sf_dir, "hours", ("count",))
    engine.downsample_streams()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", E.DownsampleConsistencyNotGuaranteed)
        for i in ids.values():
            engine.append(i, 1.0, engine.get_tags(i)["earliest_datapoint"], check_timestamp=False)
    engine.downsample_streams()
    rolled = {r["stream_id"]: r["n"] for r in engine.store.rollups("days").groupBy("stream_id").agg(F.sum("v.c").alias("n")).collect()}
    rows = [(kind, len(engine.get_data(i, "hours", start=_at(0))), rolled.get(i, 0)) for kind, i in ids.items()]
    return engine.store.local(rows, "kind string, raw long, rolled long")


@query(
    "engine_filter",
    f"""WITH n AS (SELECT stream_id, min(ts) - min(ts) % 86400 AS lo, max(ts) - max(ts) % 86400 AS hi FROM ({EVN}) GROUP BY 1)
    SELECT stream_id AS kind, CASE WHEN stream_id = 'click' THEN least(hi, 1705276800) - lo ELSE 0 END // 86400 AS days FROM n""",
)
def engine_filter(spark, sf_dir) -> DataFrame:
    """Rollups of the streams that a filter lets through, until a given time."""
    engine, ids = _engine(spark, sf_dir, "6hours", ("count",))
    engine.downsample_streams(until=from_seconds(1705276800), filter_stream=lambda s: s["kind"] == "click")
    made = engine.store.rollups("days").join(_kinds(engine, ids), "stream_id", "right")
    return made.groupBy("kind").agg(F.count("bucket").alias("days"))


@query(
    "engine_backprocess",
    f"""WITH v AS (SELECT count(*) AS n FROM (SELECT value, lag(value) OVER w AS pv, lag(ts) OVER w AS pt, ts FROM ({EVN}) WHERE stream_id = 'click' WINDOW w AS (ORDER BY ts, seq))
        WHERE value IS NULL OR (pv IS NOT NULL AND ts <> pt))
    SELECT 'pending' AS state, 0 AS n UNION ALL SELECT 'done', n FROM v UNION ALL SELECT 'new only', 1""",
)
def engine_backprocess(spark, sf_dir) -> DataFrame:
    """A derived stream is empty while its sources' history waits, whole afterwards; one without it has only what comes later."""
    engine, ids = _engine(spark, sf_dir)
    rate = engine.ensure_stream({"kind": "rate"}, {}, [], "seconds", ids["click"], "derivative")
    out = [("pending", len(engine.get_data(rate, "seconds", start=_at(0))))]
    engine.backprocess_streams()
    engine.store_derived()
    out.append(("done", len(engine.get_data(rate, "seconds", start=_at(0)))))
    later = engine.ensure_stream({"kind": "later"}, {}, [], "seconds", ids["click"], "derivative", derive_backprocess=False)
    newest = engine.get_tags(ids["click"])["latest_datapoint"]
    engine.append_multiple([{"stream_id": ids["click"], "value": 1.0, "timestamp": newest + dt.timedelta(seconds=s)} for s in (10, 20)])
    return engine.store.local([*out, ("new only", len(engine.get_data(later, "seconds", start=_at(0))))], "state string, n long")


@query("engine_switch", f"SELECT 'first' AS folder, count(*) AS n FROM ({_KINDS}) UNION ALL SELECT 'second', 0 UNION ALL SELECT 'first again', count(*) FROM ({_KINDS})")
def engine_switch(spark, sf_dir) -> DataFrame:
    """One engine over two folders in turn."""
    engine, _ = _engine(spark, sf_dir)
    first, out = engine.store.root, [("first", len(engine.find_streams()))]
    engine.use(scratch(spark, "engine"))
    out.append(("second", len(engine.find_streams())))
    engine.use(first)
    return engine.store.local([*out, ("first again", len(engine.find_streams()))], "folder string, n long")


_MISUSES = {
    "no such stream": "StreamNotFound",
    "append to derived": "AppendToDerivedStreamNotAllowed",
    "unknown downsampler": "UnsupportedDownsampler",
    "unknown operator": "UnsupportedDeriveOperator",
    "unknown type": "UnsupportedValueType",
    "two sources": "InvalidOperatorArguments",
    "reserved tag": "ReservedTagNameError",
    "other type": "InconsistentStreamConfiguration",
    "several streams": "MultipleStreamsReturned",
    "needed": "OutstandingDependenciesError",
    "before 1970": "InvalidTimestamp",
}


@query("engine_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _MISUSES.items()) + ") AS t(misuse, error)")
def engine_errors(spark, sf_dir) -> DataFrame:
    """What the engine says to misuse."""
    engine, ids = _engine(spark, sf_dir)
    rate = engine.ensure_stream({"kind": "rate"}, {}, [], "seconds", ids["click"], "derivative")
    make = lambda tags, *more, **named: engine.ensure_stream(tags, {}, [], "seconds", *more, **named)
    engine.update_tags(ids["click"], {"twin": 1})
    engine.update_tags(ids["view"], {"twin": 1})
    tries = {
        "no such stream": lambda: engine.get_data("nowhere", "seconds", start=_at(0)),
        "append to derived": lambda: engine.append(rate, 1.0, _at(2_000_000_000)),
        "unknown downsampler": lambda: engine.ensure_stream({"kind": "x"}, {}, ["most"], "seconds"),
        "unknown operator": lambda: make({"kind": "x"}, ids["view"], "product"),
        "unknown type": lambda: make({"kind": "x"}, value_type="sound"),
        "two sources": lambda: make({"kind": "x"}, [ids["click"], ids["view"]], "derivative"),
        "reserved tag": lambda: engine.update_tags(ids["view"], {"stream_id": "x"}),
        "other type": lambda: make({"kind": "click"}, value_type="nominal"),
        "several streams": lambda: make({"twin": 1}),
        "needed": lambda: engine.delete_streams({"kind": "click"}),
        "before 1970": lambda: engine.append(ids["view"], 1.0, dt.datetime(1969, 1, 1, tzinfo=dt.timezone.utc)),
    }
    out = []
    for name, misuse in tries.items():
        try:
            misuse()
        except E.EngineError as wrong:
            out.append((name, type(wrong).__name__))
    return engine.store.local(out, "misuse string, error string")
