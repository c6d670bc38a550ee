"""Queries over the driver's tables, each with the same in SQL.

A stream is an event type (or user, or supplier), times are whole UTC seconds since 1970, and sums are made from
exact decimals, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OutstandingDependenciesError
from ..functions import tags
from ..functions.granularity import LEVELS, level, to_seconds
from ..operators import derive, extras, ranges, rollup, values
from ..sources.scratch import scratch
from ..streaming import derive as streaming_derive
from ..streaming import rollups as streaming_rollups
from .engine import Engine

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
S = F.unix_seconds


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, stream: str = "event_type", value: str | Column = "value") -> DataFrame:
    return rollup.points(table(spark, sf_dir, "events"), stream, "ts", value, "event_id")


def nulled() -> Column:
    return F.when(F.col("event_id") % 17 != 0, F.col("value"))


def flat(r: DataFrame, v: str = "csqlumd", t: str = "maz") -> DataFrame:
    return r.select(
        "stream_id",
        S("bucket").alias("bucket"),
        *[F.col(f"v.{k}").alias(k) for k in v],
        *[S(f"t.{k}").alias(f"t_{k}") for k in t],
    )


# SQL pieces. Seconds are floored before the cast, which would round.
SECOND = "cast(floor(epoch(ts)) AS BIGINT)"
EV = f"SELECT event_type AS stream_id, {SECOND} AS ts, event_id AS seq, value FROM events"
EVN = f"SELECT event_type AS stream_id, {SECOND} AS ts, event_id AS seq, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events"
STD = "CASE WHEN c = 0 OR s IS NULL OR q IS NULL THEN NULL WHEN c = 1 THEN 0.0 WHEN abs(q/c - (s/c)*(s/c)) < 1e-6 OR q/c - (s/c)*(s/c) < 0 THEN 0.0 ELSE sqrt(q/c - (s/c)*(s/c)) END"
SAMPLE = "CASE WHEN c = 0 OR s IS NULL OR q IS NULL THEN NULL WHEN c = 1 THEN 0.0 WHEN abs((q - s*s/c)/(c - 1)) < 1e-6 OR (q - s*s/c)/(c - 1) < 0 THEN 0.0 ELSE sqrt((q - s*s/c)/(c - 1)) END"


def first_sql(n: int, source: str = EV) -> str:
    """First level: sums by bucket, with tw and w for the mean time."""
    return f"""SELECT stream_id, ts - ts % {n} AS bucket, count(value) AS c,
        cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS s,
        cast(sum(cast(value AS DECIMAL(18,2)) * cast(value AS DECIMAL(18,2))) AS DOUBLE) AS q,
        min(value) AS l, max(value) AS u,
        sum(CASE WHEN value IS NOT NULL THEN ts ELSE 0 END)::BIGINT AS tw, count(value) AS w, min(ts) AS a, max(ts) AS z
        FROM ({source}) GROUP BY ALL"""


def shaped_sql(inner: str, n: int, deviation: str = STD) -> str:
    return f"""SELECT stream_id, bucket, c, s, q, l, u, CASE WHEN c > 0 THEN s / c END AS m, {deviation} AS d,
        CASE WHEN w > 0 THEN tw // w ELSE bucket + {n // 2} END AS t_m, a AS t_a, z AS t_z FROM ({inner})"""


def merge_sql(inner: str, n: int) -> str:
    """A coarser level from shaped rows of a finer one. Sums are of values with two (s) and four (q) decimals."""
    return f"""SELECT stream_id, bucket - bucket % {n} AS bucket, sum(c)::BIGINT AS c,
        cast(sum(cast(s AS DECIMAL(28,2))) AS DOUBLE) AS s, cast(sum(cast(q AS DECIMAL(28,4))) AS DOUBLE) AS q, min(l) AS l, max(u) AS u,
        sum(t_m * c)::BIGINT AS tw, sum(c)::BIGINT AS w, min(t_a) AS a, max(t_z) AS z FROM ({inner}) GROUP BY stream_id, bucket - bucket % {n}"""


# reads


@query("raw_range_incl", f"SELECT stream_id, ts, seq, value FROM ({EV}) WHERE ts >= 1704672000 AND ts <= 1705104000")
def raw_range_incl(spark, sf_dir):
    rows = ranges.in_range(events(spark, sf_dir), "seconds", "ts", start=_at(1704672000), end=_at(1705104000))
    return rows.select("stream_id", S("ts").alias("ts"), "seq", "value")


def _at(seconds: int):
    from ..functions.granularity import from_seconds

    return from_seconds(seconds)


@query("raw_range_excl", f"SELECT stream_id, ts, seq, value FROM ({EV}) WHERE ts > 1704672000 AND ts < 1705104000")
def raw_range_excl(spark, sf_dir):
    rows = ranges.in_range(events(spark, sf_dir), "seconds", "ts", start_exclusive=_at(1704672000), end_exclusive=_at(1705104000))
    return rows.select("stream_id", S("ts").alias("ts"), "seq", "value")


@query("raw_reverse_limit_offset", f"SELECT stream_id, ts, seq, value FROM ({EV}) WHERE stream_id = 'click' ORDER BY ts DESC, seq DESC LIMIT 50 OFFSET 20")
def raw_reverse_limit_offset(spark, sf_dir):
    rows = events(spark, sf_dir).where("stream_id = 'click'").orderBy(F.desc("ts"), F.desc("seq")).offset(20).limit(50)
    return rows.select("stream_id", S("ts").alias("ts"), "seq", "value")


@query("floor_all_granularities", "SELECT event_id, " + ", ".join(f'{SECOND} - {SECOND} % {g.seconds} AS "{g.key}_{g.seconds}"' for g in LEVELS) + " FROM events")
def floor_all_granularities(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", *[S(g.floor_column(ts)).alias(f"{g.key}_{g.seconds}") for g in LEVELS])


# rollups


def _rollup(name: str, short: str):
    n = level(name).seconds

    @query(f"rollup_{short}", shaped_sql(first_sql(n), n))
    def run(spark, sf_dir):
        return flat(rollup.first_level(events(spark, sf_dir), name, 2))


for _name, _short in (("10seconds", "10s"), ("minutes", "1m"), ("10minutes", "10m"), ("hours", "1h"), ("6hours", "6h"), ("days", "1d")):
    _rollup(_name, _short)


@query("rollup_1h_nulls", shaped_sql(first_sql(3600, EVN), 3600))
def rollup_1h_nulls(spark, sf_dir):
    return flat(rollup.first_level(events(spark, sf_dir, value=nulled()), "hours", 2))


_SPINE = "SELECT stream_id, unnest(generate_series(min(bucket), max(bucket), 3600)) AS bucket FROM r GROUP BY stream_id"


@query(
    "rollup_1h_gapfill",
    f"""WITH r AS ({shaped_sql(first_sql(3600), 3600)})
    SELECT b.stream_id, b.bucket, coalesce(c, 0) AS c, s, q, l, u, m, d,
        coalesce(t_m, b.bucket + 1800) AS t_m, coalesce(t_a, b.bucket + 1800) AS t_a, coalesce(t_z, b.bucket + 1800) AS t_z
    FROM ({_SPINE}) b LEFT JOIN r USING (stream_id, bucket)""",
)
def rollup_1h_gapfill(spark, sf_dir):
    return flat(rollup.gap_filled(rollup.first_level(events(spark, sf_dir), "hours", 2), "hours"))


def _cascade_sql() -> str:
    inner = shaped_sql(first_sql(10), 10)
    for n in (60, 600, 3600):
        inner = shaped_sql(merge_sql(inner, n), n)
    return inner


@query("rollup_cascade_1h_timemean", f"SELECT stream_id, bucket, c, l, u, t_m, t_a, t_z FROM ({_cascade_sql()})")
def rollup_cascade_1h_timemean(spark, sf_dir):
    now = rollup.first_level(events(spark, sf_dir), "10seconds", 2)
    for name in ("minutes", "10minutes", "hours"):
        now = rollup.merge_level(now, name)
    return flat(now, "clu")


@query(
    "rollup_closed_only",
    f"""WITH e AS ({EV}), n AS (SELECT stream_id, max(ts) - max(ts) % 3600 AS hi FROM e GROUP BY 1)
    SELECT r.* FROM ({shaped_sql(first_sql(3600), 3600)}) r JOIN n USING (stream_id) WHERE r.bucket < n.hi""",
)
def rollup_closed_only(spark, sf_dir):
    raw = events(spark, sf_dir)
    newest = raw.groupBy("stream_id").agg(F.max("ts").alias("newest"))
    return flat(rollup.closed(rollup.first_level(raw, "hours", 2), "hours", newest))


@query(
    "rollup_levels_counts",
    f"""WITH e AS ({EV}), n AS (SELECT stream_id, min(ts) AS lo, max(ts) AS hi FROM e GROUP BY 1)
    SELECT stream_id, g AS seconds, cast((hi - hi % g - (lo - lo % g)) // g AS BIGINT) AS buckets
    FROM n, (SELECT unnest([3600, 21600, 86400]) AS g)""",
)
def rollup_levels_counts(spark, sf_dir):
    """Rows of each level of the gap-filled cascade, from hours on."""
    levels = rollup.cascade(events(spark, sf_dir), "10minutes", exact_scale=2)
    counts = [made.groupBy("stream_id").agg(F.count(F.lit(1)).alias("buckets")).withColumn("seconds", F.lit(level(name).seconds)) for name, made in levels.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.select("stream_id", "seconds", "buckets")


#: Without exact decimals, as the engine computes, sums depend on the order of rows, by less than is rounded away.
_ROUNDED = ["stream_id", "bucket", "c", "round(s, 4) AS s", "round(q, 6) AS q", "l", "u", "round(m, 9) AS m", "t_m", "t_a", "t_z"]


@query("rollup_1h_double", f"SELECT {', '.join(_ROUNDED)} FROM ({shaped_sql(first_sql(3600, EVN), 3600)})")
def rollup_1h_double(spark, sf_dir):
    return flat(rollup.first_level(events(spark, sf_dir, value=nulled()), "hours"), "csqlum").selectExpr(*_ROUNDED)


@query("rollup_cascade_6h_double", f"SELECT {', '.join(_ROUNDED)} FROM ({shaped_sql(merge_sql(shaped_sql(first_sql(3600, EVN), 3600), 21600), 21600)})")
def rollup_cascade_6h_double(spark, sf_dir):
    hours = rollup.first_level(events(spark, sf_dir, value=nulled()), "hours")
    return flat(rollup.merge_level(hours, "6hours"), "csqlum").selectExpr(*_ROUNDED)


@query("rollup_on_read_1h", f"SELECT stream_id, bucket, c, s, q, l, u, m, d, bucket AS t_m FROM ({shaped_sql(first_sql(3600), 3600, SAMPLE)})")
def rollup_on_read_1h(spark, sf_dir):
    return flat(rollup.on_read(events(spark, sf_dir), "hours", gaps=False, exact_scale=2), t="m")


@query("rollup_projected", f"SELECT stream_id, bucket, m, u, t_z FROM ({shaped_sql(first_sql(86400), 86400)})")
def rollup_projected(spark, sf_dir):
    r = rollup.first_level(events(spark, sf_dir), "days", 2)
    return flat(ranges.projected(r, ["mean", "max"], ["last"]), "mu", "z")


@query("rollup_count_nominal", f"SELECT user_id::VARCHAR AS stream_id, {SECOND} - {SECOND} % 86400 AS bucket, count(event_type) AS c FROM events GROUP BY ALL")
def rollup_count_nominal(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("stream_id"),
        F.timestamp_seconds(S(F.col("ts").cast("timestamp"))).alias("ts"),
        F.col("event_id").alias("seq"),
        F.lit(None).cast("double").alias("value"),
        F.col("event_type").alias("value_json"),
        F.lit(None).cast(rollup.AGG).alias("agg"),
    )
    return flat(rollup.first_level(raw, "days"), "c", "")


@query(
    "preaggregated_merge",
    """SELECT l_suppkey::VARCHAR AS stream_id, d - d % 86400 AS bucket, count(*) AS c, cast(sum(cast(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s,
        min(l_quantity) AS l, max(l_quantity) AS u
    FROM (SELECT *, cast(floor(epoch(l_shipdate)) AS BIGINT) AS d FROM lineitem) GROUP BY ALL""",
)
def preaggregated_merge(spark, sf_dir):
    """Points that are themselves aggregates (one for each order line group) roll up like their rows."""
    q = F.col("l_quantity").cast("decimal(18,2)")
    parts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate", "l_returnflag").agg(
        F.count("l_quantity").alias("c"), F.sum(q).cast("double").alias("s"), F.sum(q * q).cast("double").alias("q"), F.min("l_quantity").alias("l"), F.max("l_quantity").alias("u")
    )
    null = F.lit(None).cast("double")
    raw = parts.select(
        F.col("l_suppkey").cast("string").alias("stream_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("seq"),
        null.alias("value"), F.lit(None).cast("string").alias("value_json"), F.struct("c", "s", "q", "l", "u", null.alias("m"), null.alias("d")).alias("agg"),
    )
    return flat(rollup.first_level(raw, "days"), "cslu", "")


# derived streams


def _pair(spark, sf_dir, value="value", first="click", second="view") -> DataFrame:
    raw = events(spark, sf_dir, value=value)
    return derive.tagged([raw.where(F.col("stream_id") == first), raw.where(F.col("stream_id") == second)], "both")


def _out(df: DataFrame) -> DataFrame:
    return df.select("stream_id", S("ts").alias("ts"), "seq", "value")


def _fold_sql(first: str, second: str, n: int, name: str) -> str:
    """Two sources in buckets of `n` seconds, row by row: the last value of each counts until both are there."""
    return f"""WITH RECURSIVE c AS (
        SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ts, ord, seq) AS rn
        FROM (SELECT ts - ts % {n} AS bucket, ts, 0 AS ord, seq, value FROM ({first}) UNION ALL SELECT ts - ts % {n}, ts, 1, seq, value FROM ({second}))
    ), f AS (
        SELECT bucket, rn, ord = 0 AS h0, ord = 1 AS h1, CASE WHEN ord = 0 THEN value END AS v0, CASE WHEN ord = 1 THEN value END AS v1,
            CASE WHEN ord = 0 THEN seq END AS s0, CASE WHEN ord = 1 THEN seq END AS s1, false AS made FROM c WHERE rn = 1
        UNION ALL
        SELECT bucket, rn, n0 AND NOT n1, n1 AND NOT n0, v0, v1, s0, s1, n0 AND n1 FROM (
            SELECT c.bucket, c.rn, ord = 0 OR h0 AS n0, ord = 1 OR h1 AS n1,
                CASE WHEN ord = 0 THEN value ELSE v0 END AS v0, CASE WHEN ord = 1 THEN value ELSE v1 END AS v1,
                CASE WHEN ord = 0 THEN seq ELSE s0 END AS s0, CASE WHEN ord = 1 THEN seq ELSE s1 END AS s1
            FROM f JOIN c ON c.bucket = f.bucket AND c.rn = f.rn + 1)
    ) SELECT '{name}' AS stream_id, bucket AS ts, greatest(s0, s1) AS seq, CASE WHEN v0 IS NOT NULL OR v1 IS NOT NULL THEN coalesce(v0, 0) + coalesce(v1, 0) END AS value
    FROM f WHERE made"""


def _sum_sql(source: str, n: int) -> str:
    return _fold_sql(f"SELECT * FROM ({source}) WHERE stream_id = 'click'", f"SELECT * FROM ({source}) WHERE stream_id = 'view'", n, "both")


@query("derive_sum", _sum_sql(EV, 3600))
def derive_sum(spark, sf_dir):
    return _out(derive.aligned_sum(_pair(spark, sf_dir), 2, "hours"))


@query("derive_sum_nulls", _sum_sql(EVN, 3600))
def derive_sum_nulls(spark, sf_dir):
    return _out(derive.aligned_sum(_pair(spark, sf_dir, nulled()), 2, "hours"))


@query("derive_sum_folded", _sum_sql(EV, 86400))
def derive_sum_folded(spark, sf_dir):
    """Many rows of a source in a bucket of a day: each complete set gives a row."""
    return _out(derive.aligned_sum(_pair(spark, sf_dir), 2, "days"))


@query(
    "derive_sum_10m",
    f"""WITH r AS ({shaped_sql(first_sql(600), 600)})
    SELECT 'both' AS stream_id, t_z - t_z % 600 AS ts, sum(0)::BIGINT AS seq, max(CASE WHEN stream_id = 'click' THEN m END) + max(CASE WHEN stream_id = 'view' THEN m END) AS value
    FROM r WHERE stream_id IN ('click', 'view') GROUP BY 1, 2 HAVING count(DISTINCT stream_id) = 2""",
)
def derive_sum_10m(spark, sf_dir):
    return _out(derive.aligned_sum(_two_rollups(rollup.first_level(events(spark, sf_dir), "10minutes", 2)), 2, "10minutes"))


def _two_rollups(r: DataFrame) -> DataFrame:
    return derive.tagged([derive.from_rollup(r.where("stream_id = 'click'")), derive.from_rollup(r.where("stream_id = 'view'"))], "both")


def _derivative_sql(source: str) -> str:
    return f"""SELECT stream_id, ts, seq, CASE WHEN value IS NOT NULL THEN (value - pv) / (ts - pt) END AS value FROM (
        SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM ({source}) WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq))
        WHERE value IS NULL OR (pv IS NOT NULL AND ts <> pt)"""


@query("derive_derivative", _derivative_sql(EV))
def derive_derivative(spark, sf_dir):
    return _out(derive.derivative(events(spark, sf_dir)))


@query("derive_derivative_nulls", _derivative_sql(EVN))
def derive_derivative_nulls(spark, sf_dir):
    return _out(derive.derivative(events(spark, sf_dir, value=nulled())))


def _reset_sql(source: str) -> str:
    return f"""SELECT stream_id, ts, seq, 1.0::DOUBLE AS value FROM (
        SELECT *, lag(value) OVER (PARTITION BY stream_id ORDER BY ts, seq) AS pv FROM ({source}) WHERE value IS NOT NULL) WHERE pv > value"""


@query("derive_counter_reset", _reset_sql(EVN))
def derive_counter_reset(spark, sf_dir):
    return _out(derive.counter_reset(events(spark, sf_dir, value=nulled())))


def _counters(spark, sf_dir) -> DataFrame:
    """Resets of the stream of clicks, and the stream of views as a counter."""
    raw = events(spark, sf_dir, value=nulled())
    resets = derive.counter_reset(raw.where("stream_id = 'click'"))
    return derive.tagged([resets, raw.where("stream_id = 'view'")], "rate")


def _counter_sql(top: str) -> str:
    return f"""WITH resets AS ({_reset_sql(EVN)}), ev AS (
        SELECT ts, seq, value, 0 AS ord FROM resets WHERE stream_id = 'click' UNION ALL SELECT ts, seq, value, 1 FROM ({EVN}) WHERE stream_id = 'view'
    ), seen AS (
        SELECT *, lag(ord) OVER w AS pk, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM ev
        WHERE ord = 1 OR value IS NULL OR value <> 0 WINDOW w AS (ORDER BY ts, ord, seq)
    ), delta AS (SELECT *, CASE WHEN value < pv THEN {top} ELSE value - pv END AS delta FROM seen)
    SELECT 'rate' AS stream_id, ts, seq, CASE WHEN value IS NOT NULL THEN delta / (ts - pt) END AS value FROM delta
    WHERE value IS NULL OR (ord = 1 AND pk = 1 AND pv IS NOT NULL AND ts <> pt AND delta IS NOT NULL)"""


@query("derive_counter_derivative", _counter_sql("NULL::DOUBLE"))
def derive_counter_derivative(spark, sf_dir):
    return _out(derive.counter_derivative(_counters(spark, sf_dir)))


@query("derive_counter_derivative_max", _counter_sql("256.0::DOUBLE - pv + value"))
def derive_counter_derivative_max(spark, sf_dir):
    return _out(derive.counter_derivative(_counters(spark, sf_dir), 256))


@query("derive_chain", _fold_sql(f"SELECT * FROM ({_derivative_sql(EV)}) WHERE stream_id = 'click'", f"SELECT * FROM ({EV}) WHERE stream_id = 'view'", 3600, "chain"))
def derive_chain(spark, sf_dir):
    """A sum of one stream's derivative and another stream, by hours."""
    raw = events(spark, sf_dir)
    rate = derive.derivative(raw.where("stream_id = 'click'"))
    return _out(derive.aligned_sum(derive.tagged([rate, raw.where("stream_id = 'view'")], "chain"), 2, "hours"))


@query("rollup_of_derived", f"SELECT stream_id, ts - ts % 86400 AS bucket, count(value) AS c, min(ts) AS t_a, max(ts) AS t_z FROM ({_reset_sql(EV)}) GROUP BY ALL")
def rollup_of_derived(spark, sf_dir):
    resets = derive.counter_reset(events(spark, sf_dir)).withColumns({"value_json": F.lit(None).cast("string"), "agg": F.lit(None).cast(rollup.AGG)})
    return flat(rollup.first_level(resets, "days"), "c", "az")


# catalog


def _streams(spark, sf_dir) -> DataFrame:
    """One stream a user; its tags are made from the user's events."""
    e = table(spark, sf_dir, "events")
    made = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("low"), F.array_sort(F.collect_set("event_type")).alias("types"))
    tag = F.to_json(F.struct(F.concat(F.lit("User "), F.col("user_id")).alias("title"), F.struct("n", "low").alias("stats"), "types"))
    return made.select("user_id", tag.alias("tags"))


_STREAMS_SQL = "SELECT user_id, count(*) AS n, min(event_type) AS low, list_sort(list_distinct(list(event_type))) AS types FROM events GROUP BY 1"


@query("stream_catalog_find", f"SELECT user_id FROM ({_STREAMS_SQL}) WHERE low = 'click' AND list_contains(types, 'view')")
def stream_catalog_find(spark, sf_dir):
    return _streams(spark, sf_dir).where(tags.matches({"stats": {"low": "click"}, "types": "view"}, F.col("tags"))).select("user_id")


@query(
    "stream_catalog_ops",
    f"""SELECT user_id, lower('User ' || user_id) = 'user 7' AS iexact, contains(lower('User ' || user_id), 'r 1') AS icontains, n >= 12 AS gte, n > 12 AS gt,
        low IN ('click', 'purchase') AS in_, list_has_all(types, ['click', 'view']) AS all_, list_has_all(types, ['view']) AND low = 'click' AS contained FROM ({_STREAMS_SQL})""",
)
def stream_catalog_ops(spark, sf_dir):
    m = lambda q: tags.matches(q, F.col("tags"))
    return _streams(spark, sf_dir).select(
        "user_id",
        m({"title": {"iexact": "USER 7"}}).alias("iexact"),
        m({"title": {"icontains": "R 1"}}).alias("icontains"),
        m({"stats": {"n": {"gte": 12}}}).alias("gte"),
        m({"stats": {"n": {"gt": 12}}}).alias("gt"),
        m({"stats": {"low": {"in": ["click", "purchase"]}}}).alias("in_"),
        m({"types": {"all": ["click", "view"]}}).alias("all_"),
        tags.contains({"stats": {"low": "click"}, "types": ["view"]}, F.col("tags")).alias("contained"),
    )


@query("stream_props_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::DOUBLE >= 50")
def stream_props_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(tags.matches({"k": {"gte": 50}}, F.col("props"))).select("event_id")


# the engine itself


def _engine(spark, sf_dir, highest: str = "seconds", downsamplers: tuple = ()) -> tuple[Engine, dict[str, str]]:
    """An engine with a stream for each type of event, and the streams' ids by type."""
    engine = Engine(spark, scratch(spark, "engine"))
    rows = events(spark, sf_dir, value=nulled())
    kinds = sorted(r["stream_id"] for r in rows.select("stream_id").distinct().collect())
    ids = {k: engine.ensure_stream({"kind": k}, {}, list(downsamplers), highest) for k in kinds}
    named = engine.store.local(list(ids.items()), "kind string, id string")
    at = rows.join(F.broadcast(named), F.col("stream_id") == F.col("kind"))
    engine.append_frame(at.select(F.col("id").alias("stream_id"), "ts", "seq", "value"))
    return engine, ids


def _kinds(engine: Engine, ids: dict[str, str]) -> DataFrame:
    return engine.store.local([(v, k) for k, v in ids.items()], "stream_id string, kind string")


@query("earliest_latest", f"SELECT stream_id AS kind, min(ts) AS earliest, max(ts) AS latest FROM ({EV}) GROUP BY 1")
def earliest_latest(spark, sf_dir):
    """Times of the first and last datapoint, as tags say."""
    engine, _ = _engine(spark, sf_dir)
    rows = [(s["kind"], to_seconds(s["earliest_datapoint"]), to_seconds(s["latest_datapoint"])) for s in engine.find_streams()]
    return engine.store.local(rows, "kind string, earliest long, latest long")


@query("stream_count", f"SELECT stream_id AS kind, count(*) AS n, count(value) AS values FROM ({EVN}) GROUP BY 1")
def stream_count(spark, sf_dir):
    """Lengths of reads."""
    engine, ids = _engine(spark, sf_dir)
    read = {k: engine.get_data(i, "seconds", start=_at(0)) for k, i in ids.items()}
    return engine.store.local([(k, len(d), d.df.where("value is not null").count()) for k, d in read.items()], "kind string, n long, values long")


@query("engine_reverse_slice", f"SELECT stream_id AS kind, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC, seq DESC) AS r FROM ({EVN}) WHERE ts >= 1704672000) WHERE r > 20 AND r <= 70")
def engine_reverse_slice(spark, sf_dir):
    """A slice of each stream, newest first, as the engine's reads give it."""
    engine, ids = _engine(spark, sf_dir)
    rows = [(k, to_seconds(p["t"]), p["v"]) for k, i in ids.items() for p in engine.get_data(i, "seconds", start=_at(1704672000), reverse=True)[20:70]]
    return engine.store.local(rows, "kind string, ts long, value double")


@query(
    "engine_rollup_6h",
    f"""WITH n AS (SELECT stream_id, min(ts) - min(ts) % 21600 AS lo, max(ts) - max(ts) % 21600 AS hi FROM ({EVN}) GROUP BY 1),
        r AS ({shaped_sql(merge_sql(shaped_sql(first_sql(3600, EVN), 3600), 21600), 21600)}),
        b AS (SELECT stream_id, unnest(generate_series(lo, hi - 1, 21600)) AS bucket FROM n)
    SELECT b.stream_id AS kind, b.bucket, coalesce(c, 0) AS c, round(s, 4) AS s, l, u FROM b LEFT JOIN r USING (stream_id, bucket)""",
)
def engine_rollup_6h(spark, sf_dir):
    """Two levels that downsample_streams has written, run twice."""
    engine, ids = _engine(spark, sf_dir, "10minutes", ("sum", "min", "max"))
    engine.downsample_streams()
    engine.downsample_streams()
    made = engine.store.rollups("6hours").join(_kinds(engine, ids), "stream_id")
    return made.select("kind", S("bucket").alias("bucket"), "v.c", F.round("v.s", 4).alias("s"), "v.l", "v.u")


def _derived(engine: Engine, ids: dict[str, str]) -> dict[str, str]:
    both = engine.ensure_stream({"kind": "both"}, {}, [], "seconds", [ids["click"], ids["view"]], "sum")
    rate = engine.ensure_stream({"kind": "rate"}, {}, [], "seconds", ids["purchase"], "derivative")
    return ids | {"both": both, "rate": rate, "change": engine.ensure_stream({"kind": "change"}, {}, [], "seconds", both, "derivative")}


@query("dependents_semi_join", "SELECT * FROM (VALUES ('click', 'both'), ('view', 'both'), ('purchase', 'rate'), ('both', 'change')) AS t(source, dependent)")
def dependents_semi_join(spark, sf_dir):
    """Which streams are derived from which, as tags say."""
    engine, ids = _engine(spark, sf_dir)
    _derived(engine, ids)
    found = engine.find_streams()
    kinds = {s["stream_id"]: s["kind"] for s in found}
    return engine.store.local([(s["kind"], kinds[d]) for s in found for d in s.get("contributes_to", [])], "source string, dependent string")


@query(
    "delete_anti_join",
    f"""SELECT stream_id AS kind, count(*) AS n, stream_id IN ('click', 'view') AS refused FROM ({EVN}) WHERE stream_id <> 'purchase' GROUP BY 1
    UNION ALL SELECT 'both', (SELECT count(*) FROM ({_fold_sql(f"SELECT * FROM ({EVN}) WHERE stream_id = 'click'", f"SELECT * FROM ({EVN}) WHERE stream_id = 'view'", 1, "both")})), false""",
)
def delete_anti_join(spark, sf_dir):
    """What is left when a stream goes with its dependents, compacted, and what cannot go since others need it."""
    engine, ids = _engine(spark, sf_dir)
    every, refused = _derived(engine, ids), set()
    engine.backprocess_streams()
    for kind in ("change", "rate", "purchase", "click", "view"):
        try:
            engine.delete_streams({"kind": kind})
        except OutstandingDependenciesError:
            refused.add(kind)
    engine.compact()
    rows = [(s["kind"], len(engine.get_data(every[s["kind"]], "seconds", start=_at(0))), s["kind"] in refused) for s in engine.find_streams()]
    return engine.store.local(rows, "kind string, n long, refused boolean")


# extensions


@query("median_1h", f"SELECT stream_id, ts - ts % 3600 AS bucket, median(value) AS median FROM ({EV}) GROUP BY ALL")
def median_1h(spark, sf_dir):
    return extras.median(events(spark, sf_dir), "hours").select("stream_id", S("bucket").alias("bucket"), "median")


def _nominal(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).cast("string").alias("stream_id"), F.timestamp_seconds(S(F.col("ts").cast("timestamp"))).alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("value_json"))


_FREQ = f"SELECT (user_id % 50)::VARCHAR AS stream_id, {SECOND} - {SECOND} % 86400 AS bucket, event_type AS value, count(*) AS n FROM events GROUP BY ALL"


@query("frequencies", _FREQ)
def frequencies(spark, sf_dir):
    finer = extras.frequencies(_nominal(spark, sf_dir), "hours")
    return extras.merged_frequencies(finer, "days").select("stream_id", S("bucket").alias("bucket"), "value", "n")


def _extreme(name: str, order: str):
    @query(name, f"SELECT stream_id, bucket, value AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, bucket ORDER BY {order}, value) AS r FROM ({_FREQ})) WHERE r = 1")
    def run(spark, sf_dir):
        counts = extras.frequencies(_nominal(spark, sf_dir), "days")
        return extras.extremes(counts).select("stream_id", S("bucket").alias("bucket"), name)


_extreme("most_often", "n DESC")
_extreme("least_often", "n")


@query(
    "interval_stats",
    f"""WITH g AS (SELECT stream_id, ts, ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, seq) AS gap FROM ({EV}))
    SELECT stream_id, ts - ts % 86400 AS bucket, sum(gap)::BIGINT / count(gap) AS intervals_mean, min(gap) AS intervals_min, max(gap) AS intervals_max,
        sum(gap * gap)::BIGINT AS intervals_sum_squares,
        sqrt(greatest(sum(gap * gap)::BIGINT / count(gap) - (sum(gap)::BIGINT / count(gap)) * (sum(gap)::BIGINT / count(gap)), 0.0)) AS intervals_std_dev
    FROM g WHERE gap IS NOT NULL GROUP BY 1, 2""",
)
def interval_stats(spark, sf_dir):
    return extras.interval_stats(events(spark, sf_dir), "days").withColumn("bucket", S("bucket"))


@query("graph_validate")
def graph_validate(spark, sf_dir):
    """Orders as graphs: the customer and the order are vertices; odd orders name a vertex that is not there."""
    o = table(spark, sf_dir, "orders")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ids = F.array(F.struct(name("c", "o_custkey").alias("i")), F.struct(name("o", "o_orderkey").alias("i")))
    target = F.when(F.col("o_orderkey") % 2 == 0, name("o", "o_orderkey")).otherwise(F.lit("nowhere"))
    edges = F.array(F.struct(name("c", "o_custkey").alias("f"), target.alias("t")))
    graphs = o.select("o_orderkey", F.struct(ids.alias("v"), edges.alias("e")).alias("graph"))
    return graphs.select("o_orderkey", values.graph_errors(F.col("graph")).alias("error"))


ORACLE["graph_validate"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN 'an edge names an unknown vertex' END AS error FROM orders"


@query("high_accuracy_sum", "SELECT stream_id, ts - ts % 86400 AS bucket, count(*) AS count, sum(cast(value AS DECIMAL(18,2)))::DECIMAL(38,2)::VARCHAR AS sum FROM (" + EV + ") GROUP BY ALL")
def high_accuracy_sum(spark, sf_dir):
    raw = events(spark, sf_dir).withColumn("value_json", F.col("value").cast("decimal(18,2)").cast("string"))
    made = values.exact_sums(raw, level("days").floor_column(F.col("ts")))
    return made.select("stream_id", S("bucket").alias("bucket"), "count", F.col("sum").cast("decimal(38,2)").cast("string").alias("sum"))


# streaming


def _live(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    fields = table(spark, sf_dir, "events").schema
    # As a pattern, the path may be one file or a folder of files.
    live = spark.readStream.schema(fields).parquet(path[:-1] + "[t]")
    return live.select(F.col("event_type").alias("stream_id"), F.timestamp_seconds(S(F.col("ts").cast("timestamp"))).alias("ts"), F.col("event_id").alias("seq"), F.col("value").cast("decimal(18,2)").alias("value"))


def _ran(spark, rows: DataFrame) -> DataFrame:
    out = scratch(spark, "stream")
    streaming_rollups.into_table(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query(
    "stream_rollup",
    f"""SELECT * FROM ({shaped_sql(merge_sql(shaped_sql(first_sql(600), 600), 3600), 3600)}) WHERE bucket + 3600 <= (SELECT max(ts) - 10 FROM ({EV}))""",
)
def stream_rollup(spark, sf_dir):
    rows = _ran(spark, streaming_rollups.chained(_live(spark, sf_dir), ["10minutes", "hours"]))
    values = [F.col(k).cast("long" if k == "c" else "double").alias(k) for k in "csqlumd"]
    return rows.select("stream_id", S("bucket").alias("bucket"), *values, *[S(k).alias(k) for k in ("t_m", "t_a", "t_z")])


def _stateful(spark, made: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a streaming plan with state of its own, which the RocksDB store keeps."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        rows = _ran(spark, made())
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return rows.select("stream_id", S("ts").alias("ts"), "value")


def _live_doubles(spark, sf_dir, nulls: bool = False) -> DataFrame:
    value = F.col("value").cast("double")
    return _live(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 17 != 0, value) if nulls else value)


def _live_pair(spark, sf_dir, first: str, second: str, name: str) -> DataFrame:
    """Two live streams as sources 0 and 1 of a derived one, with nulls."""
    kind = F.col("stream_id")
    rows = _live_doubles(spark, sf_dir, True).where(kind.isin(first, second))
    return rows.withColumn("ord", F.when(kind == first, 0).otherwise(1)).withColumn("stream_id", F.lit(name))


@query("stream_derivative", f"SELECT stream_id, ts, value FROM ({_derivative_sql(EVN)})")
def stream_derivative(spark, sf_dir):
    return _stateful(spark, lambda: streaming_derive.derivative(_live_doubles(spark, sf_dir, True)))


@query("stream_counter_reset", f"SELECT stream_id, ts, value FROM ({_reset_sql(EVN)})")
def stream_counter_reset(spark, sf_dir):
    return _stateful(spark, lambda: streaming_derive.counter_reset(_live_doubles(spark, sf_dir, True)))


@query(
    "stream_counter_derivative",
    f"""WITH ev AS (SELECT ts, seq, value, CASE WHEN stream_id = 'click' THEN 0 ELSE 1 END AS ord FROM ({EVN}) WHERE stream_id IN ('click', 'view')),
    seen AS (SELECT *, lag(ord) OVER w AS pk, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM ev
        WHERE ord = 1 OR value IS NULL OR value <> 0 WINDOW w AS (ORDER BY ts, ord, seq)),
    delta AS (SELECT *, CASE WHEN value < pv THEN 256.0::DOUBLE - pv + value ELSE value - pv END AS delta FROM seen)
    SELECT 'rate' AS stream_id, ts, CASE WHEN value IS NOT NULL THEN delta / (ts - pt) END AS value FROM delta
    WHERE value IS NULL OR (ord = 1 AND pk = 1 AND pv IS NOT NULL AND ts <> pt)""",
)
def stream_counter_derivative(spark, sf_dir):
    """Clicks that are not 0 or null reset the rate of views."""
    return _stateful(spark, lambda: streaming_derive.counter_derivative(_live_pair(spark, sf_dir, "click", "view", "rate"), 256.0))


@query("stream_sum", f"SELECT stream_id, ts, value FROM ({_sum_sql(EVN, 3600)})")
def stream_sum(spark, sf_dir):
    return _stateful(spark, lambda: streaming_derive.aligned_sum(_live_pair(spark, sf_dir, "click", "view", "both"), 2, "hours"))
