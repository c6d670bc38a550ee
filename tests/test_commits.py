"""Commits of the store: runs that die, writers that meet, deletion, compaction, warnings."""

import datetime as dt
import warnings

import pytest
from pyspark.sql import functions as F

from chronomill import errors as E
from chronomill.operators import derive, rollup
from chronomill.plans.engine import Engine
from chronomill.sources.store import Contended, Store
from chronomill.streaming.rollups import monotonic_sink

T0 = dt.datetime(2000, 1, 1, 12, tzinfo=dt.timezone.utc)
POINTS = "stream_id string, ts timestamp, value double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


@pytest.fixture
def engine(spark, folder):
    return Engine(spark, folder)


def make(engine, name="a", downsamplers=("count", "sum"), **more):
    return engine.ensure_stream({"name": name}, {}, list(downsamplers), "seconds", **more)


def fill(engine, stream, seconds):
    engine.append_multiple([{"stream_id": stream, "value": float(s), "timestamp": at(s)} for s in seconds])


def counts(engine, stream, g):
    return [r["v"]["c"] for r in engine.get_data(stream, g, start=T0)]


def dies(*args, **kwargs):
    raise RuntimeError("the driver is gone")


def test_a_rollup_that_dies_is_taken_up_without_counting_twice(engine, spark, folder, monkeypatch):
    stream = make(engine)
    fill(engine, stream, range(0, 130, 5))
    monkeypatch.setattr(engine.store, "commit", dies)
    with pytest.raises(RuntimeError):
        engine.downsample_streams()
    assert counts(Engine(spark, folder), stream, "10seconds") == []
    # The second level dies after the first has been committed.
    second = Engine(spark, folder)
    commit, done = second.store.commit, []
    monkeypatch.setattr(second.store, "commit", lambda *a, **k: done.append(commit(*a, **k)) if not done else dies())
    with pytest.raises(RuntimeError):
        second.downsample_streams()
    third = Engine(spark, folder)
    assert counts(third, stream, "10seconds") == [2] * 12 and counts(third, stream, "minutes") == []
    third.downsample_streams()
    third.downsample_streams()
    assert counts(third, stream, "10seconds") == [2] * 12 and counts(third, stream, "minutes") == [12, 12]


def test_an_append_that_dies_leaves_nothing(engine, monkeypatch):
    stream = make(engine)
    fill(engine, stream, [1])
    monkeypatch.setattr(engine.store, "stage", dies)
    with pytest.raises(E.StreamAppendFailed):
        fill(engine, stream, [2])
    monkeypatch.undo()
    assert engine.get_tags(stream)["latest_datapoint"] == at(1) and len(engine.get_data(stream, "seconds", start=T0)) == 1


def test_sequence_numbers_never_fall(engine, spark):
    gone, stays = make(engine, "gone"), make(engine, "stays")
    fill(engine, gone, [1, 2, 3])
    fill(engine, stays, [1])
    before = engine.store.refresh().next_seq
    engine.delete_streams({"name": "gone"})
    engine.compact()
    assert engine.store.points().count() == 1 and len(engine.store.runs("points")) == 1
    late = make(engine, "late", (), derive_from=stays, derive_op="derivative", derive_backprocess=False)
    fill(engine, stays, [5, 9])
    assert engine.store.refresh().next_seq > before
    assert [r["seq"] for r in engine.points(engine.catalog.get(stays)).orderBy("seq").collect()] == sorted({r["seq"] for r in engine.store.points().collect()})
    assert [p["v"] for p in engine.get_data(late, "seconds", start=T0)] == [1.0]
    with pytest.raises(E.StreamNotFound):
        engine.get_tags(gone)


def test_numbers_of_many_partitions_keep_the_order_of_batches(engine, spark):
    stream = make(engine)
    for value in (0, 1):
        rows = spark.range(600, numPartitions=150).select(F.lit(stream).alias("stream_id"), F.lit(at(0)).alias("ts"), F.lit(float(value)).alias("value"))
        engine.append_frame(rows)
    assert [p["v"] for p in engine.get_data(stream, "seconds", start=T0)] == [0.0] * 600 + [1.0] * 600
    assert engine.store.points().select("seq").distinct().count() == 1200


def test_two_engines_share_a_folder(engine, spark, folder, monkeypatch):
    other = Engine(spark, folder)
    stream = make(engine)
    assert make(other) == stream
    fill(engine, stream, [1])
    fill(other, stream, [2])
    write, met = engine._write, []

    def slower(*args, **kwargs):
        if not met:
            met.append(fill(other, stream, [4]))
        return write(*args, **kwargs)

    monkeypatch.setattr(engine, "_write", slower)
    fill(engine, stream, [4])  # another point came between: made again
    assert [p["t"] for p in engine.get_data(stream, "seconds", start=T0)] == [at(1), at(2), at(4), at(4)]
    met.clear()
    with pytest.raises(E.StreamAppendContended):
        engine.append_frame(spark.createDataFrame([(stream, at(9), 1.0)], POINTS).selectExpr("*", "0L as seq"))  # as `slower` appends at 4 first
    assert len(other.get_data(stream, "seconds", start=T0)) == 5


def test_the_slower_of_two_rollups_raises(engine, spark, folder, monkeypatch):
    stream = make(engine)
    fill(engine, stream, [0, 11, 25])
    other, stage, met = Engine(spark, folder), engine.store.stage, []

    def slower(*args, **kwargs):
        if not met:
            met.append(other.downsample_streams())
        return stage(*args, **kwargs)

    monkeypatch.setattr(engine.store, "stage", slower)
    with pytest.raises(E.LockExpiredMidMaintenance):
        engine.downsample_streams()
    assert counts(other, stream, "10seconds") == [1, 1]
    fill(other, stream, [31])  # an append does not stand in a rollup's way
    monkeypatch.undo()
    engine.downsample_streams()
    assert counts(engine, stream, "10seconds") == [1, 1, 1]


def test_log_is_summed_and_vacuumed(spark, folder):
    store = Store(spark, folder)
    store.SUMMED = 4
    for n in range(9):
        store.write("heads", store.local([(n,)], "x int"))
    lost = store.stage("heads", store.local([(99,)], "x int"))
    fresh = Store(spark, folder)
    assert fresh.refresh() == store.state and fresh.read("heads", "x int").count() == 9
    assert fresh.vacuum(3600) == 0 and fresh.vacuum(-5) == 1 and lost not in fresh.refresh().runs["heads"]
    assert fresh._names(f"{folder}/log") == sorted([f"{7:012d}.json", f"{8:012d}.json", f"{8:012d}.sum"])
    assert Store(spark, folder).refresh() == fresh.refresh() == store.refresh()
    with pytest.raises(Contended):
        fresh.commit("append", {}, since=2)
    since = fresh.refresh().version
    store.write("streams", store.local([(1,)], "x int"))
    with pytest.raises(Contended):
        fresh.commit("catalog", {}, since=since)
    store.drop()
    assert fresh.refresh().version == 0 and fresh.read("heads", "x int").count() == 0


def test_compaction_changes_no_read(engine):
    stream, other = make(engine), make(engine, "b")
    for k in range(4):
        fill(engine, stream, range(k * 30, k * 30 + 30, 3))
        fill(engine, other, [k])
        engine.downsample_streams()
    show = lambda: [list(engine.get_data(s, g, start=T0)) for s in (stream, other) for g in ("seconds", "10seconds", "minutes")]
    before, tags = show(), [engine.get_tags(s) for s in (stream, other)]
    engine.compact()
    assert show() == before and [engine.get_tags(s) for s in (stream, other)] == tags
    assert {len(r) for r in engine.store.refresh().runs.values()} == {1}
    fill(engine, stream, [200])
    engine.downsample_streams()
    assert sum(counts(engine, stream, "10seconds")) == 40
    engine.store.vacuum(-5)
    assert sum(counts(engine, stream, "10seconds")) == 40


def test_recent_points_hold_rollups_back(spark, folder):
    engine = Engine(spark, folder, margin=3600)
    stream = make(engine)
    fill(engine, stream, [0, 11, 25])
    assert engine.downsample_streams() == [] and counts(engine, stream, "10seconds") == []
    engine.margin = 0
    engine.downsample_streams()
    assert counts(engine, stream, "10seconds") == [1, 1]


def test_warnings(engine):
    stream, text = make(engine), engine.ensure_stream({"name": "n"}, {}, ["count"], "seconds", value_type="nominal")
    make(engine, "rate", (), derive_from=stream, derive_op="derivative")
    make(engine, "per reset", (), derive_from=[{"name": "reset", "stream": text}, {"stream": stream}], derive_op="counter_derivative")
    fill(engine, stream, [0, 30])
    with pytest.warns(E.InvalidValueWarning, match="one second"):
        fill(engine, stream, [30])
    with pytest.warns(E.InvalidValueWarning, match="no number"):
        engine.append(text, "often", at(0))
    engine.downsample_streams()
    with pytest.warns(E.DownsampleConsistencyNotGuaranteed, match="lack"):
        engine.append(stream, 1.0, at(3), check_timestamp=False)
    engine.overrun = 0
    with pytest.warns(E.DownsampleConsistencyNotGuaranteed, match="took"):
        engine.downsample_streams()
    odd = engine.ensure_stream({"name": "odd"}, {}, ["count", "sum", "sum_squares"], "seconds")
    engine.append_multiple([{"stream_id": odd, "value": {"c": 2, "s": 100.0, "q": 1.0}, "timestamp": at(s)} for s in (0, 20)])
    engine.overrun = 1000
    engine.downsample_streams()
    with pytest.warns(E.InternalInconsistencyWarning):
        list(engine.get_data(odd, "10seconds", start=T0))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fill(engine, stream, [40, 41])


def test_a_stream_batch_that_comes_again_changes_nothing(engine, spark, tmp_path):
    stream = make(engine)
    sink = monotonic_sink(engine, f"file://{tmp_path}/late")
    batch = spark.createDataFrame([(stream, at(10), 1.0)], POINTS)
    sink(batch, 0)
    sink(batch, 0)
    mixed = spark.createDataFrame([(stream, at(5), 2.0), (stream, at(20), 3.0)], POINTS)
    sink(mixed, 1)
    sink(mixed, 1)
    assert [p["v"] for p in engine.get_data(stream, "seconds", start=T0)] == [1.0, 3.0]
    assert [r["value"] for r in spark.read.parquet(f"file://{tmp_path}/late").collect()] == [2.0]


def test_no_bucket_of_a_sum_is_lost(spark):
    rows = [("x", at(s), i, v, o) for i, (s, o, v) in enumerate([(0, 0, 3.0), (1, 1, 4.0), (1, 1, 5.0), (10, 0, 1.0), (12, 1, None), (20, 0, None), (21, 1, None), (30, 0, 1.0)])]
    df = spark.createDataFrame(rows, "stream_id string, ts timestamp, seq long, value double, ord int")
    found = [(r["ts"].second, r["value"]) for r in derive.aligned_sum(df, 2, "10seconds").orderBy("ts").collect()]
    assert found == [(0, 7.0), (10, 1.0), (20, None)]


def test_previous_rows_reach_over_days(spark):
    day = 86_400
    rows = [("x", at(s), i, float(v)) for i, (s, v) in enumerate([(0, 1), (5, 2), (day, 7), (3 * day, 9), (3 * day + 1, 4)])] + [("y", at(2 * day), 9, 1.0)]
    df = spark.createDataFrame(rows, "stream_id string, ts timestamp, seq long, value double")
    found = {(r["stream_id"], r["value"]): r["prev"] and r["prev"]["value"] for r in derive.with_previous(df, ["value"], ["ts", "seq"]).collect()}
    assert found == {("x", 1.0): None, ("x", 2.0): 1.0, ("x", 7.0): 2.0, ("x", 9.0): 7.0, ("x", 4.0): 9.0, ("y", 1.0): None}
    assert [r["value"] for r in derive.counter_reset(df).collect()] == [1.0]


def test_cascade_reads_each_level_once(spark):
    raw = rollup.points(spark.createDataFrame([("x", at(s), float(s)) for s in range(0, 200_000, 500)], POINTS), "stream_id", "ts", "value")
    levels = rollup.cascade(raw, "seconds")
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for df in levels.values()]
    assert max(scans) <= 8
    assert [df.agg(F.sum("v.c")).first()[0] for df in levels.values()][:2] == [399, 399]


def test_stored_derived_streams_read_like_plans(spark, tmp_path):
    import random

    stored, plain = (Engine(spark, f"file://{tmp_path}/{n}") for n in ("stored", "plain"))
    rng = random.Random(4)
    batches, second = [], 0
    for _ in range(4):
        batch = []
        for _ in range(30):
            second += rng.choice([0, 1, 1, 2, 9, 50_000])
            batch.append((rng.choice("abc"), second, rng.choice([None, 0.0, 1.0, 5.0, 3.0, 9.0])))
        batches.append(batch)
    shown = []
    for engine in (stored, plain):
        ids = {n: make(engine, n, ()) for n in "abc"}
        ids["total"] = make(engine, "total", (), derive_from=[ids["a"], ids["b"]], derive_op="sum")
        ids["rate"] = make(engine, "rate", (), derive_from=ids["a"], derive_op="derivative")
        ids["change"] = make(engine, "change", (), derive_from=ids["total"], derive_op="derivative")
        ids["reset"] = engine.ensure_stream({"name": "reset"}, {}, [], "seconds", ids["b"], "counter_reset", value_type="nominal")
        ids["per"] = make(engine, "per", (), derive_from=[{"name": "reset", "stream": ids["reset"]}, {"stream": ids["c"]}], derive_op="counter_derivative", derive_args={"max_value": 10})
        for n, batch in enumerate(batches):
            engine.append_multiple([{"stream_id": ids[k], "value": v, "timestamp": at(s)} for k, s, v in batch])
            if engine is stored and n != 2:
                engine.store_derived()
        shown.append({n: [(p["t"], p["v"]) for p in engine.get_data(i, "seconds", start=T0)] for n, i in ids.items()})
    assert shown[0] == shown[1] and all(len(v) > 2 for v in shown[0].values())
    state = stored.catalog.derived()
    assert len(state) == 5
    assert stored.store_derived() == 0
    stored.compact()
    assert {n: [(p["t"], p["v"]) for p in stored.get_data(s["stream_id"], "seconds", start=T0)] for s in stored.find_streams() for n in [s["name"]]} == shown[0]
