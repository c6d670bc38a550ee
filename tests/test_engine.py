"""The engine end to end, on vectors with known results."""

import datetime as dt
import decimal
import warnings

import pytest

from chronomill import errors as E
from chronomill.plans.engine import Engine

T0 = dt.datetime(2000, 1, 1, 12, tzinfo=dt.timezone.utc)
ALL = ["mean", "sum", "min", "max", "sum_squares", "std_dev", "count"]


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


def make(engine, name="a", downsamplers=ALL, granularity="seconds", **more):
    return engine.ensure_stream({"name": name}, {}, downsamplers, granularity, **more)


def fill(engine, stream, pairs):
    engine.append_multiple([{"stream_id": stream, "value": v, "timestamp": at(s)} for s, v in pairs])


def read(engine, stream, g="seconds", **more):
    return list(engine.get_data(stream, g, **({"start": T0} | more)))


def test_range_bounds_at_three_levels(engine, spark):
    stream = make(engine)
    rows = spark.createDataFrame([(stream, at(i), float(i)) for i in range(1200)], "stream_id string, ts timestamp, value double")
    engine.append_frame(rows)
    engine.append(stream, 0, at(1200))
    engine.downsample_streams(until=at(1200))
    s, e = T0, at(60)
    for g, counts in (("seconds", (61, 60, 60, 59)), ("10seconds", (7, 6, 6, 5)), ("minutes", (2, 1, 1, 0))):
        got = [
            len(engine.get_data(stream, g, start=s, end=e)),
            len(engine.get_data(stream, g, start_exclusive=s, end=e)),
            len(engine.get_data(stream, g, start=s, end_exclusive=e)),
            len(engine.get_data(stream, g, start_exclusive=s, end_exclusive=e)),
        ]
        assert tuple(got) == counts, g
    assert len(engine.get_data(stream, "seconds", start=dt.datetime.min, end=dt.datetime.max)) == 1201
    assert len(engine.get_data(stream, "seconds", start=dt.datetime.max)) == 0
    assert len(engine.get_data(stream, "seconds", start=T0, end=dt.datetime.min)) == 0
    assert [len(engine.get_data(stream, g, start=T0)) for g in ("10seconds", "minutes", "10minutes", "hours", "days")] == [120, 20, 2, 0, 0]


def test_slices_and_open_bucket(engine):
    stream = make(engine)
    fill(engine, stream, [(i, i) for i in range(200)])
    data = engine.get_data(stream, "seconds", start=T0)
    assert (len(data), len(data[:20]), len(data[50:70]), len(data[190:210])) == (200, 20, 20, 10)
    assert data[3]["v"] == 3 and engine.get_data(stream, "seconds", start=T0, reverse=True)[0]["v"] == 199
    with pytest.raises(IndexError):
        data[200]
    with pytest.raises(TypeError):
        data["x"]
    engine.downsample_streams()
    assert len(engine.get_data(stream, "10seconds", start=T0)) == 19
    on_read = Engine(engine.spark, engine.store.root, mode="on_read")
    assert on_read.downsample_streams() == []
    assert len(on_read.get_data(stream, "10seconds", start=T0)) == 20


def test_nulls_and_gap_fill(engine):
    stream = make(engine)
    fill(engine, stream, [(0, None), (1, 10), (60, None), (61, None), (120, 2), (180, None)])
    engine.downsample_streams()
    tens = read(engine, stream, "10seconds")
    assert tens[0]["v"] == {"c": 1, "d": 0.0, "m": 10.0, "l": 10.0, "q": 100.0, "s": 10.0, "u": 10.0}
    assert tens[0]["t"] == {"a": at(0), "m": at(1), "z": at(1)}
    assert tens[1]["v"] == {"c": 0, "d": None, "m": None, "l": None, "q": None, "s": None, "u": None}
    assert tens[1]["t"] == {"a": at(15), "m": at(15), "z": at(15)}
    minutes = read(engine, stream, "minutes", value_downsamplers=["mean"], time_downsamplers=[])
    assert minutes == [{"v": {"m": 10.0}}, {"v": {"m": None}}, {"v": {"m": 2.0}}]


def test_gaps_between_runs(engine):
    stream = make(engine, granularity="seconds")
    fill(engine, stream, [(0, 10), (600, 20)])
    engine.downsample_streams(until=at(825))
    fill(engine, stream, [(1200, 30), (1260, 30)])
    engine.downsample_streams()
    means = [r["v"]["m"] for r in read(engine, stream, "minutes", value_downsamplers=["mean"])]
    assert means == [10] + [None] * 9 + [20] + [None] * 9 + [30]
    assert engine.get_tags(stream)["downsampled_until"]["minutes"] == at(1260)


def test_two_points_far_apart_fill_the_time_between(engine):
    stream = make(engine)
    fill(engine, stream, [(0, 1), (48 * 3600, 1)])
    engine.downsample_streams()
    assert len(engine.get_data(stream, "10seconds", start=T0)) == 17280


def test_duplicates_in_one_second(engine):
    stream = make(engine)
    fill(engine, stream, [(0, i) for i in range(1, 6)] + [(36000, None)])
    engine.downsample_streams()
    first = read(engine, stream, "10seconds")[0]
    assert first["t"] == {"a": T0, "z": T0, "m": T0}
    assert first["v"] == {"c": 5, "d": 1.4142135623730951, "m": 3.0, "l": 1.0, "q": 55.0, "s": 15.0, "u": 5.0}
    levels = ("10seconds", "minutes", "10minutes", "hours", "6hours", "days")
    assert [len(engine.get_data(stream, g, start=T0)) for g in levels] == [3600, 600, 60, 10, 1, 0]
    assert [r["v"] for r in read(engine, stream)[:5]] == [1, 2, 3, 4, 5]


def test_pre_aggregated_points(engine):
    stream = make(engine)
    part = {"c": 3, "s": 9, "l": 3, "u": 3, "q": 27, "m": 3, "d": 0}
    fill(engine, stream, [(i, v) for i in range(30) for v in (part, 3, 3, 3)])
    engine.downsample_streams()
    v = read(engine, stream, "10seconds")[0]["v"]
    assert (v["c"], v["m"], v["l"], v["u"], v["s"], v["q"]) == (60, 3, 3, 3, 180, 540)
    with pytest.raises(ValueError):
        engine.append(stream, {"c": 3}, at(40))
    with pytest.raises(ValueError):
        engine.append(stream, part | {"x": 1}, at(40))
    other = make(engine, "b")
    nulls = dict.fromkeys("cslumdq")
    one = {"c": 1, "s": 42, "l": 42, "u": 42, "m": 42, "d": None, "q": None}
    fill(engine, other, [(i, v) for i in range(30) for v in (nulls, one)])
    engine.downsample_streams({"name": "b"})
    v = read(engine, other, "10seconds")[0]["v"]
    assert (v["c"], v["m"], v["l"], v["u"], v["s"], v["q"]) == (10, 42, 42, 42, 420, None)


def derived(engine, name, op, sources, kind="numeric", downsamplers=(), granularity="seconds", **more):
    return engine.ensure_stream({"name": name}, {}, list(downsamplers), granularity, derive_from=sources, derive_op=op, value_type=kind, **more)


def test_derived_streams(engine):
    a, b = make(engine, "a"), make(engine, "b")
    total = derived(engine, "sum", "sum", [a, b])
    rate = derived(engine, "rate", "derivative", a)
    chain = derived(engine, "chain", "sum", [a, rate])
    first = [21, 25, 28, 32, 25]
    for s, x, y in [(i, v, v) for i, v in enumerate(first)] + [(10, 70, 42), (11, 74, 42)]:
        engine.append_multiple([{"stream_id": a, "value": x, "timestamp": at(s)}, {"stream_id": b, "value": y, "timestamp": at(s)}])
    values = lambda s: [r["v"] for r in read(engine, s)]
    assert values(total) == [42, 50, 56, 64, 50, 112, 116]
    assert values(rate) == [4, 3, 4, -7, 7.5, 4]
    assert values(chain) == [29, 31, 36, 18, 77.5, 78]
    with pytest.raises(E.AppendToDerivedStreamNotAllowed):
        engine.append(total, 1, at(20))
    with pytest.raises(E.OutstandingDependenciesError):
        engine.delete_streams({"name": "a"})
    engine.delete_streams({"name": "chain"})
    assert engine.get_tags(a)["contributes_to"] == [total, rate]


def test_sum_of_a_coarser_level(engine):
    a, b = make(engine, "a"), make(engine, "b")
    total = derived(engine, "sum", "sum", [{"stream": a, "granularity": "10seconds"}, {"stream": b, "granularity": "10seconds"}], granularity="10seconds")
    for s in (a, b):
        fill(engine, s, [(i, 5) for i in range(32)])
    engine.downsample_streams()
    assert [r["v"] for r in read(engine, total, "10seconds")] == [10, 10, 10]


UPTIME = [10, 23, 28, 44, 2, 17, 90, 30, 2]
RESETS = UPTIME + [5, 10, 15, 23, 1, 7, 12, 19, 25, 31, 45, 51]


def test_counters(engine):
    up, data = make(engine, "up"), make(engine, "data")
    reset = derived(engine, "reset", "counter_reset", up, "nominal", ["count"])
    fill(engine, up, list(enumerate(UPTIME)))
    fill(engine, data, list(enumerate([5, 12, 7, 25, 7, 18, 33, 40, 5])))
    sources = [{"name": "reset", "stream": reset}, {"stream": data}]
    rate = derived(engine, "rate", "counter_derivative", sources, derive_args={"max_value": 256})
    late = derived(engine, "late", "counter_derivative", sources, derive_args={"max_value": 256}, derive_backprocess=False)
    assert read(engine, rate) == [] and engine.get_tags(rate)["pending_backprocess"]
    engine.backprocess_streams()
    assert [r["v"] for r in read(engine, rate)] == [7, 251, 18, 11, 15]
    assert read(engine, late) == []
    fill(engine, up, [(i, v) for i, v in enumerate(RESETS) if i >= len(UPTIME)])
    assert [r["v"] for r in read(engine, reset)] == [1, 1, 1, 1]
    engine.downsample_streams()
    assert [r["v"]["c"] for r in read(engine, reset, "10seconds")] == [3, 1]


def test_derived_nulls(engine):
    a, b, c = make(engine, "a"), make(engine, "b"), make(engine, "c")
    one, null = derived(engine, "s1", "sum", [a, b]), derived(engine, "s2", "sum", [a, c])
    rate, reset = derived(engine, "d", "derivative", a), derived(engine, "r", "counter_reset", a, "nominal")
    both = derived(engine, "cd", "counter_derivative", [{"name": "reset", "stream": reset}, {"stream": a}])
    points = [(0, None), (1, 10), (60, None), (61, None), (120, 2)]
    for s, f in ((a, lambda v: v), (b, lambda v: 1), (c, lambda v: None)):
        fill(engine, s, [(t, f(v)) for t, v in points])
    values = lambda s: [r["v"] for r in read(engine, s)]
    assert values(one) == [1, 11, 1, 1, 3]
    assert values(null) == [None, 10, None, None, 2]
    assert values(rate) == [None, None, None]
    assert values(both) == [None, None, None]
    assert values(reset) == [1]


def test_derive_errors(engine):
    a, n = make(engine, "a"), make(engine, "n", ["count"], value_type="nominal")
    slow = make(engine, "m", granularity="minutes")
    with pytest.raises(E.UnsupportedDeriveOperator):
        derived(engine, "x", "product", [a])
    with pytest.raises(E.IncompatibleTypes):
        derived(engine, "x", "sum", [a, n])
    with pytest.raises(E.IncompatibleTypes):
        derived(engine, "x", "counter_reset", a)
    with pytest.raises(E.InvalidOperatorArguments):
        derived(engine, "x", "derivative", [a, a])
    with pytest.raises(E.InvalidOperatorArguments):
        derived(engine, "x", "counter_derivative", [a, a])
    with pytest.raises(E.IncompatibleGranularities):
        derived(engine, "x", "sum", [a, slow])
    with pytest.raises(E.StreamNotFound):
        derived(engine, "x", "sum", ["nowhere"])


def test_tags(engine):
    tags = {"title": "Stream 1", "number": 1, "view": {"downsamplers": ["mean", "min"], "hidden": False}}
    one = engine.ensure_stream({"title": "Stream 1"}, tags, ["count"], "seconds")
    two = engine.ensure_stream({"title": "Stream 2"}, {"number": 2}, ["count"], "seconds")
    assert engine.ensure_stream({"title": "Stream 1"}, tags, ["count"], "seconds") == one
    ids = lambda q=None: [s["stream_id"] for s in engine.find_streams(q)]
    assert ids() == [one, two]
    assert ids({"number": 2}) == [two]
    assert ids({"view": {"hidden": False}}) == [one] and ids({"view": {"downsamplers": "mean"}}) == [one]
    assert ids({"title": {"iexact": "stream 1"}}) == [one] and ids({"title": {"icontains": "STREAM"}}) == [one, two]
    assert ids({"number": {"gte": 1}}) == [one, two] and ids({"number": {"gt": 1}}) == [two]
    assert ids({"number": {"in": [1, 7]}}) == [one]
    assert ids({"view": {"downsamplers": {"all": ["mean", "min"]}}}) == [one] and ids({"view": {"downsamplers": {"all": ["mean", "max"]}}}) == []
    held = lambda q: [s["stream_id"] for s in engine.find_streams(q, containment=True)]
    assert held({"view": {"downsamplers": ["min"]}}) == [one] and held({"number": 2}) == [two] and held({"number": {"gte": 1}}) == []
    assert ids({"value_type": "numeric"}) == [] and ids({"stream_id": one}) == []
    engine.update_tags(one, {"view": {"hidden": True}, "new": 3})
    shown = engine.get_tags(one)
    assert shown["view"] == {"downsamplers": ["mean", "min"], "hidden": True} and shown["new"] == 3
    engine.remove_tag(one, "new")
    engine.remove_tag(one, {"view": {"hidden": ""}})
    assert engine.get_tags(one)["view"] == {"downsamplers": ["mean", "min"]} and "new" not in engine.get_tags(one)
    engine.clear_tags(one)
    assert ids({"title": "Stream 1"}) == []
    with pytest.raises(E.ReservedTagNameError):
        engine.ensure_stream({"stream_id": 1}, {}, [], "seconds")
    with pytest.raises(E.ReservedTagNameError):
        engine.find_streams({"a": {"b__c": 1}})
    with pytest.raises(E.StreamNotFound):
        engine.get_tags("nowhere")
    engine.ensure_stream({"n": 1}, {"k": 1}, [], "seconds")
    engine.ensure_stream({"n": 2}, {"k": 1}, [], "seconds")
    with pytest.raises(E.MultipleStreamsReturned):
        engine.ensure_stream({"k": 1}, {}, [], "seconds")
    engine.delete_streams({"k": 1})
    assert ids({"k": 1}) == []


def test_configuration_errors(engine):
    make(engine)
    with pytest.raises(E.InconsistentStreamConfiguration):
        make(engine, value_type="nominal", downsamplers=["count"])
    with pytest.raises(E.UnsupportedDownsampler):
        make(engine, "x", ["frobnicate"])
    with pytest.raises(E.UnsupportedDownsampler):
        make(engine, "x", ["median"])
    with pytest.raises(E.UnsupportedDownsampler):
        make(engine, "x", ["mean"], value_type="nominal")
    with pytest.raises(E.UnsupportedGranularity):
        make(engine, "x", granularity="fortnights")
    with pytest.raises(E.UnsupportedValueType):
        make(engine, "x", value_type="boolean")
    with pytest.raises(AttributeError):
        engine.get_data("x", "seconds")
    with pytest.raises(AttributeError):
        engine.get_data("x", "seconds", start=T0, end=T0, end_exclusive=T0)


def test_timestamps(engine):
    stream = make(engine)
    engine.append(stream, 1, at(10))
    with pytest.raises(E.InvalidTimestamp):
        engine.append(stream, 1, at(9))
    engine.append(stream, 1, at(9), check_timestamp=False)
    for bad in (dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2038, 1, 19, 3, 14, 8)):
        with pytest.raises(E.InvalidTimestamp):
            engine.append(stream, 1, bad, check_timestamp=False)
    assert engine.get_tags(stream)["latest_datapoint"] == at(10) and engine.get_tags(stream)["earliest_datapoint"] == at(9)


def test_value_types(engine):
    nominal = make(engine, "n", ["count"], value_type="nominal")
    mixed = [10, {}, "label", {"foo": "bar", "z": 42}]
    fill(engine, nominal, list(enumerate(mixed)))
    assert [r["v"] for r in read(engine, nominal)] == mixed
    graph = make(engine, "g", ["count"], value_type="graph")
    good = {"v": [{"i": "a", "x": 1}, {"i": "b"}], "e": [{"f": "a", "t": "b"}]}
    fill(engine, graph, [(0, good), (20, good)])
    assert read(engine, graph)[0]["v"] == good
    bad = [{}, {"v": []}, {"v": [{"x": 1}], "e": []}, {"v": [{"i": 1}, {"i": 1}], "e": []}, {"v": [{"i": 1}], "e": [{"f": 1}]}, {"v": [{"i": 1}], "e": [{"f": 1, "t": 2}]}]
    for value in bad:
        with pytest.raises(ValueError):
            engine.append(graph, value, at(30))
    with pytest.raises(TypeError):
        engine.append(graph, "graph", at(30))
    with pytest.raises(TypeError):
        engine.append(make(engine), "x", at(0))
    engine.downsample_streams()
    assert [r["v"] for r in read(engine, graph, "10seconds")] == [{"c": 1}, {"c": 0}]


def test_high_accuracy_and_big_integers(engine, spark):
    from pyspark.sql import functions as F

    from chronomill.functions.granularity import level
    from chronomill.operators.values import exact_sums

    exact = make(engine, value_type="numeric", value_type_options={"high_accuracy": True})
    value = decimal.Decimal("3.14159265358979323846264338327950288419716939937510582097494459")
    fill(engine, exact, [(0, value), (1, 2**128), (2, value)])
    assert [r["v"] for r in read(engine, exact)] == [value, decimal.Decimal(2**128), value]
    rows = engine.store.points().where(F.col("stream_id") == exact)
    got = exact_sums(rows, level("10seconds").floor_column(F.col("ts"))).collect()[0]
    assert decimal.Decimal(got["sum"]) == decimal.Context(prec=64).add(decimal.Context(prec=64).add(value, 2**128), value)
    plain = make(engine, "p")
    fill(engine, plain, [(0, 2**128)])
    assert read(engine, plain)[0]["v"] == float(2**128)


def test_no_downsamplers_give_no_rollups(engine):
    stream = make(engine, downsamplers=[])
    fill(engine, stream, [(0, 1), (100, 2)])
    engine.downsample_streams()
    assert len(engine.get_data(stream, "minutes", start=T0)) == 0


def test_returned_datapoints_and_filter(engine):
    a, b = make(engine, "a"), make(engine, "b")
    for s in (a, b):
        fill(engine, s, [(4 * i, i) for i in range(1000)])
    with warnings.catch_warnings():
        warnings.simplefilter("error", E.EngineWarning)
        made = engine.downsample_streams(return_datapoints=True, filter_stream=lambda tags: tags["name"] == "a")
    assert {m["stream_id"] for m in made} == {a} and len(made) == 399 + 66 + 6 + 1
    engine.use(engine.store.root + "-other")
    assert engine.find_streams() == []
