"""The sink that splits off rows that come too late; rows of a micro-batch in order, in bounded memory."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest

from chronomill.plans.engine import Engine
from chronomill.streaming import derive
from chronomill.streaming.rollups import monotonic_sink

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_rows_before_the_newest_point_are_set_aside(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    stream = engine.ensure_stream({"name": "a"}, {}, ["count"], "seconds")
    fields = "stream_id string, ts timestamp, value double"
    sink = monotonic_sink(engine, f"file://{tmp_path}/late")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    sink(spark.createDataFrame([(stream, at(10), 1.0)], fields), 0)
    sink(spark.createDataFrame([(stream, at(5), 2.0), (stream, at(20), 3.0)], fields), 1)
    assert [r["v"] for r in engine.get_data(stream, "seconds", start=T0)] == [1.0, 3.0]
    assert [r["value"] for r in spark.read.parquet(f"file://{tmp_path}/late").collect()] == [2.0]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1_000, 1_024, 20_000])
def test_rows_of_a_micro_batch_are_put_in_order_in_files(n, tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    rng = np.random.default_rng(n)
    rows = pd.DataFrame({"at": rng.integers(-50, 50, n), "ord": rng.integers(0, 2, n), "seq": rng.integers(0, 5, n), "value": np.arange(n) * 1.0})
    parts = list(derive.in_order((rows[i : i + 300] for i in range(0, n, 300)), run=64, files=4))
    assert max(map(len, parts)) <= 64
    found = pd.DataFrame(np.concatenate(parts))
    pd.testing.assert_frame_equal(found, rows.sort_values(["at", "ord", "seq"], kind="stable", ignore_index=True).astype(found.dtypes))
    assert not os.listdir(tmp_path)


class _Held:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, fields):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("made", [lambda: derive.AlignedSum(2, 3600), lambda: derive.Measured("derivative"), lambda: derive.Measured("counter_reset"), lambda: derive.Measured("counter_derivative", 256.0)])
def test_derived_streams_take_a_micro_batch_of_any_size_in_parts(made, monkeypatch):
    """Parts of a micro-batch give the rows that the whole gives, and only a few frames are held at a time."""
    n, frame = 1 << 18, 1 << 13
    alive, most = [], []

    class Frame(pd.DataFrame):
        def __del__(self):
            alive and alive.pop()

    def frames():
        rng = np.random.default_rng(1)
        for i in range(0, n, frame):
            at = rng.integers(0, 10**12, frame)
            value = np.where(rng.random(frame) < 0.1, np.nan, rng.integers(0, 200, frame))
            f = Frame({"at": at, "second": at // 1_000_000, "ts": at.astype("datetime64[us]"), "ord": rng.integers(0, 2, frame), "seq": np.arange(i, i + frame), "value": value})
            alive.append(1)
            most.append(len(alive))
            yield f
            del f

    def run():
        p, state = made(), _Held()
        p.init(state)
        out = pd.concat(list(p.handleInputRows(("x",), frames(), None)), ignore_index=True)
        return out, state.value

    whole, state = run()
    if hasattr(derive, "RUN"):
        monkeypatch.setattr(derive.in_order, "__defaults__", (1 << 14, 4))
    most.clear()
    parts, state_of_parts = run()
    assert len(whole) > 1_000 and max(most) <= 4
    pd.testing.assert_frame_equal(parts, whole)
    assert repr(state_of_parts) == repr(state)
