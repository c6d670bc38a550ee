"""Every registered query of the engine equals its SQL."""

import os

import duckdb
import pytest

from chronomill.plans import engine_queries, queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    if name not in queries.ORACLE:
        assert len(found)
        return
    expected = duck.execute(queries.ORACLE[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    key = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert key(found) == key(expected)


def test_sum_folded_gives_every_complete_set(spark):
    from pyspark.sql import functions as F

    from chronomill.operators import derive

    rows = [("x", 0, i, float(v), o) for i, (o, v) in enumerate([(0, 1), (1, 2), (0, 5), (1, 7)])]
    df = spark.createDataFrame(rows, "stream_id string, s long, seq long, value double, ord int")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + F.col("seq"))).drop("s")
    assert [r["value"] for r in derive.aligned_sum(df, 2, "10seconds").orderBy("seq").collect()] == [3.0, 12.0]


def test_sum_folds_a_large_bucket_row_by_row(spark):
    """No bucket is gathered into an array, and rows that come out cost the same wherever they stand in it."""
    import contextlib
    import io

    from pyspark.sql import functions as F

    from chronomill.operators import derive

    n = 20_000
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 3 * 86_400 + (F.col("id") / 2).cast("long"))
    ord_ = ((F.col("id") * 7 + F.col("id") % 11) % 3).cast("int")
    value = F.when(F.col("id") % 4 != 0, F.col("id") * 0.1)
    df = spark.range(n).select(F.lit("x").alias("stream_id"), at.alias("ts"), F.col("id").alias("seq"), value.alias("value"), ord_.alias("ord"))
    made = derive.aligned_sum(df, 3, "days")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        made.explain()
    assert "collect_list" not in out.getvalue()
    expected, held, bucket = [], {}, None
    for r in sorted(df.select(F.unix_seconds("ts").alias("s"), "ord", "seq", "value").collect()):
        if r["s"] // 86_400 != bucket:
            bucket, held = r["s"] // 86_400, {}
        held[r["ord"]] = r
        if len(held) == 3:
            total = None
            for i in range(3):
                if held[i]["value"] is not None:
                    total = (total or 0.0) + held[i]["value"]
            expected.append((bucket * 86_400, max(h["seq"] for h in held.values()), total))
            held = {}
    found = made.select(F.unix_seconds("ts"), "seq", "value").collect()
    assert len(expected) > 1_000 and sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_plans_stay_narrow(spark):
    """One shuffle for a rollup, pruned columns, bounds pushed to the scan."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.QUERIES["rollup_1h"](spark, FOLDER).explain()
        queries.QUERIES["raw_range_incl"](spark, FOLDER).explain()
    plan = out.getvalue()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "props" not in plan
