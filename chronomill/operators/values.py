"""Value types: what a stream accepts and how values are stored."""

from __future__ import annotations

import decimal
import json
import numbers

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedValueType
from ..functions.aggregates import VALUE_DOWNSAMPLERS

TYPES = ("numeric", "nominal", "graph")
CONTEXT = decimal.Context(prec=64)
GRAPH = "struct<v:array<struct<i:string>>,e:array<struct<f:string,t:string>>>"


def canonical(value) -> str:
    """JSON text that is equal for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def graph_errors(graph: Column) -> Column:
    """Null for a valid graph (GRAPH), else what is wrong: null parts, repeated vertex ids, edges to unknown ids."""
    ids = F.transform(graph["v"], lambda x: x["i"])
    known = F.forall(graph["e"], lambda e: F.array_contains(ids, e["f"]) & F.array_contains(ids, e["t"]))
    return (
        F.when(graph.isNull() | graph["v"].isNull() | graph["e"].isNull(), F.lit("vertices or edges are missing"))
        .when(F.exists(ids, lambda i: i.isNull()), F.lit("a vertex has no id"))
        .when(F.size(F.array_distinct(ids)) != F.size(ids), F.lit("vertex ids repeat"))
        .when(~F.coalesce(known, F.lit(False)), F.lit("an edge names an unknown vertex"))
    )


def check_graph(value) -> None:
    """The same rules for one value on the driver."""
    if not isinstance(value, dict):
        raise TypeError(f"a graph is a dictionary, not {type(value).__name__}")
    try:
        vertices, edges = value["v"], value["e"]
        ids = [canonical(v["i"]) for v in vertices]
        ends = [canonical(e[k]) for e in edges for k in ("f", "t")]
    except (KeyError, TypeError) as wrong:
        raise ValueError("a graph has v (each with i) and e (each with f and t)") from wrong
    if len(set(ids)) != len(ids):
        raise ValueError("vertex ids repeat")
    if not set(ends) <= set(ids):
        raise ValueError("an edge names an unknown vertex")


def stored_value(value, value_type: str, options: dict, downsamplers: list[str]) -> dict:
    """value, value_json and agg of a point for one Python value.

    Numbers become doubles; with high_accuracy their exact decimal text is kept as well, and integers
    outside 64 bits do not overflow either way. A dictionary for a numeric stream is a point that is
    already downsampled and must have exactly the stream's aggregates.
    """
    row = {"value": None, "value_json": None, "agg": None}
    if value_type not in TYPES:
        raise UnsupportedValueType(f"{value_type!r} is none of {', '.join(TYPES)}")
    if value is None:
        return row
    if value_type == "nominal":
        return row | {"value_json": canonical(value)}
    if value_type == "graph":
        check_graph(value)
        return row | {"value_json": canonical(value)}
    if isinstance(value, dict):
        keys = {VALUE_DOWNSAMPLERS[n].key for n in downsamplers}
        if set(value) != keys:
            raise ValueError(f"a downsampled point has the aggregates {sorted(keys)}, not {sorted(value)}")
        parts = {k: (None if v is None else float(v)) for k, v in value.items()}
        count = parts.get("c")
        return row | {"agg": {k: parts.get(k) for k in "sqlumd"} | {"c": None if count is None else int(count)}}
    if isinstance(value, bool) or not isinstance(value, (numbers.Number, decimal.Decimal)):
        raise TypeError(f"a numeric stream takes numbers, not {type(value).__name__}")
    if options.get("high_accuracy"):
        exact = CONTEXT.create_decimal(value if isinstance(value, (int, decimal.Decimal)) else repr(value))
        return row | {"value": float(exact), "value_json": str(exact)}
    return row | {"value": float(value)}


def shown_value(row, value_type: str, options: dict):
    """The Python value of a stored point."""
    if row["agg"] is not None:
        return {k: v for k, v in row["agg"].asDict().items() if v is not None}
    if value_type == "numeric":
        if options.get("high_accuracy") and row["value_json"] is not None:
            return CONTEXT.create_decimal(row["value_json"])
        return row["value"]
    return None if row["value_json"] is None else json.loads(row["value_json"])


def exact_sums(raw: DataFrame, bucket: Column) -> DataFrame:
    """stream_id, bucket, count, sum, min, max, mean of high-accuracy values as decimal text with 64 digits.

    Spark's decimals end at 38 digits, so the texts of one partition are added in Python first and what
    is shuffled is one row for each stream, bucket and partition.
    """
    fields = "stream_id string, bucket timestamp, count long, sum string, min string, max string"

    def fold(frame: pd.DataFrame) -> dict:
        values = [CONTEXT.create_decimal(x) for x in frame["sum"]]
        total = decimal.Decimal(0)
        for v in values:
            total = CONTEXT.add(total, v)
        low = min(CONTEXT.create_decimal(x) for x in frame["min"])
        high = max(CONTEXT.create_decimal(x) for x in frame["max"])
        return {"count": int(frame["count"].sum()), "sum": str(total), "min": str(low), "max": str(high)}

    def partial(batches):
        for frame in batches:
            rows = [{"stream_id": k[0], "bucket": k[1]} | fold(f) for k, f in frame.groupby(["stream_id", "bucket"])]
            yield pd.DataFrame(rows, columns=["stream_id", "bucket", "count", "sum", "min", "max"])

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        got = fold(frame)
        mean = CONTEXT.divide(CONTEXT.create_decimal(got["sum"]), decimal.Decimal(got["count"]))
        return pd.DataFrame([{"stream_id": frame["stream_id"].iloc[0], "bucket": frame["bucket"].iloc[0]} | got | {"mean": str(mean)}])

    text = F.coalesce("value_json", F.col("value").cast("string"))
    rows = raw.where(text.isNotNull()).select(
        "stream_id", bucket.alias("bucket"), F.lit(1).cast("long").alias("count"), text.alias("sum"), text.alias("min"), text.alias("max")
    )
    parts = rows.mapInPandas(partial, fields)
    return parts.groupBy("stream_id", "bucket").applyInPandas(final, fields + ", mean string")
