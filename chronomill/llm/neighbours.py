"""Nearest neighbours by inner product: a vantage-point tree per shard."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

LEAF = 64


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """Points of one shard in tree order, with the tree over them.

    The inner product becomes a distance by one more coordinate: each point is lifted to the
    norm of the longest, so that the nearest lifted point has the largest product.
    Node: vantage point, its points [lo, hi), and the distance ranges of its two halves.
    """

    points: np.ndarray  # as given, in double precision
    lift: np.ndarray
    ids: np.ndarray
    nodes: list[tuple]

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
        squares = (points**2).sum(1)
        lift = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))
        order, nodes = np.argsort(ids, kind="stable"), []
        whole = np.concatenate([points, lift[:, None]], 1)
        rng = np.random.default_rng(3)
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][3 + side] = at
            if hi - lo <= leaf:
                nodes.append([lo, hi, None, -1, -1, 0, 0, 0, 0])
                order[lo:hi] = np.sort(order[lo:hi])
                continue
            own = order[lo:hi]
            tried = rng.choice(len(own), min(8, len(own)), replace=False)
            probe = whole[own[rng.choice(len(own), min(64, len(own)), replace=False)]]
            spread = [np.linalg.norm(probe - whole[own[t]], axis=1).std() for t in tried]
            vantage = whole[own[tried[int(np.argmax(spread))]]]
            distance = np.linalg.norm(whole[own] - vantage, axis=1)
            middle = len(own) // 2
            sides = np.argpartition(distance, middle)
            order[lo:hi], distance = own[sides], distance[sides]
            near, far = distance[:middle], distance[middle:]
            nodes.append([lo, hi, vantage, -1, -1, near.min(), near.max(), far.min(), far.max()])
            todo += [(lo + middle, hi, at, 1), (lo, lo + middle, at, 0)]
        return cls(points[order], lift[order], ids[order], [tuple(n) for n in nodes])

    def search(self, queries: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and products of the k best points of each query (-1 where there are fewer), best first, ties to smaller
        ids, and how many pairs of query and point were looked at. Points under a query's `least` product are left out.

        A half is skipped if the triangle inequality puts it farther than `factor` times the
        distance of the k-th best so far; with factor 1 the result is exact.
        """
        n = len(queries)
        ids, products = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
        least = np.full(n, -np.inf) if least is None else least
        looked = 0
        if not len(self.points):
            return ids, products, looked
        longest = (self.points[0] ** 2).sum() + self.lift[0] ** 2
        norms = (queries**2).sum(1)
        reach = longest + norms
        lifted = np.concatenate([queries, np.zeros((n, 1))], 1)
        slack = 1e-7 * (1 + np.sqrt(reach))  # of a distance, whose square is a difference of rounded numbers
        # What a matrix product may differ by from a product added up in order.
        rounding = 4 * queries.shape[1] * np.finfo(np.float64).eps * np.sqrt(norms * longest)
        stack = [(0, np.arange(n), np.zeros(n))]
        while stack:
            at, asked, bound = stack.pop()
            worst = np.maximum(products[asked, -1], least[asked])
            radius = np.sqrt(np.maximum(reach[asked] - 2 * worst, 0.0))  # infinite until k are found
            asked = asked[bound <= factor * radius + slack[asked]]
            if not len(asked):
                continue
            lo, hi, vantage, left, right, near_lo, near_hi, far_lo, far_hi = self.nodes[at]
            if vantage is None:
                looked += len(asked) * (hi - lo)
                self._leaf(lo, hi, queries, asked, ids, products, least, rounding)
                continue
            distance = np.linalg.norm(lifted[asked] - vantage, axis=1)
            near = np.maximum(np.maximum(near_lo - distance, distance - near_hi), 0)
            far = np.maximum(np.maximum(far_lo - distance, distance - far_hi), 0)
            inner = distance <= (near_hi + far_lo) / 2
            for child, gap, first in ((left, near, inner), (right, far, ~inner)):
                stack.append((child, asked[~first], gap[~first]))
            for child, gap, first in ((left, near, inner), (right, far, ~inner)):
                if first.any():
                    stack.append((child, asked[first], gap[first]))
        return ids, products, looked

    def _leaf(self, lo, hi, queries, asked, ids, products, least, rounding):
        """A matrix product finds what may be among the best; those products are then added up in order, as they are reported."""
        k, points = ids.shape[1], self.points[lo:hi]
        for at in range(0, len(asked), max(1, 2_000_000 // points.size)):
            own = asked[at : at + max(1, 2_000_000 // points.size)]
            rough = queries[own] @ points.T
            floor = np.maximum(products[own, -1], least[own])
            if rough.shape[1] > k:
                floor = np.maximum(floor, np.partition(rough, -k, axis=1)[:, -k])
            maybe = rough >= (floor - 2 * rounding[own])[:, None]
            some = maybe.any(1)
            if not some.any():
                continue
            own, maybe = own[some], maybe[some]
            q, p = np.nonzero(maybe)
            found = np.full(maybe.shape, -np.inf)
            found[q, p] = in_order(queries[own[q]], points[p])
            found[found < least[own][:, None]] = -np.inf
            all_ids = np.concatenate([ids[own], np.where(found > -np.inf, self.ids[lo:hi], -1)], 1)
            all_products = np.concatenate([products[own], found], 1)
            keep = np.lexsort((all_ids, -all_products), axis=1)[:, :k]
            ids[own] = np.take_along_axis(all_ids, keep, 1)
            products[own] = np.take_along_axis(all_products, keep, 1)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


@dataclass
class Cells:
    """Pivots by vector size, and of each cell the distances of its points from the pivot.

    Distances are between lifted vectors (see Tree); longest is the square of the longest point's norm.
    """

    longest: dict[int, float]
    pivots: dict[int, np.ndarray]
    ranges: dict[tuple[int, int], tuple[float, float]] | None = None

    def distances(self, vectors: np.ndarray, lifted: bool) -> np.ndarray:
        """From vectors of one size to all pivots; queries are not lifted."""
        size = vectors.shape[1]
        pivots, longest = self.pivots[size], self.longest[size]
        lift = lambda v: np.sqrt(np.maximum(longest - (v**2).sum(1), 0.0))[:, None]
        rows = np.concatenate([vectors, lift(vectors) if lifted else np.zeros((len(vectors), 1))], 1)
        centres = np.concatenate([pivots, lift(pivots)], 1)
        square = (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T
        return np.sqrt(np.maximum(square, 0.0))

    def may_hold(self, vectors: np.ndarray, worst: np.ndarray, factor: float) -> np.ndarray:
        """Which cells can hold a point with a product of `worst` or more: (vectors, cells)."""
        size = vectors.shape[1]
        distance = self.distances(vectors, False)
        low, high = (np.array([self.ranges.get((size, c), (np.inf, -np.inf))[i] for c in range(distance.shape[1])]) for i in (0, 1))
        gap = np.maximum(np.maximum(low - distance, distance - high), 0.0)
        reach = self.longest[size] + (vectors**2).sum(1)
        radius = np.sqrt(np.maximum(reach - 2 * worst, 0.0))
        return gap <= (factor * radius + 1e-7 * (1 + np.sqrt(reach)))[:, None]


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _by_size(batch):
    """(size, rows of that size) of a batch with a column size."""
    sizes = np.asarray(batch.column("size").to_pylist())
    for size in sorted(set(sizes.tolist())):
        yield size, batch.take(pa.array(np.flatnonzero(sizes == size)))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = 8_192, block_rows: int = 16_384, most_cells: int = 1_024
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` to each row of `queries`.

    Both have vec_id and embedding; a row is not its own neighbour. Nearest has the largest inner
    product in double precision, ties go to the smaller vec_id, and with fewer than k candidates
    all are returned. Unusable vectors (see `usable`) and null ids take no part; vectors of different
    lengths have no product and never meet. Rows that repeat a vec_id are one row if their vectors are
    equal, and candidates of that id each if not. Other columns are not read.

    Equal vectors are searched once: of each, the k + 1 smallest ids are all that can rank. Points are dealt
    by nearness: each to the cell of the nearest of `most_cells` pivots at most, and large cells to shards of about
    `shard_rows`, each with a tree. A query is searched in its own cell first, then in those whose range of
    distances can still hold a better point; `factor` relaxes that bound as it does the trees'. Only the pivots
    and the cells' ranges are broadcast.
    """
    spark = vectors.sparkSession

    def clean(df):
        v = F.col("embedding").cast("array<double>")
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))

    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    listed = clean(vectors).distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    points = listed.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stored(points.select(F.element_at("ids", 1).alias("low"), "ids", F.size("embedding").alias("size"), "embedding"), "points")
    asked = clean(queries).distinct()
    firsts = asked.groupBy("embedding").agg(F.min("vec_id").alias("query"))
    asked = stored(asked.join(firsts, "embedding").withColumn("size", F.size("embedding")), "queries")
    distinct = asked.where("vec_id = query").select("query", "size", "embedding")

    cells, shards = _dealt(points, shard_rows, most_cells)
    trees = stored(_trees(shards), "trees")
    held = spark.sparkContext.broadcast(cells)
    home = stored(_sent(distinct.withColumn("least", F.lit(float("-inf"))), held, None), "queries-home")
    hits = stored(_searched(home, trees, k, factor, block_rows), "hits")
    best = Window.partitionBy("query", "size").orderBy(F.desc("score"), "low")
    if len(cells.ranges) > 1:
        worst = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") == k + 1).select("query", "size", F.col("score").alias("least"))
        again = distinct.join(worst, ["query", "size"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        others = stored(_sent(again, held, factor), "queries-others")
        hits = hits.unionByName(stored(_searched(others, trees, k, factor, block_rows), "hits"))
    found = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    named = found.join(points.select("low", "size", "ids"), ["low", "size"]).select("query", "size", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query", "size").orderBy(F.desc("score"), "vec_id")
    named = named.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    own = asked.select(F.col("vec_id").alias("query_id"), "query", "size")
    each = own.join(named, ["query", "size"]).where("vec_id <> query_id")
    place = Window.partitionBy("query_id", "size").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(points: DataFrame, shard_rows: int, most_cells: int) -> tuple[Cells, DataFrame]:
    """The cells, and `points` with cell and part: the shard of its cell."""
    spark = points.sparkSession
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    sizes = points.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).collect()  # one a vector length
    total = max(sum(r["n"] for r in sizes), 1)
    wanted = min(most_cells, -(-total // shard_rows))
    place = F.row_number().over(Window.partitionBy("size").orderBy("hash", "low"))
    few = points.withColumn("hash", F.xxhash64("low", F.lit(9))).where(F.pmod("hash", F.lit(1 << 30)) <= F.lit(int(min(1.0, 8 * wanted / total) * (1 << 30))))
    chosen: dict[int, list] = {r["size"]: [] for r in sizes}
    for r in few.withColumn("n", place).where(F.col("n") <= wanted).select("size", "embedding").collect():  # most_cells a vector length
        chosen[r["size"]].append(r["embedding"])
    pivots = {size: np.array(v or [[0.0] * size], np.float64) for size, v in chosen.items()}
    cells = Cells({r["size"]: r["longest"] for r in sizes}, pivots)
    held = spark.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            for size, own in _by_size(batch):
                distance = held.value.distances(_matrix(own.column("embedding")), True)
                cell = distance.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(cell.astype(np.int32)), pa.array(distance[np.arange(len(cell)), cell])], names=[*own.schema.names, "cell", "distance"]
                )

    fields = "low long, size int, embedding array<double>, cell int, distance double"
    placed = stored(points.select("low", "size", "embedding").mapInArrow(run, fields), "cells")
    found = placed.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).collect()
    # A distance is known to the root of the rounding of its square.
    cells.ranges = {(r["size"], r["cell"]): (r["lo"] - 1e-7 * (1 + r["lo"]), r["hi"] + 1e-7 * (1 + r["hi"])) for r in found}
    parts = spark.createDataFrame([(r["size"], r["cell"], -(-r["n"] // shard_rows)) for r in found], "size int, cell int, parts int")
    shards = placed.drop("distance").join(F.broadcast(parts), ["size", "cell"])
    return cells, shards.withColumn("part", F.pmod(F.xxhash64("low"), F.col("parts")).cast("int"))


def _trees(shards: DataFrame) -> DataFrame:
    """size, cell, part, tree of every shard."""

    def build(table: pa.Table) -> pa.Table:
        tree = Tree.build(_matrix(table.column("embedding")), np.array(table.column("low").to_pylist(), np.int64))
        return pa.table([*(table.column(c)[:1] for c in ("size", "cell", "part")), pa.array([pickle.dumps(tree)], pa.binary())], names=["size", "cell", "part", "tree"])

    return shards.groupBy("size", "cell", "part").applyInArrow(build, "size int, cell int, part int, tree binary")


def _sent(queries: DataFrame, cells, factor: float | None) -> DataFrame:
    """A row of `queries` for its own cell (no factor), or for each other cell that may hold points of its `least` product or better."""

    def run(batches):
        for batch in batches:
            for size, own in _by_size(batch):
                if size not in cells.value.pivots:
                    continue  # no point has as many components
                asked = _matrix(own.column("embedding"))
                home = cells.value.distances(asked, False).argmin(1)
                if factor is None:
                    row, cell = np.arange(len(home)), home
                else:
                    open_ = cells.value.may_hold(asked, np.array(own.column("least").to_pylist()), factor)
                    open_[np.arange(len(home)), home] = False
                    row, cell = np.nonzero(open_)
                out = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32))], names=[*out.schema.names, "cell"])

    rows = queries.select("query", "size", "embedding", "least")
    return rows.mapInArrow(run, "query long, size int, embedding array<double>, least double, cell int")


def _searched(sent: DataFrame, trees: DataFrame, k: int, factor: float, block_rows: int) -> DataFrame:
    """query, size, low, score of the best of every shard of each cell that a query is sent to.

    Queries meet a shard's tree in blocks, so that a task holds one tree and one block.
    """
    kind = pa.schema([("query", pa.int64()), ("size", pa.int32()), ("low", pa.int64()), ("score", pa.float64())])
    blocks = sent.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))  # one a cell
    keys = ["size", "cell", "part", "block"]
    tiles = trees.join(F.broadcast(blocks), ["size", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shards = trees.groupBy("size", "cell").agg((F.max("part") + 1).alias("parts")).join(blocks, ["size", "cell"])
    asked = sent.join(F.broadcast(shards), ["size", "cell"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))

    def search(block: pa.Table, tree: pa.Table) -> pa.Table:
        if not tree.num_rows or not block.num_rows:
            return kind.empty_table()
        names, least = block.column("query").to_numpy(), block.column("least").to_numpy()
        low, score, _ = pickle.loads(tree.column("tree")[0].as_py()).search(_matrix(block.column("embedding")), k + 1, factor, least)
        held = low.ravel() >= 0
        size = np.full(held.sum(), block.column("size")[0].as_py(), np.int32)
        return pa.table([np.repeat(names, low.shape[1])[held], size, low.ravel()[held], score.ravel()[held]], schema=kind)

    dealt = asked.select(*keys, "query", "least", "embedding").groupBy(*keys)
    return dealt.cogroup(tiles.select(*keys, "tree").groupBy(*keys)).applyInArrow(search, "query long, size int, low long, score double")
