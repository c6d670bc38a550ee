"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .components import components
from .shared import all_of, flagged, free_names, narrowed, slices, stored, text_or_empty
from .words import WordHashes, rolling, words_of

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Gram sets that can count as hot at most.
MOST_HOT = 16_384


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """Bands and rows per band: the fewest bands of `rows` rows whose chance to
    bring a pair of similarity `threshold` together is at least `recall`."""
    bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
    return bands, rows


def gram_set(words: list[bytes], hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; a shorter text is one gram; no words, none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes.of(words), min(width, len(words))))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = (rng.integers(0, 1 << 32, bands * rows, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.shifts = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)

    def band_hashes(self, grams: np.ndarray) -> list[int]:
        """One 64-bit hash for each band of the signature of a gram set that is not empty."""
        x = (grams >> np.uint64(32)).astype(np.uint32)[:, None]
        low = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            h = (x[at : at + 2048] ^ self.shifts) * self.factors
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            np.minimum(low, h.min(0), out=low)
        parts = low.reshape(self.bands, self.rows)
        return [xxhash.xxh3_64_intdigest(p.tobytes(), k) - (1 << 63) for k, p in enumerate(parts)]


def sketches(docs: DataFrame, bands: int, rows: int, width: int = WORDS) -> DataFrame:
    """doc_id, text_key, node (64-bit fingerprint of the gram set; null without words), size (its grams), bands."""
    fields = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))]
    kind = pa.schema(fields)

    def run(batches):
        hashes, minhash = WordHashes(), MinHash(bands, rows)
        for part in slices(batches, "text"):
            nodes, sizes, signed = [], [], []
            for text in part.column("text").to_pylist():
                grams = gram_set(words_of(text), hashes, width)
                nodes.append(fingerprint(grams) if len(grams) else None)
                sizes.append(len(grams))
                signed.append(minhash.band_hashes(grams) if len(grams) else None)
            own = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signed, kind.field("bands").type)]
            yield pa.record_batch([part.column("doc_id"), part.column("text_key"), *own], schema=kind)

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, size long, bands array<long>")


def fingerprint(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, in blocks of a matrix product."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float64)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    member = np.repeat(np.arange(m), sizes)
    distinct, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    member, column = member[keep], number[column[keep]]
    out = np.zeros((m, m))
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    width = max(256, 8_000_000 // max(m, 1))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, min(width, int(shared.sum()) - at)), np.float32)
        block[member[lo:hi], column[lo:hi] - at] = 1
        out += block @ block.T
    return out


def linked(sets: list[np.ndarray], threshold: float, first: int | None = None) -> np.ndarray:
    """Which pairs reach `threshold`. With `first`, only pairs of one of the first `first` sets and a later one."""
    both = overlaps(sets)
    sizes = np.fromiter(map(len, sets), np.float64, len(sets))
    yes = both >= threshold * (sizes[:, None] + sizes[None] - both) - 1e-9
    np.fill_diagonal(yes, False)
    if first is not None:
        yes[:first, :first] = False
        yes[first:, first:] = False
    return yes


def _roots(yes: np.ndarray) -> np.ndarray:
    """The first member that each member is connected with."""
    root = np.arange(len(yes))
    while True:
        near = np.where(yes, root[None], len(yes)).min(1, initial=len(yes))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar_documents(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, recall: float = RECALL, tile: int = 512, tile_grams: int = 8_000_000, hot_rows: int = 1_000
) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, kept, n_copies, n_links.

    Two documents are linked if the Jaccard similarity of their sets of `width`-word grams is at
    least `threshold`; linked documents, directly or through others, are one class, named by its
    smallest doc_id, which is the one kept. n_copies counts the rows with the same set (itself
    included), n_links all other rows that a row is linked with, copies included. Null text counts
    as empty. A text without words has no grams and no links: it is a class of its own. Rows
    that repeat an id are judged each by its own text, so `kept` may differ among them; a null id is kept only where its class
    has no id at all. No rows give no rows; other columns are not read.

    Equal sets are one node. Nodes that share a band hash meet in that bucket with their full sets, each pair in
    the first band that it shares, so every pair is verified once. Only verified links make classes. A
    bucket of over `tile` nodes (or `tile_grams` grams) is verified in tiles of parts against parts; a tile gives counts and
    a spanning forest of its links, never pairs. Sets with over `hot_rows` copies, bounded in number, are joined to their rows by broadcast.
    """
    return _judged(docs, threshold, width, recall, tile, tile_grams, hot_rows).drop("text_key", "root")


def _judged(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, recall: float = RECALL, tile: int = 512, tile_grams: int = 8_000_000, hot_rows: int = 1_000
) -> DataFrame:
    """The rows of `similar_documents` with their text_key and root (a node of the class; null without words).

    A node stands in edges as (no_id, low_id, node) with its smallest doc_id first, so the smallest
    of a class, which its component is named by, holds the class's name.
    """
    bands, rows = choose_bands(threshold, recall)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    read = read.withColumn("text_key", F.xxhash64("text"))
    sketch = stored(sketches(read, bands, rows, width), "sketches")
    # Copies of a set are combined before the shuffle.
    nodes = stored(
        sketch.where("node is not null")
        .groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("doc_id").alias("low_id"),
            F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("low_key"),
            F.first("size").alias("size"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    members = _companions(nodes, tile, tile_grams)
    whose = (F.col("text_key") == F.col("low_key")) & F.col("doc_id").eqNullSafe(F.col("low_id"))
    with_text = narrowed(read, "text_key", members.select(F.col("low_key").alias("text_key"))).join(members, whose)
    tallies = stored(_verified(_tiles(_gram_rows(with_text, width)), threshold), "links")
    classes = components(tallies.select(F.col("node").alias("a"), F.col("with").alias("b")))
    classes = classes.select("node.node", F.col("root.node").alias("root"), _name(F.col("root")).alias("class_id"))
    links = tallies.groupBy("node.node").agg(F.sum("links").alias("links"))
    verdict = nodes.join(links.join(classes, "node"), "node", "left").select(
        "node",
        F.coalesce("root", "node").alias("root"),
        F.when(F.col("root").isNull(), F.col("low_id")).otherwise(F.col("class_id")).alias("class_id"),
        "copies",
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    verdict = stored(verdict, "verdicts")
    # Fewer than MOST_HOT nodes can have over a MOST_HOTth of all rows; their verdicts go to the rows, not the rows to them.
    many = max(hot_rows, (nodes.agg(F.sum("copies")).first()[0] or 0) // MOST_HOT)
    hot = verdict.where(F.col("copies") > many)
    own = sketch.select("doc_id", "text_key", "node")
    rest = own.join(F.broadcast(hot.select("node")), "node", "left_anti").join(verdict.where(F.col("copies") <= many), "node", "left")
    found = own.join(F.broadcast(hot), "node").unionByName(rest)
    class_id = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return found.select(
        "doc_id",
        "text_key",
        "root",
        class_id.alias("class_id"),
        F.col("doc_id").eqNullSafe(class_id).alias("kept"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
    )


def _vertex() -> Column:
    """A node as it stands in edges: the smallest id first, no id behind all ids."""
    return F.struct(F.col("low_id").isNull().alias("no_id"), F.coalesce("low_id", F.lit(0)).alias("low_id"), F.col("node").alias("node"))


def _name(vertex: Column) -> Column:
    return F.when(~vertex["no_id"], vertex["low_id"])


def _companions(nodes: DataFrame, tile: int, tile_grams: int) -> DataFrame:
    """Nodes that meet another one, with their places: (band, hash, parts) of each bucket where a pair of theirs
    meets for the first time; node, vertex, copies, low_id, low_key, bands, places.

    Sizes of buckets are partial sums. Small buckets are looked through by their signatures alone, so that full sets
    go only where they are needed; large ones are taken as they are.
    """
    placed = nodes.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    bucket = F.xxhash64("band", "hash")
    sizes = placed.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("grams")).where("nodes > 1")
    parts = F.ceil(F.greatest(F.col("nodes") / tile, F.col("grams") / tile_grams)).cast("int")
    sizes = stored(sizes.select("band", "hash", "nodes", parts.alias("parts")), "buckets")
    met = narrowed(placed.drop("size").withColumn("bucket", bucket), "bucket", sizes.select(bucket.alias("bucket"))).drop("bucket")
    met = stored(met.join(sizes, ["band", "hash"]), "met")
    small = met.where(F.col("nodes") <= tile).drop("nodes").join(nodes.select("node", "bands"), "node")
    large = met.where(F.col("nodes") > tile).drop("nodes")
    needed = _first_met(small).unionByName(large)
    places = needed.groupBy("node").agg(F.collect_list(F.struct("band", "hash", "parts")).alias("places"))  # at most one a band
    return stored(nodes.join(places, "node").withColumn("vertex", _vertex()).drop("size"), "members")


def _first_met(placed: DataFrame) -> DataFrame:
    """Rows (node, band, hash, parts) of `placed` whose node shares no earlier band with some other node of the bucket."""

    def run(batches):
        for key, group in itertools.groupby(_python_rows(batches, ["band", "hash", "parts", "node", "bands"]), lambda r: r[:3]):
            members = [r[3:] for r in group]
            first = _earlier(np.array([m[1] for m in members], np.int64), None, key[0])
            np.fill_diagonal(first, True)
            own = [m[0] for m, shared in zip(members, first.all(1)) if not shared]
            if own:
                columns = [pa.array(own, pa.int64()), *(pa.array([x] * len(own), t) for x, t in zip(key, (pa.int32(), pa.int64(), pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "band", "hash", "parts"])

    dealt = placed.repartition("band", "hash").sortWithinPartitions("band", "hash", "parts")
    return dealt.mapInArrow(run, "node long, band int, hash long, parts int")


def _python_rows(batches, names: list[str]):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _earlier(bands: np.ndarray, others: np.ndarray | None, band: int) -> np.ndarray:
    """Which pairs of rows of `bands` and `others` (by default the same) share a band before `band`."""
    others = bands if others is None else others
    out = np.zeros((len(bands), len(others)), bool)
    for k in range(band):
        out |= bands[:, k, None] == others[None, :, k]
    return out


def _tiles(members: DataFrame) -> DataFrame:
    """A row for each place of a member and each tile of its bucket that it belongs to."""
    at = members.select("vertex", "copies", "bands", "grams", F.explode("places").alias("place"))
    at = at.select("place.*", "vertex", "copies", "bands", "grams")
    part = F.pmod(F.xxhash64("vertex.node", F.lit(5)), F.col("parts")).cast("int")
    at = at.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    row, col = F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col")
    return at.select("band", "hash", row, col, "part", "vertex", "copies", "bands", "grams")


def _gram_rows(members: DataFrame, width: int) -> DataFrame:
    """The full gram set of each member's text; of rows that share an id, those whose set is the node's."""
    names = ["vertex", "copies", "bands", "places"]
    schema = StructType([*(members.schema[n] for n in names), StructField("grams", BinaryType())])

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            nodes = batch.column("node").to_pylist()
            sets = [gram_set(words_of(x), hashes, width) for x in batch.column("text").to_pylist()]
            own = pa.array([fingerprint(s) == n for s, n in zip(sets, nodes)])
            grams = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), grams], names=[*names, "grams"]).filter(own)

    return members.mapInArrow(run, schema)


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """For each member of each tile: node, with (a node that it is connected with in the tile), links; nodes as vertices."""
    vertex = tiles.schema["vertex"].dataType
    kind = pa.struct([("no_id", pa.bool_()), ("low_id", pa.int64()), ("node", pa.int64())])

    def settle(key, table: list[tuple]):
        band, row, col = key[0], key[2], key[3]
        seen, members = set(), []
        for m in sorted(table, key=lambda m: (m[0] != row, m[1]["node"])):  # rows that repeat an id repeat its set
            if m[1]["node"] not in seen:
                seen.add(m[1]["node"])
                members.append(m)
        if len(members) < 2:
            return [], [], []
        copies = np.array([m[2] for m in members])
        bands = np.array([m[3] for m in members], np.int64)
        first = None if row == col else sum(m[0] == row for m in members)
        yes = linked([np.frombuffer(m[4], np.uint64) for m in members], threshold, first) & ~_earlier(bands, None, band)
        hit = np.flatnonzero(yes.any(1))
        roots = _roots(yes)
        return [members[i][1] for i in hit], [members[roots[i]][1] for i in hit], (yes @ copies)[hit].tolist()

    def run(batches):
        out: list[list] = [[], [], []]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (kind, kind, pa.int64()))], names=["node", "with", "links"])
        rows = _python_rows(batches, ["band", "hash", "row", "col", "part", "vertex", "copies", "bands", "grams"])
        for key, group in itertools.groupby(rows, lambda r: r[:4]):
            for column, values in zip(out, settle(key, [r[4:] for r in group])):
                column.extend(values)
            if len(out[0]) > 20_000:
                yield batch()
                out = [[], [], []]
        yield batch()

    schema = StructType([StructField("node", vertex), StructField("with", vertex), StructField("links", LongType())])
    keys = ["band", "hash", "row", "col"]
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with one document of each class of similar documents, all columns as they were.

    A row is told by its id and its text: other texts of a repeated id, or of a null id, stay or go
    with their own classes. Where several rows of a class have the id that is kept, one of them stays.
    """
    judged = stored(_judged(docs, **settings).select("doc_id", "text_key", "root", "kept"), "near-verdicts")
    kept = judged.where("kept and root is not null")
    several = kept.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min("text_key").alias("stay_key")).where("rows > 1")
    repeated = kept.join(several, "root").select("doc_id", "text_key", (F.col("text_key") != F.col("stay_key")).alias("drop"))
    marks = judged.where("not kept").select("doc_id", "text_key", F.lit(True).alias("drop")).union(repeated).distinct()
    key, row, mark_id, mark, drop, maybe = free_names(docs.columns, "_key", "_row", "_mark_id", "_mark", "_drop", "_maybe")
    marks = stored(marks.select(F.col("doc_id").alias(mark_id), F.col("text_key").alias(mark), F.col("drop").alias(drop)), "near-marks")
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty()))
    # Only rows that may have a mark are shuffled.
    keyed = flagged(keyed, key, marks.select(F.col(mark).alias(key)), maybe)
    unmarked, keyed = keyed.where(~F.col(maybe)).select(*all_of(docs.columns)), keyed.where(F.col(maybe))
    same = (F.col(key) == F.col(mark)) & F.col("doc_id").cast("long").eqNullSafe(F.col(mark_id))
    alone = keyed.join(marks.drop(drop), same, "left_anti").select(*all_of(docs.columns))
    repeats = Window.partitionBy(key, "doc_id").orderBy(key)
    first = keyed.join(marks.where(~F.col(drop)).drop(drop), same, "left_semi").withColumn(row, F.row_number().over(repeats))
    return unmarked.union(alone).union(first.where(F.col(row) == 1).select(*all_of(docs.columns)))
