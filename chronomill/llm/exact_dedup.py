"""Exact dedup by an extendible-hash index kept in the shared folder (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import all_of, free_names, gone_at_exit, new_path, quoted, stored, text_or_empty

MAX_DEPTH = 16
#: Keys that can count as hot at most, and the tasks over which the rows of one are spread.
MOST_HOT, SALTS = 16_384, 32
MOST_OWNERS = 20_000


def split_directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Global depth and directory (slot to bucket) of an extendible hash table.

    `counts` has the rows of each of the 2**max_depth finest slots. A bucket that holds
    over `capacity` rows is split on its next bit; when it is as deep as the directory,
    the directory doubles first. At `max_depth` a bucket is left overfull, and its rows chain.
    """
    sums = [0] * (1 << max_depth)
    for slot, n in counts.items():
        sums[slot] = n
    levels = [sums]
    while len(levels[-1]) > 1:
        finer = levels[-1]
        levels.append([finer[i] + finer[i + 1] for i in range(0, len(finer), 2)])
    levels.reverse()
    directory, local, starts, depth, bucket = [0], [0], [0], 0, 0
    while bucket < len(local):
        rows = levels[local[bucket]][starts[bucket] >> (depth - local[bucket])]
        if rows <= capacity or local[bucket] == max_depth:
            bucket += 1
            continue
        if local[bucket] == depth:
            directory = [x for x in directory for _ in range(2)]
            starts = [2 * x for x in starts]
            depth += 1
        half = 1 << (depth - local[bucket] - 1)
        at = starts[bucket] + half
        directory[at : at + half] = [len(local)] * half
        local[bucket] += 1
        local.append(local[bucket])
        starts.append(at)
    return depth, directory


def _slot(key: Column, depth: int) -> Column:
    """The first `depth` bits of a key's place in the hash range."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - depth).cast("int") if depth else F.lit(0)


@dataclass(frozen=True)
class Directory:
    """Slots of the hash range and the bucket of each, kept in the shared folder; keys with many rows beside it.

    A bucket is a range of the hash, buckets are numbered in its order, and an owner task has a run of them.
    """

    slots: DataFrame  # slot, bucket: 2**MAX_DEPTH rows at most
    hot: DataFrame  # key: MOST_HOT rows at most
    depth: int
    buckets: int

    @classmethod
    def of(cls, keys: DataFrame, bucket_rows: int, hot_rows: int) -> Directory:
        """Made from the column `key` of all rows."""
        spark = keys.sparkSession
        counts = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-counts")
        dealt = F.when(F.col("n") > hot_rows, 1).otherwise(F.col("n"))  # rows of a hot key are combined before
        filled = counts.groupBy(_slot(F.col("key"), MAX_DEPTH).alias("slot")).agg(F.sum(dealt).alias("n"), F.sum("n").alias("rows"))
        found = filled.collect()  # at most 2**MAX_DEPTH rows, whatever the input
        depth, split = split_directory({r["slot"]: r["n"] for r in found}, bucket_rows)
        if depth == 0:
            depth, split = 1, split * 2  # so that a slot is always looked up by its key
        order = {b: i for i, b in enumerate(dict.fromkeys(split))}
        slots = spark.createDataFrame([(i, order[b]) for i, b in enumerate(split)], "slot int, bucket int")
        # Fewer than MOST_HOT keys can have over a MOST_HOTth of all rows.
        many = max(hot_rows, sum(r["rows"] for r in found) // MOST_HOT)
        return cls(stored(slots, "dedup-directory"), stored(counts.where(F.col("n") > many).select("key"), "dedup-hot"), depth, len(order))

    def located(self, rows: DataFrame, key: str, bucket: str, hot: str) -> DataFrame:
        """`rows` with the bucket of their `key`, and whether the key has many rows."""
        slot, flag = free_names([*rows.columns, bucket, hot], "_slot", "_flag")
        hot_keys = self.hot.select(F.col("key").alias(flag))
        slots = self.slots.select(F.col("slot").alias(slot), F.col("bucket").alias(bucket))
        at = rows.withColumn(slot, _slot(F.col(key), self.depth)).join(F.broadcast(slots), slot)
        at = at.join(F.broadcast(hot_keys), F.col(key) == F.col(flag), "left")
        return at.withColumn(hot, F.col(flag).isNotNull()).drop(slot, flag)

    def dealt(self, rows: DataFrame, bucket: str, owner: str) -> DataFrame:
        """`rows` with their owner task: a run of buckets each, one bucket at least."""
        owners = int(min(self.buckets, MOST_OWNERS))
        at = rows.withColumn(owner, F.floor(F.col(bucket) * F.lit(owners) / self.buckets).cast("int"))
        return at.repartitionById(owners, owner)


@dataclass(frozen=True)
class Index:
    """The stored index: its directory, and a folder of files for each bucket.

    Entry: bucket, key, chain (place among the entries of one key), text_sha256, hot, keep_id, group_size.
    """

    directory: Directory
    path: str

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key long, chain int, text_sha256 string, hot boolean, keep_id long, group_size long, bucket int").parquet(self.path)

    def looked_up(self, keys: DataFrame) -> DataFrame:
        """`keys` (doc_id, key, text_sha256) with the keep_id and group_size of their entry.

        The directory names the bucket where an entry is looked for, and the chain's entries are told apart by SHA-256,
        since their bytes have been compared. The rows of a hot key are spread over SALTS tasks.
        """
        spread = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int")
        rows = self.directory.located(keys, "key", "bucket", "hot").withColumn("salt", F.when(F.col("hot"), spread).otherwise(0)).drop("hot")
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        entries = self.entries(keys.sparkSession).withColumn("salt", F.explode(salts)).drop("hot", "chain")
        return rows.join(entries, ["bucket", "key", "text_sha256", "salt"]).drop("bucket", "salt")


def _keys(docs: DataFrame, text_col: str, key_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text_or_empty(text_col)), 64 - key_bits)


def exact_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 8_192, key_bits: int = 64, hot_rows: int = 1_000
) -> tuple[DataFrame, Index]:
    """The keys of all rows (doc_id, key, text_sha256), and the index of all distinct texts.

    Rows are dealt by the bucket of their key to owner tasks. An owner sorts the texts of each key and compares the bytes of
    neighbours: where they differ, the chain of that key has another entry. `key_bits` below 64 makes keys collide.
    Texts of a hot key, one with over `hot_rows` rows, are combined before they are dealt.
    """
    docs = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("key", _keys(docs, "text", key_bits))
    keys = stored(docs.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), "dedup-keys")
    directory = Directory.of(keys, bucket_rows, hot_rows)
    rows = directory.located(docs, "key", "bucket", "hot")
    one = rows.where(~F.col("hot")).select("bucket", "key", "hot", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    many = rows.where("hot").groupBy("bucket", "key", "hot", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    owned = directory.dealt(one.unionByName(many), "bucket", "owner")
    line = Window.partitionBy("owner", "bucket", "key").orderBy("text")
    fresh = owned.withColumn("fresh", F.coalesce(F.lag("text").over(line) != F.col("text"), F.lit(True)))
    chained = fresh.withColumn("chain", F.sum(F.col("fresh").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    entries = chained.groupBy("owner", "bucket", "key", "chain").agg(
        F.max(F.when(F.col("fresh"), F.sha2("text", 256))).alias("text_sha256"),
        F.max("hot").alias("hot"),
        F.max("keep_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
    )
    path = new_path(docs.sparkSession, "dedup-index")
    entries.select("key", "chain", "text_sha256", "hot", "keep_id", "group_size", "bucket").write.partitionBy("bucket").option(
        "compression", "zstd"
    ).parquet(path)
    gone_at_exit(docs.sparkSession, path)
    return keys, Index(directory, path)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The largest id of each group of equal texts stays; rows that
    repeat both id and text are all marked alike, and a null id stays only when no row of its
    group has an id. Further columns of `docs` are not read. No rows give no rows.
    """
    keys, made = exact_index(docs, id_col, text_col, **index)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return made.looked_up(keys).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def without_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 8_192, key_bits: int = 64, hot_rows: int = 1_000
) -> DataFrame:
    """`docs` with one row for each distinct text, that with the largest id; all columns as they were, whatever their names.

    Null text counts as empty. Of rows that repeat the id that stays, one is kept; where no row of a group has an id, one of them.
    Whole rows go to the owners of their buckets, once; of a hot key only the best row of each text of a task.
    """
    key, bucket, hot, owner, text, row, none = free_names(docs.columns, "_key", "_bucket", "_hot", "_owner", "_text", "_row", "_none")
    same = docs.schema[text_col].dataType == StringType()  # then the text itself need not travel twice
    carried = [c for c in docs.columns if not (same and c == text_col)]
    keyed = docs.select(
        text_or_empty(text_col).alias(text),
        F.col(quoted(text_col)).isNull().alias(none),
        F.struct(*all_of(carried)).alias(row),
    ).withColumn(key, F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits))
    directory = Directory.of(stored(keyed.select(F.col(key).alias("key")), "dedup-keys"), bucket_rows, hot_rows)
    rows = directory.located(keyed, key, bucket, hot)
    payload = F.struct(F.col(none), F.col(row))
    number = lambda payload: payload[row][id_col]
    best = F.coalesce(F.max_by(payload, F.col(row)[id_col]), F.first(payload))
    many = rows.where(F.col(hot)).groupBy(bucket, key, text).agg(best.alias(row))
    one = rows.where(~F.col(hot)).select(bucket, key, text, payload.alias(row))
    owned = directory.dealt(one.unionByName(many), bucket, owner)
    line = Window.partitionBy(owner, bucket, key).orderBy(F.col(text), number(F.col(row)).desc_nulls_last())
    first = owned.withColumn(hot, F.coalesce(F.lag(text).over(line) != F.col(text), F.lit(True))).where(F.col(hot))
    back = [F.when(~F.col(row)[none], F.col(text)).alias(c) if same and c == text_col else F.col(row)[row][c].alias(c) for c in docs.columns]
    return first.select(*back)
