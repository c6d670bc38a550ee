"""Tables in the folder that driver and executors share, and small helpers that every operator uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all runs on one machine (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        folder = tempfile.mkdtemp(prefix="chronomill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder.append(folder)
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/chronomill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a read of the table, not a second run of
    what made it, and every reader sees the same rows.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like `stored`, as a table of the catalog dealt by `key`: a join or group on it needs no shuffle of its rows.

    Its files are in the shared folder as well; the session's catalog only knows how they are dealt.
    """
    path = new_path(df.sparkSession, name)
    table = f"chronomill_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.table(table)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete `path`, which exists, when it ends: plans that read it may run until then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """`wanted` with as many underscores behind each as keep it apart from all `columns`, upper and lower case alike."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """`name` for F.col, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def all_of(columns: list[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in columns]


def appended(df: DataFrame, run, fields: list[StructField]) -> DataFrame:
    """All columns of `df` and those that `run` puts behind them, batch by batch in Arrow; any names may stand in `df`."""
    odd = [c for c in df.columns if not c.replace("_", "a").isalnum()]
    plain = dict(zip(odd, free_names(df.columns, *(f"column{i}" for i in range(len(odd))))))
    names = [plain.get(c, c) for c in df.columns]
    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, df.schema.fields)] + fields)
    return df.toDF(*names).mapInArrow(run, schema).toDF(*df.columns, *(f.name for f in fields))


#: Bits of one row of a bitmap: what bitmap_construct_agg makes.
_BITMAP_BITS = 32_768


def flagged(rows: DataFrame, key: str, wanted: DataFrame, flag: str, most_bits: int = 27) -> DataFrame:
    """`rows` and `flag`: true where the long `key` is in the column `key` of `wanted`, and in a few rows besides.

    For rows with long texts, of which few are wanted: those that are not never reach the shuffle of the join
    that follows, which decides. The wanted keys are marked in a bitmap of 16 bits a key and 2**`most_bits` bits at
    most (16 MB), which is broadcast; where there are more keys than it tells apart, more rows are flagged, never fewer.
    """
    bits = int(min(most_bits, max(15, (16 * max(wanted.count(), 1)).bit_length())))
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    part, mark, place = free_names([*rows.columns, flag], "_part", "_marks", "_place")
    marks = (
        wanted.select(slot.alias(place))
        .groupBy(F.floor(F.col(place) / _BITMAP_BITS).cast("int").alias(part))
        .agg(F.bitmap_construct_agg((F.col(place) % _BITMAP_BITS)).alias(mark))
    )
    placed = rows.withColumns({part: F.floor(slot / _BITMAP_BITS).cast("int"), place: (slot % _BITMAP_BITS).cast("int")})
    byte = F.conv(F.hex(F.substring(mark, F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, F.col(place) % 8).bitwiseAND(1) == 1
    return placed.join(F.broadcast(marks), part, "left").select(*all_of(rows.columns), F.coalesce(held, F.lit(False)).alias(flag))


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of `rows` that `flagged` flags."""
    (flag,) = free_names(rows.columns, "_flag")
    return flagged(rows, key, wanted, flag).where(F.col(flag)).drop(flag)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def hashed_sample(df: DataFrame, expected_rows: int) -> DataFrame:
    """About `expected_rows` rows of `df`, picked by a hash of its doc_id and text (what there is of them).

    Never more than twice as many, also if a text fills the table, then those with the lowest hashes; all rows, if there are fewer.
    """
    total = df.count()
    if total <= expected_rows:
        return df
    limit = int(expected_rows / total * (1 << 30))
    keys = [c for c in ("doc_id", "text") if c in df.columns]
    place = F.pmod(F.xxhash64(F.lit("sample"), *[F.col(c) for c in keys]), F.lit(1 << 30))
    return df.where(place < limit).orderBy(place).limit(2 * expected_rows)


def slices(batches, column: str, limit: int = 4_000_000):
    """Arrow record batches cut so that the texts of each part stay near `limit` characters.

    A part holds one row at least, so one very long text is a part of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = held = 0
        for i, size in enumerate(sizes):
            if i > first and held + size > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)


def texts_of(batch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]
