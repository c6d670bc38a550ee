"""Token counts kept as rollups of signed changes."""

from __future__ import annotations

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import PreTokenizer, read_ranks
from .packing import WordBpe
from .shared import removed, slices, text_or_empty, texts_of

KEYS = ["source", "lang", "tokenizer"]
_FIELDS = "source string, lang string, tokenizer string, docs long, tokens long"

class ByteCounter:
    """How many ids a text has by a file of ranks, each match of `pattern` being encoded by itself."""

    LIMIT = 300_000

    def __init__(self, path: str, pattern: str):
        self.split = PreTokenizer(pattern).split
        self.core = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})
        self.known: dict[str, int] = {}

    def _new(self, word: str) -> int:
        n = len(self.core.encode_ordinary(word))
        if len(word) <= 64:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            self.known[word] = n
        return n

    def __call__(self, text: str) -> int:
        known = self.known
        return sum(known[w] if w in known else self._new(w) for w in self.split(text))


class WordCounter:
    """How many ids a text has by a word-end vocabulary."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)

    def __call__(self, text: str) -> int:
        return len(self.bpe.encode(text)) // 4


def counter(path: str, pattern: str | None = None):
    """A function from texts to counts, by the kind of vocabulary file: ranks with a `pattern`, or a word-end vocabulary."""
    return ByteCounter(path, pattern) if path.endswith(".tiktoken") else WordCounter(path)


def counted(docs: DataFrame, tokenizers: dict[str, tuple]) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens of every whole text by each of `tokenizers`, in one scan.

    `tokenizers` has the arguments of `counter` by tokenizer version. Null text counts as empty, which has no tokens. Other
    columns are not read; rows that repeat an id are counted each.
    """
    names = ["doc_id", "source", "lang"]
    kind = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("tokens", pa.int64())])

    def run(batches):
        counters = {name: counter(*given) for name, given in tokenizers.items()}
        for part in slices(batches, "text"):
            texts = texts_of(part)
            for name, count in counters.items():
                own = [pa.array([name] * len(texts), pa.string()), pa.array(map(count, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *own], schema=kind)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in KEYS[:2]], text_or_empty().alias("text"))
    return read.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts that change: the old ones leave, the new ones come."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version, in a shared folder.

    A commit adds up a batch's signed changes on the executors and writes one small table, named by the
    batch id; Spark's committer makes it visible as a whole. A batch id that is already there is left
    as it is, so a repeated commit changes nothing, and one that died halfway is written anew.
    Totals are the sum over all batches, in any order, so late batches are as good as early ones.
    Null keys are keys of their own. Keys whose documents have all left are not reported.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.path}/batch={batch}/_SUCCESS")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply `changes` (KEYS, tokens, sign); False if this batch id has been applied before. A null count counts as no tokens."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch!r}")
        if self.committed(batch):
            return False
        signed = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens")
        )
        changed = signed.where("docs <> 0 or tokens <> 0")
        # Additive and small: as many rows as keys. One file, so that a batch is one object.
        changed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        return sorted(n[6:] for n in names if n.startswith("batch=") and self.committed(n[6:]))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        paths = [f"{self.path}/batch={b}" for b in self.batches()]
        reader = self.spark.read.schema(_FIELDS)
        rows = reader.parquet(*paths) if paths else self.spark.createDataFrame([], _FIELDS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self, into: str) -> None:
        """Write the totals as the only batch of a new rollup at `into`; the old one stays readable."""
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{into.rstrip('/')}/batch=base")

    def drop(self) -> None:
        removed(self.spark, self.path)
