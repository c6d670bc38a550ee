"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, language_id, licenses, near_dedup, neighbours, packing, quality, secrets, token_counts
from .shared import crc_remainder, gone_at_exit, hashed_sample, new_path, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_remainder("doc_id", 5) != 0)
    # The labels of a bounded sample pick the texts to learn from.
    sample = hashed_sample(marks.where("quality is not null"), 5_000)
    net = quality.fit(docs.join(F.broadcast(sample), "doc_id"), train_rows=5_000)
    scores = quality.scored(docs, net)
    held_out = (crc_remainder("doc_id", 5) == 0).alias("held_out")
    return scores.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scans = secrets.scanned(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return scans.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed("base_spans"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(crc_remainder("doc_id", 4) != 2))
    found = language_id.identified(docs.select("doc_id", "text"), model)
    held_out = (crc_remainder("doc_id", 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip_digest(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_documents(_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=1.0)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of four commits over all documents, two of them sent twice.

    All documents come under byte_bpe_50k; all are counted again under word_bpe_49k; all of src0
    leave byte_bpe_50k (its deletion has reached that version only); and all other documents with a language
    code other than en are revised in byte_bpe_50k to the counts of word_bpe_49k. A null source is not src0; a null
    code is no code and is not revised. Each text is counted once by each tokenizer, and the changes are made from those counts.
    """
    import public_tokenizers

    one, two = "byte_bpe_50k", "word_bpe_49k"
    files = {one: (public_tokenizers.path(f"{one}.tiktoken"), public_tokenizers.PATTERN), two: (public_tokenizers.path(f"{two}.json"),)}
    counts = stored(token_counts.counted(_table(spark, sf_dir, "documents"), files), "token-counts")
    first, second = (counts.where(F.col("tokenizer") == t) for t in (one, two))
    rollup = token_counts.Rollup(spark, new_path(spark, "token-rollup"))
    others = "lang <> 'en' and not source <=> 'src0'"
    for _ in range(2):
        rollup.commit("2024-01-load", token_counts.inserts(first))
        rollup.commit("2024-02-recount", token_counts.inserts(second))
    rollup.commit("2024-03-delete", token_counts.deletes(first.where("source = 'src0'")))
    revised = second.where(others).withColumn("tokenizer", F.lit(one))
    rollup.commit("2024-04-revise", token_counts.revisions(first.where(others), revised))
    gone_at_exit(spark, rollup.path)
    return rollup.totals()


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_secrets, op3_language, op4_packing, op5_byte_bpe, op6_near_join, op7_neighbours, op8_licenses, op9_exact_dedup, op10_token_counts)
}

ORACLE_SQL = {
    "op7_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
