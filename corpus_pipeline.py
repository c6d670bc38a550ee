"""Five stages from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.llm import exact_dedup, language_id, near_dedup, packing, secrets
from chronomill.llm.shared import all_of, free_names, new_path, removed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, lang as predicted; where no row has a lang to learn from, it stays as it is.

    Null and empty texts have no letter and go; ids, repeated or null, are not looked at; all other columns stay as they are.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    label, _ = free_names(docs.columns, "lang_pred", "score")
    told = F.col(label) != language_id.UNDETERMINED
    found = language_id.identified(docs, model).where(told | F.regexp_like(F.col("text"), F.lit(r"\p{L}")))
    return found.withColumn("lang", F.when(told, F.col(label)).otherwise(F.col("lang"))).select(*all_of(docs.columns))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id; null ids stay only where a group has no id. Columns stay as they are."""
    return exact_dedup.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents, that with the smallest doc_id.

    Rows are told by id and text, so other texts of a null or repeated id stay. Columns stay as they are.
    """
    return near_dedup.without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in text replaced and n_chars as it is then; null texts and all other columns stay as they are."""
    _, spans = free_names(docs.columns, "base_spans", "spans")
    clean = secrets.redacted(secrets.scanned(docs, secrets.fit(docs)), spans=spans)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*all_of(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences; a null text is one end token, a null id stays null, other columns are not read."""
    return packing.packed_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: SQL has no naive Bayes over hashed n-grams and no sub-word tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again.

    What a stage has written is deleted once the next stage has read it; only the last stage's rows stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
