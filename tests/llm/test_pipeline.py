"""The pipeline and the registered queries on small tables."""

import duckdb
import pytest

import corpus_pipeline
from chronomill.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    body = " ".join(f"word{i} the and of" for i in range(60))
    secret = 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"'
    rows = [
        (1, body, "en", "s", None),
        (2, body, "en", "s", 3),
        (3, body + " tail", "en", None, 3),
        (4, "der die und nicht " * 5 + secret, "de", "s", 3),
        (5, None, "en", "s", 0),
        (6, "", None, "s", 0),
        (7, "123 !!", "en", "s", 6),
        (8, "quite another text about the sea " + " ".join(f"x{i}" for i in range(9000)), None, "s", 1),
        (None, "no id here but words of its own", "en", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages(spark, docs):
    columns, now, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        seen[name] = now.collect()
        assert name == "pack" or now.columns == columns
    ids = {name: sorted((r["doc_id"] for r in rows), key=str) for name, rows in seen.items()}
    assert ids["language"] == [1, 2, 3, 4, 8, None]
    assert ids["exact_duplicates"] == [2, 3, 4, 8, None]
    assert ids["near_duplicates"] == ids["secret_scan"] == [2, 4, 8, None]
    clean = {r["doc_id"]: r for r in seen["secret_scan"]}
    assert clean[4]["text"] == "der die und nicht " * 5 + "[secret]" + '"' and clean[4]["n_chars"] == len(clean[4]["text"])
    assert len({r["doc_id"] for r in seen["pack"]}) == 4


def test_language_stage_without_labels_keeps_texts_with_letters(spark, docs):
    from pyspark.sql import functions as F

    found = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert sorted((r["doc_id"] for r in found), key=str) == [1, 2, 3, 4, 8, None] and {r["lang"] for r in found} == {None}


def test_stages_on_no_rows(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.collect() == []


CLASH = ("score", "lang_pred", "spans", "base_spans", "_dedup_sha", "_stay_id", "_drop_id", "_key", "_row", "node", "kept", "key", "root", "a.b")


def test_stages_keep_further_columns(spark, docs):
    from pyspark.sql import functions as F

    more = docs.withColumns({c: F.concat(F.lit("mine "), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in CLASH})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, more, "")
        assert found.columns == more.columns, name
        seen = found.collect()
        assert seen
        for r in seen:
            assert {r[c] for c in CLASH} == {f"mine {-1 if r['doc_id'] is None else r['doc_id']}"}, name
    assert corpus_pipeline.pack(spark, more, "").count()


def test_near_duplicates_stage_goes_by_rows_not_ids(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    data = [(1, text(0)), (None, text(0) + " tail"), (None, text(1)), (4, text(0) + " end"), (4, text(2))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    found = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in found if r["doc_id"]) == [(1, text(0)), (4, text(2))]
    assert [r["text"] for r in found if r["doc_id"] is None] == [text(1)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expected = con.execute(queries.ORACLE_SQL[name]).df()[list(found.columns)]
    key = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert key(found) == key(expected)


def test_token_counts_with_null_keys(spark, tmp_path):
    from tests.llm.test_operators import plain_counters

    pairs = [(a, b) for a in ("en", "de", None) for b in ("src0", "src1", None)]
    data = [(i, f"don't stop-me now {i}", lang, source, 0) for i, (lang, source) in enumerate(pairs * 2)] + [(99, None, "de", None, 0)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    count = {"byte_bpe_50k": plain_counters()["bytes"], "word_bpe_49k": plain_counters()["words"]}
    expected = {}
    for _, text, lang, source, _ in data:
        for name in count:
            if name == "byte_bpe_50k" and source == "src0":
                continue
            revised = lang not in ("en", None) and name == "byte_bpe_50k"
            own = expected.setdefault((source, lang, name), [0, 0])
            own[0] += 1
            own[1] += count["word_bpe_49k" if revised else name](text or "")
    found = queries.op10_token_counts(spark, str(tmp_path)).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"]] for r in found} == expected


#: What the queries' results must have: columns, their types, and one row a document or not.
CONTRACT = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_near_join": "doc_id bigint, class_id bigint, kept boolean, n_copies bigint, n_links bigint",
    "op7_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_token_counts": "source string, lang string, tokenizer string, docs bigint, tokens bigint",
}


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """A few documents and labels, some of them awkward, in files of the driver's layout."""
    folder = str(tmp_path_factory.mktemp("tables"))
    source = "/root/testdata/sf0.001"
    awkward = [(-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "cc by " * 40 + "secret: hunter2hunter2", "en", None, 0), (None, "no id", "de", "s", 0)]
    docs = spark.read.parquet(f"{source}/documents.parquet")
    docs.unionByName(spark.createDataFrame(awkward, SCHEMA)).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "embeddings"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", list(CONTRACT))
def test_registered_queries_keep_their_contract(spark, small_tables, name):
    import zlib

    df = queries.QUERIES[name](spark, small_tables)
    columns = [c.split() for c in CONTRACT[name].split(", ")]
    assert [(c, t) for c, t in df.dtypes if c in {c for c, _ in columns}] == [tuple(c) for c in columns]
    found, docs = df.collect(), spark.read.parquet(f"{small_tables}/documents.parquet").collect()
    if name in ("op4_packing", "op7_neighbours", "op10_token_counts"):
        assert found and (name != "op4_packing" or {r["doc_id"] for r in found} == {r["doc_id"] for r in docs})
        return
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in docs)
    if "held_out" in df.columns:
        modulus, rest = (5, 0) if name == "op1_quality" else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % modulus == rest) for r in found)
        assert all(0 <= r["score"] <= 1 for r in found)
    if name == "op1_quality":
        assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)
    if name == "op3_language":
        und = {r["doc_id"] for r in docs if not any(c.isalpha() for c in r["text"] or "")}
        assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == und
