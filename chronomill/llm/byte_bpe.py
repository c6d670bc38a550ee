"""Byte-level BPE of whole texts by one encoding of each distinct pre-token, and back."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from .shared import appended, bucketed, free_names, slices, text_or_empty


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PreTokenizer:
    """Pre-tokens of a text in order; they cover the whole text.

    Texts of Latin letters, digits, common signs and white space take a pattern with the classes
    written out, which the standard library matches faster; all others the pattern given.
    """

    _L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", " \t\n\v\f\r\x85\xa0"
    LATIN = re.compile("[\t-\r -~\x85\xa0-ɏ‐-‧‰-⁞₠-₿]*")
    FAST = re.compile(
        f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_L}{_N}{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
    )
    #: The pattern that FAST spells out.
    KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern)
        self.fast = self.FAST if pattern == self.KNOWN else None

    def split(self, text: str) -> list[str]:
        if self.fast and self.LATIN.fullmatch(text):
            return self.fast.findall(text)
        return [m[0] for m in self.any.finditer(text)]


def _pack(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes: small numbers, which are the most, leave the high planes nearly empty."""
    return _pack(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _joined(parts: list[bytes]) -> bytes:
    """Byte strings and their lengths as one compressed value."""
    return _pack(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts))


def _split(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends], ends)]


def word_blocks(docs: DataFrame, pattern: str, buckets: int, block_chars: int = 9_000_000) -> DataFrame:
    """The corpus as blocks of whole documents, each with its distinct pre-tokens.

    block; doc_ids; counts (positions per document); places: the exploded pre-tokens of the block in order of
    position, as the number of the word at each; homes: the bucket of each word; parts: for each bucket its
    words. Words are numbered by how often they stand in the block, so a position costs little more than a byte.
    """
    fields = "block long, doc_ids array<long>, counts binary, places binary, homes binary, parts array<struct<bucket:int,words:binary>>"
    part_type = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))

    def run(batches):
        from pyspark import TaskContext

        split, number, base = PreTokenizer(pattern).split, 0, TaskContext.get().partitionId() << 32
        words, ids, counts, places, held = {}, [], [], [], 0

        def block():
            found = np.concatenate(places)
            places.clear()  # a block's parts go as soon as they are packed: two blocks never stand side by side
            often = np.bincount(found, minlength=len(words))
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            words.clear()
            raw = [raw[i] for i in order.tolist()]
            homes = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in raw), "<u2", len(raw))
            parts: dict[int, list[bytes]] = {}
            for home, w in zip(homes.tolist(), raw):
                parts.setdefault(home, []).append(w)
            del raw
            listed = [{"bucket": h, "words": _joined(parts.pop(h))} for h in sorted(parts)]
            values = [base + number, ids, _planes(np.array(counts, "<u4")), _planes(rank[found]), _pack(homes.tobytes()), listed]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), part_type]
            return pa.record_batch(
                [pa.array([v], t) for v, t in zip(values, kinds)], names=["block", "doc_ids", "counts", "places", "homes", "parts"]
            )

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if held and held + len(text) > block_chars:
                    yield block()
                    number += 1
                    words, ids, counts, places, held = {}, [], [], [], 0
                tokens = split(text)
                for w in tokens:
                    if w not in words:
                        words[w] = len(words)
                ids.append(doc_id)
                counts.append(len(tokens))
                places.append(np.fromiter(map(words.__getitem__, tokens), "<u4", len(tokens)))
                held += len(text) + 64
        if ids:
            yield block()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(run, fields)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32 bit) of every text; null text counts as empty.

    One row per row of `docs`, repeated ones too; no rows give no rows. Other columns are not read.

    Every distinct word of a block is sent once to the bucket that its hash names, so all blocks' copies of a word
    meet in one bucket, which encodes it once; its ids go back to the blocks, which put their documents
    together by position. A hot word is one entry a block. The blocks are a table bucketed by block, so
    only words and ids are shuffled, never the positions.
    """
    spark = docs.sparkSession
    # More buckets for more documents, so that a bucket stays a task's work at any size.
    kind = "<u2" if max(read_ranks(ranks_path).values()) < 1 << 16 else "<u4"
    buckets = int(min(16_384, max(64, docs.count() // 4_000)))
    blocks = bucketed(word_blocks(docs, pattern, buckets), "block", int(spark.conf.get("spark.sql.shuffle.partitions")), "bpe_blocks")
    sent = blocks.select(F.col("block").alias("home"), F.explode("parts").alias("part")).select("home", "part.bucket", "part.words")

    def encode(batches):
        core = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        known, bucket = {}, None
        for batch in batches:
            out = []
            for now, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if now != bucket:
                    known, bucket = {}, now
                ids = []
                for w in _split(words):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = np.array(core.encode_ordinary(w.decode("utf-8", "surrogatepass")), kind).tobytes()
                    ids.append(found)
                out.append(_joined(ids))
            yield pa.record_batch([batch.column("home"), batch.column("bucket"), pa.array(out, pa.binary())], names=["home", "bucket", "ids"])

    met = sent.repartition("bucket").sortWithinPartitions("bucket")
    returned = met.mapInArrow(encode, "home long, bucket int, ids binary")
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def reassemble(block: pa.Table, table: pa.Table) -> pa.Table:
        found, ids = [], []
        if block.num_rows:
            homes = np.frombuffer(zstandard.decompress(block.column("homes")[0].as_py()), "<u2")
            by_bucket = [x for part in table.sort_by("bucket").column("ids").to_pylist() for x in _split(part)]
            by_word: list = [None] * len(homes)
            for word, x in zip(np.argsort(homes, kind="stable").tolist(), by_bucket):
                by_word[word] = x
            counts = _from_planes(block.column("counts")[0].as_py())
            places = _from_planes(block.column("places")[0].as_py())
            found, at = block.column("doc_ids")[0].as_py(), 0
            for n in counts.tolist():
                short = b"".join(map(by_word.__getitem__, places[at : at + n].tolist()))
                ids.append(np.frombuffer(short, kind).astype("<u4").tobytes())
                at += n
        return pa.table([pa.array(found, pa.int64()), pa.array(ids, pa.binary())], schema=out)

    whole = blocks.select("block", "doc_ids", "counts", "places", "homes").groupBy("block")
    return whole.cogroup(returned.groupBy("home")).applyInArrow(reassemble, "doc_id long, ids binary")


def decoded(encoded_rows: DataFrame, ranks_path: str) -> DataFrame:
    """`encoded_rows` and decoded: the bytes of its ids, by a join of each id with the token-byte table.

    The table has as many rows as the vocabulary and stands in order of id, so each worker holds it and the join takes
    rows by their place: the tokens of a batch lie one behind the other, as its texts do. An id that is not in the table
    raises a ValueError; a null or empty list of ids gives no bytes. Where `encoded_rows` has a column decoded, the new
    one gets an underscore more.
    """
    (name,) = free_names(encoded_rows.columns, "decoded")

    def run(batches):
        ranks = read_ranks(ranks_path)
        table = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        tokens = pa.array(table, pa.large_binary())
        for part in slices(batches, "ids", 8_000_000):
            rows = part.column("ids").to_pylist()
            ids = np.frombuffer(b"".join(x or b"" for x in rows), "<u4")
            if len(ids) and (int(ids.max()) >= len(tokens) or tokens.take(pa.array(ids)).null_count):
                raise ValueError("ids that the token-byte table does not have")
            joined = tokens.take(pa.array(ids))
            ends = np.cumsum([0, *(len(x or b"") // 4 for x in rows)])
            offsets = np.frombuffer(joined.buffers()[1], "<i8", len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
            data = joined.buffers()[2] if len(ids) and joined.buffers()[2] else pa.py_buffer(b"")
            places = offsets[ends] - offsets[0]
            texts = [data[a:b].to_pybytes() for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, name])

    return appended(encoded_rows, run, [StructField(name, BinaryType())])


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    return decoded(encoded(docs, ranks_path, pattern), ranks_path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
