"""Best-fit packing of token pieces under several capacities at once."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import free_names, slices, stored, text_or_empty, texts_of

END_ID = 1


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold. Attention cost is the sum of squared piece lengths."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


class WordBpe:
    """Ids of whole texts by a word-end BPE file.

    Texts of plain Latin only take the vocabulary's ranks through a byte-pair core, a long stretch at a time and without
    anything remembered (a word end is written as a line feed, which no pre-token holds). The tokenizer drops white
    space and never joins pre-tokens, so the ids of other texts are those of their white-space chunks in order, which are remembered. All
    chunks of a run that are not known yet are encoded at once: those of plain Latin through the core (a zero character,
    a pre-token of its own, stands between two chunks), others through the library itself, as
    whole texts with separators that Python alone splits at.
    """

    LIMIT, RUN, STRETCH = 300_000, 65_536, 262_144
    LATIN = re.compile("[!-~¡-ɏ‐-‧‰-⁞₠-₿]+")
    NOT_LATIN = re.compile("[^!-~¡-ɏ‐-‧‰-⁞₠-₿\0]")
    NOT_PLAIN = re.compile(r"[^\s!-~¡-ɏ‐-‧‰-⁞₠-₿]")
    WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼½¾]|\0|[^\\sa-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾\0]+")
    SPACE = re.compile(r"\s")
    SEPARATORS = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        ranks = self._ranks()
        # The special token never occurs: an empty set of them would be looked for at every character.
        special = {"\n\n": 1 + max(ranks.values())}
        self.core = tiktoken.Encoding("word-ends", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens=special)
        (self.between,) = self._core_ids("\0").tolist()
        self.known: dict[str, bytes] = {}

    def _ranks(self) -> dict[bytes, int]:
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {}
        for token, rank in self.library.get_vocab().items():
            if token not in special:
                ended = token.endswith("</w>")
                spelled = bytes(letters[c] for c in (token[:-4] if ended else token))
                ranks[spelled + b"\n" * ended] = rank
        return ranks

    def _core_ids(self, lower: str) -> np.ndarray:
        words = self.WORD.findall(lower)
        return self.core.encode_to_numpy("\n".join(words) + "\n", disallowed_special=()).astype("<u4", copy=False)

    def _through_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        # Lower case first: it can leave the Latin block. No letter of the block depends on those beside it there.
        whole = "\0".join(chunks)
        lower = whole.lower()
        if self.NOT_LATIN.search(whole) or self.NOT_LATIN.search(lower) or whole.count("\0") >= len(chunks):
            plain = [c for c in chunks if self.LATIN.fullmatch(c) and self.LATIN.fullmatch(c.lower())]
            self.known.update((c, self._through_library(c)) for c in set(chunks).difference(plain))
            chunks, lower = plain, "\0".join(plain).lower()
        if chunks:
            ids = self._core_ids(lower)
            cuts, held = (4 * np.flatnonzero(ids == self.between)).tolist(), ids.tobytes()
            self.known.update((c, held[i:j]) for c, i, j in zip(chunks, [0, *(x + 4 for x in cuts)], [*cuts, len(held)]))

    def _run(self, chunks: list[str]) -> bytes:
        known = self.known
        new = list(set(chunks).difference(known))
        if len(known) + len(new) > self.LIMIT:
            known.clear()
            new = list(set(chunks))
        if new:
            self._learn(new)
        ids = b"".join(map(known.__getitem__, chunks))
        for chunk in new:
            if len(chunk) > 64:
                del known[chunk]
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.SEPARATORS.search(text):
            return self._through_library(text)
        lower = text.lower()
        if not self.NOT_PLAIN.search(text) and (text.isascii() or not self.NOT_PLAIN.search(lower)):
            return b"".join(self._core_ids(x).tobytes() for x in self._stretches(lower))
        chunks = (lower if text.isascii() else text).split()
        return b"".join(self._run(chunks[i : i + self.RUN]) for i in range(0, len(chunks), self.RUN))

    def _stretches(self, text: str):
        at = 0
        while at < len(text):
            space = self.SPACE.search(text, at + self.STRETCH)
            end = space.start() if space else len(text)
            yield text[at:end]
            at = end


def tokenized(docs: DataFrame, vocabulary: str, max_tokens: int = 4096) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids (little-endian unsigned 32 bit).

    Each document's ids end with id 1; null text counts as empty and is that one id. A document
    of more than `max_tokens` ids is cut into pieces of that length, the last one shorter.
    """
    end, step = np.array([END_ID], "<u4").tobytes(), 4 * max_tokens
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        bpe = WordBpe(vocabulary)
        for part in slices(batches, "text"):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                ids = bpe.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(cut) // 4, cut)):
                        column.append(value)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, kind.types)], schema=kind)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: Capacity, rule: str = "dot", weights=(1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, largest pieces first.

    Of all open sequences where the piece fits under every capacity, rule "dot" takes the one
    whose residual vector has the smallest weighted dot product with the piece's demand, and rule
    "norm" the one that leaves the smallest weighted residual norm; both in shares of the capacity.
    """
    full = capacity.array()
    demand = np.stack([lengths, np.ones_like(lengths), lengths.astype(np.float64) ** 2], 1) / full
    scale = np.asarray(weights, np.float64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    residual, number, used = np.empty((256, 3)), np.empty(256, np.int64), np.empty(256, np.int64)
    opened = count = 0
    slack = 1e-12
    order = np.argsort(-lengths, kind="stable")
    smallest = demand[order[-1]] if len(order) else full
    for i in order:
        need = demand[i]
        best = -1
        if count:
            left = residual[:count] - need
            fits = np.flatnonzero(left.min(1) >= -slack)
            if len(fits):
                cost = residual[fits] @ (need * scale) if rule == "dot" else (left[fits] ** 2) @ scale
                best = fits[cost.argmin()]
        if best < 0:
            if (need > 1 + slack).any():
                raise ValueError(f"a piece of {lengths[i]} tokens exceeds the capacity")
            if count == len(number):
                residual, number, used = (np.concatenate([x, np.empty_like(x)]) for x in (residual, number, used))
            best, count = count, count + 1
            residual[best], number[best], used[best] = 1.0, opened, 0
            opened += 1
        bins[i], offsets[i] = number[best], used[best]
        residual[best] -= need
        used[best] += lengths[i]
        if (residual[best] < smallest - slack).any():  # nothing that is left fits: close it
            count -= 1
            residual[best], number[best], used[best] = residual[count], number[count], used[count]
    return bins, offsets


def packed(pieces: DataFrame, capacity: Capacity = Capacity(), group_rows: int = 16_384, rule: str = "dot") -> DataFrame:
    """`pieces` (any columns, with `length`) with sequence_id and offset.

    Pieces are dealt by their place in the stored table, not by any key, to groups of about
    `group_rows`, and each group is packed by itself, so a task's memory and time are bounded
    and each group loses about one sequence. No rows give no rows. Where `pieces` has columns sequence_id or offset, the new
    ones get an underscore more (see `free_names`).
    """
    row, sequence, place = free_names(pieces.columns, "_row", "sequence_id", "offset")
    rows = stored(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_rows))
    dealt = rows.select(F.col(row).alias("_row"), F.col("length").cast("long").alias("length")).withColumn(
        "_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("long")
    )

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity, rule)
        group = table.column("_group")[0].as_py()
        return pa.table({"_row": table.column("_row"), "sequence_id": bins + (group << 32), "offset": offsets})

    placed = dealt.groupBy("_group").applyInArrow(pack, "_row long, sequence_id long, offset long").toDF(row, sequence, place)
    return rows.join(placed, row).drop(row)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences of packed pieces that still carry their ids: sequence_id, length, ids, doc_ids.

    A sequence is at most its capacity, so the lists gathered here are bounded. No pieces give no rows; a null doc_id stays in its list as null.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return whole.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        ids.alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )


def packed_digest(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity()) -> DataFrame:
    """Pieces and their places, with a checksum of the ids instead of the ids.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Every row of `docs`
    gives its own pieces, rows that repeat an id too; a null id stays null. Columns other than
    doc_id and text are not read.
    """
    pieces = tokenized(docs, vocabulary, capacity.tokens)
    return packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
