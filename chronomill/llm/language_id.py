"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .shared import appended, free_names, slices, text_or_empty, texts_of

UNDETERMINED = "und"
_WORDY = re.compile(r"[^\W\d_]")
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def gram_blocks(texts: list[str], bits: int, longest: int, block: int = 250_000):
    """(text number, bucket) of the hashed 1- to `longest`-grams of each lower-cased text, as pairs of arrays.

    A text is framed by spaces, so first and last letters count as such. Grams come in blocks of about `block`
    characters, so that memory beside the texts is bounded, however long one of them is; numbers never fall.
    """
    held: list[tuple[int, str, int]] = []  # text number, characters, how many of them start a gram here
    size = 0
    for number, text in enumerate(texts):
        framed = f" {text.lower()} "
        for at in range(0, len(framed), block):
            own = min(block, len(framed) - at)
            held.append((number, framed[at : at + own + longest - 1], own))
            size += own
            if size >= block:
                yield from _hashed(held, bits, longest)
                held, size = [], 0
    if held:
        yield from _hashed(held, bits, longest)


def _hashed(parts: list[tuple[int, str, int]], bits: int, longest: int):
    sizes = np.fromiter((len(x[1]) for x in parts), np.int64, len(parts))
    codes = np.frombuffer("".join(x[1] for x in parts).encode("utf-32-le", "surrogatepass"), "<u4")
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    room = np.repeat(sizes, sizes) - place  # characters from here to the part's end
    starts = place < np.repeat(np.fromiter((x[2] for x in parts), np.int64, len(parts)), sizes)
    number = np.repeat(np.fromiter((x[0] for x in parts), np.int64, len(parts)), sizes)
    state = np.zeros(len(codes), np.uint32)
    for n in range(1, longest + 1):
        if len(codes) < n:
            return
        state = (state[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(_MULTIPLIERS[(n - 1) % 4])
        state = state ^ (state >> np.uint32(15))
        keep = starts[: len(state)] & (room[: len(state)] >= n)
        yield number[: len(state)][keep], ((state * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits))[keep].astype(np.int64)


@dataclass
class Model:
    """labels in order; log_prior by label; log_prob (buckets by labels)."""

    labels: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int
    longest: int

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Predicted label and its posterior probability for each text."""
        if not self.labels:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total = np.tile(self.log_prior.astype(np.float64), (len(texts), 1))
        for number, bucket in gram_blocks(texts, self.bits, self.longest):
            first = np.flatnonzero(np.diff(number, prepend=-1))
            total[number[first]] += np.add.reduceat(self.log_prob[bucket], first, axis=0, dtype=np.float64)
        best = total.argmax(1)
        top = total[np.arange(len(texts)), best]
        certain = 1.0 / np.exp(total - top[:, None]).sum(1)
        letters = [has_letter(x) for x in texts]
        labels = [self.labels[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
        return labels, np.where(letters, np.clip(certain, 0.0, 1.0), 0.0)


def fit(labelled: DataFrame, train_rows: int = 6_000, bits: int = 16, longest: int = 3, smoothing: float = 0.5, least_rows: int = 200) -> Model:
    """Fit on about `train_rows` rows (text, lang) picked by a hash, and about `least_rows` of each language at least
    (all that there are of a rarer one), twice as many at most; null languages are left out.

    Languages are counted over all rows, which gives their priors. Executors count the grams of the sample's texts and
    add them up by language and bucket, so what reaches the driver is languages x 2**bits numbers. No
    labelled rows give a model that answers `und`.
    """
    known = labelled.where(F.col("lang").isNotNull())
    total = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(total)
    share = train_rows / max(sum(total.values()), 1)
    limits = [(at, lang, int(min(1.0, max(share, least_rows / total[lang])) * (1 << 30))) for at, lang in enumerate(labels)]
    limit = known.sparkSession.createDataFrame(limits, "_label int, _lang string, _limit long")
    keys = [F.col(c) for c in ("doc_id", "text") if c in known.columns]
    place = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30))
    sample = known.select("lang", text_or_empty().alias("text"), place.alias("_place")).join(F.broadcast(limit), F.col("lang") == F.col("_lang"))
    # Repeats of one text without an id would come or go together: the bound holds whatever the table.
    rows = sample.where("_place < _limit").orderBy("_place").limit(2 * (train_rows + least_rows * len(total))).select("_label", "text")

    def count(batches):
        sums = np.zeros(len(labels) << bits, np.int64)
        for part in slices(batches, "text"):
            own = np.array(part.column("_label").to_pylist(), np.int64)
            for number, bucket in gram_blocks(texts_of(part), bits, longest):
                sums += np.bincount((own[number] << bits) + bucket, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    # The limit leaves one partition; its rows are dealt anew, so no task has more than its share of the texts.
    dealt = rows.repartition(16).mapInArrow(count, "at long, n long")
    found = dealt.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(labels) << bits)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(len(labels), 1 << bits).T
    documents = np.array([total[lang] for lang in labels], np.float64)
    log_prob = np.log(counts + smoothing) - np.log((counts + smoothing).sum(0))
    return Model(labels, np.log(documents / max(documents.sum(), 1)), log_prob.astype(np.float32), bits, longest)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` and lang_pred, score.

    lang_pred is `und` and the score 0 where the text is null or has no letter. Where `docs` has columns of these
    names, the new ones get an underscore more (see `free_names`). A very long text costs time in proportion, and memory
    for itself and one block of its grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = free_names(docs.columns, "lang_pred", "score")

    def run(batches):
        model = shared.value
        for part in slices(batches, "text", 1_000_000):
            labels, scores = model.score(texts_of(part))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=[*part.schema.names, *names],
            )

    return appended(docs, run, [StructField(names[0], StringType()), StructField(names[1], DoubleType())])
