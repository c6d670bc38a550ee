"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .shared import appended, free_names, hashed_sample, slices, stored, text_or_empty, texts_of

WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 8, 2, 4, 24, 16
HALF = 256  # a chunk has two halves and overlaps each neighbour by one
PAD = 256
_STEPS = HALF // STRIDE


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole halves (two at least, and room for a window); halves per text."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    halves = np.array([max(2, -(-(len(x) + WIDTH) // HALF)) for x in raw], np.int64)
    out = np.full(halves.sum() * HALF + WIDTH, PAD, np.int16)
    at = 0
    for x, n in zip(raw, halves):
        out[at : at + len(x)] = np.frombuffer(x, np.uint8)
        at += n * HALF
    return out, halves


def windows_of(embedded: np.ndarray, steps: int) -> np.ndarray:
    """(rows, steps, WIDTH * DIM): the windows of each row of embedded bytes, STRIDE apart."""
    row, item = embedded.strides[0], embedded.itemsize
    view = np.lib.stride_tricks.as_strided(embedded, (len(embedded), steps, WIDTH * DIM), (row, STRIDE * DIM * item, item))
    return np.ascontiguousarray(view)


@dataclass
class Network:
    embedding: np.ndarray  # (257, DIM), the last row is padding and stays zero
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray  # (1,)
    combine: np.ndarray  # weights of the columns of document_logits

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        embedding = rng.normal(0, 1, (257, DIM)).astype(np.float32)
        embedding[PAD] = 0
        zero = lambda n: np.zeros(n, np.float32)
        return cls(embedding, f(WIDTH * DIM, FILTERS), zero(FILTERS), f(FILTERS, HIDDEN), zero(HIDDEN), f(HIDDEN), zero(1), np.array([1.0, 0, 0, 0, 0, 0]))

    def pooled(self, codes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each half: (halves, FILTERS).

        Windows reach past their half, but not past a document's last half (`last`).
        """
        top = np.empty((len(last), FILTERS), np.float32)
        for at in range(0, len(last), 64):
            n = min(64, len(last) - at)
            rows = codes[(np.arange(at, at + n) * HALF)[:, None] + np.arange(HALF + WIDTH)]
            rows[last[at : at + n], HALF:] = PAD
            top[at : at + n] = (windows_of(self.embedding[rows], _STEPS) @ self.filters).max(1)
        return np.maximum(top + self.bias, 0)

    def chunk_logits(self, features: np.ndarray) -> np.ndarray:
        return np.maximum(features @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias[0]

    def document_logits(self, texts: list[str]) -> np.ndarray:
        """Mean, lowest and highest chunk logit, 1, the empty share of the first chunk, and that times the mean: (texts, 6).

        Few filters respond in a text of a few words, so the last two say how much its logit means.
        """
        codes, halves = padded(texts)
        last = np.zeros(halves.sum(), bool)
        last[np.cumsum(halves) - 1] = True
        top = self.pooled(codes, last)
        logits = self.chunk_logits(np.maximum(top[:-1], top[1:])[~last[:-1]])
        counts = halves - 1
        starts = np.cumsum(counts) - counts
        columns = [np.add.reduceat(logits, starts) / counts, np.minimum.reduceat(logits, starts), np.maximum.reduceat(logits, starts)]
        short = 1 - np.minimum(np.add.reduceat(codes[: len(last) * HALF] != PAD, (np.cumsum(halves) - halves) * HALF), 2 * HALF) / (2 * HALF)
        return np.stack([*columns, np.ones(len(texts)), short, short * columns[0]], 1).astype(np.float64)

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 for each whole text."""
        if not texts:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.document_logits(texts) @ self.combine, -40, 40)))


def chunks_of(texts: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, the number of each one's text): bytes of all chunks, or of `most` a text, spread evenly over all of it."""
    codes, halves = padded(texts)
    first = np.cumsum(halves) - halves
    picked = [np.arange(h - 1) if most is None or h - 1 <= most else np.linspace(0, h - 2, most).astype(np.int64) for h in halves]
    number = np.repeat(np.arange(len(texts)), [len(p) for p in picked])
    own = np.concatenate(picked) if picked else np.empty(0, np.int64)
    rows = codes[((own + first[number]) * HALF)[:, None] + np.arange(2 * HALF + WIDTH)]
    rows[own == (halves - 2)[number], 2 * HALF :] = PAD
    return rows, number


def train(texts: list[str], labels: np.ndarray, **settings) -> Network:
    """A network for `texts`: trained on all their chunks, then on their document logits. See `train_chunks` and `combined`."""
    labels = np.asarray(labels, np.float32)
    chunks, number = chunks_of(texts)
    counts = np.bincount(number, minlength=len(texts))
    net = train_chunks(chunks, labels[number], 1.0 / counts[number] if len(texts) else np.empty(0), **settings)
    return combined(net, net.document_logits(texts) if len(texts) else np.empty((0, 6)), labels)


def train_chunks(chunks: np.ndarray, target: np.ndarray, share: np.ndarray, passes: int = 4, rate: float = 4e-3, batch: int = 128, seed: int = 7) -> Network:
    """Adam on `chunks`, each with its document's label as `target` and as `share` one by the chunks of its document.

    Without both labels the network stays as it starts; `combined` then makes the result a constant.
    """
    net = Network.start(seed)
    if len(target) == 0 or target.min() == target.max():
        return net
    weight = np.minimum(np.asarray(share, np.float32) * 8, 1.0)  # documents count alike
    names = ["embedding", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias"]
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(passes):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            n = len(own)
            bytes_ = chunks[own]
            windows = windows_of(net.embedding[bytes_], 2 * _STEPS)
            responses = windows @ net.filters
            where = responses.argmax(1)
            features = np.take_along_axis(responses, where[:, None], 1)[:, 0] + net.bias
            pooled = np.maximum(features, 0)
            inner = pooled @ net.hidden + net.hidden_bias
            active = np.maximum(inner, 0)
            logit = active @ net.out + net.out_bias[0]
            error = ((1 / (1 + np.exp(-logit)) - target[own]) * weight[own] / n).astype(np.float32)
            d_inner = error[:, None] * net.out * (inner > 0)
            d_feature = (d_inner @ net.hidden.T) * (features > 0)
            chosen = windows[np.arange(n)[:, None], where]  # (n, FILTERS, WIDTH * DIM)
            d_embedding = np.zeros_like(net.embedding)
            touched = bytes_[np.arange(n)[:, None, None], where[:, :, None] * STRIDE + np.arange(WIDTH)]
            d_bytes = (d_feature[:, :, None] * net.filters.T).reshape(n, FILTERS, WIDTH, DIM)
            for d in range(DIM):
                d_embedding[:, d] = np.bincount(touched.ravel(), d_bytes[..., d].ravel(), 257)
            d_embedding[PAD] = 0
            slopes = {
                "embedding": d_embedding,
                "filters": np.einsum("nf,nfk->kf", d_feature, chosen, optimize=True),
                "bias": d_feature.sum(0),
                "hidden": pooled.T @ d_inner,
                "hidden_bias": d_inner.sum(0),
                "out": active.T @ error,
                "out_bias": error.sum(keepdims=True),
            }
            step += 1
            for k, slope in slopes.items():
                first, second = moments[k]
                first *= 0.9
                first += 0.1 * slope
                second *= 0.999
                second += 0.001 * slope * slope
                change = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - change).astype(np.float32))
    return net


def combined(net: Network, x: np.ndarray, labels: np.ndarray) -> Network:
    """`net` with the weights that a logistic regression gives the columns `x` of its document logits.

    Without both labels among the rows the result is a constant: the share of label 1, or 0.5.
    """
    labels = np.asarray(labels, np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        return replace(net, combine=np.array([0, 0, 0, np.log(share / (1 - share)), 0, 0]))
    prior = w = np.array([1.0, 0, 0, 0, 0, 0])
    for _ in range(30):  # damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(6)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - labels) + 1e-2 * (w - prior)), -1, 1)
    return replace(net, combine=w)


def fit(labelled: DataFrame, train_rows: int = 5_000, train_chunks_a_text: int = 24, **settings) -> Network:
    """Train on about `train_rows` rows (text, quality), twice as many at most, picked by a hash; rows without a label are left out.

    One executor task trains the filters, on `train_chunks_a_text` chunks of a text at most, spread over all of it: with the
    defaults at most 240,000 chunks of about a kilobyte. The combination of chunks is learned from the logits of the sample's
    whole texts, which executors compute; six numbers a text reach the driver.
    """
    import pickle

    rows = hashed_sample(labelled.where(F.col("quality").isNotNull()), train_rows)
    rows = rows.select(text_or_empty().alias("text"), F.col("quality").cast("int").alias("quality"))
    rows = stored(rows.withColumn("key", F.xxhash64("text")).repartition(16), "quality-sample")

    def cut(batches):
        for part in slices(batches, "text", 1_000_000):
            chunks, number = chunks_of(texts_of(part), train_chunks_a_text)
            counts = np.bincount(number, minlength=part.num_rows)
            own = [part.column(c).take(pa.array(number)) for c in ("key", "quality")]
            share = pa.array(1.0 / counts[number])
            data = pa.array([c.tobytes() for c in chunks], pa.binary())
            yield pa.RecordBatch.from_arrays([*own, share, data], names=["key", "quality", "share", "chunk"])

    def learn(batches):
        keys, labels, shares, chunks = [], [], [], []
        for batch in batches:
            keys += batch.column("key").to_pylist()
            labels += batch.column("quality").to_pylist()
            shares += batch.column("share").to_pylist()
            chunks += [np.frombuffer(c, np.int16) for c in batch.column("chunk").to_pylist()]
        order = sorted(range(len(keys)), key=lambda i: (keys[i], labels[i], chunks[i].tobytes()))  # not by arrival
        data = np.stack([chunks[i] for i in order]) if chunks else np.empty((0, 2 * HALF + WIDTH), np.int16)
        net = train_chunks(data, np.array([labels[i] for i in order], np.float32), np.array([shares[i] for i in order]), **settings)
        yield pa.record_batch([pa.array([pickle.dumps(net)])], names=["net"])

    pieces = rows.mapInArrow(cut, "key long, quality int, share double, chunk binary")
    found = pieces.repartition(1).mapInArrow(learn, "net binary").collect()
    net = pickle.loads(found[0]["net"]) if found else Network.start()
    held = rows.sparkSession.sparkContext.broadcast(net)

    def logits(batches):
        for part in slices(batches, "text", 1_000_000):
            x = held.value.document_logits(texts_of(part))
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["quality", "x"])

    seen = sorted((r["x"], r["quality"]) for r in rows.mapInArrow(logits, "quality int, x array<double>").collect())
    return combined(net, np.array([x for x, _ in seen]).reshape(-1, 6), np.array([q for _, q in seen]))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of `docs` and score: the network's probability of quality 1 for the whole text.

    Null and empty texts are scored as one chunk of padding. Where `docs` has a column named score, the new one gets an
    underscore more (see `free_names`). A very long text costs time in proportion, and memory for a few bytes a character.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    (name,) = free_names(docs.columns, "score")

    def run(batches):
        for part in slices(batches, "text", 1_000_000):
            scores = shared.value.score(texts_of(part))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, name])

    return appended(docs, run, [StructField(name, DoubleType())])
