"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are taken in overlapping chunks that cover all of it. Learned filters of ``WIDTH`` bytes run over every chunk; each filter is
max-pooled over the chunk. A document's features are the mean and the maximum of its chunks' pooled values, and a logistic unit combines them
into one probability. Filters are a sum of one table row for each byte and place, so there is no separate embedding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, table, unused
from sparkloom.session import cut

WIDTH, FILTERS, CHUNK, OVERLAP = 4, 16, 512, 16
#: The training sample's bound: rows, and bytes of a text (a longer one is not in the sample, though it is scored whole).
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, BATCH, SEED = 4_000, 8_192, 12, 32, 7


class Network:
    """filters: (WIDTH, 256, FILTERS); bias, mean and peak: (FILTERS,); offset: a number."""

    def __init__(self, filters, bias, mean, peak, offset):
        self.filters, self.bias, self.mean, self.peak, self.offset = filters, bias, mean, peak, offset

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        f = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        return cls(f, np.zeros(FILTERS, np.float32), r.normal(0, 0.1, FILTERS).astype(np.float32), r.normal(0, 0.1, FILTERS).astype(np.float32), 0.0)

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.mean, self.peak]

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Of all filters at every place; codes has WIDTH - 1 bytes more than places."""
        n = len(codes) - WIDTH + 1
        out = self.filters[0][codes[:n]]
        for j in range(1, WIDTH):
            out += self.filters[j][codes[j : j + n]]
        return out


def codes_of(text: str | None) -> np.ndarray:
    """A text's bytes with WIDTH - 1 zero bytes behind, so that even an empty text has a place."""
    raw = (text or "").encode()
    return np.frombuffer(raw + b"\0" * (WIDTH if not raw else WIDTH - 1), dtype=np.uint8)


def starts_of(places: int) -> np.ndarray:
    """Where chunks of CHUNK places begin, each OVERLAP before the last one's end; the last chunk may be shorter."""
    return np.arange(0, max(1, places - OVERLAP), CHUNK - OVERLAP)


def pooled(net: Network, codes: np.ndarray) -> np.ndarray:
    """Max-pooled responses of every chunk: (chunks, FILTERS). Responses are made for some chunks at a time, so memory is bounded."""
    places = len(codes) - WIDTH + 1
    out = []
    for k in range(0, len(starts := starts_of(places)), 64):
        own = starts[k : k + 64]
        lo, hi = own[0], min(places, own[-1] + CHUNK)
        r = net.responses(codes[lo : hi + WIDTH - 1])
        for s in own:
            out.append(r[s - lo : min(places, s + CHUNK) - lo].max(axis=0))
    return np.array(out)


def score(net: Network, text: str | None) -> float:
    """The probability of label 1."""
    p = np.tanh(pooled(net, codes_of(text)) + net.bias)
    z = float(p.mean(axis=0, dtype=np.float64) @ net.mean + p.max(axis=0) @ net.peak + net.offset)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str], labels: list[int], seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """Gradient descent (Adam) on the logistic loss, both classes weighted alike; without both classes, the constant share of label 1."""
    y = np.array(labels, dtype=np.float64)
    net = Network.fresh(seed)
    if not len(y) or y.min() == y.max():
        net.mean[:], net.peak[:] = 0, 0
        net.offset = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    coded, order = [codes_of(t) for t in texts], np.random.default_rng(seed)
    params = [*net.parts(), np.zeros(1)]
    m, v, step = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params], 0
    for _ in range(epochs):
        turn = order.permutation(len(y))
        for k in range(0, len(turn), BATCH):
            grads = [np.zeros(p.shape) for p in params]
            for i in turn[k : k + BATCH]:
                _add_gradient(net, coded[i], y[i], weight[i], grads)
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                g /= BATCH
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
            net.offset = float(params[-1][0])
    return net


def _add_gradient(net: Network, codes: np.ndarray, y: float, weight: float, grads: list[np.ndarray]) -> None:
    places = len(codes) - WIDTH + 1
    r, starts, each = net.responses(codes), starts_of(places), np.arange(FILTERS)
    at = np.array([s + r[s : s + CHUNK].argmax(axis=0) for s in starts])  # (chunks, filters)
    p = np.tanh(r[at, each] + net.bias)
    peak = p.argmax(axis=0)
    mean, top = p.mean(axis=0), p[peak, each]
    z = float(mean @ net.mean + top @ net.peak + net.offset)
    d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    grads[2] += d * mean
    grads[3] += d * top
    grads[4] += d
    dp = np.repeat((d * net.mean / len(starts))[None, :], len(starts), axis=0)
    dp[peak, each] += d * net.peak
    dr = dp * (1 - p * p)
    grads[1] += dr.sum(axis=0)
    for j in range(WIDTH):
        np.add.at(grads[0][j], (codes[at + j], each[None, :].repeat(len(starts), axis=0)), dr)


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list:
    """What is learned from: rows (hash, doc_id, quality, text) of labelled documents whose crc32(doc_id as text) mod 3 is not 1.

    At most ``rows`` of them with at most ``most_bytes`` bytes, those of least hash: a bounded sample, the same for the same tables. Of a repeated
    id, the least text counts. The ids are chosen first, below a hash that leaves about twice as many as are wanted, so that what tasks send on is
    bounded by ``rows`` however many tasks there are; texts are read for the chosen ids only.
    """
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(crc_mod(F.col("doc_id"), 3) != 1)
    some = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    ids = cut(known.join(some.select("doc_id").distinct(), "doc_id").select("doc_id", "quality", F.xxhash64("doc_id").alias("hash")))
    share = (2 * rows + 100) / max(1, ids.count())
    if share < 1:
        ids = ids.where(F.col("hash").cast("double") < -(2.0**63) + share * 2.0**64)
    chosen = ids.orderBy("hash", "doc_id").limit(rows)  # the broadcast side has this many rows at most
    texts = some.join(F.broadcast(chosen), "doc_id").groupBy("hash", "doc_id", "quality").agg(F.min("text").alias("text"))
    return sorted(texts.collect(), key=lambda r: (r.hash, r.doc_id))  # bounded


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Network:
    """A network for ``quality``, learned from the rows of sample_of()."""
    sample = sample_of(docs, labels, rows, most_bytes)
    return fit([r.text for r in sample], [r.quality for r in sample])


def _scorer(net: Network):
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([score(net, t.as_py()) for t in column], type=pa.float64())

    return run


def classify(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 for the whole text; a column ``out`` of df is replaced, and no other name clashes.

    Null texts count as empty and get the score of an empty text. Repeated rows are scored alike and stay apart; equal scores (ties) stay as they are; an empty table gives an empty one.
    """
    return df.withColumn(out, _scorer(net)(F.col(f"`{text}`").cast("string")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that score less than ``least``; a score of just ``least`` stays.

    The network learns from the labelled rows of docs. Null texts are judged as empty ones; repeated rows stay or go alike; an empty table gives an empty one; without labels of both
    kinds all texts get one score. No column name clashes.
    """
    (name,) = unused(docs, "quality_score_")
    return classify(docs, train(docs, labels), out=name).where(F.col(name) >= least).drop(name)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """All documents by the learned classifier. Repeated and null ids are scored row by row; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
