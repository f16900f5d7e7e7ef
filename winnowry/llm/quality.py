"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

A document's vector is the share of each hashed n-gram among its n-grams.  Words are runs of
letters and digits or of other signs; n-grams are taken over the words themselves and over
their kinds (case, signs, length, repetition of the word before), so that what marks junk is
seen in texts whose words were never met.  Weights follow the regularised leader, one step a
document; a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .packed import spread

BITS = 20
SAMPLE = 12_000
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(128) if not chr(c).isalnum()]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 4
_KIND[97:123] = 8
_KIND[128:] = 16


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and where those of each text begin (one more entry)."""
    h, first, s, e = W.words(data, at)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kinds = np.bitwise_or.reduceat(_KIND[data], s).astype(np.uint64)
    ends = _KIND[data[e - 1]].astype(np.uint64)
    size = np.minimum(e - s, 24) // 4
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    kind = kinds | (ends << np.uint64(5)) | (size.astype(np.uint64) << np.uint64(10)) | (same.astype(np.uint64) << np.uint64(20))
    joint = doc[1:] == doc[:-1]
    two = lambda x: np.concatenate([np.where(joint, x[:-1] * np.uint64(0x9FB21C651E98DF25) ^ x[1:], x[:-1]), x[-1:]])
    k1 = W.mix(kind + np.uint64(1 << 40))
    k2 = W.mix(two(k1) + np.uint64(1))
    w2 = W.mix(two(h) + np.uint64(2))
    all_ = np.stack([k1, k2, h, w2], axis=1).reshape(-1) >> np.uint64(64 - BITS)
    return all_.astype(np.int64), first * 4


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = W.utf8(batch.column("text"))
        for i, j in W.slices(at):
            idx, first = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
            keys, shares = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                u, c = np.unique(idx[a:b], return_counts=True)
                keys.append(u.astype(np.int32))
                shares.append((c / max(1, b - a)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, j - i), batch.column("y").slice(i, j - i), pa.array(keys, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                names=["id", "y", "keys", "shares"],
            )


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(id, y, text) of training rows: crc32 of the id modulo 5 is not 0; at most ``sample`` by hash of the id.

    The sample is taken from the labels, so what is broadcast has at most ``sample`` rows.
    """
    ok = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ok = ok.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ok = ok.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(ok), "doc_id").select(F.col("doc_id").alias("id"), "y", "text")


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0


class Ftrl:
    """Follow-the-regularised-leader for logistic loss: per-coordinate rates, L1 and L2."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> None:
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias
        p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        g = p - y
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, passes: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias from at most ``sample`` labelled documents; a fixed order, so reruns agree."""
    rows = labelled(docs, labels, label, sample).mapInArrow(_vectors, "id long, y int, keys array<int>, shares array<float>").toArrow()
    rows = rows.sort_by([("id", "ascending")])
    ys, keys, shares = (rows.column(c).to_pylist() if c == "y" else [np.asarray(x.values) for x in rows.column(c)] for c in ("y", "keys", "shares"))
    model = Ftrl()
    rng = np.random.default_rng(5)
    for _ in range(passes):
        for i in rng.permutation(len(ys)):
            model.step(keys[i], shares[i] * 10, ys[i])
    return (model.weights(slice(None)) * 10).astype(np.float32), float(model.bias)


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Defined cases: null and empty texts get the score of the bias alone; ties and repeated rows
    each get a row; without labelled rows all scores are 0.5; no rows give no rows; other columns
    are not read, whatever they are called.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            data, at = W.utf8(batch.column("text"))
            for i, j in W.slices(at):
                idx, first = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
                total = np.concatenate([[0.0], np.cumsum(w[idx], dtype=np.float64)])
                n = np.diff(first)
                logit = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1) + bias
                p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p)], names=["doc_id", "score"])

    out = spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
