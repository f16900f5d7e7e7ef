"""Toxicity: a sparse linear classifier with a counterfactual penalty.

A document is the set of its words.  Training minimises the logistic loss plus an L1 term plus
the squared change of the score when an identity term in a labelled sentence is swapped for
another one, and for neutral sentences that mention a group; so mentions of a group do not
move the score.  Words are kept by their full 64-bit hash: no collisions with rare words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordhash as W
from .packed import give_back, with_columns
from .quality import held_out, labelled

SAMPLE = 12_000
#: Words for groups of people, in four languages.
IDENTITY = (
    "women men woman man girls boys gay lesbian straight trans bisexual black white asian latino african arab "
    "jewish jews muslim muslims christian christians hindu buddhist atheist immigrants refugees foreigners disabled deaf blind "
    "old young poor rich frauen männer juden muslime christen ausländer femmes hommes juifs musulmans chrétiens étrangers "
    "mujeres hombres judíos musulmanes cristianos extranjeros"
).split()
NEUTRAL = ("{} people live here", "my neighbours are {}", "a story about {}", "viele {} leben hier", "des {} vivent ici", "muchos {} viven aquí")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = W.utf8(batch.column("text"))
        for i, j in W.slices(at):
            h, first, _, _ = W.words(data[at[i] : at[j]], at[i : j + 1] - at[i], W.PLAIN)
            sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, j - i), batch.column("y").slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], names=["id", "y", "set"]
            )


def word_hashes(words: list[str]) -> np.ndarray:
    data, at = W.utf8(pa.array(words))
    return W.words(data, at, W.PLAIN)[0]


class Model:
    """Sorted word hashes, their weights, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.keys, self.weights, self.bias = keys, weights, bias
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(keys >> np.uint64(48)).astype(np.int64)] = True

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        h, first, _, _ = W.words(data, at, W.PLAIN)
        out = np.full(len(at) - 1, self.bias)
        if not len(self.keys) or not len(h):
            return out
        cand = np.flatnonzero(self.likely[(h >> np.uint64(48)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[cand]).clip(0, len(self.keys) - 1)
        hit = self.keys[k] == h[cand]
        doc = np.searchsorted(first, cand[hit], side="right") - 1
        pair = np.unique(doc * len(self.keys) + k[hit])
        np.add.at(out, pair // len(self.keys), self.weights[pair % len(self.keys)])
        return out


def train(sets: list[np.ndarray], ys: np.ndarray, l1: float = 8e-4, swap: float = 1.0, rounds: int = 300, least: int = 3) -> Model:
    """Proximal gradient descent with momentum over word sets (sorted 64-bit hashes)."""
    if not len(ys):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    ident = np.unique(word_hashes(list(IDENTITY)))
    neutral = [np.unique(word_hashes(t.format(w).split())) for t in NEUTRAL for w in IDENTITY]
    rows = [*sets, *neutral]
    lens = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    vocab, count = np.unique(flat[: lens[: len(sets)].sum()], return_counts=True)
    vocab = np.union1d(vocab[count >= least], ident)
    del sets, count
    y = np.concatenate([ys, np.zeros(len(neutral))])
    share = np.concatenate([np.full(len(ys), 1 / len(ys)), np.full(len(neutral), 0.1 / len(neutral))])
    # both classes count alike up to a factor of three, as positives are rare
    share[: len(ys)] *= np.where(ys == 1, min(3.0, (ys == 0).sum() / max(1, (ys == 1).sum())), 1.0)
    k = np.searchsorted(vocab, flat)
    np.minimum(k, len(vocab) - 1, out=k)
    ok = vocab[k] == flat
    del flat
    k = k[ok]
    doc = np.repeat(np.arange(len(rows)), lens)[ok]
    group = np.flatnonzero(np.isin(vocab, ident))
    in_group = np.isin(k, group)
    # a swap replaces one term of a sentence by each other term: the mean change over all terms is w - mean(w)
    swaps = np.bincount(k[in_group], weights=share[doc[in_group]], minlength=len(vocab))[group]
    w, b = np.zeros(len(vocab)), 0.0
    v, vb, t = w.copy(), b, 1.0
    most = np.bincount(doc, minlength=len(rows)).max() + 1
    seen = np.bincount(k, weights=share[doc], minlength=len(vocab))
    step = 1.0 / (0.25 * (seen + 1e-3) * min(most, 60) + 2 * swap * 0.5)
    step_b = 1.0 / (0.25 * share.sum() * min(most, 60))
    for _ in range(rounds):
        logit = np.bincount(doc, weights=v[k], minlength=len(rows)) + vb
        r = share * (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y)
        g = np.bincount(k, weights=r[doc], minlength=len(vocab))
        change = v[group] - v[group].mean()
        g[group] += 2 * swap * (swaps + 1 / len(group)) * change
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step_b * r.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    keep = w != 0
    return Model(vocab[keep], w[keep], float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled documents outside the held-out fifth; reruns agree."""
    rows = labelled(docs, labels, label, sample).mapInArrow(_sets, "id long, y int, set array<long>").toArrow().sort_by([("id", "ascending")])
    model = _trained(rows)
    del rows
    give_back()
    return model


def _trained(rows: pa.Table) -> Model:
    """The model of rows (id, y, set) in order."""
    sets = [np.asarray(x.values).view(np.uint64) for x in rows.column("set")]
    return train(sets, np.array(rows.column("y").to_pylist(), float))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability that a document is toxic; whole texts, all other columns pass through.

    Defined cases: null and empty texts get the score of the bias; without labelled rows every
    score is 0.5; repeated rows get equal scores; an input column named like the added one is
    replaced; no rows give no rows.
    """

    def fill(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        data, at = W.utf8(column)
        for i, j in W.slices(at):
            p = 1 / (1 + np.exp(-np.clip(model.logits(data[at[i] : at[j]], at[i : j + 1] - at[i]), -35, 35)))
            yield j - i, [pa.array(p)]

    return with_columns(docs, text_col, f"`{name.replace('`', '``')}` double", fill)


__all__ = ["IDENTITY", "Model", "fit", "held_out", "score", "train"]
