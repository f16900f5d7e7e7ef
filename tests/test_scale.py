"""Steps whose work or tables must not grow faster than their input."""

import random

import numpy as np
from pyspark.sql import functions as F

from winnowry.operators import audits, nearest, similarity, taste, tournament


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_far_points_meet_few_tiles(spark, monkeypatch):
    """A flat strip of targets with points far above it, on several tiles; equal distances across tiles."""
    monkeypatch.setattr(nearest, "_TILE", 50)
    monkeypatch.setattr(nearest, "_SLICE", 100)
    asked = []
    met = nearest._met
    monkeypatch.setattr(nearest, "_met", lambda points, *rest: asked.append(points.count()) or met(points, *rest))
    r = random.Random(4)
    spots = [(i, float(r.randrange(9000)), float(3600 + r.randrange(400))) for i in range(1000)] + [(2000 + i, 9000.0 + 2 * i, 3600.0) for i in range(100)]
    points = [(i, r.uniform(0, 9000), r.uniform(-3000, 12000)) for i in range(600)] + [(1000 + i, 9001.0 + 2 * i, 3000.0) for i in range(99)]
    p, t = spark.createDataFrame(points, "i long, x double, y double"), spark.createDataFrame(spots, "k long, x double, y double")
    want = []
    for i, x, y in points:
        d, k = min(((a - x) * (a - x) + (b - y) * (b - y), k) for k, a, b in spots)
        want.append((i, k, d))
    assert rows(nearest.nearest_points(p, "i", t, "k"), "i", "k", "distance2") == sorted(want)
    assert asked[0] == len(points) and asked[1] < 5 * len(points)  # of 22 tiles


def _vectors(spark, n, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 :: 7] = x[: len(x[n // 2 :: 7])]  # copies
    label = r.integers(0, 4, n)
    return x, label, spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "i long, v array<double>, label int").cache()


def test_blocks_are_shuffled_a_bounded_number_of_times(spark, monkeypatch):
    """Many more blocks than cells: every pair once, and no row on more than _SIDE + 1 cells."""
    monkeypatch.setattr(similarity, "_BLOCK", 10)
    monkeypatch.setattr(similarity, "_SIDE", 4)
    x, label, items = _vectors(spark, 500)
    a, b = np.triu_indices(500, 1)
    s = (x @ x.T)[a, b]
    ok = s >= 0.8
    assert rows(similarity.near_pairs(items, "i", "v", 0.8), "i", "j") == sorted(zip(a[ok].tolist(), b[ok].tolist(), strict=True))
    ok &= label[a] != label[b]
    unlike = similarity.near_pairs(items, "i", "v", 0.8, ["label"], lambda i, j, p, q: p[0] != q[0])
    assert rows(unlike, "i", "j") == sorted(zip(a[ok].tolist(), b[ok].tolist(), strict=True))
    near = ((x @ x.T)[:, label == 0] > 0.9).any(axis=1) & (label != 0)
    assert rows(similarity.near_any(items.where("label <> 0"), items.where("label = 0"), "i", "v", 0.9), "i") == [(int(i),) for i in np.flatnonzero(near)]
    seen = similarity.block_pairs(similarity.packed(items, "i", ["v"]), "i long, j long", lambda one, two, same: [one[0][:1], two[0][:1]])
    assert seen.rdd.getNumPartitions() == 4 * 5 // 2 and seen.count() == 50 * 51 // 2
    both = similarity._measured(items.withColumn("own", F.col("label") == 0), "i", "v", [(True, 0.5), (False, 0.5), (False, 0.98)], 0.0, "own")
    own = (label[a] == 0) & (label[b] == 0)
    assert np.allclose(both, [np.quantile(s[own], 0.5), *np.quantile(s, [0.5, 0.98])], atol=1e-9)


def test_vector_groups_need_no_pairs(spark, monkeypatch):
    """Several rounds give the groups that all pairs give."""
    monkeypatch.setattr(similarity, "_FIRST", 40)
    _, _, items = _vectors(spark, 600)
    want = rows(similarity.leader_groups(items, similarity.near_pairs(items, "i", "v", 0.9), "i"), "i", "leader")
    monkeypatch.setattr(similarity, "near_pairs", None)
    assert rows(similarity.vector_groups(items, "i", "v", 0.9), "i", "leader") == want
    assert similarity.vector_groups(items.where("false"), "i", "v", 0.9).count() == 0


def test_verdicts_are_read_in_both_orders_without_doubling(spark):
    """Rows of one pair in both orders, several of one order, nulls: as ``both_ways`` reads them."""
    r = random.Random(9)
    data = [(a, b, r.choice(["a", "b", "tie", "neither", "inconsistent"])) for a in range(6) for b in range(6) for _ in range(r.randrange(3))] + [(None, 1, "a"), (2, None, "b")]
    v = spark.createDataFrame(data, "a long, b long, winner string")
    want = {(x["a"], x["b"]): x["winner"] for x in tournament.both_ways(v).where("a IS NOT NULL AND b IS NOT NULL").collect()}
    got = {}
    for x in tournament._one_way(v).groupBy("x", "y").agg(*tournament._read_both()).collect():
        got[x["y"], x["x"]] = x["yx"]
        got[x["x"], x["y"]] = x["xy"]
    assert got == want
    plan = tournament.tournaments(spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "g long, i long, s double"), "g", "i", "s", v)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0


def test_accounting_joins_nothing(spark):
    """Repeated matches, verdicts in both orders, nulls and equal items."""
    asked = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 4), (None, 5), (5, None), (6, 6)], "a long, b long")
    paid = spark.createDataFrame([(2, 1), (1, 2), (9, 9), (None, 5), (6, 6), (5, 5)], "a long, b long")
    out = audits.accounting(asked, paid)
    assert tuple(out.first()) == (4, 3, 2)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and tuple(audits.accounting(asked.where("false"), paid).first()) == (0, 0, 6)


def test_held_out_scores_are_sorted_once(spark):
    """Sorted columns serve many batches; ties count half."""
    r = np.random.default_rng(3)
    scores, mask, other = r.integers(0, 9, (40, 3)).astype(float), r.random((40, 3)) < 0.6, r.integers(0, 9, (70, 3)).astype(float)
    held = taste._held(scores, mask)
    want = [sum((h > o) + (h == o) / 2 for h in scores[mask[:, k], k] for o in other[:, k]) for k in range(3)]
    assert np.allclose(taste._wins(held, other[:30]) + taste._wins(held, other[30:]), want)
