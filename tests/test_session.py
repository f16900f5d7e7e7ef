"""The session from metrics to a ranking, one case for each strategy and each rung of the guard ladder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowry.engine import Config, Curation


@pytest.fixture(scope="module")
def pool(spark, tmp_path_factory):
    """Forty items around two directions; all vectors share a large part, as embeddings do."""
    r = np.random.default_rng(5)
    x = np.ones((40, 6)) + r.normal(size=(40, 6)) * 0.4
    x[:20, 0] += 0.8
    x[20:, 1] += 0.8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), float(i * 7 % 40), float(i * 11 % 40) if i % 4 else None, float(i * 3 % 40) if i % 2 else None) for i, v in enumerate(x)]
    path = str(tmp_path_factory.mktemp("pool") / "items")
    spark.createDataFrame(rows, "item long, vector array<double>, general double, face double, vision double").write.parquet(path)
    return spark.read.parquet(path), x


def labels(spark, *items):
    return spark.createDataFrame([(i,) for i in items], "item long")


def scores(scored):
    return [r["score"] for r in scored.items.orderBy("item").collect()]


def test_strategies_of_cold_scores(spark, pool):
    items, _ = pool
    z = lambda v: ((np.array(v) - np.mean(v)) / np.std(v)).tolist()
    order = [i * 7 % 40 / 39 for i in range(40)]
    face = [i * 11 % 40 for i in range(40) if i % 4]
    ranked = sorted(range(30), key=lambda k: face[k])
    place = {k: n / 29 for n, k in enumerate(ranked)}
    have = iter(range(30))
    faces = [place[next(have)] if i % 4 else 0.5 for i in range(40)]
    cases = {
        "auto": ("face", faces), "general": ("general", order), "face": ("face", faces), "blend": ("blend", [(a + b) / 2 for a, b in zip(order, faces, strict=True)]),
    }
    for name, (used, want) in cases.items():
        s = Curation(spark, items, Config(strategy=name)).scored()
        assert (s.strategy, s.mode, s.weight) == (used, "cold", 0.0) and np.allclose(scores(s), z(want)), name
    assert Curation(spark, items, Config(strategy="vision_face")).scored().strategy == "vision_face"
    assert Curation(spark, items.drop("vision"), Config(strategy="vision_face")).scored().strategy == "face"
    assert Curation(spark, items.drop("face", "vision")).scored().strategy == "general"


def test_rungs_of_the_ladder(spark, pool):
    items, _ = pool
    spread, close = labels(spark, 1, 9, 15, 22, 30, 38, 38, 777), labels(spark, *range(8))
    on = Config(use_probe=True)
    cold = scores(Curation(spark, items).scored())
    for config, marked, want in ((on, None, "cold"), (Config(), spread, "probe off"), (on, labels(spark, 1, 30, 30, 777), "too few"), (Config(use_probe=True, most_concentration=0.5), close, "too concentrated")):
        s = Curation(spark, items, config).scored(marked)
        assert s.mode == want and s.weight == 0.0 and scores(s) == cold and s.pinned.count() == 0, want
    s = Curation(spark, items, on).scored(spread)
    assert s.mode == "fused" and s.pinned.count() == 6 and abs(s.weight - (0.2 + 0.5 / 15)) < 1e-12 and scores(s) != cold


def test_fused_scores_equal_numpy(spark, pool):
    items, x = pool
    known = [1, 9, 15, 22, 30, 38]
    s = Curation(spark, items, Config(use_probe=True, most_concentration=9.0)).scored(labels(spark, *known))
    z = (x - x.mean(0)) / x.std(0)
    y = np.isin(np.arange(40), known).astype(float)
    w, b = np.zeros(6), 0.0
    for _ in range(800):
        g = np.where(y == 1, 34 / 6, 1.0) * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w, b = w - 0.5 * (z.T @ g + 3.0 * w) / 40, b - 0.5 * g.mean()
    personal = z @ w + b
    personal = (personal - personal.mean()) / personal.std()
    cold = np.array(scores(Curation(spark, items).scored()))
    assert np.allclose(scores(s), (1 - s.weight) * cold + s.weight * personal)


def test_labels_come_first_only_if_they_are_used(spark, pool):
    items, _ = pool
    marked = labels(spark, 1, 9, 15, 22, 30, 38)
    first = lambda c, n=6: {r["item"] for r in c.rank(labels=marked).where(f"ord < {n}").collect()}
    base = {"stage2": False, "floor": 0.999, "most_concentration": 9.0}
    assert first(Curation(spark, items, Config(use_probe=True, **base))) == {1, 9, 15, 22, 30, 38}
    cold = Curation(spark, items, Config(**base))
    top = sorted(zip(scores(cold.scored()), range(40), strict=True), reverse=True)[:6]
    assert first(cold) == {i for _, i in top}


def test_report_of_a_session(spark, pool):
    items, _ = pool
    c = Curation(spark, items, Config(target=5, segments=0, strategy="general"))
    ranked = c.rank().cache()
    gold = labels(spark, 17, 34, 11, 999)  # three of the four best by the general metric, and one that is not there
    got = c.evaluate(ranked, gold, 5, c.select(ranked)).first()
    assert (got["n_total"], got["n_gold"], got["k"], got["delivered_n"]) == (40, 3, 5, 5) and got["hits"] >= got["delivered_hits"] > 0 and got["auc"] > 0.9
    assert c.hits(ranked, gold, (5,)).first()["hits"] == got["hits"]
    out = c.export(ranked, c.select(ranked))
    families = ranked.select("family").distinct().count()
    assert out.where("kind = 'selected'").count() == 5 and out.select("family").distinct().count() == families
    assert out.groupBy("item").count().where("count > 1").count() == 0 and ranked.where(F.col("rejected")).count() == 0
