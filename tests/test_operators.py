"""Small hand-made cases."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowry import cli
from winnowry.engine import Config, Curation, ReplayJudge
from winnowry.functions import geometry, ranks, text
from winnowry.operators import nearest, ordering, pairsets, selection, similarity, statistics, taste, tournament
from winnowry.sources import files
from winnowry.streaming import progress


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ranks_of_ties_singletons_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "i int, v double")
    assert rows(ranks.sparse_rank(df, "v", "i", "r"), "i", "r") == [(1, 0.0), (2, 1.0), (3, 0.5)]
    one = spark.createDataFrame([(1, 2.0)], "i int, v double")
    assert ranks.mid_rank(one, "v", "r").first()["r"] == 0.5 and ranks.distinct_rank(one, "v", "i", "r").first()["r"] == 0.0
    assert ranks.z_score(one, "v", "z").first()["z"] == 0.0


def test_clamp_raises_on_infinite(spark):
    with pytest.raises(Exception, match="not finite"):
        spark.range(1).select(ranks.clamp_score(F.lit(float("inf")))).collect()


def test_segments_and_hash(spark):
    assert [r[0] for r in spark.range(5).select(ranks.segment(F.col("id"), F.lit(5), 2)).collect()] == [0, 0, 0, 1, 1]
    px = spark.createDataFrame([([0] * 32 + [255] * 32,)], "p array<int>")
    assert px.select(geometry.block_hash(F.col("p"))).first()[0] == 2**32 - 1


def tournament_of(spark, said, cap=8):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 2, 0.8), ("g", 3, 0.7)], "g string, i long, s double")
    v = spark.createDataFrame(said, "a long, b long, winner string") if said else None
    return tournament.tournaments(df, "g", "i", "s", v, cap).first()


def test_tournament_champion_and_reversed_verdict(spark):
    t = tournament_of(spark, [(2, 1, "a"), (2, 3, "tie")])
    assert t["ranked"] == [2, 1, 3] and not t["rejected"]
    assert tournament_of(spark, None)["ranked"] == [1, 2, 3]


def test_tournament_rejection(spark):
    assert tournament_of(spark, [(1, 2, "neither"), (1, 3, "inconsistent")])["rejected"]
    assert not tournament_of(spark, [(1, 2, "neither"), (1, 3, "tie")])["rejected"]
    assert not tournament_of(spark, [(1, 2, "inconsistent"), (1, 3, "inconsistent")])["rejected"]


def greedy(rows_, k, cap, segments):
    quota, picked, fam, seg = max(1, -(-k // segments)), [], {}, {}
    for first in (True, False):
        for o, i, f, s in rows_:
            if len(picked) == k or i in picked or fam.get(f, 0) >= cap or first and seg.get(s, 0) >= quota:
                continue
            picked.append(i)
            fam[f], seg[s] = fam.get(f, 0) + 1, seg.get(s, 0) + 1
        if len(picked) == k:
            break
    return picked


def test_spread_selection_is_greedy(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        data = [(o, o * 7, r.randint(0, 12), r.randint(0, 4)) for o in range(80)]
        df = spark.createDataFrame(data, "o long, i long, f int, s int")
        got = [x["i"] for x in selection.spread_selection(df, "i", "f", "s", "o", 12, 2, 5).orderBy("pick").collect()]
        assert got == greedy(data, 12, 2, 5)


def test_verdicts_keep_the_cap_and_count_reasons(spark):
    picked = spark.createDataFrame([(0, 1, 10), (1, 2, 11), (2, 3, 12)], "pick int, i long, g long")
    duels = spark.createDataFrame(
        [(0, 1, 4, 10, 13, 0.1, "b"), (1, 2, 5, 11, 13, 0.2, "b"), (2, 3, 6, 12, 14, 0.3, None)],
        "segment int, defender long, challenger long, defender_group long, challenger_group long, margin double, verdict string",
    )
    r = selection.apply_verdicts(picked, duels, "i", "g", 1).first()
    assert r["final"] == [4, 2, 3] and (r["swapped"], r["refused_family_cap"], r["missing"], r["kept"]) == (1, 1, 1, 0)
    with pytest.raises(Exception, match="unknown verdict"):
        selection.apply_verdicts(picked, duels.withColumn("verdict", F.lit("?")), "i", "g", 1).collect()


def test_leaders_join_the_most_similar_smaller_leader(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.6, 0.8]), (4, [0.0, 1.0])], "i long, v array<double>")
    near = similarity.near_pairs(v, "i", "v", 0.7)
    assert rows(similarity.leader_groups(v, near, "i"), "i", "leader") == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_exact_statistics():
    assert statistics.mcnemar(0, 0) == 1.0 and math.isclose(statistics.mcnemar(1, 5), 0.21875)
    assert math.isclose(statistics.hypergeometric_tail(0, 10, 3, 4), 1.0)
    exact = 2 * sum(math.comb(1400, i) for i in range(651)) / 2**1400
    assert math.isclose(statistics.mcnemar(650, 750), exact, rel_tol=1e-9) and statistics.mcnemar(10**8, 10**8) == 1.0
    assert statistics.needed(0.75) is not None and statistics.power(10, 0.5) <= 0.05


def test_auc_with_an_empty_class(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "v double, g boolean")
    assert math.isnan(statistics.auc(df, "v", "g").first()["auc"])
    low, high = spark.range(1).select(*statistics.wilson(F.lit(0), F.lit(0))).first()
    assert math.isnan(low) and math.isnan(high)


def test_small_plans():
    items = [("a", "f", 0), ("b", "f", 0), ("c", "f", 1), ("d", "g", 1)]
    assert pairsets.seat_ceiling(items, 1, 1) == 2 and pairsets.seat_ceiling(items, 2, 2) == 3
    assert pairsets.independent_set("abcd", [("a", "b"), ("b", "c")]) in (["a", "c", "d"],)
    picks = pairsets.quota_pick([("g", "x", 0.1), ("g", "y", 0.2), ("h", "x", 0.3)], 3, 1, 1)
    assert picks == [("g", "x", 0.1)]


def plain_codes(n, seed):
    """The generator in 32-bit numpy arithmetic."""
    a, out = np.uint32(seed), []
    with np.errstate(over="ignore"):
        while len(out) < n:
            code = ""
            for _ in range(4):
                a = np.uint32(a + np.uint32(0x6D2B79F5))
                t = np.uint32((a ^ (a >> np.uint32(15))) * (np.uint32(1) | a))
                t = np.uint32(t + np.uint32((t ^ (t >> np.uint32(7))) * (np.uint32(61) | t))) ^ t
                code += text.ALPHABET[int(int(t ^ (t >> np.uint32(14))) / 2**32 * len(text.ALPHABET))]
            out.append(code)
    return out


def test_places_do_not_depend_on_ranges(spark):
    """Global places, places in groups, running sums and counts below against sorted lists; one group holds most rows."""
    r = np.random.default_rng(5)
    data = [(int(i), "big" if r.random() < 0.7 else str(r.choice(["a", "b"])), int(r.integers(0, 9))) for i in r.permutation(300)] + [(900, None, 3), (901, None, 4)]
    df = spark.createDataFrame(data, "i long, g string, v int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        order = sorted(data, key=lambda x: (-x[2], x[0]))
        got = ordering.numbered(df, [F.desc("v"), F.col("i")], "at").orderBy("at").collect()
        assert [(x["i"], x["at"]) for x in got] == [(x[0], k) for k, x in enumerate(order)]
        total = ordering.running_sum(df, [F.desc("v"), F.col("i")], F.col("v"), "s").orderBy(F.desc("v"), "i").collect()
        assert [x["s"] for x in total] == np.cumsum([x[2] for x in order]).tolist()
        inside = {x["i"]: (x["at"], x["n"]) for x in ordering.numbered_in(df, ["g"], [F.col("v"), F.col("i")], "at", "n").collect()}
        below = {(x["g"], x["v"]): (x["c"], x["below_c"]) for x in ordering.below_counts(df, "v", {"c": F.count("*")}, ["g"]).collect()}
        for g in ("big", "a", "b", None):
            mine = sorted((x for x in data if x[1] == g), key=lambda x: (x[2], x[0]))
            assert [inside[x[0]] for x in mine] == [(k, len(mine)) for k in range(len(mine))]
            for v in {x[2] for x in mine}:
                assert below[g, v] == (sum(x[2] == v for x in mine), sum(x[2] < v for x in mine))
        none = df.where("false")
        assert ordering.numbered(none, [F.col("i")], "at").collect() == ordering.numbered_in(none, ["g"], [F.col("i")], "at").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)


def test_blocked_pairs_and_quantiles(spark):
    """Several blocks, against numpy: all pairs, quantiles, and quantiles of flagged items."""
    r = np.random.default_rng(8)
    x = r.normal(size=(1300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = r.random(1300) < 0.1
    items = spark.createDataFrame([(i, v.tolist(), bool(o)) for i, (v, o) in enumerate(zip(x, own, strict=True))], "i long, v array<double>, own boolean").cache()
    a, b = np.triu_indices(1300, 1)
    s = (x @ x.T)[a, b]
    got = {(p["i"], p["j"]): p["s"] for p in similarity.near_pairs(items, "i", "v", 0.97).collect()}
    want = {(int(i), int(j)): c for i, j, c in zip(a, b, s, strict=True) if c >= 0.97}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert np.allclose(similarity.quantiles(items, "i", "v", [0.5, 0.98]), np.quantile(s, [0.5, 0.98]), atol=1e-9)
    assert np.allclose(similarity.quantiles(items, "i", "v", [0.5], 0.5, "own"), np.quantile(s[own[a] & own[b]] + 0.5, 0.5), atol=1e-9)
    assert similarity.threshold(items.where("i = 0"), "i", "v", 0.9, 0.7) == 0.7


def test_scenes(spark):
    """Hashes with one differing bit in many places, a limit of light, of time, of contrast; the nearest, earliest representative."""
    spread = sum(1 << (4 * k) for k in range(14))
    data = [
        (1, 0, 100, 50, 0), (2, spread, 100, 50, 60),  # 14 bits apart, close in time
        (3, (1 << 63) - 1, 100, 50, 0), (4, (1 << 63) - 2, 145, 50, 10**6),  # one bit apart but too bright
        (5, (1 << 63) - 8, 100, 50, 10**6),  # three bits from 3; two from 4, whose time is close
        (6, 0, 100, 3, 0), (7, None, 100, 50, 0), (8, 3, 100, 50, 10**7), (9, -(1 << 63), 100, 50, None),
    ]
    df = spark.createDataFrame(data, "i long, bits long, light int, contrast int, t long")
    got = rows(similarity.scene_groups(df, "i", "bits", "light", "contrast", F.timestamp_seconds("t")), "i", "group", "position", "count")
    assert got == [(1, 1, 1, 4), (2, 1, 2, 4), (4, 2, 1, 2), (5, 2, 2, 2), (8, 1, 3, 4), (9, 1, 4, 4)]


def test_probe(spark):
    """Scores against the same steps in numpy on all rows."""
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 5))
    y = (x[:, 0] + 0.3 * r.normal(size=120) > 0.8).astype(int)
    items = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i long, v array<double>, y int")
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros(5), 0.0
    share = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    for _ in range(800):
        g = share * (y - 1 / (1 + np.exp(-(z @ w + b))))
        w, b = w + 0.5 * (z.T @ g / 120 - 3.0 * w / 120), b + 0.5 * g.mean()
    got = {q["i"]: q["p"] for q in taste.probe_scores(items, "i", "v", "y", [0, 1]).where("target = 1").collect()}
    assert np.allclose([got[i] for i in range(120)], 1 / (1 + np.exp(-(z @ w + b))), atol=1e-9)
    wins = np.mean([(p > q) + (p == q) / 2 for p in x[y == 1, 0] for q in x[y == 0, 0]])
    assert math.isclose(statistics.rank_auc(x[:, 0], y == 1), wins)


def test_capped_top_grows_the_cap(spark):
    df = spark.createDataFrame([(i, "big" if i < 20 else f"s{i}") for i in range(25)], "i long, g string")
    for k, cap, want in ((5, 1, [0, 20, 21, 22, 23]), (12, 2, [*range(7), 20, 21, 22, 23, 24]), (99, 1, list(range(25)))):
        assert [r["i"] for r in selection.top_with_cap(df, "g", [F.col("i")], k, cap).orderBy("i").collect()] == want


def test_large_groups_are_cut_before_the_tournament(spark):
    df = spark.createDataFrame([("g", i, -float(i)) for i in range(50)], "g string, i long, s double")
    t = tournament.tournaments(df, "g", "i", "s", None, 8)
    assert t.first()["members"] == list(range(8))
    p = tournament.places(df, t, "g", "i", "s")
    assert rows(p, "within_rank", "i") == [(i, i) for i in range(50)]


def test_handshake_refuses_other_plans_and_unknown_items(spark):
    plan = spark.createDataFrame([(1, 2, 0), (2, 3, 1)], "a long, b long, pos int")
    said = spark.createDataFrame([(2, 1, "a"), (1, 3, "b")], "a long, b long, winner string")
    right = tournament.plan_hash(plan).first()["hash"]
    assert tuple(tournament.handshake(plan, right, said).first()) == (1, 1, 1)
    with pytest.raises(ValueError, match="another plan"):
        tournament.handshake(plan, "0" * 32, said)
    with pytest.raises(ValueError, match="another plan"):
        tournament.handshake(plan.withColumn("pos", 1 - F.col("pos")), right, said)
    with pytest.raises(ValueError, match="unknown item"):
        tournament.handshake(plan, right, said.unionByName(spark.createDataFrame([(9, 1, "a")], said.schema)))


def test_plan_hash_is_md5_of_compact_ascii_json(spark):
    pairs = [["b 1.jpg", 'q"x\\.jpg'], ["照片.jpg", "é😀~.jpg"], ["a.jpg", "c/d.jpg"]]
    plan = spark.createDataFrame([(a, b, i * 3) for i, (a, b) in enumerate(pairs)], "a string, b string, pos int").orderBy("a")
    assert tournament.plan_hash(plan).first()["hash"] == hashlib.md5(json.dumps(pairs, separators=(",", ":")).encode()).hexdigest()
    assert tournament.plan_hash(plan.where("false")).first()["hash"] == hashlib.md5(b"[]").hexdigest()


def test_fold_directions(spark):
    calls = [
        (1, "AB", "1"), (1, "BA", "2"), (2, "AB", "1"), (2, "BA", "1"), (3, "AB", "tie"), (3, "BA", "tie"), (4, "AB", "neither"), (4, "BA", "neither"),
        (5, "AB", "tie"), (5, "BA", "neither"), (6, "AB", "2"), (7, "BA", "1"),
    ]
    df = spark.createDataFrame(calls, "k int, dir string, pick string")
    got = rows(tournament.fold_directions(df, ["k"]), "k", "verdict", "missing")
    assert got == [(1, "a", None), (2, "inconsistent", None), (3, "tie", None), (4, "neither", None), (5, "inconsistent", None), (6, None, "BA"), (7, None, "AB")]
    coded = [
        (1, "AB", "2", "A", "B", "A"), (1, "BA", "2", "B", "A", "A"),  # the code beats the place
        (2, "AB", "1", "A", "B", "A"), (2, "BA", "2", "B", "A", "X"),  # a code of nobody
        (3, "AB", "tie", "A", "B", "NONE"), (3, "BA", "tie", "B", "A", None), (4, "AB", "1", None, "B", "B"), (4, "BA", "2", "", "A", "B"),  # no codes shown
    ]
    df = spark.createDataFrame(coded, "k int, dir string, pick string, first_code string, second_code string, winner_code string")
    got = rows(tournament.fold_directions(df, ["k"]), "k", "verdict", "contradiction")
    assert got == [(1, "a", True), (2, "inconsistent", False), (3, "tie", False), (4, "a", False)]


def test_both_ways_of_contradictory_rows(spark):
    df = spark.createDataFrame([(1, 2, "tie"), (1, 2, "b"), (2, 1, "b"), (3, 4, "a")], "a long, b long, winner string")
    assert rows(tournament.both_ways(df), "a", "b", "winner") == [(1, 2, "b"), (2, 1, "b"), (3, 4, "a"), (4, 3, "b")]


def test_replay_waste(spark):
    """The first seed loses its second match, so the rest of its plan is never read."""
    df = spark.createDataFrame([("g", i, -float(i)) for i in range(5)] + [("h", 10, 2.0), ("h", 11, 1.0)], "g string, i long, s double")
    said = spark.createDataFrame([(0, 1, "a"), (2, 0, "a"), (0, 3, "b"), (0, 4, "a"), (2, 3, "tie")], "a long, b long, winner string")
    played = tournament.tournaments(df, "g", "i", "s", said)
    plan = spark.createDataFrame([("g", 0, 0, 1), ("g", 1, 0, 2), ("g", 5, 0, 3), ("g", 7, 0, 4), ("h", 9, 10, 11)], "g string, pos int, a long, b long")
    got = rows(tournament.replay_waste(plan, played, said, "g"), "g", "planned", "consulted", "never", "answered", "by_score", "first_switch", "changed")
    assert got == [("g", 4, 2, 2, 3, 1, 1, True), ("h", 1, 1, 0, 0, 1, None, False)]


def test_anchor_kinds_that_run_short(spark):
    items = spark.createDataFrame(
        [("a", 1, 0.9, True), ("a", 2, 0.5, False), ("b", 1, 0.9, False), ("b", 2, 0.5, True), ("c", 1, 0.1, True), ("d", 1, 0.3, False), ("e", 1, None, False), ("e", 2, 0.2, False), ("e", 3, 0.1, True)],
        "g string, i int, r double, c boolean",
    )
    reasons = spark.createDataFrame([("a", "short"), ("c", "much longer"), ("d", "none"), ("b", "the longest reason of all")], "g string, reason string")
    got = rows(selection.choose_anchors(items, "g", "i", "r", "c", reasons, 4), "g", "kind", "typical", "place")
    assert got[:4] == [("a", "win", 2, got[0][3]), ("b", "win", 1, got[1][3]), ("c", "win", 2, 0), ("d", "reject", 0, 1)]
    assert sorted(x[3] for x in got if x[3] is not None) == [0, 1, 2, 3] and got[4][2] == 1  # nobody chose several
    assert rows(selection.choose_anchors(items, "g", "i", None, "c", reasons, 1), "g", "place")[1] == ("b", 0)
    assert selection.choose_anchors(items.where("false"), "g", "i", "r", "c", reasons, 3).count() == 0


def test_nearest_points_equal_brute_force(spark):
    """Clusters of different density, equal distances, one far point, and targets at one place."""
    r = random.Random(12)
    spots = [(i, round(r.gauss(0, 0.01), 4), round(r.gauss(5, 0.01), 4)) for i in range(300)] + [(1000 + i, r.uniform(-500, 500), r.uniform(-500, 500)) for i in range(60)]
    spots += [(2000, 7.0, 7.0), (1999, 7.0, 7.0), (2001, 7.0, 9.0), (3000, None, 1.0), (3001, float("nan"), 1.0)]
    points = [(i, r.gauss(0, 0.02), r.gauss(5, 0.02)) for i in range(200)] + [(500 + i, r.uniform(-700, 700), r.uniform(-700, 700)) for i in range(80)]
    points += [(900, 7.0, 8.0), (901, 1e6, -1e6), (902, None, 0.0), (900, 7.0, 8.0)]
    p, t = spark.createDataFrame(points, "i long, x double, y double"), spark.createDataFrame(spots, "k long, x double, y double")
    want = []
    for i, x, y in {q for q in points if q[1] is not None}:
        d, k = min(((a - x) * (a - x) + (b - y) * (b - y), k) for k, a, b in spots[:-2])
        want.append((i, k, d))
    assert rows(nearest.nearest_points(p, "i", t, "k"), "i", "k", "distance2") == sorted(want)
    one = spark.createDataFrame([(5, 3.0, 3.0)], "k long, x double, y double")
    assert rows(nearest.nearest_points(p.where("i < 3"), "i", one, "k"), "i", "k") == [(0, 5), (1, 5), (2, 5)]
    assert nearest.nearest_points(p, "i", t.where("false"), "k").count() == 0 == nearest.nearest_points(p.where("false"), "i", t, "k").count()


def test_strategies_fall_back(spark):
    df = spark.createDataFrame([(1, 0.3, None), (2, 0.1, 0.9), (3, 0.2, 0.5)], "i long, g double, f double").withColumn("v", F.lit(None).cast("double"))
    assert ranks.composite_score(df, "g", "f", "i", "s", "vision_face", "v")[1] == "face" == ranks.composite_score(df, "g", "f", "i", "s")[1]
    assert rows(ranks.composite_score(df, "g", "f", "i", "s", "vision_face", "f")[0], "i", "s") == [(1, -1.0), (2, 1.0), (3, 0.0)]
    with pytest.raises(ValueError, match="unknown strategy"):
        ranks.composite_score(df, "g", "f", "i", "s", "?")


def test_text_helpers():
    assert text.last_json('<think>{"a":0}</think> x {"a": 1} tail') == {"a": 1} and text.last_json("none") is None
    assert text.translate_reason("1 beats 2, not 10 or 1.5", ["p", "q"]) == "p beats q, not 10 or 1.5"
    codes = text.codes(500)
    assert len(set(codes)) == 500 and codes[:5] == text.codes(5) == plain_codes(5, 20260904)
    assert set("".join(codes)) <= set(text.ALPHABET) and not set("0OIL1Z2S5B8") & set(text.ALPHABET)


def test_files(spark, tmp_path):
    for p in ("a/x.jpg", "b/x.jpg", "gold/y.jpg", "z.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    assert rows(files.list_items(spark, str(tmp_path), ["gold"]), "rel") == [("a/x.jpg",), ("b/x.jpg",)]
    (tmp_path / "v.jsonl").write_text('{"a":"1","b":"2","winner":"maybe"}\n')
    with pytest.raises(Exception, match="unknown verdict"):
        files.read_verdicts(spark, str(tmp_path / "v.jsonl")).collect()
    (tmp_path / "r.jsonl").write_text('{"a":"1","b":"2","winner":"a"}\n{"a": "1", "b\n')
    good, bad = files.read_results(spark, str(tmp_path / "r.jsonl"), files.VERDICT)
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        files.guard_sink("/data/in/out", ["/data/in"])
    assert files.guard_sink("/data/out", ["/data/in"], ["/data"])


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "calls"
    src.mkdir()
    (src / "1.json").write_text('{"cell":"x","pair":1,"ok":true,"ts":"2024-01-01T00:00:00Z"}\n{"cell":"x","pair":2,"ok":false}\n{"cell":"y","pa')
    q = progress.watch(spark, str(src), "seen", str(tmp_path / "cp"))
    q.awaitTermination(60)
    batch = progress.progress(spark.read.schema(progress.CALL).option("mode", "DROPMALFORMED").json(str(src)))
    assert rows(spark.table("seen"), "cell", "done", "ok") == rows(batch, "cell", "done", "ok") == [("x", 2, 1)]


def test_session(spark, tmp_path):
    r = np.random.default_rng(1)
    base = r.normal(size=(6, 8))
    x = np.repeat(base, 3, axis=0) + r.normal(size=(18, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist(), float(i % 5)) for i, v in enumerate(x)], "item long, vector array<double>, score double")
    c = Curation(spark, items, Config(target=6, segments=3, family_cap=1, percentile=0.88))  # 18 of 153 pairs are inside groups
    ranked = c.rank().cache()
    assert ranked.count() == 18 and ranked.select("family").distinct().count() == 6
    assert c.select(ranked).count() == 6
    items.write.parquet(f"{tmp_path}/items")
    items.where("item < 6").write.parquet(f"{tmp_path}/gold")
    for verb in ("cut", "preview", "curve", "eval", "export"):
        cli.main([verb, f"{tmp_path}/items", "--gold", f"{tmp_path}/gold", "--out", f"{tmp_path}/{verb}", "--target", "4", "--names", "3", "5", "99"])
    assert spark.read.parquet(f"{tmp_path}/cut").where("selected").count() == 3
    assert rows(spark.read.parquet(f"{tmp_path}/preview"), "item") == [(3,), (5,)]
    report = spark.read.parquet(f"{tmp_path}/eval").first()
    assert report["k"] == report["delivered_n"] == 4 and report["n_gold"] == 6 and "delivered_hits" not in c.evaluate(ranked, items.where("item < 6")).columns
    kinds = spark.read.parquet(f"{tmp_path}/export").groupBy("kind").count().collect()
    assert {k["kind"]: k["count"] for k in kinds}["selected"] == 4
    assert spark.read.parquet(f"{tmp_path}/curve").select("protocol").distinct().count() == 2
    said = spark.createDataFrame([], "a long, b long, winner string")
    assert rows(c.rank(ReplayJudge(said)), "item", "ord") == rows(ranked, "item", "ord")
