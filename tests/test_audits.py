"""Calibration, retest, accounting, coverage and shards on hand-made rows."""

import itertools
import random

from winnowry.operators import audits

ROW = "a int, b int, winner string, skipped boolean, consistent boolean, code_a string, code_b string, code_read_ok boolean, contradiction boolean"


def one(spark, rows, plan):
    return audits.calibration(spark.createDataFrame(rows, ROW), spark.createDataFrame(plan, "a int, b int, answer string")).first()


def test_calibration_counts_and_guards(spark):
    row = lambda a, w, sk=None, codes=("x", "y", True, False): (a, a + 1, w, sk, True, *codes)
    plan = [(i, i + 1, "a") for i in range(6)]
    good = [row(0, "a"), row(1, "b"), row(2, "tie"), row(3, "neither"), row(4, "inconsistent"), row(5, "a")]
    r = one(spark, good, plan)
    assert (r["gold"], r["other"], r["tie"], r["neither"], r["inconsistent"], r["problems"]) == (2, 1, 1, 1, 1, [])
    assert abs(r["hit_rate"] - 2 / 3) < 1e-12 and abs(r["stated_rate"] - 4 / 6) < 1e-12 and r["code_ok"] == 6 and r["contradictions"] == 0
    assert one(spark, good[:5], plan)["problems"] == ["number of rows", "other pairs"]
    assert one(spark, [*good[:5], (6, 5, "a", None, True, "x", "y", True, False)], plan)["problems"] == ["other pairs"]
    r = one(spark, [*good[:5], row(5, "inconsistent", True)], plan)
    assert r["problems"] == ["skipped pairs"] and r["inconsistent"] == 1 and r["skipped"] == 1
    assert one(spark, [*good[:5], row(5, "c")], plan)["problems"] == ["unknown winners"]
    bare = (None, None, True, None)
    r = one(spark, [row(i, "a", codes=bare) for i in range(6)], plan)
    assert r["problems"] == ["no codes shown"] and r["code_ok"] is None is r["contradictions"]
    assert one(spark, [*good[:5], row(5, "a", codes=("x", "y", None, False))], plan)["problems"] == ["codes missing in some rows"]
    r = one(spark, [], plan)
    assert r["n"] == 0 and r["hit_rate"] is None and r["problems"] == ["number of rows", "other pairs", "no codes shown"]


def test_retest_counts_pairs_without_making_them(spark):
    r = random.Random(4)
    rows = [(g, i, r.random() < 0.5, r.choice([True, False, None])) for g in "xyz" for i in range(12)] + [("alone", 0, True, True)]
    first, second = spark.createDataFrame([x[:3] for x in rows], "g string, i int, kept boolean"), spark.createDataFrame([(g, i, k) for g, i, _, k in rows], "g string, i int, kept boolean")
    for got in audits.retest(first, second, "g", "i", "kept").collect():
        mine = [(x, y) for g, _, x, y in rows if g == got["g"] and y is not None]
        want = dict.fromkeys(("both_ties", "one_tie", "same_way", "opposite"), 0)
        for (xa, ya), (xb, yb) in itertools.combinations(mine, 2):
            p, q = xa - xb, ya - yb
            want["both_ties" if p == q == 0 else "one_tie" if p * q == 0 else "same_way" if p == q else "opposite"] += 1
        assert {k: got[k] for k in want} == want and got["n"] == len(mine) and got["same"] == sum(x == y for x, y in mine)


def test_accounting_is_null_without_a_record(spark):
    asked = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a int, b int")
    said = spark.createDataFrame([(2, 1, "a"), (4, 5, "b"), (7, 8, "a"), (9, 8, "a")], "a int, b int, winner string")
    assert tuple(audits.accounting(asked, said).first()) == (2, 1, 2)
    assert tuple(audits.accounting(asked, None).first()) == (None, None, None)


def test_coverage_tells_empty_cells(spark):
    rows = spark.createDataFrame([("p", "x", "a", "b", True), ("p", "x", "a", "", False), ("q", "y", "a", None, True)], "tag string, arm string, ab string, ba string, consistent boolean")
    got = {(r["tag"], r["arm"], r["check"]): (r["n"], r["ok"]) for r in audits.coverage(rows, spark.createDataFrame([("p", 2), ("q", 1)], "tag string, n int"), ["x", "y"]).collect()}
    assert got["p", "x", "pairs"] == (2, True) and got["p", "y", "pairs"] == (0, False) and got["q", "y", "pairs"] == (1, True)
    assert got["p", "x", "directions"] == (1, False) and got["p", "y", "directions"] == (0, True) and got["p", "x", "consistent"] == (1, True) and len(got) == 12


def test_arms_and_shards(spark):
    rows = [("t", arm, i, 0, w) for arm, said in (("x", "abt"), ("y", "abt"), ("z", "abb"), ("w", "")) for i, w in enumerate(said)] + [("t", "x", 9, 0, None)]
    df = spark.createDataFrame(rows, "tag string, arm string, a int, b int, winner string")
    got = {(r["one"], r["two"]): (r["same"], r["common"], r["differ"]) for r in audits.arms_differ(df, ["x", "y", "z", "w"]).collect()}
    assert got["x", "y"] == (3, 3, False) and got["x", "z"] == (2, 3, True) == got["y", "z"] and got["z", "w"] == (0, 0, True)
    plan = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("u", 3, "a"), ("u", 4, "a"), ("v", 5, "a"), ("w", 6, "a")], "s string, k int, t string")
    found = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "a"), (5, "b"), (6, "a"), (6, "b")], "k int, t string")
    assert [r["s"] for r in audits.complete_shards(plan, found, "s", ["k"], "t").collect()] == ["s"]
