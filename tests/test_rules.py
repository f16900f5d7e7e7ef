"""Ordered rules, saliency ties, eligibility, rank selection and sharpness risks on hand-made rows."""

import random
import statistics as st

from pyspark.sql import functions as F

from winnowry.functions import rules
from winnowry.operators import ordering, quality

SCHEMA = (
    "i int, humans array<struct<box array<double>, confidence double>>, faces array<struct<box array<double>, yaw double, quality double>>, "
    "salient array<array<double>>, mask array<double>, coverage double, instances int"
)


def test_classify_by_the_first_rule_that_holds(spark):
    big, small = ([0.3, 0.2, 0.4, 0.6], 0.9), ([0.1, 0.1, 0.1, 0.2], 0.9)
    face = lambda w, yaw=None, q=None, x=0.4: ([x, 0.6, w, w], yaw, q)
    mask, wide = [0.3, 0.2, 0.4, 0.6], [0.0, 0.0, 1.0, 1.0]
    cases = [
        (1, [], [face(0.2)], [], None, 0.0, 0, "clear_portrait", 0.72 + 0.08),
        (2, [], [face(0.2, 0.0, 0.1)], [], None, 0.0, 0, "incidental_people", 0.72),  # a poor face
        (3, [], [face(0.2, 1.5)], [], None, 0.0, 0, "incidental_people", 0.72),  # turned away
        (4, [big], [face(0.1)], [], None, 0.0, 0, "clear_portrait", 0.72 + 0.02),  # a weak face inside a human
        (5, [([0.7, 0.0, 0.2, 0.3], 0.9)], [face(0.1)], [], None, 0.0, 0, "incidental_people", 0.72),  # and beside one
        (6, [big], [face(0.1), face(0.1, x=0.1), face(0.1, x=0.7)], [], mask, 0.2, 1, "dominant_person", 0.92),
        (7, [big, big], [], [], mask, 0.2, 1, "incidental_people", 0.72),  # half each
        (8, [big], [], [], mask, 0.005, 1, "incidental_people", 0.72),  # no mask to speak of
        (9, [big], [], [], None, 0.2, 1, "incidental_people", 0.72),
        (10, [small], [], [[0.1, 0.1, 0.2, 0.2]], [0.1, 0.1, 0.1, 0.2], 0.02, 1, "person_in_landscape", 0.60 + 0.02 + 0.2),
        (11, [small], [], [[0.5, 0.5, 0.2, 0.2]], [0.1, 0.1, 0.1, 0.2], 0.02, 1, "incidental_people", 0.72),
        (12, [small], [], [wide], [0.1, 0.1, 0.1, 0.2], 0.02, 1, "incidental_people", 0.72),  # saliency is everywhere
        (13, [], [], [[0.4, 0.2, 0.2, 0.4]], [0.4, 0.2, 0.2, 0.4], 0.05, 2, "person_in_landscape", 0.60 + 0.05 + 0.2),
        (14, [], [], [[0.4, 0.2, 0.2, 0.4]], [0.4, 0.2, 0.2, 0.4], 0.05, 4, "incidental_people", 0.72),  # four of them
        (15, [], [], [[0.4, 0.2, 0.2, 0.2]], [0.4, 0.2, 0.2, 0.2], 0.05, 1, "incidental_people", 0.72),  # not upright
        (16, [([0.4, 0.2, 0.2, 0.2], 0.3)], [], [[0.4, 0.2, 0.2, 0.2]], [0.4, 0.2, 0.2, 0.2], 0.05, 1, "person_in_landscape", 0.85),  # an unsure human is enough
        (17, [([0.4, 0.2, 0.2, 0.2], 0.3)], [], [], None, 0.0, 0, "no_person", 0.92),
        (18, [], [], [], None, None, None, "no_person", 0.92),
    ]
    df = spark.createDataFrame([c[:7] for c in cases], SCHEMA)
    got = {r["i"]: r["c"] for r in df.select("i", rules.classify(*[F.col(c) for c in df.columns[1:]]).alias("c")).collect()}
    for c in cases:
        assert got[c[0]]["reason"] == c[7] and abs(got[c[0]]["confidence"] - c[8]) < 1e-9, (c, got[c[0]])
        assert (got[c[0]]["category"] == "people") == (c[7] in ("clear_portrait", "dominant_person", "person_in_landscape"))


def test_saliency_takes_the_first_of_equals(spark):
    person = [0.0, 0.0, 0.4, 0.4]
    rows = [
        (1, person, [[0.2, 0.2, 0.4, 0.4], [-0.2, -0.2, 0.4, 0.4]], (0.25, 0.25)),
        (2, person, [[0.3, 0.3, 0.1, 0.1], [0.0, 0.0, 0.2, 0.2], [0.2, 0.2, 0.2, 0.2]], (0.25, 1.0)),
        (3, person, [[0.4, 0.0, 0.4, 0.4], [0.5, 0.5, 0.0, 0.1]], (0.0, 0.0)), (4, person, [], (0.0, 0.0)), (5, [0.0, 0.0, 0.0, 0.0], [person], (0.0, 0.0)),
        (6, person, [[0.0, 0.0, 0.8, 0.4], [0.0, 0.0, 0.4, 0.2]], (1.0, 0.5)),  # both products are a half
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "i int, person array<double>, salient array<array<double>>")
    for r, want in zip(df.select("i", rules.saliency_support(F.col("person"), F.col("salient")).alias("s")).orderBy("i").collect(), rows, strict=True):
        assert all(abs(a - b) < 1e-9 for a, b in zip(r["s"], want[3], strict=True)), (r, want)


def test_eligibility_is_never_null(spark):
    rows = [(0.1, 0.0, 200), (0.1, 0.3, 200), (0.1, None, 200), (0.3, None, 200), (0.1, 0.0, 159), (0.1, 0.0, None), (None, 0.3, 200), (0.22, 0.2, 160)]
    df = spark.createDataFrame(rows, "o double, p double, px int")
    got = [tuple(r["e"]) for r in df.select(rules.eligibility(F.col("o"), F.col("p"), F.col("px")).alias("e")).collect()]
    t, f = True, False
    assert got == [(t, f, t), (t, t, f), (t, f, t), (t, f, f), (f, f, f), (f, f, f), (f, t, f), (t, f, f)]


def test_medians_and_ranks_equal_sorted_lists(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None, "c"]), r.choice([None, *range(9)])) for _ in range(400)] + [("one", 4), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    lists = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {x[0] for x in rows}}
    got = {x["g"]: (x["n"], x["median"]) for x in ordering.medians(df, "v", ["g"]).collect()}
    assert got == {g: (len(v), st.median(v)) for g, v in lists.items() if v}
    p90 = {x["g"]: x["p"] for x in ordering.at_ranks(df, "v", ["g"], {"p": ordering.nearest(0.9)}).collect()}
    assert p90 == {g: v[min(int(len(v) * 0.9), len(v) - 1)] for g, v in lists.items() if v}
    assert ordering.medians(df, "v", []).first()["median"] == st.median(v for _, v in rows if v is not None)
    assert ordering.medians(df.where("false"), "v", ["g"]).count() == 0


def test_sharpness_risks_have_two_tiers(spark):
    rows = [
        (1, "f", 10.0, []), (2, "f", 10.0, ["low_sharpness"]), (3, "f", 5.4, ["noise"]), (4, "f", 5.6, []), (5, "f", 5.0, ["low_contrast"]),
        (6, None, 1.9, ["noise", "low_sharpness"]), (7, None, 3.0, None), (8, "lone", None, ["low_sharpness"]), (9, "zero", 0.0, []), (10, "zero", 0.0, []),
    ]
    df = spark.createDataFrame(rows, "i int, f string, s double, r array<string>")
    got = {x["i"]: x["r"] for x in quality.sharpness_risks(df, "f", "s", "r").collect()}
    low = "low_sharpness"  # family median 5.6, library median 5.0
    assert got == {1: [], 2: [], 3: ["noise"], 4: [], 5: ["low_contrast"], 6: ["noise"], 7: [], 8: [low], 9: [], 10: []}
    sharper = df.withColumn("s", F.when(F.col("i") == 4, 10.0).when(F.col("i") == 6, 1.7).otherwise(F.col("s")))  # 10 and 5
    got = {x["i"]: x["r"] for x in quality.sharpness_risks(sharper, "f", "s", "r").collect()}
    assert got[3] == [low, "noise"] and got[5] == ["low_contrast"] and got[6] == [low, "noise"] and got[7] == []
    assert quality.sharpness_risks(df.where("false"), "f", "s", "r").count() == 0
