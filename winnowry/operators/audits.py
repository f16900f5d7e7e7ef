"""Audits of recorded runs: which checks each passes, which runs are void and what they cost, and what the others score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tournament import plan_json


@dataclass(frozen=True)
class Expected:
    """What a run should have read and sent; photos of anchors are sent in two images each."""

    rubric_md5: str
    photos2: int = 10
    photos3: int = 8


def with_group(runs: DataFrame) -> DataFrame:
    """Adds the group that a run's configuration makes: A without the third stage, B1, B2 with a rubric, B3 with anchors as well, else null."""
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    on, rubric, anchors = F.coalesce(F.col("config.stage3Vlm"), F.lit(False)), has(F.col("config.stage3RubricFile")), has(F.col("config.stage3AnchorsFile"))
    group = F.when(~on & ~rubric & ~anchors, "A").when(on & ~rubric & ~anchors, "B1").when(on & rubric & ~anchors, "B2").when(on & rubric & anchors, "B3")
    return runs.withColumn("group", group)


def checks(runs: DataFrame, calls: DataFrame, verdicts: DataFrame, expected: Expected) -> DataFrame:
    """(run, group, check, ok, detail): a row for each check that applies to a run.

    Checks of what a run was given apply only where the stage in question ran, so a run that failed early is not blamed for what it never read.
    """
    sent = calls.where("sent").groupBy("run").agg(*[F.count_if(F.col("stage") == s).alias(f"sent{s}") for s in (2, 3)])
    third = verdicts.where("stage = 3").select("run", F.col("plan_md5").alias("v_md5"), F.col("plan").alias("v_plan"), F.lit(True).alias("judged"))
    r = with_group(runs).join(sent, "run", "left").join(third, "run", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    a, known = F.col("group") == "A", F.col("group").isNotNull()
    s2, s3 = F.coalesce(F.col("stage2.status"), F.lit("")), F.coalesce(F.col("stage3.status"), F.lit(""))
    ran3, inputs, rubric = s3.isin("ran", "no_contests"), F.col("stage3_inputs"), F.col("group").isin("B2", "B3")
    read = known & ~a & ran3 & inputs.isNotNull()
    plan = F.coalesce(F.col("stage3.plan"), F.array().cast("array<struct<segment:bigint,a:string,b:string>>"))
    again = F.md5(plan_json(F.transform(plan, lambda p: F.array(p["a"], p["b"]))).cast("binary"))
    found: list[Column] = []

    def check(name: str, applies: Column, ok: Column, *detail: Column | str) -> None:
        text = F.concat_ws(" ", *[d if isinstance(d, Column) else F.lit(d) for d in detail])
        found.append(F.when(applies, F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), text.alias("detail"))))

    check("known group", F.lit(True), known, F.coalesce("group", F.lit("no group")))
    check("no inputs without a third stage", a, inputs.isNull(), F.coalesce("stage3_inputs.rubric_md5", F.lit("")))
    check("inputs recorded", known & ~a & ran3, inputs.isNotNull())
    check("rubric read", read & rubric, F.col("stage3_inputs.rubric_md5") == expected.rubric_md5, F.coalesce("stage3_inputs.rubric_md5", F.lit("none")))
    check("no rubric read", read & ~rubric, (zero("stage3_inputs.rubric_chars") == 0) & (F.length(F.coalesce("stage3_inputs.rubric_md5", F.lit(""))) == 0), zero("stage3_inputs.rubric_chars").cast("string"))
    check("anchors of stage 3", read, zero("stage3.anchor_photos_sent") == F.when(F.col("group") == "B3", expected.photos3).otherwise(0), zero("stage3.anchor_photos_sent").cast("string"))
    check("anchors of stage 2", s2 == "ran", zero("stage2.anchor_photos_sent") == expected.photos2, zero("stage2.anchor_photos_sent").cast("string"))
    # of an error only its first sentence is shown: the rest may quote what a judge wrote about people
    brief = lambda c: F.substring(F.substring_index(F.coalesce(F.col(c), F.lit("")), "。", 1), 1, 80)
    check("stage 2 ran", known, s2 == "ran", s2, F.when(s2 == "failed", brief("stage2.error")))
    check("stage 3 ran", known & ~a, ran3, s3, F.when(s3 == "failed", brief("stage3.error")))
    check("stage 3 off", a, s3 == "off", s3)
    check("all matches judged", known & ~a, zero("stage3.note.missing") == 0, zero("stage3.note.missing").cast("string"))
    check("all verdicts planned", known & ~a, zero("stage3.note.unused") == 0, zero("stage3.note.unused").cast("string"))
    check("plan hash", (F.size(plan) > 0) & F.col("stage3.plan_md5").isNotNull(), again == F.col("stage3.plan_md5"), F.col("stage3.plan_md5"), again)
    for s in (2, 3):
        counted = zero(f"stage{s}.comparisons") + zero(f"stage{s}.preflights")
        check(f"calls of stage {s}", F.col(f"stage{s}.comparisons").isNotNull(), counted == zero(f"sent{s}"), counted.cast("string"), zero(f"sent{s}").cast("string"))
        photos, jpegs = F.col(f"stage{s}.anchor_photos_sent"), F.col(f"stage{s}.anchor_jpegs_sent")
        check(f"images of stage {s}", photos.isNotNull() & jpegs.isNotNull(), jpegs == photos * 2, photos.cast("string"), jpegs.cast("string"))
    judged = F.coalesce("judged", F.lit(False))
    check("hash of the verdicts", judged, F.col("v_md5").eqNullSafe(F.col("stage3.plan_md5")), F.coalesce("v_md5", F.lit("none")))
    check("plan of the verdicts", judged, F.coalesce(F.col("v_plan"), F.array().cast("array<struct<segment:bigint,a:string,b:string>>")) == plan)
    out = r.select("run", "group", F.explode(F.array_compact(F.array(*found))).alias("c"))
    return out.select("run", "group", "c.check", "c.ok", "c.detail")


def void_reasons(checked: DataFrame) -> DataFrame:
    """(run, group, void): the names of the checks that a run fails, in order; none for a valid run."""
    fails = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("check"))))
    return checked.groupBy("run", "group").agg(fails.alias("void"))


def costs(voids: DataFrame, calls: DataFrame) -> DataFrame:
    """(group, valid, runs, sent, failed) of valid and void runs apart: void runs cost calls and count in nothing else."""
    by = calls.where("sent").groupBy("run").agg(F.count("*").alias("sent"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"))
    r = voids.select("run", "group", (F.size("void") == 0).alias("valid")).join(by, "run", "left")
    return r.groupBy("group", "valid").agg(F.count("*").alias("runs"), F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))


def scores(runs: DataFrame, verdicts: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each run: hits before and after (overlap2, overlap3, net), contests, swaps, decisive duels by answer, and the reach.

    A duel is decisive if one of its items is ``gold`` (item) and the other is not: up if the challenger b is, down if a is.  Its verdict, in
    either order, is right, wrong, neither, unstated (tie or inconsistent) or unjudged.  A swap is a planned pair whose a left the list and b came.
    reach is the span of hits that the plan allows: overlap2 - down to overlap2 + up.
    """
    known = gold.select("item", F.lit(True).alias("good"))
    lists = runs.select("run", F.explode(F.array(F.struct(F.lit(2).alias("at"), F.col("delivered_after_stage2").alias("l")), F.struct(F.lit(3).alias("at"), F.col("delivered_final").alias("l")))).alias("x"))
    items = lists.select("run", "x.at", F.explode("x.l").alias("item")).distinct().join(known, "item", "left_semi")
    hits = items.groupBy("run").agg(*[F.count_if(F.col("at") == s).alias(f"overlap{s}") for s in (2, 3)])
    duels = runs.select("run", "delivered_after_stage2", "delivered_final", F.explode("stage3.plan").alias("p")).select("run", "p.a", "p.b", *[
        F.coalesce(F.array_contains(c, F.col(f"p.{i}")), F.lit(False)).alias(n) for n, c, i in (("was", "delivered_after_stage2", "a"), ("stays", "delivered_final", "a"), ("comes", "delivered_final", "b"))
    ])
    third = verdicts.where("stage = 3").select("run", F.explode("verdicts").alias("v")).select("run", "v.a", "v.b", "v.winner", F.coalesce("v.consistent", F.lit(False)).alias("firm"))
    firm = third.select("run", "a", "b", "firm").unionByName(third.select("run", F.col("b").alias("a"), F.col("a").alias("b"), "firm")).groupBy("run", "a", "b").agg(F.max("firm").alias("firm"))
    said = _said(third)
    d = duels.join(said, ["run", "a", "b"], "left").join(firm, ["run", "a", "b"], "left")
    for c in ("a", "b"):
        d = d.join(known.select(F.col("item").alias(c), F.col("good").alias(f"{c}_good")), c, "left").withColumn(f"{c}_good", F.coalesce(f"{c}_good", F.lit(False)))
    side, w = F.when(F.col("b_good") & ~F.col("a_good"), "b").when(F.col("a_good") & ~F.col("b_good"), "a"), F.col("winner")
    decisive = side.isNotNull()
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    facts = d.groupBy("run").agg(
        F.count("*").alias("contests"), count(F.col("was") & ~F.col("stays") & F.col("comes"), "swaps"), count(F.col("firm"), "consistent"), count(side == "b", "up"), count(side == "a", "down"),
        count(decisive & (w == side), "right"), count(decisive & w.isin("a", "b") & (w != side), "wrong"), count(decisive & (w == "neither"), "neither"),
        count(decisive & w.isin("tie", "inconsistent"), "unstated"), count(decisive & w.isNull(), "unjudged"),
    )
    names = ["overlap2", "overlap3", "contests", "swaps", "consistent", "up", "down", "right", "wrong", "neither", "unstated", "unjudged"]
    out = runs.select("run").join(hits, "run", "left").join(facts, "run", "left")
    out = out.select("run", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return out.withColumn("net", F.col("overlap3") - F.col("overlap2")).withColumn("reach_low", F.col("overlap2") - F.col("down")).withColumn("reach_high", F.col("overlap2") + F.col("up"))


def _said(third: DataFrame) -> DataFrame:
    """Verdicts of each run readable in both orders; a row given forward wins, of several the smallest winner."""
    flip = F.when(F.col("winner") == "a", "b").when(F.col("winner") == "b", "a").otherwise(F.col("winner"))
    rows = third.select("run", "a", "b", F.struct(F.lit(0).alias("turned"), F.col("winner").alias("w")).alias("x"))
    rows = rows.unionByName(third.select("run", F.col("b").alias("a"), F.col("a").alias("b"), F.struct(F.lit(1).alias("turned"), flip.alias("w")).alias("x")))
    return rows.groupBy("run", "a", "b").agg(F.min("x")["w"].alias("winner"))


def calibration(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row of how verdicts meet known answers, with ``problems`` that make it void.

    rows are (a, b, winner, skipped, consistent, code_a, code_b, code_read_ok, contradiction), plan (a, b, answer).  gold, other, neither, tie and
    inconsistent are the five answers; pairs that were skipped are in none.  hit_rate is gold over gold and other only; stated_rate counts
    neither as well, over all rows.  code_ok and contradictions are null unless every row has its codes.  problems, in order: the number of
    rows, pairs that are not the plan's, skipped pairs, unknown winners, and codes that are missing in all rows or in some.
    """
    names = [F.struct("a", "b").alias("pair"), F.lit(1).alias("c")]
    balance = rows.select(*names).unionByName(plan.select(names[0], F.lit(-1).alias("c"))).groupBy("pair").agg(F.sum("c").alias("c"))
    strange = balance.agg(F.count_if(F.col("c") != 0).alias("strange"))
    known = rows.join(plan.groupBy("a", "b").agg(F.min("answer").alias("answer")), ["a", "b"], "left")
    asked, w = ~F.coalesce("skipped", F.lit(False)), F.col("winner")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    whole = F.col("code_a").isNotNull() & F.col("code_b").isNotNull() & F.col("code_read_ok").isNotNull() & F.col("contradiction").isNotNull() & (F.length("code_a") > 0) & (F.length("code_b") > 0)
    hit = F.coalesce(w == F.col("answer"), F.lit(False))
    facts = known.agg(
        F.count("*").alias("n"), count(asked & w.isin("a", "b") & hit, "gold"), count(asked & w.isin("a", "b") & ~hit, "other"), *[count(asked & (w == k), k) for k in ("neither", "tie", "inconsistent")],
        count(~asked, "skipped"), count(F.col("consistent"), "consistent"), count(asked & ~F.coalesce(w.isin("a", "b", "neither", "tie", "inconsistent"), F.lit(False)), "unknown"),
        count(whole, "coded"), count(F.col("code_a").isNotNull(), "shown"), count(F.col("code_read_ok"), "read"), count(F.col("contradiction"), "against"),
    )
    one = facts.crossJoin(F.broadcast(strange)).crossJoin(F.broadcast(plan.agg(F.count("*").alias("planned"))))  # one row each
    all_coded = (F.col("n") > 0) & (F.col("coded") == F.col("n"))
    why = [
        (F.col("n") != F.col("planned"), "number of rows"), (F.col("strange") > 0, "other pairs"), (F.col("skipped") > 0, "skipped pairs"), (F.col("unknown") > 0, "unknown winners"),
        (~all_coded & (F.col("shown") == 0), "no codes shown"), (~all_coded & (F.col("shown") > 0), "codes missing in some rows"),
    ]
    directional = F.col("gold") + F.col("other")
    return one.select(
        "n", "gold", "other", "neither", "tie", "inconsistent", "skipped", "consistent", F.try_divide("gold", directional).alias("hit_rate"), F.try_divide(directional + F.col("neither"), "n").alias("stated_rate"),
        F.when(all_coded, F.col("read")).alias("code_ok"), F.when(all_coded, F.col("against")).alias("contradictions"), F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in why])).alias("problems"),
    )


def retest(first: DataFrame, second: DataFrame, group: str, item: str, kept: str) -> DataFrame:
    """(group, n, same, both_ties, one_tie, same_way, opposite) of two rounds of keep or reject over the same items.

    n items were judged in both rounds, ``same`` of them alike.  A pair of a group's items says a direction in a round if one is kept and the other is not, else it
    is a tie.  Pairs are counted from the numbers of items by both answers, and never made.
    """
    two = first.select(group, item, F.col(kept).alias("x")).join(second.select(group, item, F.col(kept).alias("y")), [group, item]).where("x IS NOT NULL AND y IS NOT NULL")
    cell = lambda x, y, name: F.count_if((F.col("x") == x) & (F.col("y") == y)).alias(name)
    c = two.groupBy(group).agg(cell(True, True, "yy"), cell(True, False, "yn"), cell(False, True, "ny"), cell(False, False, "nn"))
    yy, yn, ny, nn = (F.col(k) for k in ("yy", "yn", "ny", "nn"))
    pairs = sum((k * (k - 1) for k in (yn, ny, nn)), yy * (yy - 1)) / 2
    return c.select(
        group, (yy + yn + ny + nn).alias("n"), (yy + nn).alias("same"), pairs.cast("long").alias("both_ties"), ((yy + nn) * (yn + ny)).alias("one_tie"), (yy * nn).alias("same_way"), (yn * ny).alias("opposite")
    )


def accounting(asked: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """One row (used, missing, unused) of matches asked (a, b) and recorded verdicts (a, b, winner); all null without a record.

    used counts matches that a verdict answered, in either order, missing those without one, and unused the verdicts beyond the used ones.  Null is
    not 0: nothing was bought.
    """
    if verdicts is None:
        return asked.agg(*[F.max(F.lit(None).cast("long")).alias(c) for c in ("used", "missing", "unused")])
    # one aggregate by unordered pair: no join, and verdicts are not doubled; a pair with a null is asked and never answered
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    pair = [F.when(both, F.least("a", "b")).alias("x"), F.when(both, F.greatest("a", "b")).alias("y")]
    rows = asked.select(*pair, F.lit(1).alias("asked"), F.lit(0).alias("said")).unionByName(verdicts.select(*pair, F.lit(0).alias("asked"), both.cast("int").alias("said")))
    each = rows.groupBy("x", "y").agg(F.sum("asked").alias("asked"), F.max("said").alias("said"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counts = each.agg(zero(F.sum(F.when(F.col("said") == 1, F.col("asked")))).alias("used"), zero(F.sum(F.when(F.col("said") == 0, F.col("asked")))).alias("missing"))
    return counts.crossJoin(F.broadcast(verdicts.agg(F.count("*").alias("n")))).select("used", "missing", (F.col("n") - F.col("used")).alias("unused"))


def coverage(rows: DataFrame, expected: DataFrame, arms: list[str]) -> DataFrame:
    """(tag, arm, check, n, ok) for every cell of expected tags (tag, n) and arms, whether it has rows or not.

    rows are (tag, arm, ab, ba, consistent).  pairs: as many rows as expected; directions: rows that lack an answer in one order, none allowed;
    consistent: rows with one answer in both orders, which is told and always ok.
    """
    grid = expected.select("tag", F.col("n").alias("want"), F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    lacks = (F.length(F.coalesce("ab", F.lit(""))) == 0) | (F.length(F.coalesce("ba", F.lit(""))) == 0)
    got = rows.groupBy("tag", "arm").agg(F.count("*").alias("n"), F.count_if(lacks).alias("lacks"), F.count_if("consistent").alias("firm"))
    cells = grid.join(got, ["tag", "arm"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = [("pairs", zero("n"), zero("n") == F.col("want")), ("directions", zero("lacks"), zero("lacks") == 0), ("consistent", zero("firm"), F.lit(True))]
    each = F.array(*[F.struct(F.lit(k).alias("check"), n.cast("long").alias("n"), ok.alias("ok")) for k, n, ok in told])
    return cells.select("tag", "arm", F.explode(each).alias("c")).select("tag", "arm", "c.check", "c.n", "c.ok")


def arms_differ(rows: DataFrame, arms: list[str]) -> DataFrame:
    """(tag, one, two, same, common, differ) for every two arms: rows are (tag, arm, a, b, winner), one for each arm and pair.

    Answers that are the same on every common pair mean that an arm's input was not applied.  Arms without a common pair differ.
    """
    wide = rows.groupBy("tag", "a", "b").agg(F.map_from_entries(F.collect_list(F.struct("arm", F.struct("winner")))).alias("said"))  # arms are few
    two = F.array(*[F.struct(F.lit(x).alias("one"), F.lit(y).alias("two")) for i, x in enumerate(arms) for y in arms[i + 1 :]])
    met = wide.select("tag", "said", F.explode(two).alias("p"))
    x, y = F.try_element_at("said", F.col("p.one")), F.try_element_at("said", F.col("p.two"))
    both = x.isNotNull() & y.isNotNull()
    out = met.groupBy("tag", "p.one", "p.two").agg(F.count_if(both & x["winner"].eqNullSafe(y["winner"])).alias("same"), F.count_if(both).alias("common"))
    return out.withColumn("differ", (F.col("common") == 0) | (F.col("same") < F.col("common")))


def complete_shards(plan: DataFrame, found: DataFrame, shard: str, keys: list[str], truth: str) -> DataFrame:
    """(shard) of shards that may be carried over: every planned row (shard, keys, truth) is found (keys, truth), and with the same truth.

    Found rows that contradict each other agree with nothing.
    """
    seen = found.groupBy(*keys).agg(F.min(truth).alias("_low"), F.max(truth).alias("_high"))
    both = plan.join(seen, keys, "left").select(shard, F.coalesce((F.col("_low") == F.col(truth)) & (F.col("_high") == F.col(truth)), F.lit(False)).alias("ok"))
    return both.groupBy(shard).agg(F.bool_and("ok").alias("ok")).where("ok").select(shard)
