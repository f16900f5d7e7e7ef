"""Choosing a final list: caps, quotas, marginal contests, cut lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def within_group_rank(df: DataFrame, group: str, score: str, item: str, out: str = "within_rank") -> DataFrame:
    """0 for the best of each group, then by score."""
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    return df.withColumn(out, F.row_number().over(w) - 1)


def champions_first(df: DataFrame, rank: str, score: str, item: str, out: str = "ord") -> DataFrame:
    """0-based global order: best of each group before any second, then by score."""
    return numbered(df, [F.col(rank), F.desc(score), F.col(item)], out)


def top_with_cap(df: DataFrame, group: str, order: list[Column], k: int, cap: int) -> DataFrame:
    """First k rows in ``order`` with at most c of a group; c starts at ``cap`` and grows until k rows fit.

    The smallest sufficient c comes from the group sizes: how many rows fit is linear in c between
    two sizes that occur, and these are few (1 + 2 + ... + m rows for m sizes).  Rows are
    filtered by one window over groups; the final cut is a top-k.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = F.col("n") * F.col("groups")
    steps = sizes.select(
        "n", F.coalesce(F.max("n").over(up), F.lit(0)).alias("below"), F.coalesce(F.sum(rows).over(up), F.lit(0)).alias("whole"),
        (F.sum("groups").over(all_) - F.coalesce(F.sum("groups").over(up), F.lit(0))).alias("larger"), F.least(F.lit(k), F.sum(rows).over(all_)).alias("want"),
    )
    c = F.greatest(F.lit(cap), F.col("below") + 1, F.ceil((F.col("want") - F.col("whole")) / F.col("larger")))
    need = steps.withColumn("c", c).agg(F.coalesce(F.min(F.when(F.col("c") <= F.col("n"), F.col("c"))), F.lit(cap)).alias("cap_used"))
    g = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    kept = df.withColumn("_g", g).crossJoin(F.broadcast(need)).where(F.col("_g") <= F.col("cap_used")).drop("_g")
    return kept.orderBy(*order).limit(k)


def spread_selection(df: DataFrame, item: str, group: str, seg: str, ord_: str, k: int, group_cap: int, segments: int) -> DataFrame:
    """Greedy list under a group cap and a segment quota ceil(k / S); then, if short, without the quota.

    The two caps depend on each other, so the choice is a fold over candidates in order.  It
    sees only candidates that can matter.  With quota q, at most k picks block further groups and
    each blocks its group's rows only, so the first k rows of the first 2k + q groups of every
    segment decide both passes.  Both cuts are made by
    windows before one row is built, so its size depends on k and not on the data.
    Returns (item, group, seg, ord, pick) in pick order.
    """
    quota = max(1, -(-k // max(1, segments)))
    near = Window.partitionBy(seg, group).orderBy(ord_)
    df = df.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k)
    heads = df.where("_n = 1").withColumn("_h", F.row_number().over(Window.partitionBy(seg).orderBy(ord_))).where(F.col("_h") <= 2 * k + quota)
    df = df.join(F.broadcast(heads.select(seg, group)), [seg, group], "left_semi").drop("_n")
    rows = F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), F.col(group).alias("f"), F.col(seg).alias("s"), F.col(item).alias("i"))))
    packed = df.agg(rows.alias("rows"))
    kind = df.schema
    row_t = f"struct<o:{kind[ord_].dataType.simpleString()},f:{kind[group].dataType.simpleString()},s:{kind[seg].dataType.simpleString()},i:{kind[item].dataType.simpleString()}>"
    empty = F.array().cast(f"array<{row_t}>")

    def step(with_quota: bool):
        def run(acc, r):
            same = F.size(F.filter(acc, lambda x: x["f"].eqNullSafe(r["f"])))
            ok = (F.size(acc) < k) & (same < group_cap)
            if with_quota:
                ok &= F.size(F.filter(acc, lambda x: x["s"] == r["s"])) < quota
            else:
                ok &= ~F.exists(acc, lambda x: x["i"] == r["i"])
            return F.when(ok, F.array_append(acc, r)).otherwise(acc)

        return run

    first = packed.select("rows", F.aggregate("rows", empty, step(True)).alias("picked"))
    both = first.select(F.when(F.size("picked") >= k, F.col("picked")).otherwise(F.aggregate("rows", F.col("picked"), step(False))).alias("picked"))
    out = both.select(F.posexplode("picked").alias("pick", "r"))
    return out.select(F.col("r.i").alias(item), F.col("r.f").alias(group), F.col("r.s").alias(seg), F.col("r.o").alias(ord_), "pick")


def contests(df: DataFrame, picked: DataFrame, item: str, group: str, seg: str, ord_: str, score: str, group_cap: int, deep: int = 1) -> DataFrame:
    """For each segment its last pick against the first ``deep`` candidates not picked that keep the group cap.

    A challenger of the defender's own group is always legal.
    """
    mine = picked.join(df.select(item, score), item)
    held = picked.groupBy(group).agg(F.count("*").alias("held"))
    last = mine.groupBy(seg).agg(F.max_by(F.struct(F.col(item).alias("d"), F.col(group).alias("dg"), F.col(score).alias("ds")), "pick").alias("m"))
    free = df.join(picked.select(item), item, "left_anti").join(F.broadcast(last), seg).join(F.broadcast(held), group, "left")
    legal = free.where((F.col(group) == F.col("m.dg")) | (F.coalesce("held", F.lit(0)) + 1 <= group_cap))
    nth = F.row_number().over(Window.partitionBy(seg).orderBy(ord_))
    return legal.withColumn("depth", nth).where(F.col("depth") <= deep).select(
        F.col(seg).alias("segment"), F.col("m.d").alias("defender"), F.col(item).alias("challenger"),
        F.col("m.dg").alias("defender_group"), F.col(group).alias("challenger_group"),
        F.bround(F.col("m.ds") - F.col(score), 6).alias("margin"), "depth",
    )


def apply_verdicts(picked: DataFrame, duels: DataFrame, item: str, group: str, group_cap: int) -> DataFrame:
    """One row: the list after the duels (margin, segment order) and why each seat stayed.

    duels has (segment, defender, challenger, defender_group, challenger_group, margin, verdict),
    a null verdict for a duel that was not held.  Only 'b' swaps; a swap that would pass the
    group cap is refused.  At most one duel a segment, so the fold is short.
    """
    known = ["a", "b", "tie", "neither", "inconsistent"]
    checked = duels.withColumn(
        "verdict",
        F.when(F.col("verdict").isNull() | F.col("verdict").isin(known), F.col("verdict")).otherwise(
            F.raise_error(F.concat(F.lit("unknown verdict "), F.col("verdict")))
        ),
    )
    d = checked.agg(
        F.array_sort(F.collect_list(F.struct("margin", "segment", "defender", "challenger", "defender_group", "challenger_group", "verdict"))).alias("duels")
    )
    p = picked.agg(F.array_sort(F.collect_list(F.struct("pick", F.col(item).alias("i"), F.col(group).alias("g")))).alias("seats"))

    def run(acc, r):
        others = F.size(F.filter(acc["seats"], lambda x: x["g"] == r["challenger_group"]))
        legal = (r["defender_group"] == r["challenger_group"]) | (others + 1 <= group_cap)
        swap = (r["verdict"] == "b") & legal
        seat = lambda x: F.when(
            F.coalesce(swap, F.lit(False)) & (x["i"] == r["defender"]),
            F.struct(x["pick"].alias("pick"), r["challenger"].alias("i"), r["challenger_group"].alias("g")),
        ).otherwise(x)
        what = (
            F.when(r["verdict"].isNull(), "missing").when(r["verdict"] != "b", F.concat(F.lit("kept_"), r["verdict"]))
            .when(legal, "swapped").otherwise("refused_family_cap")
        )
        return F.struct(F.transform(acc["seats"], seat).alias("seats"), F.array_append(acc["log"], what).alias("log"))

    start = F.struct(F.col("seats"), F.array().cast("array<string>").alias("log"))
    out = p.crossJoin(d).select(F.aggregate("duels", start, run).alias("r"), F.size("duels").alias("contests"))
    count = lambda k: F.size(F.filter("r.log", lambda x: x == k)).alias(k)
    names = ["swapped", "missing", "refused_family_cap", "kept_a", "kept_tie", "kept_neither", "kept_inconsistent"]
    return out.select(
        F.transform("r.seats", lambda x: x["i"]).alias("final"), "contests", *[count(k) for k in names],
        F.size(F.filter("r.log", lambda x: x.startswith("kept_"))).alias("kept"),
    )


def broken_invariants(final: DataFrame, before: DataFrame, item: str, group: str, seg: str, target: int, group_cap: int) -> DataFrame:
    """Rows (problem, key, n) for wrong length, repeated items, groups beyond the cap, and segments that have not
    as many items as ``before`` the change; empty if all is well."""
    n = final.agg(F.count("*").alias("n")).where(F.col("n") != target).select(F.lit("length").alias("problem"), F.lit("").alias("key"), "n")
    twice = final.groupBy(item).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), F.col(item).cast("string").alias("key"), "n")
    over = final.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > group_cap).select(F.lit("group cap").alias("problem"), F.col(group).cast("string").alias("key"), "n")
    each = final.select(seg, F.lit(1).alias("d")).unionByName(before.select(seg, F.lit(-1).alias("d"))).groupBy(seg).agg(F.sum("d").alias("n"))
    moved = each.where("n <> 0").select(F.lit("segment").alias("problem"), F.col(seg).cast("string").alias("key"), "n")
    return n.unionByName(twice).unionByName(over).unionByName(moved)


def cut_line_gap(df: DataFrame, value: str, item: str, n: int) -> DataFrame:
    """(gap): value at rank n less value at rank n + 1; null if there are no more than n; missing values last."""
    top = df.select(value, item).orderBy(F.desc_nulls_last(value), item).limit(n + 1)
    r = F.row_number().over(Window.orderBy(F.desc_nulls_last(value), item))
    return top.withColumn("r", r).agg((F.max(F.when(F.col("r") == n, F.col(value))) - F.max(F.when(F.col("r") == n + 1, F.col(value)))).alias("gap"))


def runner_ups(df: DataFrame, group: str, score: str, item: str, selected: DataFrame) -> DataFrame:
    """The best of each group that has no selected item."""
    others = df.join(df.join(selected.select(item), item, "left_semi").select(group).distinct(), group, "left_anti")
    return others.groupBy(group).agg(F.max_by(item, F.struct(score, -F.col(item))).alias(item), F.max(score).alias(score))


def strided_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows spread over the whole order: places min(N - 1, floor(i * N / n))."""
    total = df.agg(F.count("*").alias("_total"))
    want = total.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"), "_total").select(
        F.least(F.col("_total") - 1, F.floor(F.col("_i") * F.col("_total") / n)).alias("_at")
    )
    placed = numbered(df, [F.col(order)], "_at")
    return placed.join(F.broadcast(want.distinct()), "_at").drop("_at")


def choose_anchors(items: DataFrame, group: str, item: str, rank: str | None, chosen: str, reasons: DataFrame, n: int, seed: int = 20260901) -> DataFrame:
    """(group, kind, typical, place) of every group: ``n`` of them are anchors with a place from 0 on, the others have none.

    A group's kind is win, reject or multi by the number of its items that are ``chosen``.  Each kind gives its most typical group, in
    this order: 2 if its best chosen item is the first by ``rank``, 1 if the second, else 0, then the longer reason (``reasons`` has group and reason), then the smaller
    group.  A kind without groups leaves its seat, and seats that are left are filled by a hash of seed and group.  Without a rank nothing is typical.
    """
    order = [F.coalesce(F.col(rank), F.lit(0.0)).desc(), F.col(item)] if rank else [F.col(item)]
    placed = items.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    facts = placed.groupBy(group).agg(F.count_if(F.col(chosen)).alias("c"), F.min(F.when(F.col(chosen), F.col("_at"))).alias("best"))
    typical = F.when(F.col("best") == 1, 2).when(F.col("best") == 2, 1).otherwise(0) if rank else F.lit(0)
    kind = F.when(F.col("c") == 0, "reject").when(F.col("c") == 1, "win").otherwise("multi")
    said = reasons.select(group, F.char_length("reason").alias("said"))
    known = facts.join(said, group, "left").select(group, kind.alias("kind"), typical.alias("typical"), F.coalesce("said", F.lit(0)).alias("said"))
    first = known.groupBy("kind").agg(F.min(F.struct((-F.col("typical")).alias("t"), (-F.col("said")).alias("s"), group))[group].alias(group))
    seat = F.when(F.col("kind") == "win", 0).when(F.col("kind") == "reject", 1).otherwise(2)
    seats = first.select(group, F.struct(seat.alias("turn"), F.lit("").alias("h")).alias("turn"))  # three rows at most
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    fill = known.join(seats, group, "left_anti").select(group, F.struct(F.lit(3).alias("turn"), hashed.alias("h")).alias("turn"))
    picked = seats.unionByName(fill).orderBy("turn", group).limit(n)
    places = picked.select(group, (F.row_number().over(Window.orderBy("turn", group)) - 1).alias("place"))  # n rows
    return known.join(places, group, "left").select(group, "kind", "typical", "place")
