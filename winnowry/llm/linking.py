"""Links inside candidate buckets and their components, without pairs of all members.

``shared_members`` leaves those bucket memberships (key, id) of a banding step that can lead to
a pair.  ``link`` takes them with a ``verify`` function and returns the connected components
of the verified links.  It never emits all pairs of a bucket:

1. Every bucket names one pivot, the member that shares most buckets: among near copies that
   is the text they were made from.  Every member is compared with the best of its pivots,
   so it makes one pair at most, and a group of near copies is mostly connected after it.
2. What is left are buckets with members of two or more components.  A bucket names up to
   ``fan`` pivots, none from its largest component, and each is compared with the members of other
   components; then these pivots leave the bucket.  A bucket whose members are all connected
   is finished.  No pair is verified twice.  The number of pivots grows by rounds, so members that
   are not alike still get every comparison.
3. In a bucket of at most ``wide`` members a cheap condition picks the pairs, so a member makes ``wide``
   pairs at most.  Members of wider buckets are compared by a sharp condition on larger facts as well, which are
   joined to these members only, and a pair that shares several such buckets is left to one of
   them; so few pairs besides the links leave a wide bucket.  Its first pivots may come from the largest
   component too, as most members that can join it are linked with one of these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, is_empty

Condition = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]

_FAN = 16
_FIRST = 8
_WIDE = 32
#: Members of a bucket that one task compares with the bucket's pivots.
SLICE = 4096


def connected_components(edges: DataFrame, store: Scratch) -> DataFrame:
    """Components of the links (a, b): rows (id, comp) of every id in a link, comp the smallest id.

    Distributed union-find by alternating large-star and small-star steps until the
    links are stars around the smallest ids.  Rows with nulls and loops are ignored; no rows give no rows.
    """
    cur = store.keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while True:
        ends = cur.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(cur.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # done when every id points to one root and no root points on
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").count():
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = store.keep(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        new = store.keep(small, "links")
        store.drop(cur, large)
        cur = new
    roots = cur.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return cur.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)


def _joined(labels: DataFrame, found: DataFrame, store: Scratch) -> DataFrame:
    """Labels after more links: components of the links between components, then of their ids."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    between = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = connected_components(between, store).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    old = labels.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    fresh = moved.select(F.col("comp").alias("id"), F.col("to").alias("comp")).join(labels.select("id"), "id", "left_anti")
    return old.unionByName(fresh)


def few_bits_apart(words: int, percent: int, deviations: float, packed: bool = False) -> Condition:
    """Condition on columns n, ones and w0..: whether two sets may be a link by the bits that only one of them has.

    With ``packed`` the words are one array, named words.  A condition over single columns is so much generated code that
    together with others it is more than the JVM compiles, and each comparison then takes 20 microseconds.

    Sets of na and nb members at the threshold differ in d = (na + nb) (100 - percent) / (100 + percent) members.  Each
    of these has a bit of its own unless the other set has that bit as well, so the bits apart are d at most, and
    but for chance, ``deviations`` standard deviations, d times the share of bits that are free.
    """

    def cond(left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        if packed:
            each = F.zip_with(left("words"), right("words"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
            apart = F.aggregate(each, F.lit(0), lambda s, x: s + x)
        else:
            apart = sum((F.bit_count(left(f"w{w}").bitwiseXOR(right(f"w{w}"))) for w in range(words)), F.lit(0))
        d = (left("n") + right("n")) * (100 - percent) / (100 + percent)
        free = 1 - (left("ones") + right("ones")) / (128 * words)
        return apart <= F.least(d, d * free + F.sqrt(d * free * (1 - free)) * deviations)

    return cond


def shared_members(members: DataFrame, store: Scratch) -> DataFrame:
    """Rows (key, id, size) of the buckets that two ids or more have in common; ``members`` has each (key, id) once.

    Sizes are summed before the shuffle, so a bucket with a large share of all rows is no load for one task.  Sizes are stored, so
    their shuffle is gone before the members are dealt.
    """
    size = store.keep(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    store.release()
    # keys of one member are most, so the sizes make small tables and the members need no sort
    shared = store.keep(members.join(size.hint("shuffle_hash"), "key"), "shared")
    store.drop(size)
    return shared


def _first() -> Column:
    """The order in which the members of a bucket become pivots."""
    return F.struct("score", -F.col("id"))


def _met(now: DataFrame, names: list[str], holding: Column) -> DataFrame:
    """Pairs of each bucket's pivots, the rows with a pick, with its members in other components."""
    chosen = now.where("pick IS NOT NULL").groupBy("key", "pick").agg(F.max_by(F.struct("id", "comp", *names), _first()).alias("p"))
    return _pairs(now.join(chosen, "key"), holding)


def _met_wide(now: DataFrame, names: list[str], holding: Column, tasks: int) -> DataFrame:
    """As ``_met``, for buckets whose comparisons are much work over few bytes.

    Buckets are dealt over ``tasks`` tasks, as Spark merges tasks that read little into one.  Buckets of more than
    SLICE members are dealt in slices; each slice gets all pivots.
    """
    slices = F.ceil(F.col("of") / SLICE)
    chosen = now.where("pick IS NOT NULL").groupBy("key", "pick").agg(
        F.max("of").alias("of"), F.max_by(F.struct("id", "comp", *names), _first()).alias("p")
    )
    chosen = chosen.select("key", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), "p")
    members = now.withColumn("slice", F.pmod(F.xxhash64("id"), slices)).repartition(tasks, "key", "slice")
    return _pairs(members.join(chosen.hint("merge"), ["key", "slice"]), holding)


def _pairs(both: DataFrame, holding: Column) -> DataFrame:
    both = both.where((F.col("comp") != F.col("p.comp")) & holding)
    return both.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))


def link(
    shared: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    store: Scratch,
    facts: DataFrame | None = None,
    likely: Condition | None = None,
    more: DataFrame | None = None,
    sharp: Condition | None = None,
    fan: int = _FAN,
    wide: int = _WIDE,
) -> tuple[DataFrame, DataFrame]:
    """Components and links of the rows of ``shared_members``; see the module's text.

    ``facts`` has columns beside id, of other names than key, score, comp, main, of, others, pick, slice, keys and p; ``likely(left, right)`` builds a cheap condition over them
    that must hold for every true link; ``more`` and ``sharp`` are the larger facts and the condition
    for wide buckets.  ``verify`` gets distinct pairs (a, b), a < b, and
    returns those that are links.  Returns (labels (id, comp), links (a, b)).
    """
    names = [] if facts is None else [c for c in facts.columns if c != "id"]
    live = shared.join(shared.groupBy("id").agg(F.sum("size").alias("score")), "id")
    if facts is not None:
        live = live.join(facts, "id")
    live = store.keep(live.select("key", "id", "score", *names), "members")
    first = _first()
    tasks = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    holds = lambda c: F.lit(True) if c is None else c(F.col, lambda x: F.col(f"p.{x}"))

    pivots = live.groupBy("key").agg(F.max_by(F.struct("id", "score", *names), first).alias("p"))
    best = (
        live.join(pivots, "key").where((F.col("id") != F.col("p.id")) & holds(likely))
        .groupBy("id").agg(F.max_by("p.id", F.struct("p.score", -F.col("p.id"))).alias("p"))
    )
    pairs = store.keep(best.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct(), "pairs")
    links = store.keep(verify(pairs).select("a", "b"), "found")
    first_round = True
    tested, labels, stored = pairs, store.keep(connected_components(links, store), "labels"), live

    while True:
        now = live.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        parts = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
        most = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("of"), F.max(F.struct("c", "comp")).alias("most"))
        most = most.where("parts > 1").select("key", "of", F.col("most.comp").alias("main"), (F.col("of") - F.col("most.c")).alias("others"))
        broad_pick = F.pmod(F.xxhash64("id", "key"), F.lit(_FIRST if first_round else fan))
        pick = F.when(F.col("others") <= fan, F.col("id")).otherwise(F.pmod(F.xxhash64("id", "key"), F.lit(fan)))
        pick = F.when(F.col("of") > wide, broad_pick).otherwise(pick)
        chosen = F.col("comp") != F.col("main")
        if first_round:
            chosen |= F.col("of") > wide
        # of the members of a bucket with one number the one of the best score is the pivot
        now = now.join(most, "key").withColumn("pick", F.when(chosen, pick))
        now, old = store.keep(now, "members"), stored
        stored = now
        store.drop(old)
        if is_empty(now):
            return labels, links
        narrow, broad = now.where(F.col("of") <= wide), now.where(F.col("of") > wide)
        pairs = _met(narrow, names, holds(likely))
        if not is_empty(broad):
            # a pair is left to the smallest key of the wide buckets that both are in
            big, all_names = broad.join(broad.groupBy("id").agg(F.collect_set("key").alias("keys")), "id"), [*names, "keys"]
            holding = holds(likely)
            if more is not None:
                big, all_names = big.join(more, "id"), [*all_names, *[c for c in more.columns if c != "id"]]
                holding &= holds(sharp)
            holding &= F.array_min(F.array_intersect("keys", "p.keys")) == F.col("key")
            big = store.keep(big, "wide")
            pairs = pairs.unionByName(_met_wide(big, all_names, holding, tasks))
        pairs = store.keep(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if not is_empty(pairs):
            found = store.keep(verify(pairs).select("a", "b"), "found")
            tested = tested.unionByName(pairs)
            if not is_empty(found):
                links = links.unionByName(found)
                labels, old = store.keep(_joined(labels, found, store), "labels"), labels
                store.drop(old)
        done = now.where("pick IS NOT NULL").groupBy("key", "pick").agg(F.max_by("id", first).alias("id")).select("key", "id")
        live = now.select("key", "id", "score", *names).join(done, ["key", "id"], "left_anti")
        fan, first_round = (fan * 16 if first_round else fan * 256), False
