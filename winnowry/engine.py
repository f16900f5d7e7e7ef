"""One object with the verbs of a curation session."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ranks
from .operators import selection, similarity, statistics, taste, tournament
from .operators.ordering import numbered, numbered_in
from .operators.stored import stored


@dataclass(frozen=True)
class Config:
    """Defaults of a session."""

    target: int = 20
    segments: int = 10
    family_cap: int = 2
    percentile: float = 0.995
    floor: float = 0.90
    arena: int = 8
    match_budget: int = 60
    min_labels: int = 5
    full_labels: int = 20
    weight: tuple[float, float] = field(default=(0.2, 0.7))
    strategy: str = "auto"
    use_probe: bool = False
    most_concentration: float = 1.05
    stage2: bool = True


@dataclass(frozen=True)
class Scored:
    """Items with their final ``score``, and how it came about: the cold strategy, the rung of the guard ladder, the probe's weight."""

    items: DataFrame
    strategy: str
    mode: str
    weight: float
    concentration: float | None
    labels: DataFrame

    @property
    def pinned(self) -> DataFrame:
        """Labelled items that may come first: all of them if they were used, else none."""
        return self.labels if self.mode == "fused" else self.labels.where("false")


class Judge(Protocol):
    """Says who wins a pair: a verdict column from two rows, or a table of verdicts."""

    def table(self, pairs: DataFrame) -> DataFrame | None: ...


class LocalJudge:
    """The scores decide."""

    def table(self, pairs: DataFrame) -> DataFrame | None:
        return None


class ReplayJudge:
    """Recorded verdicts (a, b, winner) in either order; pairs without one are decided by score."""

    def __init__(self, verdicts: DataFrame) -> None:
        self.verdicts = verdicts

    def table(self, pairs: DataFrame) -> DataFrame | None:
        return self.verdicts


class Curation:
    """Items (item long, vector array, score double): scan, group, rank, explain, compare, evaluate, export.

    Instead of a score items may have the metrics it is made of: general, and face and vision, which may be null.
    """

    def __init__(self, spark: SparkSession, items: DataFrame, config: Config = Config()) -> None:
        self.spark, self.config = spark, config
        self.items = items

    def scored(self, labels: DataFrame | None = None) -> Scored:
        """Cold scores by the configured strategy, fused with a probe of the labelled items (item) if no guard is against it.

        Scores are standardised.  The guards, in order: no labels, the probe is off, too few labels, labels too much alike.
        """
        c, items = self.config, self.items
        if "general" in items.columns:
            face = items if "face" in items.columns else items.withColumn("face", F.lit(None).cast("double"))
            raw, strategy = ranks.composite_score(face, "general", "face", "item", "_raw", c.strategy, "vision" if "vision" in items.columns else None)
        else:
            raw, strategy = items.withColumn("_raw", F.col("score")), "score"
        cold = stored(ranks.z_score(raw.select("item", "vector", "_raw"), "_raw", "cold").drop("_raw"))
        known = cold.select("item").join(labels.select("item").distinct(), "item", "left_semi") if labels is not None else cold.select("item").where("false")
        known = stored(known)
        n = known.count()
        alike = None
        if c.use_probe and n >= max(c.min_labels, 2):
            marked = cold.join(known.withColumn("_known", F.lit(True)), "item", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
            alike = similarity.concentration(marked, "item", "vector", "_known")
        rung = ranks.mode(F.lit(n), F.lit(1.0 if alike is None else alike), F.lit(c.use_probe), c.min_labels, c.most_concentration)
        mode = self.spark.range(1).select(rung).first()[0]
        if mode != "fused":
            return Scored(cold.withColumn("score", F.col("cold")), strategy, mode, 0.0, alike, known)
        liked = cold.join(known.withColumn("_one", F.lit(1)), "item", "left").withColumn("_one", F.coalesce("_one", F.lit(0)))
        personal = taste.probe_scores(liked, "item", "vector", "_one", [1], linear=True).select("item", F.col("p").alias("_p"))
        both = cold.join(ranks.z_score(personal, "_p", "personal").drop("_p"), "item", "left").withColumn("personal", F.coalesce("personal", F.lit(0.0)))
        weight = self.spark.range(1).select(ranks.fusion_weight(F.lit(n), c.min_labels, c.full_labels, *c.weight)).first()[0]
        return Scored(stored(both.withColumn("score", F.col("cold") * (1 - weight) + F.col("personal") * weight)), strategy, mode, weight, alike, known)

    def families(self) -> DataFrame:
        """(item, family) by leader groups at the data's own threshold."""
        t = similarity.threshold(self.items, "item", "vector", self.config.percentile, self.config.floor)
        return similarity.vector_groups(self.items, "item", "vector", t).withColumnRenamed("leader", "family")

    def rank(self, judge: Judge | None = None, labels: DataFrame | None = None) -> DataFrame:
        """(item, family, seg, score, within_rank, ord) and whether the family was rejected.

        Without the second stage nobody plays: the order is that of the scores, and labelled items come first if they were used.
        """
        scored = self.scored(labels)
        f = stored(scored.items.select("item", "score").join(self.families(), "item"))
        if self.config.stage2:
            said = (judge or LocalJudge()).table(f)
            t = stored(tournament.tournaments(f, "family", "item", "score", said, self.config.arena))
            r = f.join(tournament.places(f, t, "family", "item", "score"), ["family", "item"])
        else:
            r = f.withColumns({"within_rank": F.lit(0), "rejected": F.lit(False)})
        r = numbered_in(r, [], [F.col("item")], "seq", "n")
        r = r.withColumn("seg", ranks.segment(F.col("seq"), F.col("n"), self.config.segments))
        if self.config.stage2:
            return selection.champions_first(r, "within_rank", "score", "item").drop("seq", "n")
        pins = r.join(scored.pinned.withColumn("_pin", F.lit(0)), "item", "left").withColumn("_pin", F.coalesce("_pin", F.lit(1)))
        return numbered(pins, [F.col("_pin"), F.desc("score"), F.col("item")], "ord").drop("_pin", "seq", "n")

    def select(self, ranked: DataFrame) -> DataFrame:
        """The delivered list; rejected families stay in the pool and are not delivered."""
        c = self.config
        ok = ranked.where(~F.col("rejected"))
        if not c.segments:
            return selection.top_with_cap(ok, "family", [F.col("ord")], c.target, c.family_cap)
        return selection.spread_selection(ok, "item", "family", "seg", "ord", c.target, c.family_cap, c.segments)

    def contests(self, ranked: DataFrame, picked: DataFrame) -> DataFrame:
        ok = ranked.where(~F.col("rejected"))
        return selection.contests(ok, picked, "item", "family", "seg", "ord", "score", self.config.family_cap)

    def explain(self, ranked: DataFrame, picked: DataFrame, around: int = 3) -> DataFrame:
        """The last picks and the first left out."""
        last = picked.orderBy(F.desc("ord")).limit(around).select("item", F.lit(True).alias("selected"))
        rest = ranked.join(picked.select("item"), "item", "left_anti").orderBy("ord").limit(around)
        return last.unionByName(rest.select("item", F.lit(False).alias("selected")))

    def preview(self, ranked: DataFrame, names: list[int]) -> DataFrame:
        """The rows of some items by name, with whether each is delivered; unknown names have no row."""
        picked = self.select(ranked).select("item", F.lit(True).alias("selected"))
        some = ranked.where(F.col("item").isin(names))
        return some.join(picked, "item", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))

    def export(self, ranked: DataFrame, picked: DataFrame) -> DataFrame:
        """(item, family, ord, kind): the delivered list, and the best item of every family that is not in it as runner-up."""
        rest = selection.runner_ups(ranked.where(~F.col("rejected")), "family", "score", "item", picked).select("item")
        named = picked.select("item", F.lit("selected").alias("kind")).unionByName(rest.withColumn("kind", F.lit("runner-up")))
        return ranked.select("item", "family", "ord").join(named, "item")

    def evaluate(self, ranked: DataFrame, gold: DataFrame, k: int = 20, delivered: DataFrame | None = None) -> DataFrame:
        """The report of a ranking against gold items, with the delivered list apart if it is given; see ``statistics.report``."""
        g = stored(self._with_gold(ranked, gold))
        return statistics.report(g, "ord", "score", "gold", k, None if delivered is None else g.join(delivered.select("item"), "item", "left_semi"))

    def hits(self, ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
        """(k, hits, lift) of the ranking against gold items."""
        return statistics.hits(self._with_gold(ranked, gold), "ord", "gold", list(ks))

    @staticmethod
    def _with_gold(ranked: DataFrame, gold: DataFrame) -> DataFrame:
        marked = gold.select("item").distinct().withColumn("gold", F.lit(True))
        return ranked.join(marked, "item", "left").withColumn("gold", F.coalesce("gold", F.lit(False)))

    def curve(self, gold: DataFrame, sizes: tuple[int, ...] = (3, 5, 10), splits: int = 200) -> DataFrame:
        """How well a probe finds the other gold items once some are labelled; see ``taste.holdout_curve``."""
        cold = self.scored().items.select("item", "vector", "score")
        return taste.holdout_curve(self._with_gold(cold, gold), "item", "vector", F.col("gold"), list(sizes), splits, baseline="score")
