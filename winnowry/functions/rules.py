"""Rules over detections of one item: eligibility, saliency, and people or scenery by the first rule that holds.

Boxes are arrays [x, y, w, h] in shares of the picture, origin bottom left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import area, let, overlap

# Fixed values, as published with the rules.
CLOSED_EYES = 0.22
HEAD_DOWN_DEGREES = 12.0
EYE_PIXELS = 160
FACE_AREA, STRONG_FACE_AREA, FACE_QUALITY, FACE_SHARE, FACE_YAW = 0.008, 0.018, 0.25, 0.42, 1.45
HUMAN_CONFIDENCE, HUMAN_AREA, HUMAN_SHARE, NEAR_FACE_AREA, NEAR_FACE = 0.55, 0.10, 0.52, 0.05, 0.03
MASK_COVERAGE, MASK_OVERLAP = 0.006, 0.20
LANDSCAPE_AREA, LANDSCAPE_PEOPLE, SALIENT_COVER, SALIENT_CONCENTRATION = 0.018, 3, 0.50, 0.10
SILHOUETTE_RATIO, SILHOUETTE_SIDES = 1.35, (0.04, 0.96)
CENTRE_X, CENTRE_Y = (0.06, 0.94), (0.05, 0.95)


def eligibility(openness: Column, pitch: Column, face_pixels: Column) -> Column:
    """struct (eyes_measured, head_down, closed) from eye openness, pitch in radians and the face's longer side in pixels.

    All three are true or false: without a pitch the head is not down, and eyes are closed only if they were measured on
    a face of enough pixels; a head that is down lowers the eyes and never counts as closed.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    measured = sure(face_pixels >= EYE_PIXELS) & openness.isNotNull()
    down = sure(pitch > F.radians(F.lit(HEAD_DOWN_DEGREES)))
    closed = measured & sure(openness < CLOSED_EYES) & ~down
    return F.struct(measured.alias("eyes_measured"), down.alias("head_down"), closed.alias("closed"))


def technical_score(sharp: Column, sharpest: Column, contrast: Column, dark: Column, bright: Column, risks: Column) -> Column:
    """Sharpness against the group's sharpest (0.40), range of 255 (0.25), pixels not clipped (0.25), no risk (0.10); 0 without a sharpness."""
    relative = F.when(sharpest > 0, F.least(sharp / sharpest, F.lit(1.0)) * 0.40).otherwise(0.0)
    clean = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), dark + bright)) * 0.25
    return F.when(sharp.isNull(), 0.0).otherwise(relative + contrast / 255 * 0.25 + clean + F.when(F.size(risks) == 0, 0.10).otherwise(0.0))


def _box_area(b: Column) -> Column:
    return F.greatest(b[2], F.lit(0.0)) * F.greatest(b[3], F.lit(0.0))


def largest(regions: Column) -> Column:
    """The region (struct with a box) of the largest area, of equals the first; null for none."""
    more = lambda best, r: best.isNull() | (_box_area(r["box"]) > _box_area(best["box"]))
    return F.aggregate(F.slice(regions, 2, F.greatest(F.size(regions), F.lit(1))), F.get(regions, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def _share(of: Column, regions: Column) -> Column:
    total = F.aggregate(regions, F.lit(0.0), lambda s, r: s + _box_area(r["box"]))
    return F.when(total > 0, _box_area(of["box"]) / total).otherwise(0.0)


def saliency_support(person: Column, salient: Column) -> Column:
    """struct (person, salient): shares of both areas that a person's box and a salient box have in common, for the salient box of
    the largest product; of equal products the first counts, and boxes without an area or a common part never do."""
    kind = "struct<person:double,salient:double>"

    def shares(s: Column) -> Column:
        common = overlap(person, s)
        return F.struct((common / area(person)).alias("person"), (common / area(s)).alias("salient"))

    def better(best: Column, s: Column) -> Column:
        fair = (area(person) > 0) & (area(s) > 0)
        return F.when(~fair, best).otherwise(let(shares(s), lambda c: F.when(c["person"] * c["salient"] > best["person"] * best["salient"], c).otherwise(best)))

    none = F.struct(F.lit(0.0).alias("person"), F.lit(0.0).alias("salient")).cast(kind)
    return F.aggregate(salient, none, better)


def _mask_supports(box: Column, mask: Column, coverage: Column) -> Column:
    least = F.least(area(box), area(mask))
    # least and greatest pass over nulls, so a missing mask is asked for by name
    return F.coalesce(mask.isNotNull() & (coverage >= MASK_COVERAGE) & (least > 0) & (overlap(box, mask) / F.when(least > 0, least) >= MASK_OVERLAP), F.lit(False))


def classify(humans: Column, faces: Column, salient: Column, mask: Column, coverage: Column, instances: Column) -> Column:
    """struct (category, reason, confidence) of one picture by the first rule that holds.

    humans are structs (box, confidence), faces structs (box, yaw, quality), salient boxes; mask is the box of the person mask or null,
    coverage its share of the picture, instances its persons.  The rules: clear_portrait, the largest face is large, turned
    to us, and stands out; dominant_person, the largest sure human is; person_in_landscape, a smaller one that mask and
    saliency confirm; else scenery, with incidental_people or no_person.  Lists must not be null.
    """
    sure = F.filter(humans, lambda h: h["confidence"] >= HUMAN_CONFIDENCE)

    def portrait(face: Column) -> Column:
        size = _box_area(face["box"])
        good = F.coalesce(face["quality"] >= FACE_QUALITY, F.lit(True))
        wide = lambda b: F.array(b[0] - NEAR_FACE, b[1] - NEAR_FACE, b[2] + 2 * NEAR_FACE, b[3] + 2 * NEAR_FACE)
        held = F.exists(sure, lambda h: (_box_area(h["box"]) >= NEAR_FACE_AREA) & (overlap(wide(h["box"]), face["box"]) > 0))
        fair = (size >= FACE_AREA) & (F.abs(F.coalesce(face["yaw"], F.lit(0.0))) <= FACE_YAW) & (_share(face, faces) >= FACE_SHARE)
        return F.coalesce(fair & good & ((size >= STRONG_FACE_AREA) | held), F.lit(False))

    def portrait_confidence(face: Column) -> Column:
        return F.least(F.lit(0.98), 0.72 + F.least(F.lit(0.16), _box_area(face["box"]) * 2) + F.coalesce(face["quality"], F.lit(0.0)) * 0.10)

    def dominant(human: Column) -> Column:
        return F.coalesce((_box_area(human["box"]) >= HUMAN_AREA) & (_share(human, sure) >= HUMAN_SHARE) & _mask_supports(human["box"], mask, coverage), F.lit(False))

    # without a sure human the mask stands for one
    region = F.array(F.struct(mask.alias("box"), F.lit(0.65).alias("confidence")))
    shown = F.when((F.size(sure) == 0) & F.coalesce((mask[2] > 0) & (mask[3] > 0), F.lit(False)), region).otherwise(sure)

    def silhouette(b: Column) -> Column:
        shape = F.coalesce(b[3] / F.when(b[2] > 0, b[2]) >= SILHOUETTE_RATIO, F.lit(False))
        return instances.between(1, LANDSCAPE_PEOPLE) & shape & (b[0] >= SILHOUETTE_SIDES[0]) & (b[0] + b[2] <= SILHOUETTE_SIDES[1])

    def landscape(human: Column, support: Column, shown: Column) -> Column:
        b = human["box"]
        x, y = b[0] + b[2] / 2, b[1] + b[3] / 2
        return F.coalesce(
            (_box_area(b) >= LANDSCAPE_AREA) & (_share(human, shown) >= HUMAN_SHARE) & (F.greatest(F.size(shown), instances) <= LANDSCAPE_PEOPLE)
            & _mask_supports(b, mask, coverage) & (support["person"] >= SALIENT_COVER) & (support["salient"] >= SALIENT_CONCENTRATION)
            & ((F.size(humans) > 0) | silhouette(b)) & x.between(*CENTRE_X) & y.between(*CENTRE_Y), F.lit(False),
        )

    people = lambda reason, confidence: F.struct(F.lit("people").alias("category"), F.lit(reason).alias("reason"), confidence.alias("confidence"))
    seen = (F.size(sure) > 0) | (F.size(faces) > 0) | F.coalesce(coverage >= MASK_COVERAGE, F.lit(False))
    scenery = F.struct(
        F.lit("scenery").alias("category"), F.when(seen, "incidental_people").otherwise("no_person").alias("reason"), F.when(seen, 0.72).otherwise(0.92).alias("confidence")
    )

    def last(human: Column, shown: Column) -> Column:
        return let(
            saliency_support(human["box"], salient),
            lambda s: F.when(human.isNotNull() & landscape(human, s, shown), people("person_in_landscape", F.least(F.lit(0.90), 0.60 + coverage + s["person"] * 0.20))).otherwise(scenery),
        )

    face, human = largest(faces), largest(sure)
    return (
        F.when(portrait(face), people("clear_portrait", portrait_confidence(face)))
        .when(dominant(human), people("dominant_person", F.least(F.lit(0.96), 0.68 + _box_area(human["box"]))))
        .otherwise(let(shown, lambda s: let(largest(s), lambda h: last(h, s))))
    )
