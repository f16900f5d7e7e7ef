"""Run folders that break each rule once, read from files."""

import copy
import hashlib
import json

import pytest

from winnowry.operators import audits
from winnowry.sources import runs as R

PLAN = [{"segment": 0, "a": "a 1.jpg", "b": "b1.jpg"}, {"segment": 1, "a": "照.jpg", "b": "b2.jpg"}, {"segment": 2, "a": "a3.jpg", "b": "b3.jpg"}]
MD5 = hashlib.md5(json.dumps([[p["a"], p["b"]] for p in PLAN], separators=(",", ":")).encode()).hexdigest()
GOOD = {
    "run": {
        "config": {"stage3Vlm": True, "stage3RubricFile": "r.md", "stage3AnchorsFile": "a.json"},
        "stage3_inputs": {"rubric_md5": "right", "rubric_chars": 10},
        "stage2": {"status": "ran", "comparisons": 2, "preflights": 1, "anchor_photos_sent": 10, "anchor_jpegs_sent": 20},
        "stage3": {"status": "ran", "comparisons": 1, "preflights": 0, "anchor_photos_sent": 8, "anchor_jpegs_sent": 16, "plan_md5": MD5, "plan": PLAN, "note": {"missing": 0, "unused": 0}},
        "delivered_after_stage2": ["a 1.jpg", "照.jpg", "a3.jpg", "gold.jpg"], "delivered_final": ["b1.jpg", "照.jpg", "a3.jpg", "gold.jpg"], "started_at": "2026-09-17T23:51:00Z",
    },
    "calls": [{"stage": 2, "sent": True, "ok": True}, {"stage": 2, "sent": True, "ok": False}, {"stage": 2, "sent": True, "ok": True}, {"stage": 2, "sent": False}, {"stage": 3, "sent": True}],
    "v3": {"plan_md5": MD5, "plan": PLAN, "verdicts": [{"a": "b1.jpg", "b": "a 1.jpg", "winner": "a", "consistent": True}, {"a": "照.jpg", "b": "b2.jpg", "winner": "tie"}]},
}
A_GROUP = {("config", "stage3Vlm"): False, ("config", "stage3RubricFile"): None, ("config", "stage3AnchorsFile"): None, ("stage3", "status"): "off", ("stage3_inputs",): None}
BROKEN = {
    "known group": {("config", "stage3RubricFile"): None}, "no inputs without a third stage": {**A_GROUP, ("stage3_inputs",): {"rubric_md5": "x"}}, "inputs recorded": {("stage3_inputs",): None},
    "rubric read": {("stage3_inputs", "rubric_md5"): "wrong"}, "anchors of stage 3": {("stage3", "anchor_photos_sent"): 7, ("stage3", "anchor_jpegs_sent"): 14},
    "no rubric read": {("config", "stage3RubricFile"): "", ("config", "stage3AnchorsFile"): "", ("stage3", "anchor_photos_sent"): 0, ("stage3", "anchor_jpegs_sent"): 0},
    "anchors of stage 2": {("stage2", "anchor_photos_sent"): 9, ("stage2", "anchor_jpegs_sent"): 18}, "stage 2 ran": {("stage2", "status"): "failed", ("stage2", "error"): "broke。he looks like"},
    "stage 3 ran": {("stage3", "status"): "failed"}, "stage 3 off": {**A_GROUP, ("stage3", "status"): "ran"}, "all matches judged": {("stage3", "note", "missing"): 1}, "all verdicts planned": {("stage3", "note", "unused"): 2},
    "calls of stage 2": {("stage2", "preflights"): 0}, "calls of stage 3": {("stage3", "comparisons"): 2}, "images of stage 2": {("stage2", "anchor_jpegs_sent"): 19}, "images of stage 3": {("stage3", "anchor_jpegs_sent"): 15},
}


def changed(run, steps):
    run = copy.deepcopy(run)
    for path, value in steps.items():
        at = run
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
    return run


def write(folder, run, calls, v3):
    folder.mkdir(parents=True)
    (folder / "run.json").write_text(json.dumps(run, ensure_ascii=False))
    if calls is not None:
        (folder / "calls.jsonl").write_text("\n".join(map(json.dumps, calls)) + '\n{"stage": 3, "se')  # a half-written line
    if v3 is not None:
        (folder / "stage3-verdicts.json").write_text(json.dumps(v3, indent=1))


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    write(root / "day 1" / "good", GOOD["run"], GOOD["calls"], GOOD["v3"])
    write(root / "day 2" / "good", changed(GOOD["run"], A_GROUP), GOOD["calls"], None)
    for name, steps in BROKEN.items():
        write(root / "broken" / name, changed(GOOD["run"], steps), GOOD["calls"], None)
    bad_plan = changed(GOOD["run"], {("stage3", "plan"): PLAN[::-1]})
    write(root / "broken" / "plan hash", bad_plan, GOOD["calls"], {**GOOD["v3"], "plan": PLAN[::-1]})
    write(root / "broken" / "hash of the verdicts", GOOD["run"], GOOD["calls"], {**GOOD["v3"], "plan_md5": "0"})
    write(root / "broken" / "plan of the verdicts", GOOD["run"], GOOD["calls"], {**GOOD["v3"], "plan": PLAN[:2]})
    write(root / "bare", {"config": {}, "stage2": {"status": "off"}, "stage3": {"status": "off"}}, None, None)
    return R.read_records(spark, str(root))


def test_each_rule_is_broken_once(records):
    checked = audits.checks(records.runs, records.calls, records.verdicts, audits.Expected("right"))
    void = {r["run"]: (r["group"], r["void"]) for r in audits.void_reasons(checked).collect()}
    assert void["day 1/good"] == ("B3", []) and void["day 2/good"] == ("A", []) and void["bare"] == ("A", ["stage 2 ran"])
    expected = {"known group": (None, ["known group"]), "no rubric read": ("B1", ["no rubric read"])}
    for name in [*BROKEN, "plan hash", "hash of the verdicts", "plan of the verdicts"]:
        group, why = void[f"broken/{name}"]
        assert (group, why) == expected.get(name, ("A" if name in ("no inputs without a third stage", "stage 3 off") else "B3", [name])), name
    detail = {(r["run"], r["check"]): r["detail"] for r in checked.collect()}
    assert detail["broken/stage 2 ran", "stage 2 ran"] == "failed broke"


def test_costs_of_void_runs_are_apart(records):
    checked = audits.checks(records.runs, records.calls, records.verdicts, audits.Expected("right"))
    got = {(r["group"], r["valid"]): (r["runs"], r["sent"], r["failed"]) for r in audits.costs(audits.void_reasons(checked), records.calls).collect()}
    assert got["B3", True] == (1, 4, 1) and got["A", True] == (1, 4, 1) and got["A", False] == (3, 8, 2) and got[None, False] == (1, 4, 1)


def test_scores_of_a_run(spark, records):
    gold = spark.createDataFrame([("b1.jpg",), ("gold.jpg",), ("照.jpg",), ("elsewhere.jpg",)], "item string")
    got = {r["run"]: r.asDict() for r in audits.scores(records.runs, records.verdicts, gold).collect()}
    want = {
        "overlap2": 2, "overlap3": 3, "net": 1, "contests": 3, "swaps": 1, "consistent": 1, "up": 1, "down": 1, "right": 1, "wrong": 0, "neither": 0, "unstated": 1, "unjudged": 0, "reach_low": 1, "reach_high": 3,
    }
    assert got["day 1/good"] == {"run": "day 1/good", **want}  # the first verdict is written the other way round
    assert got["bare"] == {"run": "bare", **dict.fromkeys(want, 0)}
    assert got["broken/images of stage 2"]["unjudged"] == 2
