from __future__ import annotations

import math
import random

import pytest

from plumbline.operators import baseline, gate, stats, validate


def test_thresholds_near_and_composite(spark):
    q = gate.questions(
        spark,
        own=[
            ("own", "a", "noul", "A", 2.0, 0.5, None, None, False, []), ("own", "b", "noul", "B", 1.0, None, 0.3, None, True, []),
            ("own", "c", "noul", "C", None, None, None, None, False, [])
        ]
    ).where("preset = 'own'")
    answers = spark.createDataFrame(
        [(1, "a", 0.5), (1, "b", 0.3), (1, "c", 0.9), (2, "a", 0.4999), (2, "b", 0.31), (3, "a", None), (3, "b", 0.41)],
        "doc_id long, question_id string, value double"
    )
    g = gate.gated(answers, q).cache()
    got = {(r.doc_id, r.question_id): (r.breach, r.level, r.near_threshold) for r in g.collect()}
    assert got[1, "a"] == (None, None, True) and got[1, "b"] == (None, None, True) and got[1, "c"] == (None, None, False)
    assert got[2, "a"] == ("below_min", "error", True) and got[2, "b"] == ("above_max", "warning", True)
    assert got[3, "a"] == (None, None, False) and got[3, "b"][2] is False
    c = {r.doc_id: r.composite for r in gate.composite(g).collect()}
    assert abs(c[1] - (0.5 * 2 + 0.3) / 3) < 1e-12 and c[3] == 0.41
    v = {r.doc_id: (r.violations, r.warnings, r.passed) for r in gate.verdicts(g).collect()}
    assert v == {1: (0, 0, True), 2: (1, 1, False), 3: (0, 1, True)}


def test_presets(spark):
    assert gate.questions(spark, "Design-Doc").count() == 10 and gate.questions(spark, "tech_spec").count() == 2
    assert gate.questions(spark).count() == 23


def test_intervals(spark):
    rows = [("one", 0.25), ("two", 0.1), ("two", 0.3)] + [("many", x / 10) for x in range(35)]
    got = {r.k: r for r in stats.mean_ci(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert (got["one"].low, got["one"].high) == (0.25, 0.25)
    sd = math.sqrt(0.02)
    assert abs(got["two"].high - (0.2 + 12.706 * sd / math.sqrt(2))) < 1e-9
    many = [x / 10 for x in range(35)]
    m = sum(many) / 35
    s = math.sqrt(sum((x - m) ** 2 for x in many) / 34)
    assert abs(got["many"].low - (m - 2.042 * s / math.sqrt(35))) < 1e-9


def test_auc_against_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), round(rng.random(), 1), rng.random() < 0.4) for _ in range(200)] + [("z", 0.5, True)]
    got = {r.g: r.auc for r in stats.roc_auc(spark.createDataFrame(rows, "g string, s double, p boolean"), ["g"], "s", "p").collect()}
    for g in "xy":
        pos, neg = ([s for k, s, p in rows if k == g and p is side] for side in (True, False))
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert abs(got[g] - want) < 6e-5
    assert got["z"] == 0.5
    assert stats.roc_auc(spark.createDataFrame(rows, "g string, s double, p boolean"), [], "s", "p").count() == 1


PAIRS = "pair_id long, question_id string, kind string, doc_id string, before_path string, after_path string, expected string, n int, mean_delta double, low double, high double, incomplete boolean, was_truncated boolean, guard_ok boolean"


def pair_rows(spark, rows):
    """rows: id, kind, expected, mean, low, high, then whether it is incomplete or cut."""
    full = [
        (i, "q", kind, None, f"b/{i}.md", f"a/{i}.md", expected, 3, mean, low, high, *((*flags, False, False)[:2]), True) for i, kind,
        expected, mean, low, high, *flags in rows
    ]
    return spark.createDataFrame(full, PAIRS)


def test_groups_bounds_are_strict_and_small_groups_have_no_verdict(spark):
    rows = [(i, "k0", "down", 0.0, 0.0, 0.0) for i in range(8)] + [(10 + i, "k1", "down", -0.2 - i / 1000, -0.3, -0.1) for i in range(8)]
    rows += [
        (20 + i, "k2", "neutral", 0.05, 0.05, 0.05) for i in range(8)
    ] + [(30 + i, "k3", "down", -0.5, -0.5, -0.5) for i in range(5)] + [(40, None, "down", -0.1, -0.1, -0.1)]
    pairs = pair_rows(spark, rows)
    ci = validate.Criteria(group_by="kind", degradation_ci_upper_max=0.0, neutral_ci_abs_max=0.05)
    g = {r.kind: r for r in validate.groups(pairs, ci).collect()}
    assert {k: r.passed for k, r in g.items()} == {"k0": False, "k1": True, "k2": True, "k3": None, "default": None}
    assert g["k1"].worst_pair == "b/10.md → a/10.md" and g["k1"].n == 8
    only = validate.Criteria(group_by="kind", degradation_ci_upper_max=0.0, report_only_kinds=("k1",))
    assert {r.kind: r.passed for r in validate.groups(pairs, only).collect()}["k1"] is None
    assert {
        r.kind: r.passed for r in validate.groups(
            pairs, validate.Criteria(group_by="kind", min_degradation_drop=0.3, min_group_size=5)
        ).collect()
    } == {"k0": False, "k1": False, "k2": True, "k3": True, "default": None}
    assert {r.kind: r.pair_id for r in validate.worst_pairs(pairs).collect()} == {"k0": 0, "k1": 10, "k2": 20, "k3": 30, None: 40}


def test_pairs_by_themselves_and_per_pair_kinds(spark):
    rows = [
        (1, "a", "down", -0.2, -0.3, -0.1), (2, "a", "down", -0.2, -0.3, 0.0), (3, "b", "neutral", 0.01, -0.06, 0.08),
        (4, "a", "down", -0.2, -0.3, -0.1, True), (5, "a", "down", -0.2, -0.3, -0.1, False, True)
    ]
    pairs = pair_rows(spark, rows)
    c = validate.Criteria(degradation_ci_upper_max=0.0, neutral_ci_abs_max=0.05)
    got = {r.worst_pair: r.passed for r in validate.groups(pairs, c).collect()}
    assert got == {"b/1.md → a/1.md": True, "b/2.md → a/2.md": False, "b/3.md → a/3.md": False, "b/4.md → a/4.md": None, "b/5.md → a/5.md": None}
    mixed = validate.Criteria(group_by="kind", degradation_ci_upper_max=0.0, per_pair_kinds=("a",), min_group_size=1)
    rows = validate.groups(pairs, mixed).collect()
    assert sorted((r.kind, r.n, r.passed) for r in rows if r.passed is not None) == [("a", 3, False), ("a", 3, True), ("b", 1, True)]


STATS = "question_id string, detected long, n_absent long, false_alarms long, n_present long, max_spread double"


def test_criteria_of_empty_and_full_populations(spark):
    every = validate.Criteria(
        min_detected=0.9, max_false_alarms=0, max_neutral_delta=0.05, min_degradation_drop=0.1, max_spread=0.1,
        degradation_ci_upper_max=0.0, neutral_ci_abs_max=0.05, pair_guard_neutral_abs_max=0.05
    )
    none = pair_rows(spark, [])
    empty = spark.createDataFrame([], STATS)
    got = {r.criterion: r.passed for r in validate.criteria_rows(empty, none, validate.groups(none, every), every).collect()}
    assert got == {
        "min_detected (rate)": False, "max_false_alarms": True, "max_neutral_delta": False, "min_degradation_drop": False,
        "degradation_ci_upper_max": False, "neutral_ci_abs_max": False, "pair_guard_neutral_abs_max": False, "max_spread": True
    }
    pairs = pair_rows(
        spark,
        [(i, "d", "down", 0.01 * i, -0.1, 0.2) for i in range(1, 6)] + [
            (9, "n", "neutral", 0.02, 0.0, 0.04), (8, "r", "neutral", 0.9, 0.8, 1.0)
        ]
    )
    c = validate.Criteria(min_detected=2, pair_guard_neutral_abs_max=0.05, report_only_kinds=("r",), group_by="kind", neutral_ci_abs_max=0.05)
    full = spark.createDataFrame([("q", 3, 4, 0, 1, 0.02)], STATS)
    groups = validate.groups(pairs, c)
    rows = {r.criterion: r for r in validate.criteria_rows(full, pairs, groups, c).collect()}
    assert rows["min_detected (count)"].passed and rows["min_detected (count)"].actual == "3/4"
    guard = rows["pair_guard_neutral_abs_max"]
    assert not guard.passed and guard.actual == "5 violations" and guard.note == "1.md (+0.010), 2.md (+0.020), 3.md (+0.030)"
    assert rows["neutral_ci_abs_max"].passed and rows["neutral_ci_abs_max"].actual == "no gating groups (all report-only or small)"
    assert not validate.all_passed(validate.criteria_rows(full, pairs, groups, c), groups, c)
    assert validate.criteria_rows(full, pairs, groups, validate.Criteria()).count() == 0
    assert validate.summary(empty).first().asDict() == {"detection_rate": 1.0, "false_alarm_rate": 0.0}
    for bad in ({"none": 1}, {"min_detect": 0.5}):
        with pytest.raises(ValueError):
            validate.Criteria.of(bad)


def test_pair_results_over_runs(spark):
    labels = spark.createDataFrame(
        [(1, "q", "down", "k", "d1", "b", "a", 3), (2, "q", "neutral", None, None, "b", "a", 2), (3, "q", "down", None, None, "b", "a", 2)],
        validate.PAIR_LABELS
    )
    side = "pair_id long, question_id string, run int, value double, was_truncated boolean"
    before = spark.createDataFrame([(1, "q", r, 0.8, False) for r in range(3)] + [(2, "q", 0, 0.5, True), (2, "q", 1, 0.5, False)], side)
    after = spark.createDataFrame(
        [(1, "q", 0, 0.7, False), (1, "q", 1, 0.5, False), (1, "q", 2, None, False), (2, "q", 0, 0.5, False), (2, "q", 1, 0.6, False)], side
    )
    got = {r.pair_id: r for r in validate.pair_results(labels, before, after).collect()}
    assert (got[1].n, got[1].incomplete, got[1].lost_runs, got[1].was_truncated, got[1].guard_ok) == (2, True, 1, False, True)
    assert abs(got[1].mean_delta + 0.2) < 1e-12 and abs(got[1].high - (-0.2 + 12.706 * math.sqrt(0.02) / math.sqrt(2))) < 1e-9
    assert (got[2].was_truncated, got[2].incomplete, got[2].guard_ok) == (True, False, True)
    assert (got[3].n, got[3].mean_delta, got[3].incomplete) == (0, 0.0, True)


def test_quantiles_and_noise_levels(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("xy"), round(rng.random(), 2)) for _ in range(3000)] + [("a", "z", None)]
    df = spark.createDataFrame(rows, "g string, h string, diff double")
    for share in (0.5, 0.99, 0.0, 1.0):
        got = {r.g: r.q for r in stats.quantiles(df, ["g"], "diff", share, "q").collect()}
        for g in "ab":
            values = sorted(v for k, _, v in rows if k == g and v is not None)
            rank = share * (len(values) - 1)
            low = values[math.floor(rank)]
            assert abs(got[g] - (low + (values[math.ceil(rank)] - low) * (rank - math.floor(rank)))) < 1e-9
    levels = stats.noise_stats(df.where("diff is not null"), ["g", "h"]).collect()
    assert sorted((r.g or "", r.h or "") for r in levels) == [("", ""), ("a", ""), ("a", "x"), ("a", "y"), ("b", ""), ("b", "x"), ("b", "y")]
    assert stats.quantiles(df.where("false"), [], "diff", 0.5, "q").count() == 0


def test_baseline_cascade(spark):
    cur = spark.createDataFrame([("a/x.md",), ("./b.md",), ("c/d.md",), ("new.md",), ("amb.md",)], "path string")
    prev = spark.createDataFrame([("a/x.md",), ("b.md",), ("repo/c/d.md",), ("u/amb.md",), ("v/amb.md",)], "path string")
    got = {r.path: (r.previous_path, r.how) for r in baseline.matched(cur, prev).collect()}
    assert got == {
        "a/x.md": ("a/x.md", "exact"), "./b.md": ("b.md", "normalised"), "c/d.md": ("repo/c/d.md", "suffix"), "new.md": (None, "new"),
        "amb.md": (None, "new")
    }
    q = spark.createDataFrame([("r", 0.5, None), ("g", None, 0.3)], "question_id string, max_threshold double, max_drop double")
    rows = lambda a, b: spark.createDataFrame([(1, "r", a), (1, "g", b)], "doc_id long, question_id string, value double")
    got = {r.question_id: r.regressed for r in baseline.diff(rows(0.75, 0.25), rows(0.5, 0.5), q).collect()}
    assert got == {"r": True, "g": False}


def test_baseline_resolved_and_truncation_and_messages(spark):
    cur = spark.createDataFrame(
        [("docs/../a.md", "a.md", {"r": 0.5, "g": 0.5}, False, [], [], True), ("n.md", "n.md", {"g": 0.1}, True, ["x"], [], False)],
        "path string, filename string, answers map<string,double>, was_truncated boolean, violations array<string>, warnings array<string>, passed boolean"
    )
    prev = spark.createDataFrame([("/w/a.md", {"r": 0.2, "g": 0.9}, True)], "path string, answers map<string,double>, was_truncated boolean")
    got = {r.path: (r.previous_path, r.how) for r in baseline.matched(cur, prev, "/w").collect()}
    assert got == {"docs/../a.md": ("/w/a.md", "resolved"), "n.md": (None, "new")}
    rows = [("own", "r", "noul", "R", None, None, 0.3, None, False, []), ("own", "g", "noul", "G", None, 0.5, None, None, True, [])]
    r = {x.path: x for x in baseline.compared(cur, prev, rows, root="/w").collect()}
    a = r["docs/../a.md"]
    assert a.violations == ["Baseline risk rise: 'r' rose by 0.30 (prev: 0.20, curr: 0.50, max allowed rise: 0.10)"] and not a.passed
    assert a.warnings == ["Baseline drop: 'g' dropped by 0.40 (prev: 0.90, curr: 0.50, max allowed drop: 0.10) (warning)"]
    assert (a.baseline.status, a.baseline.truncation_mismatch, len(a.baseline.questions)) == ("compared", True, 2)
    assert r["n.md"].baseline.status == "new" and r["n.md"].violations == ["x"] and r["n.md"].baseline.truncation_mismatch is None
    same = spark.createDataFrame([("a.md", "a.md", True)], "path string, filename string, was_truncated boolean")
    assert baseline.truncation_mismatch(same.withColumn("was_truncated", ~same["was_truncated"]), same).first().message.startswith(
        "Truncation status differs for a.md (baseline was_truncated=True, current was_truncated=False)"
    )
    assert baseline.truncation_mismatch(same, same).count() == 0
