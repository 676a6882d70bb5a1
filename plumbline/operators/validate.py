"""Validation against labels: presence verdicts over runs, before/after pairs, groups, criteria and the report they make.

Tables, all keyed by ids so that nothing here is bound to files:

* answers: doc_id, question_id, run, value;
* labels: doc_id, question_id, expected (present or absent);
* pair labels: pair_id, question_id, expected (down or neutral), kind, doc_id, before_path, after_path, runs;
* sides of pairs: pair_id, question_id, run, value, was_truncated.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import mean_ci

PAIR_LABELS = "pair_id long, question_id string, expected string, kind string, doc_id string, before_path string, after_path string, runs int"


@dataclass(frozen=True)
class Criteria:
    """What a validation must reach; what is None is not checked."""

    min_detected: float | int | None = None
    max_false_alarms: int | None = None
    max_neutral_delta: float | None = None
    min_degradation_drop: float | None = None
    max_spread: float | None = None
    group_by: str = "pair"
    degradation_ci_upper_max: float | None = None
    neutral_ci_abs_max: float | None = None
    min_group_size: int = 6
    pair_guard_neutral_abs_max: float | None = None
    pair_guard_down_tolerance: float = 0.0
    report_only_kinds: tuple[str, ...] = ()
    per_pair_kinds: tuple[str, ...] = ()

    @classmethod
    def of(cls, given: dict | None) -> Criteria:
        """From a mapping; unknown keys are errors."""
        given = dict(given or {})
        if extra := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown criteria: {sorted(extra)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def absent(value: Column) -> Column:
    return F.when(F.col("max_threshold").isNotNull(), value <= F.col("max_threshold")).otherwise(value < F.coalesce(F.col("min_threshold"), F.lit(0.5)))


def raised(answers: DataFrame, found: DataFrame) -> DataFrame:
    """Where the scan decided (``found``: doc_id, question_id, run), the value is at least 1, also without an answer of the model."""
    marked = found.select("doc_id", "question_id", "run").distinct().withColumn("_found", F.lit(True))
    return answers.join(marked, ["doc_id", "question_id", "run"], "left").withColumn(
        "value", F.when(F.col("_found"), F.greatest(F.coalesce("value", F.lit(1.0)), F.lit(1.0))).otherwise(F.col("value"))
    ).drop("_found")


def lost_answers(answers: DataFrame, labels: DataFrame, runs: int) -> DataFrame:
    """(doc_id, question_id, run) that a label asks for and no run answered: runtime errors of the validation."""
    wanted = labels.select("doc_id", "question_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    return wanted.join(answers.where("value is not null"), ["doc_id", "question_id", "run"], "left_anti")


def presence(answers: DataFrame, labels: DataFrame, question: DataFrame) -> DataFrame:
    """Verdict of each label over the runs that answered it; a label without any answer has no row (see :func:`lost_answers`)."""
    joined = answers.where("value is not null").join(labels, ["doc_id", "question_id"]).join(
        question.select("question_id", "min_threshold", "max_threshold"), "question_id", "left"
    )
    g = joined.groupBy("doc_id", "question_id", "expected").agg(
        F.every(absent(F.col("value"))).alias("all_absent"), F.some(absent(F.col("value"))).alias("any_absent"),
        (F.max("value") - F.min("value")).alias("spread")
    )
    verdict = F.when(
        F.col("expected") == "absent", F.when(F.col("all_absent"), "detected").otherwise("missed")
    ).otherwise(F.when(F.col("any_absent"), "false_alarm").otherwise("correct_present"))
    return g.select("doc_id", "question_id", "expected", verdict.alias("verdict"), "spread")


def active() -> Column:
    """Pairs that count: every run has both sides, and no side was cut."""
    return ~F.col("incomplete") & ~F.col("was_truncated")


def _reported(criteria: Criteria) -> Column:
    return F.coalesce(F.col("kind").isin(list(criteria.report_only_kinds)), F.lit(False))


def pair_results(labels: DataFrame, before: DataFrame, after: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """One row a labelled pair: runs with both sides (n), mean delta with its interval over them, what is missing or cut, and the guard."""
    key = ["pair_id", "question_id", "run"]
    one = before.select(*key, F.col("value").alias("_b"), F.col("was_truncated").alias("_tb"))
    both = one.join(
        after.select(*key, F.col("value").alias("_a"), F.col("was_truncated").alias("_ta")), key, "full"
    ).withColumn("_delta", F.col("_a") - F.col("_b"))
    cut = both.groupBy("pair_id", "question_id").agg(F.max(F.coalesce("_tb", F.lit(False)) | F.coalesce("_ta", F.lit(False))).alias("was_truncated"))
    stats = mean_ci(both, ["pair_id", "question_id"], "_delta")
    rows = labels.join(stats, ["pair_id", "question_id"], "left").join(cut, ["pair_id", "question_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.coalesce("n", F.lit(0))
    neutral = next(x for x in (criteria.pair_guard_neutral_abs_max, criteria.max_neutral_delta, 0.05) if x is not None)
    guard = F.when(F.col("expected") == "down", zero("mean") <= criteria.pair_guard_down_tolerance).otherwise(F.abs(zero("mean")) <= neutral)
    return rows.select(
        *labels.columns, n.cast("int").alias("n"), zero("mean").alias("mean_delta"), zero("low").alias("low"), zero("high").alias("high"),
        (n < F.col("runs")).alias("incomplete"), (F.col("runs") - n).cast("int").alias("lost_runs"),
        F.coalesce("was_truncated", F.lit(False)).alias("was_truncated"), guard.alias("guard_ok")
    )


def gate(expected: Column, mean: Column, low: Column, high: Column, criteria: Criteria) -> Column:
    """Whether a mean and its interval are what is expected. The bound of degradations is strict, the others are not."""
    down = high < criteria.degradation_ci_upper_max if criteria.degradation_ci_upper_max is not None else mean <= -criteria.min_degradation_drop if criteria.min_degradation_drop is not None else mean < 0
    largest = F.greatest(F.abs(low), F.abs(high))
    neutral = largest <= criteria.neutral_ci_abs_max if criteria.neutral_ci_abs_max is not None else F.abs(mean) <= (
        criteria.max_neutral_delta if criteria.max_neutral_delta is not None else 0.05
    )
    return F.when(expected == "down", down).otherwise(neutral)


def _name(both: bool = True) -> Column:
    path = F.concat("before_path", F.lit(" → "), "after_path") if both else F.col("after_path")
    return F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("["), "doc_id", F.lit("] "), path)).otherwise(path)


def worst_pairs(pairs: DataFrame) -> DataFrame:
    """Of each kind and question the pair with the largest mean delta (absolute for neutral) among those that count, or among all where none
    does; the smallest id on ties."""
    size = F.when(F.col("expected") == "down", F.col("mean_delta")).otherwise(F.abs("mean_delta"))
    picked = F.struct(active().alias("counts"), size.alias("size"), (-F.col("pair_id")).alias("low"), _name().alias("path"), F.col("mean_delta").alias("delta"))
    return pairs.groupBy("kind", "question_id").agg(F.max(picked).alias("w")).select(
        "kind", "question_id", (-F.col("w.low")).alias("pair_id"), F.col("w.path").alias("worst_pair"),
        F.col("w.delta").alias("worst_delta")
    )


def single_pairs(pairs: DataFrame, criteria: Criteria = Criteria(), whole_name: bool = True) -> DataFrame:
    """Each pair as a group of its own runs: verdict by the interval over them, none for pairs that do not count or are only reported."""
    passed = F.when(active() & ~_reported(criteria), gate(F.col("expected"), F.col("mean_delta"), F.col("low"), F.col("high"), criteria))
    name = _name(whole_name)
    kind = F.coalesce(F.col("kind"), name if whole_name else F.lit("pair"))
    return pairs.select(
        kind.alias("kind"), "question_id", "expected", F.col("n").cast("long").alias("n"), F.col("mean_delta").alias("mean"), "low", "high",
        passed.alias("passed"), name.alias("worst_pair"), F.col("mean_delta").alias("worst_delta")
    )


def groups(pairs: DataFrame, criteria: Criteria = Criteria(group_by="kind")) -> DataFrame:
    """Gate of the pairs: by kind and question on the interval of the pair means, or pair by pair; kinds listed as per-pair always so.

    A group smaller than ``min_group_size``, or of a kind that is only reported, has no verdict.
    """
    if criteria.group_by != "kind":
        return single_pairs(pairs, criteria)
    alone = F.coalesce(F.col("kind").isin(list(criteria.per_pair_kinds)), F.lit(False))
    regular = pairs.where(~alone).withColumn("kind", F.coalesce("kind", F.lit("default")))
    key = ["kind", "question_id"]
    expected = regular.groupBy(*key).agg(F.min_by("expected", "pair_id").alias("expected"))
    stats = mean_ci(regular.where(active()), key, "mean_delta")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    rows = expected.join(stats, key, "left").join(worst_pairs(regular).drop("pair_id"), key).select(
        *key, "expected", F.coalesce("n", F.lit(0)).alias("n"), zero("mean"), zero("low"), zero("high"), "worst_pair", "worst_delta"
    )
    passed = F.when(
        (F.col("n") >= max(1, criteria.min_group_size)) & ~_reported(criteria),
        gate(F.col("expected"), F.col("mean"), F.col("low"), F.col("high"), criteria)
    )
    rows = rows.select(*key, "expected", "n", "mean", "low", "high", passed.alias("passed"), "worst_pair", "worst_delta")
    return rows.unionByName(single_pairs(pairs.where(alone), criteria, whole_name=False)) if criteria.per_pair_kinds else rows


def question_stats(presence_rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Counts of verdicts of each question; with ``pairs`` also mean and interval over the means of those that count."""
    v = F.col("verdict")
    out = presence_rows.groupBy("question_id").agg(
        F.count_if(v == "detected").alias("detected"), F.count_if(F.col("expected") == "absent").alias("n_absent"),
        F.count_if(v == "false_alarm").alias("false_alarms"), F.count_if(F.col("expected") == "present").alias("n_present"),
        F.max("spread").alias("max_spread")
    )
    if pairs is None:
        return out
    every = pairs.select("question_id").distinct()
    means = every.join(mean_ci(pairs.where(active()), ["question_id"], "mean_delta"), "question_id", "left")
    means = means.select("question_id", F.coalesce("n", F.lit(0)).alias("pairs"), F.col("mean").alias("mean_delta"), "low", "high")
    zero = lambda c, to: F.coalesce(c, F.lit(to)).alias(c)
    counts = [zero(c, 0) for c in ("detected", "n_absent", "false_alarms", "n_present")]
    return out.join(means, "question_id", "full").select("question_id", *counts, zero("max_spread", 0.0), zero("pairs", 0), "mean_delta", "low", "high")


def summary(stats: DataFrame) -> DataFrame:
    """Rates over all questions: 1 detected and 0 false alarms where there is nothing to find."""
    s = stats.agg(*[F.sum(c).alias(c) for c in ("detected", "n_absent", "false_alarms", "n_present")])
    rate = lambda x, n, d: F.coalesce(F.col(x) / F.nullif(F.col(n), F.lit(0)), F.lit(d))
    return s.select(rate("detected", "n_absent", 1.0).alias("detection_rate"), rate("false_alarms", "n_present", 0.0).alias("false_alarm_rate"))


def criteria_rows(stats: DataFrame, pairs: DataFrame, group_rows: DataFrame, criteria: Criteria) -> DataFrame:
    """One row a criterion that is set: what it asks, what was found, whether it is met, and a note.

    An empty population fails the detection rate, the neutral and the drop check, the guard and the interval checks; it meets false alarms
    and spread. A population of which no group has a verdict meets the interval checks.
    """
    c = criteria
    counted = active() & ~_reported(c)
    neutral, down = F.col("expected") == "neutral", F.col("expected") == "down"
    s = stats.agg(
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("detected", "n_absent", "false_alarms", "n_present")],
        F.coalesce(F.max("max_spread"), F.lit(0.0)).alias("spread")
    )
    violates = counted & F.coalesce(
        (neutral & (F.abs("mean_delta") > c.pair_guard_neutral_abs_max)) | (down & (F.col("mean_delta") > c.pair_guard_down_tolerance)),
        F.lit(False)
    ) if c.pair_guard_neutral_abs_max is not None else F.lit(False)
    shown = F.concat(F.element_at(F.split("after_path", "/"), -1), F.lit(" ("), F.format_string("%+.3f", "mean_delta"), F.lit(")"))
    # The first three in order of id: a bounded number of rows, found apart so that no aggregate gathers all of them.
    first = pairs.where(violates).select("pair_id", "question_id", shown.alias("shown")).orderBy("pair_id", "question_id").limit(3)
    first = first.agg(
        F.concat_ws(
            ", ", F.transform(F.array_sort(F.collect_list(F.struct("pair_id", "question_id", "shown"))), lambda x: x["shown"])
        ).alias("shown")
    )
    p = pairs.agg(
        F.max(F.when(counted & neutral, F.abs("mean_delta"))).alias("neutral"),
        F.max(F.when(counted & down, F.col("mean_delta"))).alias("down"), F.count_if(counted).alias("active"),
        F.count_if(violates).alias("violations")
    )
    judged = F.col("passed").isNotNull()
    g = group_rows.agg(
        *[F.count_if(e).alias(f"{n}_groups") for n, e in (("down", down), ("neutral", neutral))],
        *[F.count_if(e & judged).alias(f"{n}_judged") for n, e in (("down", down), ("neutral", neutral))],
        *[F.count_if(e & (F.col("passed") == F.lit(False))).alias(f"{n}_failed") for n, e in (("down", down), ("neutral", neutral))],
        F.max(F.when(down & judged, F.col("high"))).alias("down_high"),
        F.max(F.when(neutral & judged, F.greatest(F.abs("low"), F.abs("high")))).alias("neutral_high"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    row = one(s).join(one(p), "_one").join(one(g), "_one").join(one(first), "_one")  # one row each
    text = lambda form, *cols: F.format_string(form, *cols)
    share = F.coalesce(F.col("detected") / F.nullif(F.col("n_absent"), F.lit(0)), F.lit(0.0))
    of = lambda a, b: text("%d/%d", a, b)
    out: list[tuple[str, str, Column, Column, Column]] = []
    if c.min_detected is not None:
        note = text("Detected %d/%d absent items", "detected", "n_absent")
        if isinstance(c.min_detected, float) and c.min_detected <= 1.0:
            out.append(
                (
                    "min_detected (rate)", f"{c.min_detected * 100:.0f}%", text("%.1f%% (%d/%d)", share * 100, "detected", "n_absent"),
                    share >= c.min_detected, note
                )
            )
        else:
            out.append(("min_detected (count)", f"{int(c.min_detected)}", of("detected", "n_absent"), F.col("detected") >= int(c.min_detected), note))
    if c.max_false_alarms is not None:
        out.append(
            (
                "max_false_alarms", f"{int(c.max_false_alarms)}", of("false_alarms", "n_present"),
                F.col("false_alarms") <= int(c.max_false_alarms), text("%d false alarms", "false_alarms")
            )
        )
    if c.max_neutral_delta is not None:
        actual = F.coalesce(text("%.3f", "neutral"), F.lit("no active neutral pairs"))
        out.append(
            (
                "max_neutral_delta", f"<= {c.max_neutral_delta:.3f}",
                F.when(F.col("neutral").isNull(), "no active neutral pairs").otherwise(actual),
                F.coalesce(F.col("neutral") <= c.max_neutral_delta, F.lit(False)), F.lit("largest change of a neutral pair")
            )
        )
    if c.min_degradation_drop is not None:
        actual = F.when(F.col("down").isNull(), "no active down pairs").otherwise(text("max delta %.3f", "down"))
        out.append(
            (
                "min_degradation_drop", f"<= -{c.min_degradation_drop:.3f}", actual,
                F.coalesce(F.col("down") <= -c.min_degradation_drop, F.lit(False)), F.lit("smallest drop of a degradation")
            )
        )
    for name, label, bound, form in (
        ("degradation_ci_upper_max", "down", c.degradation_ci_upper_max, "max CI upper %+.3f"),
        ("neutral_ci_abs_max", "neutral", c.neutral_ci_abs_max, "max CI abs %.3f")
    ):
        if bound is not None:
            n, judged_n, failed = F.col(f"{label}_groups"), F.col(f"{label}_judged"), F.col(f"{label}_failed")
            actual = F.when(n == 0, f"no {label} groups").when(
                judged_n == 0, "no gating groups (all report-only or small)"
            ).otherwise(text(form, f"{label}_high"))
            out.append(
                (
                    name, f"< {bound:+.3f}" if label == "down" else f"<= {bound:.3f}", actual, (n > 0) & (failed == 0),
                    text("%d of %d groups with a verdict fail", failed, judged_n)
                )
            )
    if c.pair_guard_neutral_abs_max is not None:
        many = F.col("violations") > 0
        out.append(
            (
                "pair_guard_neutral_abs_max", f"neutral <= {c.pair_guard_neutral_abs_max:.3f}, down <= {c.pair_guard_down_tolerance:.3f}",
                F.when(many, text("%d violations", "violations")).otherwise("all passed"), ~many & (F.col("active") > 0),
                F.when(many, F.col("shown")).otherwise("all pairs are within the guard")
            )
        )
    if c.max_spread is not None:
        out.append(
            (
                "max_spread", f"<= {c.max_spread:.3f}", text("%.3f", "spread"), F.col("spread") <= c.max_spread,
                text("largest spread of a label's runs: %.3f", "spread")
            )
        )
    if not out:
        return row.where("false").select(
            *[F.lit("").alias(x) for x in ("criterion", "required", "actual")], F.lit(True).alias("passed"), F.lit("").alias("note")
        )
    named = [
        F.struct(F.lit(n).alias("criterion"), F.lit(r).alias("required"), a.alias("actual"), ok.alias("passed"), note.alias("note")) for n,
        r, a, ok, note in out
    ]
    return row.select(F.inline(F.array(*named)))


def all_passed(criterion_rows: DataFrame, group_rows: DataFrame, criteria: Criteria) -> bool:
    """Every criterion is met and, where pairs are grouped by kind, no group fails."""
    if criterion_rows.where("not passed").limit(1).count():
        return False
    return criteria.group_by != "kind" or not group_rows.where("passed = false").limit(1).count()


def least_detected(labels: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, min_detected): how many of the absent labels of a split must be found, rounded up."""
    return labels.groupBy(*keys).agg(F.ceil(F.lit(share) * F.count_if(F.col("expected") == "absent")).cast("long").alias("min_detected"))


def unplaced_warning(message: Column) -> Column:
    """Warnings that something masked was found in none of a document's chunks."""
    return message.contains("not found in any") & message.contains("chunk")


def choice_distribution(choices: DataFrame) -> DataFrame:
    """choices: question_id, choice. Count and percentage of each choice of a question."""
    counts = choices.groupBy("question_id", "choice").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("question_id").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "question_id").select("question_id", "choice", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 4).alias("percent"))
