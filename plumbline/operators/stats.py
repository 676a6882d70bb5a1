"""Statistics of runs and pairs: confidence intervals, ROC-AUC, false alarms, spread and run noise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V


def t_critical(df: Column) -> Column:
    """The tabulated value of the next smaller degrees of freedom."""
    out = F.lit(V.T_NONE)
    for k in sorted(V.T_TABLE):
        out = F.when(df >= k, F.lit(V.T_TABLE[k])).otherwise(out)
    return out


def mean_ci(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, low, high of each group: 95 % interval of the mean; a single value is its own interval."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")
    )
    margin = F.when(F.col("n") > 1, t_critical(F.col("n") - 1) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return g.select(*keys, "n", "mean", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))


def cumulative(counts: DataFrame, keys: list[str], value: str, n: str, before: str, parts: int = 256) -> DataFrame:
    """Add ``before``: of rows (keys, value, count ``n``) with distinct values, the sum of ``n`` over the smaller values of the key.

    Values are dealt into ranges at their approximate quantiles: the sums of the ranges, few for each key, are added up first, and then the
    values within each range, so no task holds all values of a key.
    """
    cuts = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    dealt = counts.withColumn("_part", part)
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(n).alias("_n"))
    above = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_part", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_within", F.coalesce(F.sum(n).over(within), F.lit(0))).join(offsets, [*keys, "_part"])
    return out.withColumn(before, F.col("_offset") + F.col("_within")).drop("_part", "_offset", "_within")


def quantiles(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, name): the interpolated quantile of the non-null values of each key, exactly, over counts of distinct values."""
    rows = df.where(F.col(value).isNotNull()).withColumns({} if keys else {"_all": F.lit(0)})
    by = keys or ["_all"]
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = cumulative(counts, by, value, "_c", "_before").join(counts.groupBy(*by).agg(F.sum("_c").alias("_total")), by)
    rank = F.lit(share) * (F.col("_total") - 1)
    at = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")), F.col(value)))
    g = placed.groupBy(*by).agg(at(F.floor(rank)).alias("_low"), at(F.ceil(rank)).alias("_high"), F.max(rank - F.floor(rank)).alias("_part"))
    return g.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(name))


def roc_auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney AUC with averaged ranks of ties, rounded to 4; 0.5 if a side is empty.

    Distinct scores are counted first and ranked in ranges, so no window holds rows, nor all scores.
    """
    rows = df.withColumns({c: F.lit(0) for c in ["_all"] if not keys})
    keys_ = keys or ["_all"]
    counts = rows.groupBy(*keys_, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    ranked = cumulative(counts, keys_, score, "q", "below")
    out = ranked.groupBy(*keys_).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    auc = F.when((F.col("np") == 0) | (F.col("nq") == 0), 0.5).otherwise(F.round(F.col("u") / (F.col("np") * F.col("nq")), 4))
    return out.select(*keys, F.col("np").alias("n_positive"), F.col("nq").alias("n_negative"), auc.alias("auc"))


def noise_pairs(runs: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """Absolute differences of all pairs of runs of one key."""
    a = runs.select(*keys, F.col(run).alias("run_a"), F.col(value).alias("value_a"))
    b = runs.select(*keys, F.col(run).alias("run_b"), F.col(value).alias("value_b"))
    return a.join(b, keys).where("run_a < run_b").select(*keys, "run_a", "run_b", F.abs(F.col("value_a") - F.col("value_b")).alias("diff"))


def noise_stats(pairs: DataFrame, group: str | list[str]) -> DataFrame:
    """Count, mean, maximum and 99th percentile (interpolated) by all of the group's columns, by each shorter beginning of them, and overall;
    columns that a level does not have are null."""
    columns = [group] if isinstance(group, str) else list(group)
    levels = []
    for k in range(len(columns), -1, -1):
        keys = columns[:k]
        g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.max("diff").alias("max_diff"))
        p99 = quantiles(pairs, keys, "diff", 0.99, "p99")
        joined = g.join(p99, keys) if keys else g.withColumn("_one", F.lit(1)).join(p99.withColumn("_one", F.lit(1)), "_one")
        named = [F.col(c) if c in keys else F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in columns]
        levels.append(joined.select(*named, "n", "mean_diff", "max_diff", "p99"))
    return reduce(DataFrame.unionByName, levels)


def run_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median_value): the median over the runs of each document, which are few."""
    return df.groupBy(*keys).agg(F.median(value).alias("median_value"))


def spread_ratio(df: DataFrame, doc: str, value: str) -> DataFrame:
    """Mean difference against the standard deviation between documents, rounded to 2; null without spread."""
    means = df.groupBy(doc).agg(F.avg(value).alias("m"))
    g = means.agg(F.avg("m").alias("mean_value"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd"))
    ratio = F.round(F.abs("mean_value") / F.nullif(F.col("sd"), F.lit(0.0)), 2)
    return g.select("mean_value", "sd", ratio.alias("ratio"), F.coalesce(ratio >= 1.5, F.lit(False)).alias("clearly_larger"))


def feasibility(scores: DataFrame, keys: list[str], least_auc: float = 0.75, most_false_alarms: float = 0.10, spread: DataFrame | None = None) -> DataFrame:
    """Verdict from score pairs (is_holdout, better_score, worse_score) by ``keys``: threshold from the tuning pairs, the rest held out.

    The threshold is the median of the worse tuning scores (0.5 without any); a false alarm is a better held-out score at or under it. With
    ``spread`` (keys, clearly_larger; see :func:`spread_ratio`) the difference must also be clearly larger than that between documents.
    """
    rows = scores.withColumns({"_k": F.lit(0)} if not keys else {})
    by = keys or ["_k"]
    threshold = quantiles(rows.where(~F.col("is_holdout")), by, "worse_score", 0.5, "t")
    held = rows.where("is_holdout")
    long = held.select(*by, F.col("better_score").alias("s"), F.lit(True).alias("p")).unionByName(
        held.select(*by, F.col("worse_score").alias("s"), F.lit(False).alias("p"))
    )
    auc = roc_auc(long, by, "s", "p").select(*by, "auc")
    alarms = held.join(threshold, by, "left").groupBy(*by).agg(
        F.round(F.avg((F.col("better_score") <= F.coalesce("t", F.lit(0.5))).cast("double")), 4).alias("false_alarm_rate"),
        F.count(F.lit(1)).alias("n_held_out")
    )
    out = auc.join(alarms, by).withColumn("feasible", (F.col("auc") >= least_auc) & (F.col("false_alarm_rate") <= most_false_alarms))
    if spread is not None:
        wide = spread.withColumns({"_k": F.lit(0)} if not keys else {}).select(*by, "clearly_larger")
        out = out.join(wide, by, "left").withColumn("feasible", F.col("feasible") & F.coalesce("clearly_larger", F.lit(False)))
    return out.drop("_k")
