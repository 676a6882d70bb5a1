"""Thresholds, composites and verdicts over a long table of answers: doc_id, question_id, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V

QUESTIONS = "preset string, question_id string, type string, label string, weight double, min_threshold double, max_threshold double, preflight string, advisory boolean, criteria array<string>, q_ord int"


def questions(spark: SparkSession, preset: str | None = None, own: list[tuple] | None = None) -> DataFrame:
    """The question table of a preset (dash and underscore are the same), or of all; ``own`` adds or replaces rows by (preset, question)."""
    rows = {(r[0], r[1]): r for r in V.QUESTIONS} | {(r[0], r[1]): r for r in own or []}
    df = spark.createDataFrame([(*r[:10], i) for i, r in enumerate(rows.values())], QUESTIONS)
    return df if preset is None else df.where(F.replace(F.lower("preset"), F.lit("-"), F.lit("_")) == preset.lower().replace("-", "_"))


def normalised_score(score: Column, levels: Column | int) -> Column:
    levels = F.lit(levels) if isinstance(levels, int) else levels
    return F.least(F.greatest(score / F.greatest(levels - 1, F.lit(1)), F.lit(0.0)), F.lit(1.0))


def gated(answers: DataFrame, question: DataFrame) -> DataFrame:
    """Join the questions, which Spark broadcasts if they are small; add breach, level and near_threshold."""
    joined = answers.join(question, "question_id")
    v, low, high = F.col("value"), F.col("min_threshold"), F.col("max_threshold")
    breach = F.when(v < low, "below_min").when(v > high, "above_max")
    near = F.coalesce(F.abs(v - low) <= V.NEAR + V.EPSILON, F.lit(False)) | F.coalesce(F.abs(v - high) <= V.NEAR + V.EPSILON, F.lit(False))
    warn = F.col("advisory") | F.col("preset").isin(V.WARN_ONLY)
    return joined.withColumn("breach", breach).withColumn(
        "level", F.when(breach.isNotNull(), F.when(warn, "warning").otherwise("error"))
    ).withColumn("near_threshold", near)


def composite(gated_answers: DataFrame) -> DataFrame:
    """Weighted mean of the answered questions with a weight; null where there is none."""
    w = F.when(F.col("value").isNotNull() & (F.col("weight") > 0), F.col("weight"))
    return gated_answers.groupBy("doc_id").agg((F.sum(F.col("value") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("composite"))


def verdicts(gated_answers: DataFrame) -> DataFrame:
    return gated_answers.groupBy("doc_id").agg(
        F.count_if(F.col("level") == "error").alias("violations"), F.count_if(F.col("level") == "warning").alias("warnings"),
        (F.count_if(F.col("level") == "error") == 0).alias("passed")
    )


def violations(gated_answers: DataFrame) -> DataFrame:
    """(doc_id, rule, source) of all breaches: those over a maximum (1) and those under a minimum (2)."""
    of = lambda breach, n: gated_answers.where(F.col("breach") == breach).select(
        "doc_id", F.col("question_id").alias("rule"), F.lit(n).alias("source")
    )
    return of("above_max", 1).unionByName(of("below_min", 2))


def overridden(answers: DataFrame, counters: DataFrame) -> DataFrame:
    """Preflight: found credentials force has_secrets to 1, found free mail forces has_pii to 1."""
    found = answers.join(
        counters.select(
            "doc_id", "credentials", F.coalesce(F.try_element_at("by_type", F.lit("email_free_mail")), F.lit(0)).alias("free_mail")
        ),
        "doc_id", "left"
    )
    by = F.when(
        (F.col("question_id") == "has_secrets") & (F.col("credentials") > 0), "credentials"
    ).when((F.col("question_id") == "has_pii") & (F.col("free_mail") > 0), "pii")
    return found.withColumn("overridden_by", by).withColumn("value", F.when(by.isNotNull(), 1.0).otherwise(F.col("value"))).drop("credentials", "free_mail")


def exit_code(violations: Column, errors: Column) -> Column:
    return F.when(violations > 0, 1).when(errors > 0, 3).otherwise(0)
