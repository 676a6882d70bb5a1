"""Comparison with the answers of an earlier report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.features import normalised_path


def resolved(path: Column, root: str) -> Column:
    """The absolute path below ``root``, without . and .. parts."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    )
    return F.concat(F.lit("/"), F.array_join(up, "/"))


def matched(current: DataFrame, previous: DataFrame, root: str | None = None) -> DataFrame:
    """(path, previous_path, how) of every current path.

    Exact first; with ``root`` then the same absolute path; then equal after normalisation, if unique; then one path being the end of the
    other, if unique. Paths that are several times equal after normalisation do not fall through. The suffix search joins on the base
    name, so it is an equi-join.
    """
    cur = current.select("path").distinct().withColumns({"norm": normalised_path(F.col("path")), "base": F.element_at(F.split("path", "/"), -1)})
    prev = previous.select(F.col("path").alias("previous_path")).distinct().withColumns(
        {"pnorm": normalised_path(F.col("previous_path")), "pbase": F.element_at(F.split("previous_path", "/"), -1)}
    )
    exact = cur.join(prev, cur["path"] == prev["previous_path"]).select("path", "previous_path", F.lit("exact").alias("how"))
    if root is not None:
        left = cur.join(exact, "path", "left_anti").select("path", resolved(F.col("path"), root).alias("_at"))
        right = prev.select("previous_path", resolved(F.col("previous_path"), root).alias("_at"))
        one = left.join(right, "_at").groupBy("path").agg(F.max("previous_path").alias("previous_path"))
        exact = exact.unionByName(one.withColumn("how", F.lit("resolved")))
    rest = cur.join(exact, "path", "left_anti")
    same = rest.join(prev, rest["norm"] == prev["pnorm"]).select("path", "previous_path").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path")))
    equal = same.where("n = 1").select("path", "previous_path", F.lit("normalised").alias("how"))
    rest = rest.join(same.select("path").distinct(), "path", "left_anti")
    ends = F.concat(F.lit("/"), F.col("norm")).endswith(
        F.concat(F.lit("/"), F.col("pnorm"))
    ) | F.concat(F.lit("/"), F.col("pnorm")).endswith(F.concat(F.lit("/"), F.col("norm")))
    near = rest.join(prev, (rest["base"] == prev["pbase"]) & ends).select("path", "previous_path").withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("path"))
    )
    suffix = near.where("n = 1").select("path", "previous_path", F.lit("suffix").alias("how"))
    found = exact.unionByName(equal).unionByName(suffix)
    return cur.select("path").join(found, "path", "left").withColumn("how", F.coalesce("how", F.lit("new")))


def diff(current: DataFrame, previous: DataFrame, question: DataFrame) -> DataFrame:
    """Per document and question: delta, and whether it is worse by more than the limit (strict). A question with a maximum is a risk."""
    prev = previous.select("doc_id", "question_id", F.col("value").alias("previous"))
    joined = current.select("doc_id", "question_id", F.col("value").alias("current")).join(prev, ["doc_id", "question_id"]).join(question, "question_id")
    limit = F.coalesce(F.col("max_drop"), F.lit(V.MAX_DROP)) if "max_drop" in question.columns else F.lit(V.MAX_DROP)
    worse = F.when(F.col("max_threshold").isNotNull(), F.col("current") - F.col("previous")).otherwise(F.col("previous") - F.col("current"))
    return joined.where("previous is not null and current is not null").select(
        "doc_id", "question_id", "previous", "current", (F.col("current") - F.col("previous")).alias("delta"),
        (worse > limit).alias("regressed")
    )


def truncation_mismatch(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, message) of matched documents of which one side was cut and the other not; both have path, filename and was_truncated."""
    prev = previous.select(F.col("path").alias("previous_path"), F.col("was_truncated").alias("_was"))
    both = matched(current, previous).where("previous_path is not null").join(
        current.select("path", "filename", "was_truncated"), "path"
    ).join(prev, "previous_path")
    word = lambda c: F.when(c, "True").otherwise("False")
    message = F.concat(
        F.lit("Truncation status differs for "), "filename", F.lit(" (baseline was_truncated="), word(F.col("_was")),
        F.lit(", current was_truncated="), word(F.col("was_truncated")), F.lit("). Scores may be shifted by truncation.")
    )
    return both.where(~F.col("_was").eqNullSafe(F.col("was_truncated"))).select("path", message.alias("message"))


def compared(results: DataFrame, previous: DataFrame, rows: list[tuple], root: str | None = None, max_drop: float = V.MAX_DROP) -> DataFrame:
    """Report rows (path, answers, violations, warnings, passed, was_truncated) against an earlier report: regressions become violations, or
    warnings for advisory questions. Adds ``baseline`` (status, filepath, truncation_mismatch, and the difference of each question).

    ``rows`` are the questions of the preset, in order; the last item of a row may be a mapping with ``max_drop``.
    """
    prev = previous.select(F.col("path").alias("_previous"), F.col("answers").alias("_answers"), F.col("was_truncated").alias("_cut"))
    joined = results.join(
        matched(results, previous, root).where("previous_path is not null").select("path", "previous_path"), "path", "left"
    ).join(prev, F.col("previous_path") == F.col("_previous"), "left")
    errors, warnings, diffs = [], [], []
    for row in rows:
        q, kind, high, advisory = row[1], row[2], row[6], row[8]
        if kind == "choice":
            continue
        limit = row[10].get("max_drop", max_drop) if len(row) > 10 and isinstance(row[10], dict) else max_drop
        now, then = F.try_element_at("answers", F.lit(q)), F.try_element_at("_answers", F.lit(q))
        worse = now - then if high is not None else then - now
        verb, what, allowed = ("rose", "risk rise", "rise") if high is not None else ("dropped", "drop", "drop")
        text = F.format_string(
            f"Baseline {what}: '{q}' {verb} by %.2f (prev: %.2f, curr: %.2f, max allowed {allowed}: {limit:.2f})" + (
                " (warning)" if advisory else ""
            ),
            worse, then, now
        )
        (warnings if advisory else errors).append(F.when(worse > limit, text))
        diffs.append(
            F.when(
                (now - then).isNotNull(),
                F.struct(
                    F.lit(q).alias("question_id"), then.alias("previous"), now.alias("current"), (now - then).alias("delta"),
                    F.lit(limit).alias("max_drop"), (worse > limit).alias("regressed")
                )
            )
        )
    listed = lambda cs: F.filter(F.array(*cs), lambda m: m.isNotNull()) if cs else F.array()
    texts = lambda cs: listed(cs).cast("array<string>")
    known = F.col("_previous").isNotNull()
    status = F.struct(
        F.when(known, "compared").otherwise("new").alias("status"), F.col("previous_path").alias("baseline_filepath"),
        F.when(known, ~F.col("_cut").eqNullSafe(F.col("was_truncated"))).alias("truncation_mismatch"), listed(diffs).alias("questions")
    )
    out = joined.withColumns({"_more": texts(errors), "baseline": status})
    out = out.withColumns(
        {
            "violations": F.concat("violations", "_more"), "warnings": F.concat("warnings", texts(warnings)),
            "passed": F.col("passed") & (F.size("_more") == 0)
        }
    )
    return out.select(*results.columns, "baseline")
