"""Reports: JSON, Markdown, tables, CI annotations, validations; and a content-addressed cache of results."""

from __future__ import annotations

import hashlib
import json
import os
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_rows(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*[F.col(c) for c in results.columns])).alias("json"))


def annotations(violations: DataFrame) -> DataFrame:
    """One CI line a violation; missing line or column parts drop out."""
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), F.col(c).cast("string")))
    where = F.concat_ws(",", F.concat(F.lit("file="), F.col("path")), part("line", "line"), part("col", "column"))
    return violations.select(F.concat(F.lit("::"), F.col("level"), F.lit(" "), where, F.lit("::"), F.col("message")).alias("line"))


def pivoted(answers: DataFrame, ids: list[str]) -> DataFrame:
    """One column a question; the question ids are given, so no job runs to find them."""
    return answers.groupBy("doc_id").pivot("question_id", ids).agg(F.first("value"))


def markdown(answers: DataFrame, ids: list[str], limit: int | None = None) -> str:
    """A table for people; without ``limit`` rows come to the driver one partition at a time."""
    rows = pivoted(answers, ids).orderBy("doc_id")
    shown = (rows.limit(limit) if limit else rows).toLocalIterator()
    lines = ["| document | " + " | ".join(ids) + " |", "|" + "---|" * (len(ids) + 1)]
    return "\n".join([*lines, *("| " + " | ".join([str(r["doc_id"]), *[_two(r[i]) for i in ids]]) + " |" for r in shown)])


def _two(value: float | None) -> str:
    return "-" if value is None else f"{value:.2f}"


def json_lines(rows: DataFrame) -> Iterator[str]:
    """One JSON array, indented by two, text kept as it is; ``[]`` without rows. Rows come to the driver one partition at a time."""
    before = "["
    for r in json_rows(rows).toLocalIterator():
        yield before
        before = textwrap.indent(json.dumps(json.loads(r["json"]), indent=2, ensure_ascii=False), "  ") + ","
    yield "[]" if before == "[" else before[:-1]
    if before != "[":
        yield "]"


def _verdict(passed: bool | None) -> str:
    return "ERROR" if passed is None else "PASS" if passed else "FAIL"


def markdown_report(results: DataFrame, ids: list[str], warnings: list[str] = ()) -> Iterator[str]:
    """Documents with a column a question (~ marks a value near its threshold), then what is wrong with them, baselines and warnings."""
    yield "| document | verdict | composite | " + " | ".join(ids) + " |"
    yield "|" + "---|" * (len(ids) + 3)
    rows = results.orderBy("path")
    for r in rows.toLocalIterator():
        near = set(r["near_threshold"])
        cells = [(r["choices"] or {}).get(i) or (_two((r["answers"] or {}).get(i)) + (" ~" if i in near else "")) for i in ids]
        yield "| " + " | ".join([f"`{r['path']}`", _verdict(r["passed"]), _two(r["composite_score"]), *cells]) + " |"
    noted = rows.where((F.size("violations") > 0) | (F.size("warnings") > 0) | F.col("error").isNotNull())
    for r in noted.toLocalIterator():
        yield ""
        yield f"**`{r['path']}`**"
        yield from (f"- {m}" for m in [*r["violations"], *(f"(warning) {w}" for w in r["warnings"]), *([f"error: {r['error']}"] if r["error"] else [])])
    if "baseline" in results.columns:
        yield from ["", "| document | question | before | now | delta | limit | verdict |", "|---|---|---|---|---|---|---|"]
        for r in rows.select("path", "baseline").toLocalIterator():
            if r["baseline"]["status"] == "new":
                yield f"| `{r['path']}` | - | - | - | - | - | new |"
            for q in r["baseline"]["questions"]:
                yield f"| `{r['path']}` | {q['question_id']} | {q['previous']:.2f} | {q['current']:.2f} | {q['delta']:+.2f} | {q['max_drop']:.2f} | {'REGRESSED' if q['regressed'] else 'ok'} |"
    if warnings:
        yield ""
        yield from (f"- {w}" for w in warnings)


#: Terminal colours of a score: good from 0.75, middling from 0.50, else bad.
_BADGES = ((0.75, "32"), (0.50, "33"), (0.0, "31"))


def badge(value: float | None, colour: bool) -> str:
    if value is None or not colour:
        return _two(value)
    return f"\x1b[{next(c for least, c in _BADGES if value >= least or least == 0.0)}m{value:.2f}\x1b[0m"


def table_report(results: DataFrame, colour: bool = False) -> Iterator[str]:
    """One line a document with its composite, its answers and what is wrong; a sentence without documents."""
    none = True
    for r in results.orderBy("path").toLocalIterator():
        none = False
        near = set(r["near_threshold"])
        yield f"{_verdict(r['passed'])}  {r['path']}  {badge(r['composite_score'], colour)}  ({r['redactions_count']} redactions)"
        answers = [f"{q} {badge(v, colour)}{' ~' if q in near else ''}" for q, v in sorted((r["answers"] or {}).items())]
        if answers or r["choices"]:
            yield "      " + ", ".join([*answers, *(f"{q} {c}" for q, c in sorted((r["choices"] or {}).items()))])
        yield from (f"      {v}" for v in [*r["violations"], *(f"(warning) {w}" for w in r["warnings"]), *([f"error: {r['error']}"] if r["error"] else [])])
        if "baseline" in r:
            yield from (
                f"      {q['question_id']} {q['previous']:.2f} -> {q['current']:.2f} ({q['delta']:+.2f}){' REGRESSED' if q['regressed'] else ''}" for q in r["baseline"]["questions"]
            )
    if none:
        yield "No matching files."


@dataclass(frozen=True)
class Validation:
    """What a validation found; the tables are small but ``pairs``, which is only streamed."""

    preset: str
    runs: int
    mock: bool
    passed: bool | None
    stats: DataFrame
    groups: DataFrame
    pairs: DataFrame
    criteria: DataFrame
    choices: DataFrame
    summary: dict
    warnings: list[str]


def _status(passed: bool | None, mock: bool) -> str:
    return "N/A (MOCK)" if mock else "N/A" if passed is None else "PASS" if passed else "FAIL"


def _validation_tables(v: Validation) -> Iterator[tuple[str, list[str], Iterator[list[str]]]]:
    """(title, columns, rows) of the parts that have rows."""
    stats = v.stats.where("n_absent + n_present > 0").orderBy("question_id").collect()
    if stats:
        rate = lambda n, of, none: f"{n} ({n / of * 100:.0f}%)" if of else f"{n} ({none})"
        rows = (
            [
                s["question_id"], str(s["n_absent"]), rate(s["detected"], s["n_absent"], "N/A"), str(s["n_absent"] - s["detected"]),
                str(s["n_present"]), rate(s["false_alarms"], s["n_present"], "0%"), f"{s['max_spread']:.3f}"
            ] for s in stats
        )
        yield "Presence Questions (Noul)", ["Question", "Expected Absent", "Detected", "Missed", "Expected Present", "False Alarms", "Max Spread"], rows
    if v.pairs.limit(1).count():
        groups = v.groups.orderBy("kind", "question_id", "worst_pair").toLocalIterator()
        rows = (
            [
                g["kind"], g["question_id"], g["expected"], str(g["n"]), f"{g['mean']:+.3f}", f"[{g['low']:+.3f}, {g['high']:+.3f}]",
                _status(g["passed"], v.mock), f"{g['worst_pair']} ({g['worst_delta']:+.3f})"
            ] for g in groups
        )
        yield "Pair Groups (Direction & CI)", ["Group (Kind)", "Question", "Expected", "n", "Mean Δ", "95% CI", "Status", "Worst Pair"], rows

        def one(p) -> list[str]:
            name = lambda path: path.rsplit("/", 1)[-1]
            status = f"INCOMPLETE ({p['lost_runs']} lost)" if p["incomplete"] else "TRUNCATED" if p["was_truncated"] else _status(p["guard_ok"], False)
            return [
                f"{name(p['before_path'])} → {name(p['after_path'])}", p["question_id"], p["expected"], f"{p['mean_delta']:+.3f}",
                f"[{p['low']:.2f}, {p['high']:.2f}]", "N/A (MOCK)" if v.mock else status
            ]

        yield "Score Pairs (Direction & CI)", ["Pair", "Question", "Expected", "Mean Δ", "95% CI", "Status"], map(
            one, v.pairs.orderBy("pair_id", "question_id").toLocalIterator()
        )
    criteria = v.criteria.collect()
    if criteria:
        yield "Criteria Verification", ["Criterion", "Required", "Actual", "Status"], (
            [c["criterion"], c["required"], c["actual"], _status(c["passed"], v.mock)] for c in criteria
        )
    choices = v.choices.orderBy("question_id", "choice").collect()
    if choices:
        yield f"Choice Distributions (Non-gating, counts over {v.runs} run(s))", ["Question", "Choice", "Count", "Share"], (
            [c["question_id"], c["choice"], str(c["n"]), f"{c['percent']:.1f}%"] for c in choices
        )


def validation_markdown(v: Validation) -> Iterator[str]:
    yield "# Validation Report" + (" (MOCK)" if v.mock else "")
    yield ""
    yield f"**Preset:** `{v.preset}` | **Runs:** {v.runs} | **Verdict:** {_status(v.passed, v.mock)}"
    for title, columns, rows in _validation_tables(v):
        yield from ["", f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + " :---: |" * len(columns)]
        yield from ("| " + " | ".join(r) + " |" for r in rows)
    if v.warnings:
        yield from ["", "## Unplaced Warnings", ""]
        yield from (f"- {w}" for w in v.warnings)


def validation_table(v: Validation) -> Iterator[str]:
    yield f"Validation of {v.preset} over {v.runs} run(s): {_status(v.passed, v.mock)}"
    for title, columns, rows in _validation_tables(v):
        yield from ["", title, "  " + " | ".join(columns)]
        yield from ("  " + " | ".join(r) for r in rows)
    yield from (f"warning: {w}" for w in v.warnings)


def validation_json(v: Validation) -> Iterator[str]:
    """One JSON object; its lists are streamed a row a line."""
    head = {"preset_name": v.preset, "runs": v.runs, "mock": v.mock, "all_passed": v.passed, "summary": v.summary, "unplaced_warnings": v.warnings}
    yield json.dumps(head, ensure_ascii=False)[:-1] + ","
    parts = [
        ("question_stats", v.stats), ("pair_group_results", v.groups), ("pair_results", v.pairs), ("criteria_results", v.criteria),
        ("choice_distributions", v.choices)
    ]
    for k, (name, df) in enumerate(parts):
        yield f'"{name}": ['
        before = None
        for r in json_rows(df).toLocalIterator():
            if before is not None:
                yield before + ","
            before = r["json"]
        if before is not None:
            yield before
        yield "]" + ("," if k + 1 < len(parts) else "}")


def published(results: DataFrame) -> DataFrame:
    """Aggregates that say nothing of a document: by preset, how many there are, pass, fail or end in an error, and the mean composite."""
    return results.groupBy("preset_name").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.avg("composite_score").alias("mean_composite")
    )


def masked_ids(rows: DataFrame, public: Column) -> DataFrame:
    """Document ids are shown only for public ones."""
    return rows.withColumn("doc_id", F.when(public, F.col("doc_id").cast("string")).otherwise("(private)"))


def leaks(lines: DataFrame, tokens: list[str]) -> DataFrame:
    """Lines that hold a private token; must be empty before anything is published."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.col("line").contains(t)
    return lines.where(hit)


def cache_key(text: Column, options: str) -> Column:
    return F.sha2(F.concat_ws("::", text, F.lit(options)), 256)


def with_cache(docs: DataFrame, cache: DataFrame, options: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached columns, misses) by content and options."""
    keyed = docs.withColumn("cache_key", cache_key(F.col("text"), options))
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")


def questions_key(rows: list[tuple]) -> str:
    """A hash of a preset's questions, whatever order they come in; part of the options of a cache key."""
    return hashlib.sha256(json.dumps(sorted([list(map(str, r)) for r in rows]), ensure_ascii=False).encode()).hexdigest()


def cache_folder(environment: dict[str, str] | None = None) -> str:
    """Where results are kept: the folder that ``PLUMBLINE_CACHE`` names, a local one in CI, else the user's cache folder; where that cannot
    be made, a local one."""
    env = os.environ if environment is None else environment
    if given := env.get("PLUMBLINE_CACHE"):
        return given
    local = ".plumbline-cache"
    if env.get("CI") == "true":
        return local
    target = Path(env.get("XDG_CACHE_HOME") or Path(env.get("HOME", "~")).expanduser() / ".cache") / "plumbline"
    try:
        target.mkdir(parents=True, exist_ok=True)
    except OSError:
        return local
    return str(target)


def store(results: DataFrame, path: str) -> None:
    """Add rows with a ``cache_key``; readers see a batch whole or not at all, as its files are committed together."""
    results.withColumn("prefix", F.left("cache_key", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What :func:`store` has kept, one row a key; nothing if there is no readable cache."""
    try:
        return spark.read.parquet(path).drop("prefix").dropDuplicates(["cache_key"])
    except AnalysisException:
        return None


def clear(spark: SparkSession, path: str) -> int:
    """Delete a cache; the number of results that it had."""
    found = stored(spark, path)
    n = found.count() if found is not None else 0
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return n
