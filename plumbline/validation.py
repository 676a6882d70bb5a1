"""A validation run: labelled documents and pairs, evaluated several times, against what is expected of them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate
from .functions import fixed as V
from .functions.storage import materialise
from .operators import gate, validate
from .operators.report import Validation
from .sources import files

Evaluator = Callable[[DataFrame], DataFrame]


def located(path: str, folder: Path) -> str:
    """A label's path: itself if absolute, else below the labels' folder if it is there, else as it stands."""
    near = folder / path
    return path if Path(path).is_absolute() or not near.exists() else str(near)


def _found_by_scan(results: DataFrame) -> DataFrame:
    """(doc_id, question_id, run) where spans or preflight decided, by what the violations say."""
    any_of = lambda *tests: F.exists(F.concat("violations", "warnings"), lambda v: tests[0](v) | tests[1](v))
    secrets = any_of(lambda v: v.startswith("Credential Exposure: ["), lambda v: v.contains(" credential(s) detected by pre-flight scan"))
    personal = any_of(lambda v: v.startswith("PII Exposure: ["), lambda v: v.contains(" personal PII item(s) detected by pre-flight scan"))
    named = F.array(F.when(secrets, F.lit("has_secrets")), F.when(personal, F.lit("has_pii")))
    return results.select("doc_id", "run", F.explode(named).alias("question_id")).where("question_id is not null")


def run(
    spark: SparkSession, label_file: str, evaluator: Evaluator, preset: str, own: list[tuple] | None = None, runs: int | None = None,
    mock: bool = False
) -> tuple[Validation, list[str]]:
    """(report, runtime errors). ``evaluator`` turns documents (doc_id, text, path, run) into report rows.

    Every file is read once and evaluated once a run, whatever documents and pairs name it.
    """
    folder = Path(label_file).resolve().parent
    text = Path(label_file).read_text(encoding="utf-8")
    raw = yaml.safe_load(text) or {}
    labels = files.labels(spark, text)
    criteria = validate.Criteria.of(raw.get("criteria"))
    runs = runs or int(raw.get("runs") or 3)
    question = gate.questions(spark, preset, own)
    if unknown := [
        r["question_id"] for r in files.unknown_questions(
            labels["documents"].select("question_id").unionByName(labels["pairs"].select("question_id")), question
        ).distinct().orderBy("question_id").collect()
    ]:
        raise ValueError(f"labels ask for questions that the preset lacks or that are choices: {', '.join(unknown)}")

    listed = [d["path"] for d in raw.get("documents") or []] + [p[s] for p in raw.get("pairs") or [] for s in ("before", "after")]
    where = {p: located(p, folder) for p in dict.fromkeys(listed)}
    errors = [f"{p}: no such file" for p, at in where.items() if not Path(at).exists()]
    there = sorted({at for at in where.values() if Path(at).exists()})
    given = spark.createDataFrame([(p, str(Path(at).absolute())) for p, at in where.items()], "label string, path string")
    pair_runs = {i: int(p.get("runs") or runs) for i, p in enumerate(raw.get("pairs") or [])}
    most = max([runs, *pair_runs.values()])
    docs = files.text_files(spark, there) if there else spark.createDataFrame([], "path string, filename string, text string, error string")
    errors += [f"{r['path']}: {r['error']}" for r in docs.where("error is not null").select("path", "error").collect()]
    docs = docs.where("error is null").select("path", "text", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("run"))
    results = materialise(evaluator(docs.withColumn("doc_id", F.xxhash64("path", "run"))))
    errors += [
        f"{r['path']} (run {r['run'] + 1}/{most}): {r['error']}" for r in results.where("error is not null").select(
            "path", "run", "error"
        ).orderBy("path", "run").collect()
    ]

    named = results.where("error is null").join(given, "path").select(
        F.col("label").alias("doc_id"), "run", "answers", "choices", "violations", "warnings", "was_truncated"
    )
    answers = named.select("doc_id", "run", F.explode("answers").alias("question_id", "value"))
    found = _found_by_scan(named)
    document_labels = labels["documents"].select(F.col("path").alias("doc_id"), "question_id", "expected")
    first_runs = F.col("run") < runs
    # An answer that the scan gives stands also where the model gave none.
    asked = answers.where(first_runs).unionByName(
        found.where(first_runs).join(answers, ["doc_id", "question_id", "run"], "left_anti").withColumn("value", F.lit(None).cast("double"))
    )
    decided = materialise(validate.raised(asked, found))
    lost = validate.lost_answers(decided, document_labels, runs)
    errors += [
        f"{r['doc_id']} (run {r['run'] + 1}/{runs}): question {r['question_id']} has no answer" for r in lost.orderBy(
            "doc_id", "question_id", "run"
        ).collect()
    ]
    verdicts = validate.presence(decided, document_labels, question)

    rows = [
        (i, q, e, p.get("kind"), p.get("doc_id"), p["before"], p["after"], pair_runs[i]) for i,
        p in enumerate(raw.get("pairs") or []) for q, e in p["expect"].items()
    ]
    pair_labels = spark.createDataFrame(rows, validate.PAIR_LABELS)

    def side(path: str) -> DataFrame:
        cut = named.select(F.col("doc_id").alias(path), "run", "was_truncated", "answers")
        one = pair_labels.select("pair_id", "question_id", path, "runs").join(cut, path).where("run < runs")
        return one.select("pair_id", "question_id", "run", F.try_element_at("answers", F.col("question_id")).alias("value"), "was_truncated")

    pairs = materialise(validate.pair_results(pair_labels, side("before_path"), side("after_path"), criteria))
    errors += [
        f"pair {r['before_path']} -> {r['after_path']}: question {r['question_id']} lacks {r['lost_runs']} run(s)" for r in pairs.where("incomplete").orderBy(
            "pair_id", "question_id"
        ).collect()
    ]
    groups = materialise(validate.groups(pairs, criteria))
    stats = materialise(validate.question_stats(verdicts, pairs))
    checked = materialise(validate.criteria_rows(stats, pairs, groups, criteria))
    passed = None if mock else validate.all_passed(checked, groups, criteria)

    sides = spark.createDataFrame([(p,) for p in listed], "doc_id string")
    choices = validate.choice_distribution(sides.join(named, "doc_id").select(F.explode("choices").alias("question_id", "choice")))
    warned = named.select("doc_id", "run", F.explode("warnings").alias("message")).where(validate.unplaced_warning(F.col("message"))).distinct()
    warnings = [f"{r['doc_id']} (run {r['run'] + 1}/{most}): {r['message']}" for r in warned.orderBy("doc_id", "run", "message").collect()]
    counts = pairs.agg(F.count_if("incomplete").alias("incomplete_pairs"), F.count_if("was_truncated").alias("truncated_pairs")).first().asDict()
    summary = {
        "documents_evaluated": len(raw.get("documents") or []), "pairs_evaluated": len(raw.get("pairs") or []), **counts,
        **validate.summary(stats).first().asDict(), "criteria_passed": passed
    }
    return Validation(preset, runs, mock, passed, stats, groups, pairs, checked, choices, summary, list(dict.fromkeys(warnings))), errors


def evaluators(
    preset: str, make_provider: Callable[[], object] | None, role_globs: tuple[str, ...] = (), max_chars: int = V.MAX_CHARS,
    own: list[tuple] | None = None
) -> Evaluator:
    """Answers from a provider, or the fixed ones of a dry run."""
    if make_provider is None:
        return lambda docs: evaluate.mock(docs, preset, role_globs, max_chars)
    return lambda docs: evaluate.online(docs, preset, make_provider, role_globs, max_chars, own=own)
