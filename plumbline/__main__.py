"""Command line: ``python -m plumbline eval PATH... --preset safety --format json``; prints the report and exits with its code.

0: all pass; 1: a document or criterion fails; 2: wrong usage; 3: something could not be evaluated.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate, validation
from .functions import fixed as V
from .functions.storage import materialise
from .operators import baseline, gate, report
from .sources import files, hooks, project, providers, schemas


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline")
    commands = parser.add_subparsers(dest="command", required=True)

    def preset_options(p: argparse.ArgumentParser) -> None:
        p.add_argument("--preset", help="the name of a preset")
        p.add_argument("--config", help="a preset or project file")
        p.add_argument("--provider", help="auto, http or module:Class")
        p.add_argument("--url", help="where the HTTP provider is")
        p.add_argument("--model")
        p.add_argument("--dry-run", action="store_true", help="fixed answers")
        p.add_argument("--max-chars", type=int, default=V.MAX_CHARS)
        p.add_argument("--role-email", action="append", default=[])
        p.add_argument("--output", help="write the report to this file as well")

    run = commands.add_parser("eval", help="evaluate text files")
    run.add_argument("paths", nargs="*")
    preset_options(run)
    run.add_argument("--offline", "--rules-only", action="store_true", help="rules only; so without a provider or --dry-run")
    run.add_argument("--exclude", action="append", default=[])
    run.add_argument("--no-mask", action="store_true", help="send what was found to the provider")
    run.add_argument("--no-fail", action="store_true", help="exit with 0 although documents fail")
    run.add_argument("--baseline", help="an earlier JSON report")
    run.add_argument("--max-drop", type=float, default=V.MAX_DROP)
    run.add_argument("--staged", action="store_true", help="only files that are staged in git")
    run.add_argument("--since", help="only files changed since a git revision")
    run.add_argument("--images", action="store_true", help="send local images of the documents")
    run.add_argument("--cache", action="store_true", help="keep answers of a provider by content")
    run.add_argument("--cache-dir")
    run.add_argument("--format", choices=["json", "table", "markdown", "annotations"], default="table")
    check = commands.add_parser("validate", help="evaluate labelled files several times and check them")
    check.add_argument("labels")
    preset_options(check)
    check.add_argument("--runs", type=int)
    check.add_argument("--format", choices=["json", "table", "markdown"], default="table")
    commands.add_parser("presets", help="list the presets")
    shown = commands.add_parser("schema", help="the JSON Schema of preset or label files")
    shown.add_argument("kind", nargs="?", choices=["preset", "labels"], default="preset")
    own = commands.add_parser("check-preset", help="read a preset file and show its questions")
    own.add_argument("file")
    hook = commands.add_parser("hook", help="scan the files that an editor hook names on its input")
    hook.add_argument("paths", nargs="*")
    hook.add_argument("--preset", default="safety")
    setup = commands.add_parser("init", help="write the set-up of a pre-commit hook")
    setup.add_argument("--workflow", action="store_true", help="and of a CI job")
    cache = commands.add_parser("clear-cache", help="delete kept answers")
    cache.add_argument("--cache-dir")
    return parser


def _questions(options) -> tuple[str, list[tuple]]:
    """(preset, its own question rows): from the file that is named, else a project file above, else the built-in preset."""
    if options.config:
        text = Path(options.config).read_text(encoding="utf-8")
        import yaml

        raw = yaml.safe_load(text) or {}
        if "preset" in raw or "questions" not in raw:
            return project.merged(raw)
        rows = files.preset(text)
        return raw["name"], rows
    found = None if options.preset else project.loaded()
    return found or (options.preset or "quality", [])


def _cached(docs: DataFrame, folder: str, key: str, ask) -> DataFrame:
    """Results of documents; those whose content was answered under the same options come from the cache, the others are asked and kept.
    A cache that cannot be written never stops an evaluation."""
    spark = docs.sparkSession
    kept = report.stored(spark, folder)
    if kept is None:
        fresh = materialise(ask(docs.withColumn("cache_key", report.cache_key(F.col("text"), key))))
        hits = None
    else:
        hits, misses = report.with_cache(docs, kept.drop("path", "filename", "doc_id"), key)
        hits = materialise(hits.drop("text"))
        fresh = materialise(ask(misses))
    try:
        report.store(fresh.where("error is null").drop("path", "filename", "doc_id", "images"), folder)
    except Exception as error:
        print(f"cache: {error}", file=sys.stderr)
    fresh = fresh.withColumn("cached", F.lit(False))
    return fresh if hits is None else fresh.unionByName(hits.withColumn("cached", F.lit(True)), allowMissingColumns=True)


def _previous(spark: SparkSession, path: str, preset: str) -> DataFrame:
    """An earlier report with its answers as a map; a list of rows, or one row."""
    files.baseline(spark, path, preset)  # a dry run or another preset is an error
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = [
        (
            r["path"], {k: float(v) for k, v in (r.get("answers") or {}).items() if v is not None}, bool(r.get("was_truncated"))
        ) for r in (raw if isinstance(raw, list) else [raw])
    ]
    return spark.createDataFrame(rows, "path string, answers map<string,double>, was_truncated boolean")


def _eval(options, spark: SparkSession) -> int:
    preset, own = _questions(options)
    paths = list(options.paths)
    if options.staged or options.since:
        changed = files.git_changes(options.since)
        listing = spark.createDataFrame([(p,) for p in changed], "path string")
        found = files.text_files(spark, paths or changed, options.exclude or None) if paths or changed else files.text_files(spark, [])
        docs = files.changed(found, listing, explicit=bool(paths))
    elif paths:
        docs = files.text_files(spark, paths, options.exclude or None)
    else:
        raise ValueError("name files, or use --staged or --since")
    docs = docs.withColumn("doc_id", F.xxhash64("path"))
    if options.images:
        pictures = files.pictures(spark, sorted({str(Path(p).parent) for p in paths}) or ["."])
        found = files.images(docs.select("doc_id", "text"), pictures)
        docs = docs.join(
            found.groupBy("doc_id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("ord", "data_url"))), lambda x: x["data_url"]).alias("images")
            ),
            "doc_id", "left"
        )
    unread = docs.where("error is not null").select("path", F.col("error").alias("message"))
    unreadable = [f"{r['path']}: {r['message']}" for r in unread.collect()]
    docs = docs.where("error is null").drop("error")
    roles = tuple(options.role_email)
    if options.dry_run:
        results = evaluate.mock(docs, preset, roles, options.max_chars)
    elif options.provider and not options.offline:
        make = providers.provider(options.provider, options.url, model=options.model)
        ask = lambda d: evaluate.online(d, preset, make, roles, options.max_chars, own=own, mask=not options.no_mask)
        key = "::".join(
            [
                preset, report.questions_key(own or [q for q in V.QUESTIONS if q[0] == preset]), str(options.model), str(options.max_chars),
                str(options.no_mask), str(options.images)
            ]
        )
        folder = options.cache_dir or report.cache_folder()
        results = _cached(docs, folder, key, ask) if options.cache else ask(docs)
    else:
        results = evaluate.offline(docs, preset, roles, options.max_chars)
    rows = own or [q for q in V.QUESTIONS if q[0].replace("-", "_") == preset.lower().replace("-", "_")]
    warnings = []
    if options.baseline:
        previous = _previous(spark, options.baseline, preset)
        results = baseline.compared(results, previous, rows, root=str(Path.cwd()), max_drop=options.max_drop)
        warnings = [r["message"] for r in baseline.truncation_mismatch(results, previous).collect()]
    results = materialise(results)
    if options.format == "annotations":
        lines = (r["line"] for r in report.annotations(results.orderBy("path").select("path", F.inline("structured_violations"))).toLocalIterator())
    elif options.format == "json":
        lines = report.json_lines(results.drop("images", "cache_key").orderBy("path"))
    elif options.format == "markdown":
        lines = report.markdown_report(results, [r[1] for r in rows], warnings)
    else:
        lines = report.table_report(results, sys.stdout.isatty())
    _show(lines, options.output)
    for message in unreadable:
        print(message, file=sys.stderr)
    code = evaluate.exit_code(results)
    if options.no_fail and code == 1:
        code = 3 if results.where("error is not null").limit(1).count() else 0
    return code or (3 if unreadable else 0)


def _show(lines, output: str | None) -> None:
    """Print lines, and write them to a file that replaces an older one only when it is whole."""
    if not output:
        for line in lines:
            print(line)
        return
    part = Path(f"{output}.part")
    with part.open("w", encoding="utf-8") as file:
        for line in lines:
            print(line)
            file.write(line + "\n")
    part.replace(output)


def _validate(options, spark: SparkSession) -> int:
    import yaml

    raw = yaml.safe_load(Path(options.labels).read_text(encoding="utf-8")) or {}
    if raw.get("config") and not options.config and not options.preset:
        options.config = str(Path(options.labels).resolve().parent / raw["config"])
    options.preset = options.preset or raw.get("preset")
    preset, own = _questions(options)
    if not options.dry_run and not options.provider:
        raise ValueError("a validation asks a provider: name one, or use --dry-run")
    make = None if options.dry_run else providers.provider(options.provider, options.url, model=options.model)
    evaluator = validation.evaluators(preset, make, tuple(options.role_email), options.max_chars, own)
    found, errors = validation.run(spark, options.labels, evaluator, preset, own, options.runs, mock=options.dry_run)
    _show({"json": report.validation_json, "markdown": report.validation_markdown, "table": report.validation_table}[options.format](found), options.output)
    for message in errors:
        print(message, file=sys.stderr)
    return 1 if found.passed is False else 3 if errors else 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("plumbline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if options.command == "presets":
            print("\n".join(r["preset"] for r in gate.questions(spark).select("preset").distinct().orderBy("preset").collect()))
        elif options.command == "check-preset":
            print("\n".join(f"{r[1]} ({r[2]})" for r in files.preset(Path(options.file).read_text(encoding="utf-8"))))
        elif options.command == "schema":
            print(json.dumps(schemas.labels() if options.kind == "labels" else schemas.preset(), indent=2))
        elif options.command == "clear-cache":
            print(f"{report.clear(spark, options.cache_dir or report.cache_folder())} results deleted")
        elif options.command == "init":
            print("\n".join(hooks.scaffold(workflow=options.workflow)) or "nothing to write")
        elif options.command == "hook":
            raw = "" if options.paths or sys.stdin.isatty() else sys.stdin.read()
            named = hooks.files(options.paths, raw)
            return main(["eval", *named, "--preset", options.preset, "--offline"], spark) if named else 0
        else:
            return _eval(options, spark) if options.command == "eval" else _validate(options, spark)
    except (ValueError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
