"""Evaluation of a table of documents under a preset: offline rules, a deterministic mock, or a provider.

Input: ``doc_id`` and ``text`` (other columns are carried). Output: the input without its text, and preset_name, composite_score, passed,
violations, structured_violations, warnings, redactions_count, was_truncated, api_calls, model, mock,
error and answers (value by question).

The scan is one Arrow pass; what follows is native on the array of spans, so the rules-only modes shuffle nothing. With a provider the scan
and the answers are each written once to the checkpoint folder: a document is scanned once, and a chunk and batch of questions is asked
once, however often the result is read. Answers are pooled by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import batches
from .functions import fixed as V
from .functions.storage import materialise
from .operators import chunks, decide, gate
from .operators.spans import placed, scan, token_hashes

_TEXT = {
    "email": "is an individual address", "phone": "is an individual phone number", "ip": "is an internal/sensitive IP address",
    "url": "is an internal/sensitive URL", "secret": "is an exposed secret"
}


def _two(value: Column) -> Column:
    """Two decimals, half to even, as text."""
    return F.format_number(value, 2)


def scanned(docs: DataFrame, role_globs: tuple[str, ...] = (), mask: bool = True) -> DataFrame:
    """Add spans, masked (comments stripped) and redactions_count."""
    batches.bounded(docs.sparkSession)
    found = docs.withColumn("_scan", scan(F.col("text"), role_globs, mask))
    masked = chunks.strip_comments(F.col("_scan.masked"))
    count = F.size(F.filter("_scan.spans", lambda s: s["is_redaction"])) if mask else F.lit(0)
    return found.withColumns({"spans": F.col("_scan.spans"), "masked": masked, "redactions_count": count}).drop("_scan")


def _first_of_each(spans: Column) -> Column:
    """Numbered spans once a placeholder, in order of number."""
    numbered = F.filter(spans, lambda s: s["ord"].isNotNull() & (s["kind"] != "credential"))
    names = F.array_distinct(F.transform(numbered, lambda s: s["placeholder"]))
    return F.transform(names, lambda n: F.filter(numbered, lambda s: s["placeholder"] == n)[0])


def _offline_messages(spans: Column) -> Column:
    def of(kind: str, bad: Callable[[Column], Column], suffix: str = "") -> Column:
        hit = F.filter(spans, lambda s: (s["kind"] == kind) & bad(s))
        return F.array_distinct(F.transform(hit, lambda s: F.concat(F.lit("PII Exposure: "), s["placeholder"], F.lit(f" {_TEXT[kind]}{suffix}"))))

    known = F.filter(spans, lambda s: (s["kind"] == "credential") & ~s["is_example"])
    example = lambda s: s["is_example_domain"] | s["is_public_common"] | F.coalesce(s["ip_type"].isin("loopback", "documentation"), F.lit(False))
    return F.concat(
        of("email", lambda s: s["domain_type"] == "free_mail", " (free-mail)"),
        of("phone", lambda s: ~s["looks_like_support"]),
        of("ip", lambda s: s["ip_type"] == "private"),
        of("url", lambda s: s["is_internal_tld"] & ~example(s)),
        F.array_distinct(F.transform(known, lambda s: F.concat(F.lit("Credential Exposure: "), s["placeholder"], F.lit(" is a known "), s["type"], F.lit(" credential")))),
    )


def structured(messages: Column, level: str, spans: Column) -> Column:
    """Messages with the place of their first placeholder; of credentials that share one, the last is shown."""
    spot = "struct<message: string, level: string, line: int, column: int, end_line: int, end_column: int>"

    def one(m: Column) -> Column:
        name = F.regexp_extract(m, r"\[[A-Z][A-Z_]*(?:_\d+)?\]", 0)
        hits = F.filter(spans, lambda s: (s["placeholder"] == name) & ~s["is_example"])
        s = F.when(F.try_element_at(hits, F.lit(1))["kind"] == "credential", F.try_element_at(hits, F.lit(-1))).otherwise(F.try_element_at(hits, F.lit(1)))
        return F.struct(m.alias("message"), F.lit(level).alias("level"), *[s[c].alias(c) for c in ("line", "column", "end_line", "end_column")]).cast(spot)

    return F.transform(messages, one)


def _finished(
    df: DataFrame, preset: str, composite: Column, passed: Column, violations: Column, warnings: Column, truncated: Column, calls: Column,
    model: str | Column, mock: bool, error: Column, answers: Column | None = None, **more: Column
) -> DataFrame:
    none = F.lit(None)
    own = {
        "preset_name": F.lit(preset),
        "composite_score": composite,
        "passed": passed,
        "violations": violations,
        "warnings": warnings,
        "was_truncated": truncated,
        "api_calls": calls.cast("int"),
        "model": F.lit(model),
        "mock": F.lit(mock),
        "error": error,
        "answers": answers if answers is not None else F.create_map().cast("map<string,double>"),
        "choices": F.create_map().cast("map<string,string>"),
        "near_threshold": _none(),
        "input_tokens": none.cast("long"),
        "output_tokens": none.cast("long"),
    }
    out = df.withColumns(own | more)
    out = out.withColumn(
        "structured_violations",
        F.concat(structured(F.col("violations"), "error", F.col("spans")), structured(F.col("warnings"), "warning", F.col("spans")))
    )
    return out.drop("text", "spans", "masked", *[c for c in out.columns if c.startswith("_")])


def _none() -> Column:
    return F.array().cast("array<string>")


def offline(docs: DataFrame, preset: str, role_globs: tuple[str, ...] = (), max_chars: int = V.MAX_CHARS) -> DataFrame:
    """Rules only. Any violation fails, whatever the preset asks."""
    found = scanned(docs, role_globs).withColumn("_messages", _offline_messages(F.col("spans")))
    return _finished(
        found, preset, F.lit(None).cast("double"), F.size("_messages") == 0, F.col("_messages"), _none(), F.length("masked") > max_chars,
        F.lit(0), "offline-rules", False, F.lit(None).cast("string")
    )


def mock(docs: DataFrame, preset: str, role_globs: tuple[str, ...] = (), max_chars: int = V.MAX_CHARS) -> DataFrame:
    """Fixed answers: 0.85 for scores, 0.78 for predicates, 0.05 (0.90 if a plain phrase
    says so) for has_secrets and has_pii. Never fails."""
    found = scanned(docs, role_globs)
    rows = [r for r in V.QUESTIONS if r[0].replace("-", "_") == preset.lower().replace("-", "_")]
    given = {r[1]: F.lit(0.85 if r[2] == "score" else 0.78) for r in rows if r[2] != "choice"}
    prose = {"has_secrets": r"(?i)password\s+is\s+[^\s.,]+", "has_pii": r"\b(Taro Yamada|Hanako Tanaka|Jane Doe|John Doe)\b"}  # fixed values
    given |= {q: F.when(F.col("text").rlike(p), 0.90).otherwise(0.05) for q, p in prose.items() if q in given}
    weights = [(0.85 if r[2] == "score" else 0.78, r[4]) for r in rows if r[2] != "choice" and r[4]]
    answers = F.map_from_arrays(F.array(*[F.lit(q) for q in given]), F.array(*given.values())) if given else None
    composite = F.lit(sum(v * w for v, w in weights) / sum(w for _, w in weights)) if weights else F.lit(None).cast("double")
    return _finished(
        found, preset, composite, F.lit(True), _none(), _none(), F.length("masked") > max_chars, F.lit(0), "mock", True,
        F.lit(None).cast("string"), answers
    )


def _requests(found: DataFrame, question: list, max_chars: int, overlap: int, batch: int, mask: bool) -> DataFrame:
    """One row a document, chunk and batch of questions: doc_id, part (the chunk, or -1 for the truncated whole), state, images, questions."""
    nouls = F.array(*[F.lit(r[1]) for r in question if r[2] == "noul"]).cast("array<string>")
    others = F.array(*[F.lit(r[1]) for r in question if r[2] != "noul"]).cast("array<string>")
    asked = F.transform("_asked", lambda s: F.struct(s["placeholder"].alias("p"), F.concat(s["kind"], F.lit("_"), s["ord"].cast("string")).alias("q")))
    images = F.col("images") if "images" in found.columns else F.array().cast("array<string>")
    base = found.select("doc_id", "masked", images.alias("images"), asked.alias("c"), (F.col("_hashes") if not mask else F.lit(None)).alias("_hashes"))
    long = F.length("masked") > max_chars
    parts = F.when(long, F.transform(chunks.chunks(F.col("masked"), max_chars, overlap), lambda c: c["text"])).otherwise(F.array("masked"))
    split = base.select("doc_id", "c", "images", "_hashes", long.alias("long"), "masked", F.posexplode(parts).alias("part", "state"))
    if not mask:
        split = split.withColumns({"_own": token_hashes(F.col("state")), "_kept": token_hashes(F.col("masked"))})
    here = (lambda x, c, h: F.contains(c, x["p"])) if mask else (lambda x, c, h: placed(x["p"], F.col("_hashes"), h))
    state, masked = (F.col("state"), F.lit(None) if mask else F.col("_own")), (F.col("masked"), F.lit(None) if mask else F.col("_kept"))
    # What is in no chunk, because a cut goes through it or a comment held it, is asked in every chunk.
    inside = F.filter("c", lambda x: here(x, *state) | ~here(x, *masked))
    own = F.concat(nouls, F.when(F.col("long"), F.array().cast("array<string>")).otherwise(others))
    per_chunk = split.select("doc_id", "part", "state", "images", F.concat(own, F.transform(inside, lambda x: x["q"])).alias("all"))
    whole = base.where(long).select("doc_id", F.lit(-1).alias("part"), chunks.guarded(F.col("masked"), max_chars).alias("state"), "images", others.alias("all"))
    rows = per_chunk.unionByName(whole).where(F.size("all") > 0)
    n = F.size("all")
    batches = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / batch).cast("int")), lambda b: F.slice(F.col("all"), b * batch + 1, batch))
    return rows.select("doc_id", "part", "state", "images", F.explode(batches).alias("questions"))


def unplaced(asked: Column, before: Column, after: Column, parts: Column) -> Column:
    """Placeholders of ``asked`` that are in none of the chunks ``parts``, without those that went with a comment (in ``before``, the masked
    text, but not in ``after``, the text without comments)."""
    names = F.array_distinct(F.transform(asked, lambda s: s["placeholder"]))
    lost = F.filter(names, lambda p: ~F.exists(parts, lambda c: F.contains(c, p)))
    stripped = F.filter(names, lambda p: F.contains(before, p) & ~F.contains(after, p))
    return F.array_sort(F.array_except(lost, stripped))


def unplaced_message(names: Column, n_parts: Column) -> Column:
    head = F.concat(
        F.size(names).cast("string"), F.lit(" redacted item(s) ("), F.array_join(names, ", "), F.lit(") were not found in any of "),
        n_parts.cast("string")
    )
    return F.when(
        F.size(names) > 0,
        F.concat(
            head, F.lit(" chunks and were treated as present in every chunk; any candidate probabilities for them may be less reliable.")
        )
    )


def definitions(rows: list[tuple]) -> dict[str, dict]:
    """Type, instructions and criteria by question id; without instructions of its own a question asks for what its label names."""
    def text(r: tuple) -> str:
        given = r[10].get("instructions") if len(r) > 10 and isinstance(r[10], dict) else None
        label = r[3] or r[1].replace("_", " ")
        return given or {
            "noul": f"Whether the document has or shows: {label}", "score": f"How far the document reaches: {label}",
            "choice": f"Which one describes the document: {label}"
        }[r[2]]

    return {r[1]: {"type": r[2], "instructions": text(r), "criteria": list(r[9]) if r[9] else None} for r in rows}


def online(
    docs: DataFrame, preset: str, make_provider: Callable[[], object], role_globs: tuple[str, ...] = (), max_chars: int = V.MAX_CHARS,
    overlap: int = V.OVERLAP, batch: int = V.BATCH, own: list[tuple] | None = None, pause: float = 0.5, mask: bool = True
) -> DataFrame:
    """Ask a provider. Predicates are pooled over chunks by their maximum; a missing answer or a failed call is the row's ``error``."""
    questions = {(r[0], r[1]): r for r in V.QUESTIONS} | {(r[0], r[1]): r for r in own or []}
    rows = [r for r in questions.values() if r[0].replace("-", "_") == preset.lower().replace("-", "_")]
    if not rows:
        raise ValueError(f"unknown preset: {preset}")
    batches.bounded(docs.sparkSession)
    found = docs.withColumn("_scan", scan(F.col("text"), role_globs, mask))
    count = F.size(F.filter("_scan.spans", lambda s: s["is_redaction"])) if mask else F.lit(0)
    found = found.withColumns(
        {
            "spans": F.col("_scan.spans"), "_before": F.col("_scan.masked"), "masked": chunks.strip_comments(F.col("_scan.masked")),
            "redactions_count": count
        }
    ).drop("_scan")
    if not mask:
        found = found.withColumn("_hashes", token_hashes(F.col("text"), role_globs))
    found = materialise(found)
    first = _first_of_each(F.col("spans"))
    found = found.withColumn("_candidates", first).withColumn("_asked", F.filter("_candidates", lambda s: decide.needs_question(s["kind"], lambda c: s[c])))
    requests = _requests(found, rows, max_chars, overlap, batch, mask)
    answers = materialise(decide.provider_answers(requests, make_provider, definitions(rows), pause=pause))
    pooled = decide.pooled(answers)
    valued = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("question_id", c))))
    by_doc = pooled.groupBy("doc_id").agg(valued("value").alias("_answers"), valued("choice").alias("_choices"), F.max("error").alias("_error"))
    calls = requests.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_calls"))
    used = decide.usage(answers).select("doc_id", F.col("input_tokens").alias("_in"), F.col("output_tokens").alias("_out"), F.col("model").alias("_model"))
    joined = found.join(by_doc, "doc_id", "left").join(calls, "doc_id", "left").join(used, "doc_id", "left")
    value = lambda q: F.try_element_at("_answers", F.lit(q))

    warn_only = preset.lower().replace("-", "_") in [p.replace("-", "_") for p in V.WARN_ONLY]
    credentials = F.size(F.filter("spans", lambda s: (s["kind"] == "credential") & ~s["is_example"]))
    free = F.size(F.filter("spans", lambda s: s["type"] == "email_free_mail"))
    errors, warns, weighted, near = [], [], [], []
    for _, q, kind, label, weight, low, high, preflight, advisory, *_ in rows:
        if kind == "choice":
            continue
        v = value(q)
        forced = credentials if preflight == "credentials" or q == "has_secrets" else free if preflight == "pii" or q == "has_pii" else F.lit(0)
        item = "credential(s)" if preflight == "credentials" or q == "has_secrets" else "personal PII item(s)"
        soft = advisory or warn_only
        mark = " (warning)" if soft else ""
        by_scan = F.when(
            forced > 0,
            F.concat(
                F.lit(f"{label or q}: "), forced.cast("string"), F.lit(f" {item} detected by pre-flight scan"),
                F.coalesce(F.concat(F.lit(" (model: "), _two(v), F.lit(")")), F.lit("")), F.lit(mark)
            )
        )
        below = F.when(
            v < low,
            F.concat(F.lit(f"{label or q}: score "), _two(v), F.lit(f" is below {'' if soft else 'required '}minimum {low:.2f}{mark}"))
        ) if low is not None else F.lit(None)
        above = F.when(
            v > high,
            F.concat(F.lit(f"{label or q}: risk "), _two(v), F.lit(f" exceeds {'' if soft else 'allowed '}maximum {high:.2f}{mark}"))
        ) if high is not None else F.lit(None)
        (warns if soft else errors).append(F.coalesce(by_scan, below, above))
        close = [F.abs(v - t) <= V.NEAR + V.EPSILON for t in (low, high) if t is not None]
        near += [F.when(F.greatest(*close) if len(close) > 1 else close[0], F.lit(q))] if close else []
        if weight:
            weighted.append((v, float(weight)))
    texts = lambda cs: F.filter(F.array(*cs).cast("array<string>"), lambda m: m.isNotNull()) if cs else _none()
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in weighted), F.lit(0.0))
    composite = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in weighted), F.lit(0.0)) / F.nullif(total, F.lit(0.0))

    ids = {r[1] for r in rows}
    candidate = F.col("_candidates")

    def of(kind: str) -> Column:
        def one(s: Column) -> Column:
            p = F.try_element_at(F.col("_answers"), F.concat(F.lit(kind + "_"), s["ord"].cast("string")))
            shown = F.coalesce(F.concat(F.lit(" (model: "), _two(p), F.lit(")")), F.lit(""))
            head = "Credential Exposure: " if kind == "secret" else "PII Exposure: "
            text = F.concat(F.lit(head), s["placeholder"], F.lit(" " + _TEXT[kind]), shown)
            if kind == "email":
                return F.when(
                    s["domain_type"] == "free_mail", F.concat(F.lit(head), s["placeholder"], F.lit(f" {_TEXT[kind]} (free-mail)"))
                ).when(p >= V.HALF, text)
            if kind == "phone":
                return F.when(s["is_support_prefix"], F.lit(None)).when(F.coalesce(p >= V.HALF, ~s["looks_like_support"]), text)
            return F.when((~s["placeholder_syntax"] if kind == "secret" else F.lit(True)) & (p >= V.HALF), text)

        return F.filter(F.transform(F.filter(candidate, lambda s: s["kind"] == kind), one), lambda m: m.isNotNull())

    known = F.transform(
        F.filter("spans", lambda s: (s["kind"] == "credential") & ~s["is_example"]),
        lambda s: F.concat(F.lit("Credential Exposure: "), s["placeholder"], F.lit(" is a known format secret"))
    )
    extra = [F.concat(known, of("secret"))] if "has_secrets" in ids else []
    extra += [of(k) for k in ("email", "phone", "ip", "url")] if "has_pii" in ids else []
    parts = F.transform(chunks.chunks(F.col("masked"), max_chars, overlap), lambda c: c["text"])
    out = joined.withColumn("_parts", F.when(F.length("masked") > max_chars, parts)) if mask else joined.withColumn("_parts", F.lit(None).cast("array<string>"))
    lost = F.when(
        F.col("_parts").isNotNull(),
        unplaced_message(unplaced(F.col("_asked"), F.col("_before"), F.col("masked"), F.col("_parts")), F.size("_parts"))
    )
    out = out.withColumn("_violations", F.concat(texts(errors), *extra)).withColumn(
        "_warnings", F.filter(F.concat(texts(warns), F.array(lost)), lambda m: m.isNotNull())
    )
    error = F.col("_error")
    passed = F.when(error.isNull(), F.size("_violations") == 0)
    more = {"choices": F.col("_choices"), "near_threshold": texts(near), "input_tokens": F.col("_in"), "output_tokens": F.col("_out")}
    return _finished(
        out, preset, composite, passed, F.col("_violations"), F.col("_warnings"), F.length("masked") > max_chars,
        F.coalesce("_calls", F.lit(0)), F.coalesce("_model", F.lit("provider")), False, error, F.col("_answers"), **more
    )


def exit_code(results: DataFrame) -> int:
    """1 if any document fails, else 3 if any has an error, else 0."""
    return results.agg(
        F.count_if(~F.col("passed")).alias("v"), F.count_if(F.col("error").isNotNull()).alias("e")
    ).select(gate.exit_code(F.col("v"), F.col("e")).alias("c")).first()["c"]


def ordered(results: DataFrame, by: str = "doc_id") -> DataFrame:
    """In input order, for a sink that needs it."""
    return results.orderBy(by)
