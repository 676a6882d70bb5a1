"""Length guard, overlapping chunks, comment stripping, Markdown sections and headings."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import fixed as V


def guarded(text: Column, limit: int = V.MAX_CHARS, strict: bool = False) -> Column:
    """Both ends of a text over ``limit``, around a note of how much is left out; with ``strict`` such a text is an error."""
    half = max(limit // 2, 1)
    n = F.length(text)
    if strict:
        return F.when(
            n > limit,
            F.raise_error(F.concat(F.lit("the document has "), n.cast("string"), F.lit(f" characters; at most {limit} are allowed")))
        ).otherwise(text)
    left_out = F.greatest(n - 2 * half, F.lit(0)).cast("string")
    note = F.concat(F.lit("\n\n... [TRUNCATED "), left_out, F.lit(" CHARACTERS TO PREVENT TOKEN OVERFLOW] ...\n\n"))
    return F.when(n > limit, F.concat(F.left(text, F.lit(half)), note, F.right(text, F.lit(half)))).otherwise(text)


class _Breaks:
    """Where a text may be cut: behind its blank lines, or else behind its line breaks."""

    def __init__(self, text: str):
        lines = [m.end() for m in re.finditer("\n", text)]
        blank = [b for a, b in zip(lines, lines[1:], strict=False) if b == a + 1]
        self.levels = ((blank, 2), (lines, 1))

    def latest(self, low: int, high: int) -> int | None:
        """The last cut at or before ``high`` whose line breaks do not begin before ``low``."""
        for places, width in self.levels:
            i = bisect_right(places, high)
            if i and places[i - 1] - width >= low:
                return places[i - 1]
        return None

    def earliest(self, low: int, high: int) -> int | None:
        for places, width in self.levels:
            i = bisect_left(places, low + width)
            if i < len(places) and places[i] <= high:
                return places[i]
        return None


def chunk_spans(text: str, limit: int = V.MAX_CHARS, overlap: int = V.OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``limit`` characters that cover a text and overlap by about ``overlap``.

    A chunk ends at the last break within ``BREAK_WINDOW`` of its bound, but leaves more than the overlap; the next one starts at the first
    break within ``SNAP``, and half the overlap, of where the overlap begins. Without a break there, both are where the numbers put them.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    overlap = min(max(overlap, 0), limit // 2)
    breaks, spans, start = _Breaks(text), [], 0
    while start + limit < len(text):
        bound = start + limit
        end = breaks.latest(max(start + overlap, bound - V.BREAK_WINDOW), bound) or bound
        spans.append((start, end))
        earliest = max(start + 1, end - overlap)
        start = breaks.earliest(earliest, min(earliest + min(V.SNAP, overlap // 2), end)) or earliest
    return [*spans, (start, len(text))] if start < len(text) or not spans else spans


def split_text(text: str, limit: int = V.MAX_CHARS, overlap: int = V.OVERLAP) -> list[tuple[int, str]]:
    return [(a, text[a:b]) for a, b in chunk_spans(text, limit, overlap)]


def chunks(text: Column, limit: int = V.MAX_CHARS, overlap: int = V.OVERLAP) -> Column:
    batches.bounded()

    @F.pandas_udf("array<struct<start: int, text: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "text": c} for s, c in split_text(t, limit, overlap)] if isinstance(t, str) else None for t in texts])

    return run(text)


# Fixed value: fenced code, inline code and comments, the first alternative winning.
_COMMENT = re.compile(
    r"(?P<fence>^[ ]{0,3}(?P<fence_char>[`~]{3,})[^\n]*\n[\s\S]*?(?:^[ ]{0,3}(?P=fence_char)[`~]*[ ]*(?:\n|\Z)|\Z))|(?P<inline>(?P<tick>`+)(?:(?!\n\s*\n)[\s\S])*?(?P=tick))|(?P<comment><!--[\s\S]*?-->)",
    re.MULTILINE,
)


def strip_comments(text: Column) -> Column:
    """Comments outside code go; unclosed ones stay. Texts without ``<!--`` never reach Python's pattern."""
    batches.bounded()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _COMMENT.sub(lambda m: "" if m["comment"] else m[0], t) if isinstance(t, str) and "<!--" in t else t)

    return run(text)


def chunk_plan(length: Column, has_noul: bool, has_score: bool, limit: int = V.MAX_CHARS, overlap: int = V.OVERLAP) -> Column:
    """Struct: was_truncated, and an estimate of the chunks without line breaks."""
    many = length > limit
    n = F.when(many, F.ceil((length - overlap) / (limit - overlap))).otherwise(1).cast("int")
    calls = F.when(~many, 1).otherwise((n if has_noul else F.lit(0)) + (F.lit(1) if has_score else F.lit(0)))
    return F.struct((many & F.lit(has_score)).alias("was_truncated"), n.alias("chunks"), calls.cast("int").alias("planned_calls"))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def sections_of(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Preamble and (title, body with its heading) of the level-two sections, code fences apart."""
    preamble, out, fenced = [], [], False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        if not fenced and re.match(r"##\s+\S", line):
            out.append((line[2:].strip(), [line]))
        else:
            (out[-1][1] if out else preamble).append(line)
    return "\n".join(preamble), [(t, "\n".join(b)) for t, b in out]


def sections(text: Column) -> Column:
    batches.bounded()

    @F.pandas_udf("struct<preamble: string, sections: array<struct<title: string, body: string>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [sections_of(t or "") for t in texts]
        return pd.DataFrame({"preamble": [f[0] for f in found], "sections": [[{"title": t, "body": b} for t, b in f[1]] for f in found]})

    return run(text)


def ablations(preamble: Column, parts: Column) -> Column:
    """All variants with one section left out: array of (removed slug, text)."""
    return F.transform(
        parts,
        lambda s, i: F.struct(
            slug(s["title"]).alias("removed"),
            F.array_join(
                F.concat(F.array(preamble), F.transform(F.filter(parts, lambda o, j: j != i), lambda o: o["body"])), "\n"
            ).alias("text")
        )
    )


def ablation_labels(variants: DataFrame, questions: list[str]) -> DataFrame:
    """(variant, question_id, expected) of variants (variant, removed): what a variant's removed section answers is absent, all else present."""
    asked = F.explode(F.array(*[F.lit(q) for q in questions])).alias("question_id")
    rows = variants.select("variant", "removed", asked)
    return rows.select("variant", "question_id", F.when(F.col("removed") == F.col("question_id"), "absent").otherwise("present").alias("expected"))


def headings(text: Column) -> Column:
    """Lines with ``#``, lines above a row of =, -, ~ or ^, and bold-only lines, in order."""
    lines = F.split(text, "\n")
    # Each line with the next one: a look-up in ``lines`` from inside the lambda would split the whole text again for every line.
    pairs = F.arrays_zip(lines.alias("line"), F.slice(lines, F.lit(2), F.size(lines)).alias("next"))

    def one(pair: Column) -> Column:
        line = pair["line"]
        # Most lines are none of these, and fail each test at their first characters.
        trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
        underlined = F.coalesce(pair["next"].rlike(r"^\s*[=\-~^]{3,}\s*$"), F.lit(False))
        return (
            F.when(line.rlike(r"^\s*#"), F.regexp_replace(trimmed, r"^#+\s*", ""))
            .when(underlined & line.rlike(r"\S"), trimmed)
            .when(line.rlike(r"^\s*\*\*[^*]+\*\*:?\s*$"), F.regexp_replace(trimmed, r"^[*: ]+|[*: ]+$", ""))
        )

    return F.filter(F.transform(pairs, one), lambda h: h.isNotNull())


def has_item(text: Column, question: str, found_headings: Column | None = None) -> Column:
    """Presence of a question's item by keywords of headings (of the text, unless given), references, or an opening summary."""
    lowered = F.transform(headings(text) if found_headings is None else found_headings, lambda h: F.lower(h))
    found = F.exists(lowered, lambda h: h.rlike("|".join(re.escape(k) for k in V.KEYWORDS[question])))
    if question == "related_issues":
        found = found | text.rlike(V.ISSUE_REF)
    if question == "summary":
        found = found | (F.length(F.regexp_replace(F.split(text, "\n#", 2)[0], r"^\s+|\s+$", "")) > 40)
    return found


def presence_counts(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The heuristic against labels (doc_id, question_id, expected): by question, absent ones found absent, false alarms, and populations."""
    marked = docs.withColumn("_h", headings(F.col(text)))
    asked = [F.struct(F.lit(q).alias("question_id"), has_item(F.col(text), q, F.col("_h")).alias("there")) for q in V.KEYWORDS]
    rows = marked.select("doc_id", F.inline(F.array(*asked))).join(labels, ["doc_id", "question_id"])
    gone, asked_for = ~F.col("there"), F.col("expected") == "absent"
    return rows.groupBy("question_id").agg(
        F.count_if(gone & asked_for).alias("detected"), F.count_if(asked_for).alias("n_absent"),
        F.count_if(gone & ~asked_for).alias("false_alarms"), F.count_if(~asked_for).alias("n_present")
    )


def line_and_column(text: Column, offset: Column) -> Column:
    """1-based line and column of a 0-based offset."""
    before = F.left(text, offset)
    return F.struct((F.size(F.split(before, "\n"))).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))
