"""Sources: text files, score pairs, labels and presets in YAML, images in Markdown, baseline reports."""

from __future__ import annotations

import re
import subprocess
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.features import default_ignored, path_excluded

LABEL_KEYS = {"preset", "config", "runs", "criteria", "documents", "pairs"}
# Image types and the largest image.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
IMAGE_BYTES, IMAGES_EACH, IMAGES_MOST = 10 * 1024 * 1024, 5, 128


_GLOB = re.compile(r"[*?\[{]")


def _root(pattern: str) -> str:
    """The folder of a pattern before its first wildcard."""
    fixed = pattern[: m.start()] if (m := _GLOB.search(pattern)) else pattern
    return fixed[: fixed.rfind("/") + 1]


def text_files(spark: SparkSession, paths: str | list[str], exclude: list[str] | None = None) -> DataFrame:
    """One row a file, whole: path, filename, text, and an error where the bytes are no UTF-8 (the text is null then).

    A path without wildcards must exist and is always read; of what a pattern finds, files below ignored folders, as seen from where its
    wildcards begin, are not. Excluded files are not read. A file that several paths name is read once.
    """
    parts = []
    for given in [paths] if isinstance(paths, str) else paths:
        wild = bool(_GLOB.search(given))
        if not wild and "://" not in given and not Path(given).exists():
            raise FileNotFoundError(given)
        try:
            df = spark.read.format("binaryFile").load(given if "://" in given else str(Path(given).absolute()))
        except AnalysisException as error:
            if wild and error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        path = F.regexp_replace("path", "^file:/+", "/")
        df = df.select(path.alias("path"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
        below = F.replace("path", F.lit(str(Path(_root(given)).absolute()) + "/" if "://" not in given else _root(given)), F.lit(""))
        parts.append(df.where(~default_ignored(below)) if wild else df)
    if not parts:
        return spark.createDataFrame([], "path string, filename string, text string, error string")
    df = reduce(DataFrame.unionByName, parts).dropDuplicates(["path"])
    df = df.where(~path_excluded(F.col("path"), exclude)) if exclude else df
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return df.select("path", "filename", text.alias("text"), F.when(text.isNull(), "the file is not valid UTF-8").alias("error"))


def git_changes(since: str | None = None, folder: str = ".") -> list[str]:
    """Absolute paths of files that are added, copied, modified or renamed: staged, or since a revision; those that still exist."""
    which = ["--cached"] if since is None else [f"{since}...HEAD"]
    run = lambda *args: subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout
    top = Path(run("rev-parse", "--show-toplevel").strip())
    names = run("diff", "--name-only", "--diff-filter=ACMR", "-z", *which).split("\0")
    return [str(top / n) for n in names if n and (top / n).exists()]


def changed(files: DataFrame, changed_paths: DataFrame, explicit: bool) -> DataFrame:
    """Files among the changed paths; without explicit patterns only those with a known suffix."""
    kept = files.join(changed_paths, "path", "left_semi")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return kept if explicit else kept.where(suffix.isin(V.CHANGED_SUFFIXES))


def labels(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Labels from YAML: documents (path, question_id, expected) and pairs; unknown keys and words are errors."""
    import yaml

    raw = yaml.safe_load(text) or {}
    if extra := set(raw) - LABEL_KEYS:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    docs = [(d["path"], q, e) for d in raw.get("documents") or [] for q, e in d["expect"].items()]
    pairs = [(i, p["before"], p["after"], q, e, p.get("kind")) for i, p in enumerate(raw.get("pairs") or []) for q, e in p["expect"].items()]
    wrong = [x for *_, x in docs if x not in ("present", "absent")] + [p[4] for p in pairs if p[4] not in ("down", "neutral")]
    if wrong:
        raise ValueError(f"unknown labels: {sorted(set(wrong))}")
    for p in raw.get("pairs") or []:
        if more := set(p) - {"before", "after", "expect", "kind", "doc_id", "runs"}:
            raise ValueError(f"unknown keys of a pair: {sorted(more)}")
    return {
        "documents": spark.createDataFrame(docs, "path string, question_id string, expected string"),
        "pairs": spark.createDataFrame(pairs, "pair_id int, before string, after string, question_id string, expected string, kind string")
    }


def preset(text: str) -> list[tuple]:
    """Question rows of a preset in YAML, in the shape of the fixed ones; last comes what else a question has (instructions, max_drop)."""
    import yaml

    raw = yaml.safe_load(text)
    out = []
    for q, c in (raw.get("questions") or {}).items():
        criteria = c.get("criteria") or []
        more = {k: c[k] for k in ("instructions", "max_drop") if k in c}
        out.append(
            (
                raw["name"], q, c["type"], c.get("label"), c.get("weight"), c.get("min_threshold"), c.get("max_threshold"),
                c.get("preflight"), bool(c.get("advisory", False)), list(criteria), more
            )
        )
    return out


def unknown_questions(label_rows: DataFrame, question: DataFrame) -> DataFrame:
    """Labelled ids that the preset lacks, or that are choices; must be empty."""
    return label_rows.join(question.where("type <> 'choice'"), "question_id", "left_anti")


def baseline(spark: SparkSession, path: str, preset_name: str) -> DataFrame:
    """Rows of an earlier JSON report; dry runs and other presets are errors."""
    df = spark.read.json(path, multiLine=True)
    same = F.replace(F.col("preset_name"), F.lit("-"), F.lit("_")) == preset_name.replace("-", "_")
    bad = df.where(F.coalesce(F.col("mock"), F.lit(False)) | ~same).limit(1).count()
    if bad:
        raise ValueError("the baseline is a dry run or has another preset")
    return df


def image_references(text: Column) -> Column:
    """Targets of Markdown and HTML images outside code."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")
    return F.concat(
        F.regexp_extract_all(plain, F.lit(r"!\[[^\]]*\]\(\s*<?([^)\s>]+)"), 1),
        F.regexp_extract_all(plain, F.lit(r"(?i)<img[^>]*\ssrc=[\"']([^\"']+)"), 1)
    )


def pictures(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Image files below folders: path as documents of the folder refer to it, content, length."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(IMAGE_TYPES)}}}")
    parts = []
    for folder in folders:
        root = str(Path(folder).absolute()) + "/"
        below = F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(root), F.lit(""))
        parts.append(reader.load(root).select(below.alias("path"), "content", "length"))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["path"])


def images(docs: DataFrame, files: DataFrame, most: int = IMAGES_EACH) -> DataFrame:
    """First ``most`` usable images of each document, local ones and those written out as data; ``files`` is a binaryFile source with a path relative to the documents."""
    from pyspark.sql import Window

    refs = docs.select("doc_id", F.posexplode(image_references(F.col("text"))).alias("ord", "source")).where(~F.col("source").rlike("^(?i)https?:"))
    inline = r"^data:(image/(?:png|jpeg|gif|webp));base64,([A-Za-z0-9+/=]+)$"
    given = refs.where(F.col("source").rlike(inline)).select(
        "doc_id", "ord", F.lit("data:").alias("source"), F.regexp_extract("source", inline, 1).alias("mime_type"),
        F.floor(F.length(F.regexp_extract("source", inline, 2)) * 3 / 4).alias("byte_size"), F.col("source").alias("data_url")
    )
    kind = F.lower(F.regexp_extract("source", r"\.([^.]+)$", 1))
    mime = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in IMAGE_TYPES.items()])
    found = refs.withColumn("mime_type", mime).where("mime_type is not null").join(files.select(F.col("path").alias("source"), "content", "length"), "source")
    coded = F.concat(F.lit("data:"), "mime_type", F.lit(";base64,"), F.base64("content")).alias("data_url")
    found = found.select(
        "doc_id", "ord", "source", "mime_type", F.col("length").alias("byte_size"), coded
    ).unionByName(given).where(F.col("byte_size") <= IMAGE_BYTES)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return found.withColumn("nth", nth).where(F.col("nth") <= min(most, IMAGES_MOST)).drop("nth")


def score_pairs(raw: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of texts from rows of id, doc_id, before, after (paths or null), before_text, after_text, better, split.

    ``texts`` has path and text. The better side is after unless given; splits count only if every row has one. A path without a text is
    an error of its row.
    """
    side = lambda s: texts.select(F.col("path").alias(s), F.col("text").alias(f"_{s}"))
    joined = raw.join(side("before"), "before", "left").join(side("after"), "after", "left")
    all_split = raw.agg(F.coalesce(F.every(F.coalesce(F.col("split").isin("tuning", "heldout"), F.lit(False))), F.lit(False)).alias("all_split"))
    lost = (F.col("before").isNotNull() & F.col("_before").isNull()) | (F.col("after").isNotNull() & F.col("_after").isNull())
    out = joined.withColumn("_one", F.lit(1)).join(F.broadcast(all_split.withColumn("_one", F.lit(1))), "_one")
    return out.select(
        "id",
        F.coalesce("doc_id", "id").alias("doc_id"),
        F.coalesce("better", F.lit("after")).alias("better"),
        F.when(F.col("all_split"), F.col("split")).alias("split"),
        F.coalesce("_before", "before_text", F.lit("")).alias("before_text"),
        F.coalesce("_after", "after_text", F.lit("")).alias("after_text"),
        F.when(lost, F.lit("missing file")).alias("error"),
    )


def resolved(label_rows: DataFrame, listing: DataFrame, folder: str) -> DataFrame:
    """Add ``file`` to label rows: the path itself if absolute, else below the labels' folder if it is there, else as it stands."""
    near = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("path"))
    there = listing.select(F.col("path").alias("_near")).distinct()
    joined = label_rows.withColumn("_near_path", near).join(there, F.col("_near_path") == F.col("_near"), "left")
    return joined.withColumn("file", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.coalesce("_near", "path"))).drop("_near", "_near_path")
