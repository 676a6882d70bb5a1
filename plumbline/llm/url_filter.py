"""URL verdicts by rules and by a path-template tree, in DataFrame functions only.

The tree has, under each host, the segments of its paths. Building it:

1. Segments that are numbers, hexadecimal or mixed ids are wildcards by their shape ({n}, {x}, {id}), which leaves few distinct paths.
2. Level by level, a node with more than ``most_children`` children that are seen rarely on average (under ``rare`` URLs) gets one wildcard
   child (*).
3. Sibling branches whose labelled purities do not differ become one branch: the children are ranked by purity in steps of 1/64, and a
   step belongs to the branch before it if their 90 % Wilson intervals overlap.
4. A template's purity is the share of bad ones among its labelled URLs, smoothed with ``weight`` (1) URL of its host's purity; a host's is
   the mean of its branches, smoothed with the share over all. Templates of purity ``reject`` or more are rejected.

Labels come with the rows (true: bad, false: good, null: unknown): a rule's verdict, else what the page's own text shows
(:func:`content_label`). No label says anything of a host: a host with a bad name and clean pages is allowed, and a bad branch of any host is
rejected, with the URLs in it that have no label.

Levels are worked on distinct templates, not on URLs. Keys that hold over a thousandth of a join's rows, of which there are at most a
thousand, are joined by broadcast, the others by shuffle, so no host is one task. Segments beyond ``depth`` (6; no URL of the given tables
has more than 3) are one last segment, which the wildcards of step 2 cover like others.

Edge cases: a null URL, or one without ``://``, has an empty host and path; it forms a template like others. Rows that repeat are judged
alike, null ids are carried, other columns are not read. Without any label every verdict that no rule gives is allow. An empty table
gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, materialise, release

STEPS = 64
Z = 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    there = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(there, host).otherwise(""), F.when(there, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting one of ``rules``, pairs of verdict and host/path; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int) -> Column:
    """Segments of a path, wildcards by shape; always at least one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    head = F.slice(parts, 1, depth)
    tail = F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0))), "/")
    cut = F.when(F.size(parts) > depth, F.concat(head, F.array(tail))).otherwise(head)

    def shaped(s: Column) -> Column:
        stem = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1)
        kind = F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}")).when(stem.rlike(r"^[0-9]+([-_.][0-9]+)+$"), F.lit("{n}")).when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{x}")).when(
            stem.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{6,}$"), F.lit("{id}")
        )
        return F.coalesce(F.concat(kind, F.substring(s, F.length(stem) + 1, F.length(s))), s)

    return F.transform(cut, shaped)


def content_label(html: Column, bad_words: tuple[str, ...], least_words: int = 30) -> Column:
    """Whether a page is bad: its visible text has one of ``bad_words`` as a word; good if it has none and at least ``least_words`` words;
    else, and for a null page, unknown."""
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    bad = visible.rlike(r"(?i)(?<!\p{L})(?:" + "|".join(bad_words) + r")(?!\p{L})") if bad_words else F.lit(False)
    return F.when(bad, F.lit(True)).when(F.size(F.split(F.trim(visible), r"\s+")) >= least_words, F.lit(False))


def _wilson(bad: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = bad / n, Z * Z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half


def _branches(children: DataFrame) -> DataFrame:
    """(host, template, step, name) where several children of a node form one branch; at most 65 rows of a node reach a window."""
    known = F.col("bad") + F.col("good")
    low, high = _wilson(F.col("bad"), known)
    ranked = children.where("not wild and bad + good > 0").select("host", "template", "child", low.alias("low"), high.alias("high"), "step")
    steps = ranked.groupBy("host", "template", "step").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("child").alias("first"), F.count(F.lit(1)).alias("size")
    )
    order = Window.partitionBy("host", "template").orderBy("step")
    steps = steps.withColumn("starts", F.coalesce(F.lag("high").over(order) < F.col("low"), F.lit(True)).cast("int"))
    steps = steps.withColumn("branch", F.sum("starts").over(order))
    whole = Window.partitionBy("host", "template", "branch")
    steps = steps.withColumn("all", F.sum("size").over(whole)).withColumn("name", F.concat(F.min("first").over(whole), F.lit("~"), F.col("all").cast("string")))
    return steps.where(F.col("all") > 1).select("host", "template", "step", "name", "size")


def template_tree(urls: DataFrame, depth: int = 6, most_children: int = 16, rare: float = 8.0, weight: float = 1.0) -> DataFrame:
    """``urls``: host, segs (array), bad (boolean or null). One row a distinct (host, raw): template, its counts and purity, and n."""
    raw = urls.groupBy("host", F.col("segs").alias("raw")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad")).alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    tree = materialise(raw.withColumn("rest", F.col("raw")).withColumn("template", F.lit("")))
    rows, levels = tree.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("rest")), F.lit(0)).alias("d")).first()
    for _ in range(levels):
        open_ = tree.withColumn("child", F.try_element_at("rest", F.lit(1)))
        step = F.round(F.col("bad") / F.nullif(F.col("bad") + F.col("good"), F.lit(0)) * STEPS)
        children = open_.where("child is not null").groupBy("host", "template", "child").agg(
            *[F.sum(c).alias(c) for c in ("n", "bad", "good")], F.count(F.lit(1)).alias("raws")
        ).withColumn("step", F.coalesce(step, F.lit(-1)))
        children = materialise(children)
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
        nodes = nodes.withColumn("wild", (F.col("kinds") > most_children) & (F.col("all") / F.col("kinds") < rare))
        marked = hot_join(children, nodes, ["host", "template"], "kinds", rows, F.col("child"))
        named = hot_join(marked, _branches(marked), ["host", "template", "step"], "size", rows, F.col("child"))
        name = F.when(F.col("wild"), F.lit("*")).otherwise(F.coalesce("name", "child"))
        names = materialise(named.select("host", "template", "child", "raws", name.alias("part")))
        step = hot_join(open_, names, ["host", "template", "child"], "raws", rows, F.col("raw"))
        template = F.when(F.col("child").isNotNull(), F.concat("template", F.lit("/"), "part")).otherwise(F.col("template"))
        before, tree = tree, materialise(
            step.select(
                "host", "raw", "n", "bad", "good", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"),
                template.alias("template")
            )
        )
        release(before, children, names)
    whole = tree.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    known = (whole["bad"] or 0) + (whole["good"] or 0)
    prior = whole["bad"] / known if known else 0.0
    templates = materialise(tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")], F.count(F.lit(1)).alias("raws")))
    own = (F.col("bad") + weight * prior) / (F.col("bad") + F.col("good") + weight)
    hosts = templates.groupBy("host").agg(((F.sum(own) + prior) / (F.count(F.lit(1)) + 1)).alias("host_purity"), F.count(F.lit(1)).alias("templates"))
    judged = hot_join(templates, hosts, ["host"], "templates", rows, F.col("template")).withColumn(
        "purity", (F.col("bad") + weight * F.col("host_purity")) / (F.col("bad") + F.col("good") + weight)
    )
    judged = judged.select("host", "template", "purity", F.col("n").alias("template_urls"), "raws")
    return hot_join(tree.select("host", "raw", "template", "n"), judged, ["host", "template"], "raws", rows, F.col("raw"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], label: Column | None = None, reject: float = 0.7, depth: int = 6,
    id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """host, path, rule, verdict, template, purity and template_urls of every row; ``label`` says whether a row that no rule fits is bad."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), (label if label is not None else F.lit(None).cast("boolean")).alias("bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", "bad", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path"), depth).alias("raw"))
    tree = materialise(template_tree(rows.select("host", F.col("raw").alias("segs"), F.coalesce(F.col("ruled") == "block", "bad").alias("bad")), depth))
    total = tree.agg(F.sum("n")).first()[0] or 0
    found = hot_join(rows.drop("bad"), tree, ["host", "raw"], "n", total, F.struct(id_col, "path"))
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise("allow")
    return found.select(id_col, "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity", "template_urls")
