"""Named queries over the standard tables, and the same questions in SQL.

Values that a decision provider would give are derived from ids (``VALUE``), so that both engines have the same ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import evaluate
from ..functions import batches
from ..functions import features as X
from ..functions import fixed as V
from ..operators import baseline, chunks, corpus, decide, gate, report, spans, stats, validate
from ..sources import files, hooks
from ..streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]*[a-zA-Z0-9]"
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
_EXAMPLE_IP = r"^(127\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)"
TOKEN = r'(?i)token\s*=\s*"[^"\n]*"'


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches.bounded(spark)  # a step on a column knows the active session only, which need not be the query's
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple], columns: str) -> str:
    show = lambda v: "NULL" if v is None else "true" if v is True else "false" if v is False else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows) + f") AS t({columns})"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(column: str, values: list) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else "NULL" if v is None else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"


# Spans and features


@query(
    "q_email_features",
    f"""
    WITH m AS (SELECT lang, unnest(regexp_extract_all(text, '{EMAIL}')) AS v FROM documents),
    f AS (SELECT lang, lower(split_part(v, '@', 1)) AS l, lower(split_part(v, '@', 2)) AS d FROM m)
    SELECT lang, CASE WHEN d IN ({_quoted(V.FREE_MAIL)}) THEN 'free_mail' ELSE 'corporate' END AS domain_type,
           CASE WHEN contains(l, '.') THEN 'dotted_name' WHEN contains(l, '-') THEN 'hyphenated' ELSE 'single_word' END AS shape,
           l IN ({_quoted(V.ROLE_WORDS)}) OR {" OR ".join(f"starts_with(l, '{a}') OR ends_with(l, '{a}')" for a in V.ROLE_AFFIXES)} AS role, count(*) AS n
    FROM f GROUP BY ALL""",
)
def q_email_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), 0)).alias("v"))
    v = F.col("v")
    return m.groupBy(
        "lang", X.email_domain_type(v).alias("domain_type"), X.email_shape(v).alias("shape"), X.email_role(v).alias("role")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_ip_features",
    rf"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{IPV4}')) AS v FROM documents),
    o AS (SELECT doc_id, v, list_transform(string_split(v, '.'), lambda x: CAST(x AS BIGINT)) AS a FROM m),
    n AS (SELECT doc_id, v, ((a[1] * 256 + a[2]) * 256 + a[3]) * 256 + a[4] AS n, a FROM o WHERE a[1] <= 255 AND a[2] <= 255 AND a[3] <= 255 AND a[4] <= 255)
    SELECT CASE WHEN starts_with(v, '192.0.2.') OR starts_with(v, '198.51.100.') OR starts_with(v, '203.0.113.') THEN 'documentation'
                WHEN a[1] = 127 THEN 'loopback'
                WHEN a[1] IN (0, 10) OR a[1] >= 240 OR (a[1] = 169 AND a[2] = 254) OR (a[1] = 172 AND a[2] BETWEEN 16 AND 31)
                  OR (a[1] = 192 AND a[2] = 168) OR (a[1] = 192 AND a[2] = 0 AND a[3] = 0) OR (a[1] = 198 AND a[2] IN (18, 19)) THEN 'private'
                ELSE 'public' END AS ip_type, count(*) AS n, count(DISTINCT v) AS addresses
    FROM n GROUP BY 1""",
)
def q_ip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(IPV4), 0)).alias("v"))
    return m.withColumn("ip_type", X.ipv4_type(F.col("v"))).where("ip_type is not null").groupBy("ip_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("addresses")
    )


_OFFLINE = f"""
    WITH m AS (
      SELECT doc_id, lang, 'email' AS kind, 'undecided' AS outcome, unnest(regexp_extract_all(text, '{EMAIL}')) AS v FROM documents
      UNION ALL SELECT doc_id, lang, 'secret', 'undecided', unnest(regexp_extract_all(text, '{TOKEN}')) FROM documents
      UNION ALL SELECT doc_id, lang, 'ip', CASE WHEN regexp_matches(v, '^(10|0|127)\\.|^192\\.168\\.|^172\\.(1[6-9]|2\\d|3[01])\\.|^169\\.254\\.|^198\\.1[89]\\.|^2[45]\\d\\.') AND NOT starts_with(v, '127.') THEN 'sensitive' ELSE 'safe' END, v
        FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{IPV4}')) AS v FROM documents))"""


@query("q_offline_gate", _OFFLINE + " SELECT lang, kind, outcome, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM m GROUP BY ALL")
def q_offline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.candidates(table(spark, sf_dir, "documents"), keep=("doc_id", "lang"))
    return found.groupBy("lang", "kind", decide.offline_outcome().alias("outcome")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("doc_id").alias("documents")
    )


@query(
    "q_violations_by_lang",
    _OFFLINE + """ SELECT d.lang, count(*) AS documents, count(DISTINCT x.doc_id) AS failing
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM m WHERE outcome IN ('personal', 'sensitive', 'secret')) x ON d.doc_id = x.doc_id GROUP BY d.lang""",
)
def q_violations_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    bad = F.exists(
        spans.scan(F.col("text"))["spans"],
        lambda s: F.when(
            s["kind"] == "email", s["domain_type"] == "free_mail"
        ).when(s["kind"] == "credential", ~s["is_example"]).when(s["kind"] == "phone", ~s["looks_like_support"]).when(s["kind"] == "ip", s["ip_type"] == "private").when(s["kind"] == "url", s["is_internal_tld"]).otherwise(False)
    )
    return docs.withColumn("bad", bad).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if("bad").alias("failing"))


@query("q_mock_outcomes", f"""
    WITH m AS (SELECT 'email' AS kind, 0.8 AS p, unnest(regexp_extract_all(text, '{EMAIL}')) AS v FROM documents
      UNION ALL SELECT 'secret', 0.88, unnest(regexp_extract_all(text, '{TOKEN}')) FROM documents)
    SELECT kind, CAST(p AS DOUBLE) AS probability, CASE kind WHEN 'email' THEN 'personal' ELSE 'secret' END AS outcome, false AS near_threshold, count(*) AS n FROM m GROUP BY ALL""")
def q_mock_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.candidates(table(spark, sf_dir, "documents")).where(F.col("kind").isin("email", "secret")).withColumn(
        "probability", decide.mock_probability()
    )
    p = F.col("probability")
    return found.groupBy(
        "kind", "probability", decide.online_outcome(p).alias("outcome"), decide.near_half(p).alias("near_threshold")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("q_candidate_questions", f"""
    WITH m AS (SELECT doc_id, 'email' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(text, '{EMAIL}'), lambda x: lower(x)))) AS v FROM documents
      UNION ALL SELECT doc_id, 'ip', unnest(list_filter(list_distinct(regexp_extract_all(text, '{IPV4}')), lambda v: NOT regexp_matches(v, '{_EXAMPLE_IP}'))) FROM documents
      UNION ALL SELECT doc_id, 'secret', unnest(regexp_extract_all(text, '{TOKEN}')) FROM documents),
    n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
    SELECT doc_id, n AS questions, CAST((n + {V.BATCH - 1}) // {V.BATCH} AS BIGINT) AS requests FROM n""")
def q_candidate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = decide.candidate_questions(spans.distinct_candidates(spans.candidates(table(spark, sf_dir, "documents"))))
    return asked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"), (F.max("batch") + 1).cast("long").alias("requests"))


@query(
    "q_url_features",
    f"""
    WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages)
    SELECT host IN ({_quoted(V.EXAMPLE_DOMAINS)}) OR starts_with(host, 'example.') OR starts_with(host, 'api.example.') OR {" OR ".join(f"ends_with(host, '{e}')" for e in V.EXAMPLE_ENDINGS)} AS is_example,
           {" OR ".join(f"ends_with(host, '{e}')" for e in V.INTERNAL_ENDINGS)} AS is_internal, host = 'github.com' OR ends_with(host, '.github.com') AS is_public_common, count(*) AS n, count(DISTINCT host) AS hosts
    FROM h GROUP BY ALL""",
)
def q_url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").select(X.url_host(F.col("url")).alias("host"))
    host = F.col("host")
    return h.groupBy(
        X.url_is_example(host).alias("is_example"), X.url_is_internal(host).alias("is_internal"),
        X.url_is_public_common(host).alias("is_public_common")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("hosts"))


@query("q_comment_strip", r"""
    SELECT page_id, sha256(regexp_replace(html, '<!--(?s:.*?)-->', '', 'g')) AS stripped_sha256, length(html) <> length(regexp_replace(html, '<!--(?s:.*?)-->', '', 'g')) AS changed
    FROM pages WHERE NOT contains(html, '`') AND NOT contains(html, '~~~')""")
def q_comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the SQL leaves out those with code, as its pattern would cut the comments there."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", chunks.strip_comments(F.col("html")).alias("s"))
    return p.select("page_id", F.sha2("s", 256).alias("stripped_sha256"), (F.length("html") != F.length("s")).alias("changed"))


# Chunks


@query("q_guard_length", r"""
    SELECT doc_id, sha256(CASE WHEN length(text) > 2000 THEN left(text, 1000) || chr(10) || chr(10) || '... [TRUNCATED ' || CAST(length(text) - 2000 AS VARCHAR) || ' CHARACTERS TO PREVENT TOKEN OVERFLOW] ...' || chr(10) || chr(10) || right(text, 1000) ELSE text END) AS guarded_sha256,
           length(text) > 2000 AS was_truncated FROM documents""")
def q_guard_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(chunks.guarded(t, 2000), 256).alias("guarded_sha256"), (F.length(t) > 2000).alias("was_truncated")
    )


@query("q_chunk_plan", """
    WITH p AS (SELECT lang, length(text) AS n FROM documents)
    SELECT lang, n > 2000 AS was_truncated, CAST(CASE WHEN n > 2000 THEN ceil((n - 200) / 1800.0) ELSE 1 END AS INTEGER) AS chunks,
           CAST(CASE WHEN n > 2000 THEN ceil((n - 200) / 1800.0) + 1 ELSE 1 END AS INTEGER) AS planned_calls, count(*) AS documents FROM p GROUP BY ALL""")
def q_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("lang", chunks.chunk_plan(F.length("text"), True, True, 2000, 200).alias("p")).select("lang", "p.*")
    return p.groupBy("lang", "was_truncated", "chunks", "planned_calls").agg(F.count(F.lit(1)).alias("documents"))


# Gate


_ASKED = [(q[1], float(i)) for i, q in enumerate(V.QUESTIONS) if q[0] == "design_doc"]
_GATE = [
    (q[1], i, q[4], q[5], q[6], q[8], q[0] in V.WARN_ONLY) for i,
    q in enumerate(V.QUESTIONS) if q[0] in ("safety", "quality", "tech-spec") and q[2] != "choice"
]
_GATE_SQL = "WITH a AS (SELECT doc_id, q, w, lo, hi, adv OR warn AS warns, ((doc_id * 37 + i * 11) % 101) / 100.0::DOUBLE AS v FROM labels, " + _values(
    _GATE, "q, i, w, lo, hi, adv, warn"
) + ")"


def _gate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(q[0]).alias("question_id"), F.lit(q[1]).alias("i")) for q in _GATE])
    a = table(spark, sf_dir, "labels").select("doc_id", F.inline(rows))
    return a.select("doc_id", "question_id", (((F.col("doc_id") * 37 + F.col("i") * 11) % 101) / 100.0).alias("value"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gated(_gate_answers(spark, sf_dir), gate.questions(spark).where(F.col("preset").isin("safety", "quality", "tech-spec")))


@query("q_threshold_gate", _GATE_SQL + """
    SELECT q AS question_id, CASE WHEN v < lo THEN 'below_min' WHEN v > hi THEN 'above_max' END AS breach,
           CASE WHEN v < lo OR v > hi THEN CASE WHEN warns THEN 'warning' ELSE 'error' END END AS level, count(*) AS n FROM a GROUP BY ALL""")
def q_threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("question_id", "breach", "level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_near_threshold",
    _GATE_SQL + " SELECT q AS question_id, coalesce(abs(v - lo) <= 0.1 + 1e-9, false) OR coalesce(abs(v - hi) <= 0.1 + 1e-9, false) AS near_threshold, count(*) AS n FROM a GROUP BY ALL"
)
def q_near_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("question_id", "near_threshold").agg(F.count(F.lit(1)).alias("n"))


@query("q_composite", _GATE_SQL + " SELECT doc_id, round(sum(v * w) / sum(w), 6) AS composite FROM a GROUP BY doc_id")
def q_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.composite(_gated(spark, sf_dir)).select("doc_id", F.round("composite", 6).alias("composite"))


@query("q_verdicts", _GATE_SQL + """
    SELECT doc_id, count(*) FILTER (WHERE (v < lo OR v > hi) AND NOT warns) AS violations, count(*) FILTER (WHERE (v < lo OR v > hi) AND warns) AS warnings,
           count(*) FILTER (WHERE (v < lo OR v > hi) AND NOT warns) = 0 AS passed FROM a GROUP BY doc_id""")
def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.verdicts(_gated(spark, sf_dir))


@query("q_exit_code", _GATE_SQL + " SELECT CASE WHEN count(*) FILTER (WHERE (v < lo OR v > hi) AND NOT warns) > 0 THEN 1 ELSE 0 END AS exit_code FROM a")
def q_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = gate.verdicts(_gated(spark, sf_dir)).agg(F.sum("violations").alias("v"))
    return v.select(gate.exit_code(F.col("v"), F.lit(0)).alias("exit_code"))


@query(
    "q_score_normalise",
    "SELECT linenumber_score AS score, round(least(greatest(linenumber_score / 3.0, 0), 1), 6) AS normalised, count(*) AS n FROM (SELECT l_linenumber - 2 AS linenumber_score FROM lineitem) GROUP BY ALL"
)
def q_score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 2).alias("score"))
    return s.groupBy("score", F.round(gate.normalised_score(F.col("score"), 4), 6).alias("normalised")).agg(F.count(F.lit(1)).alias("n"))


# Validation


_RUNS = "SELECT l.doc_id, l.quality, r.run, ((l.doc_id * 37 + r.run * 7) % 101) / 100.0::DOUBLE AS v FROM labels l, (VALUES (0), (1), (2)) AS r(run)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("run"))
    return r.withColumn("value", ((F.col("doc_id") * 37 + F.col("run") * 7) % 101) / 100.0).withColumn(
        "question_id", F.concat(F.lit("q"), (F.col("doc_id") % 3).cast("string"))
    )


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("q"), (F.col("doc_id") % 3).cast("string")).alias("question_id"),
        F.when(F.col("quality") == 1, "present").otherwise("absent").alias("expected")
    )


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = spark.createDataFrame(
        [("q0", 0.5, None), ("q1", None, 0.3), ("q2", None, None)], "question_id string, min_threshold double, max_threshold double"
    )
    return validate.presence(_runs(spark, sf_dir), _expected(spark, sf_dir), question)


_PRESENCE = f"""
    WITH r AS ({_RUNS}),
    z AS (SELECT doc_id, 'q' || CAST(doc_id % 3 AS VARCHAR) AS question_id, quality, bool_and(CASE WHEN doc_id % 3 = 1 THEN v <= 0.3 ELSE v < 0.5 END) AS all_absent, bool_or(CASE WHEN doc_id % 3 = 1 THEN v <= 0.3 ELSE v < 0.5 END) AS any_absent, max(v) - min(v) AS spread FROM r GROUP BY ALL),
    x AS (SELECT doc_id, question_id, CASE quality WHEN 1 THEN 'present' ELSE 'absent' END AS expected,
                 CASE WHEN quality = 1 THEN CASE WHEN any_absent THEN 'false_alarm' ELSE 'correct_present' END ELSE CASE WHEN all_absent THEN 'detected' ELSE 'missed' END END AS verdict, spread FROM z)"""


@query("q_presence_verdict", _PRESENCE + " SELECT doc_id, question_id, expected, verdict, round(spread, 6) AS spread FROM x")
def q_presence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _presence(spark, sf_dir).withColumn("spread", F.round("spread", 6))


@query("q_presence_raised", f"""
    WITH r AS ({_RUNS}),
    u AS (SELECT doc_id, quality, CASE WHEN (doc_id + run) % 5 = 0 THEN greatest(v, 1.0) WHEN doc_id % 7 = 0 THEN NULL ELSE v END AS v FROM r),
    z AS (SELECT doc_id, 'q' || CAST(doc_id % 3 AS VARCHAR) AS question_id, quality, bool_and(CASE WHEN doc_id % 3 = 1 THEN v <= 0.3 ELSE v < 0.5 END) AS all_absent, bool_or(CASE WHEN doc_id % 3 = 1 THEN v <= 0.3 ELSE v < 0.5 END) AS any_absent FROM u WHERE v IS NOT NULL GROUP BY ALL)
    SELECT doc_id, question_id, CASE WHEN quality = 1 THEN CASE WHEN any_absent THEN 'false_alarm' ELSE 'correct_present' END ELSE CASE WHEN all_absent THEN 'detected' ELSE 'missed' END END AS verdict FROM z""")
def q_presence_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan found counts as 1 before the verdict, also where the model gave no answer."""
    runs = _runs(spark, sf_dir)
    found = runs.where("(doc_id + run) % 5 = 0")
    answers = validate.raised(runs.withColumn("value", F.when(F.col("doc_id") % 7 != 0, F.col("value"))), found)
    question = spark.createDataFrame(
        [("q0", 0.5, None), ("q1", None, 0.3), ("q2", None, None)], "question_id string, min_threshold double, max_threshold double"
    )
    return validate.presence(answers, _expected(spark, sf_dir), question).select("doc_id", "question_id", "verdict")


@query(
    "q_lost_answers",
    "SELECT doc_id, 'q' || CAST(doc_id % 3 AS VARCHAR) AS question_id, run FROM labels, (VALUES (0), (1), (2)) AS r(run) WHERE (doc_id + run) % 4 = 0"
)
def q_lost_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.lost_answers(_runs(spark, sf_dir).where("(doc_id + run) % 4 <> 0"), _expected(spark, sf_dir), 3)


@query("q_question_stats", _PRESENCE + """
    SELECT question_id, count(*) FILTER (WHERE verdict = 'detected') AS detected, count(*) FILTER (WHERE expected = 'absent') AS n_absent, count(*) FILTER (WHERE verdict = 'false_alarm') AS false_alarms,
           count(*) FILTER (WHERE expected = 'present') AS n_present, round(max(spread), 6) AS max_spread FROM x GROUP BY question_id""")
def q_question_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.question_stats(_presence(spark, sf_dir)).withColumn("max_spread", F.round("max_spread", 6))


@query("q_validation_summary", _PRESENCE + """
    SELECT round(count(*) FILTER (WHERE verdict = 'detected') / count(*) FILTER (WHERE expected = 'absent'), 6) AS detection_rate,
           round(count(*) FILTER (WHERE verdict = 'false_alarm') / count(*) FILTER (WHERE expected = 'present'), 6) AS false_alarm_rate FROM x""")
def q_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validate.summary(validate.question_stats(_presence(spark, sf_dir)))
    return s.select(F.round("detection_rate", 6).alias("detection_rate"), F.round("false_alarm_rate", 6).alias("false_alarm_rate"))


_T = "CASE " + " ".join(f"WHEN n - 1 >= {k} THEN {V.T_TABLE[k]}" for k in sorted(V.T_TABLE, reverse=True)) + f" ELSE {V.T_NONE} END"


@query("q_mean_ci95", f"""
    WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT event_type, n, round(m, 6) AS mean, round(m - {_T} * sd / sqrt(n), 6) AS low, round(m + {_T} * sd / sqrt(n), 6) AS high FROM g""")
def q_mean_ci95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_ci(table(spark, sf_dir, "events"), ["event_type"], "value").select(
        "event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")]
    )


_CRITERIA = validate.Criteria(
    min_detected=0.1, max_false_alarms=40, max_neutral_delta=0.02, min_degradation_drop=0.001, max_spread=0.2, group_by="kind", degradation_ci_upper_max=0.0,
    neutral_ci_abs_max=0.05, pair_guard_neutral_abs_max=0.011, report_only_kinds=("paraphrase",), per_pair_kinds=("swap",),
)
#: Runs of pairs: two of five lose a run, one of eleven is cut. Kinds and what is expected go by the id.
_PAIR_PARTS = f"""
    e AS (SELECT doc_id AS pair_id, CASE doc_id % 4 WHEN 0 THEN 'shuffled' WHEN 1 THEN 'padded' WHEN 2 THEN 'swap' ELSE 'paraphrase' END AS kind,
                 CASE WHEN doc_id % 4 < 2 THEN 'down' ELSE 'neutral' END AS expected, run, v AS b,
                 CASE WHEN (doc_id + run) % 10 = 3 THEN NULL WHEN doc_id % 4 < 2 THEN v * 0.5 ELSE v + (run - 1) / 64.0 + 0.01 END AS a FROM r),
    m AS (SELECT pair_id, kind, expected, count(a) AS n, coalesce(avg(a - b), 0) AS mean_delta, coalesce(stddev_samp(a - b), 0) AS sd, pair_id % 11 = 0 AS was_truncated FROM e GROUP BY ALL),
    p AS (SELECT *, n < 3 AS incomplete, mean_delta - CASE WHEN n > 1 THEN {_T} * sd / sqrt(n) ELSE 0 END AS low, mean_delta + CASE WHEN n > 1 THEN {_T} * sd / sqrt(n) ELSE 0 END AS high,
                 CASE WHEN expected = 'down' THEN mean_delta <= 0 ELSE abs(mean_delta) <= 0.011 END AS guard_ok FROM m),
    k AS (SELECT kind, expected, count(*) AS n, avg(mean_delta) AS mean, coalesce(stddev_samp(mean_delta), 0) AS sd FROM p WHERE NOT incomplete AND NOT was_truncated AND kind <> 'swap' GROUP BY ALL),
    kc AS (SELECT kind, expected, n, mean, mean - CASE WHEN n > 1 THEN {_T} * sd / sqrt(n) ELSE 0 END AS low, mean + CASE WHEN n > 1 THEN {_T} * sd / sqrt(n) ELSE 0 END AS high FROM k),
    g AS (SELECT kind, expected, n, mean, low, high, CASE WHEN n < 6 OR kind = 'paraphrase' THEN NULL WHEN expected = 'down' THEN high < 0 ELSE greatest(abs(low), abs(high)) <= 0.05 END AS passed FROM kc
          UNION ALL SELECT kind, expected, n, mean_delta, low, high, CASE WHEN incomplete OR was_truncated THEN NULL ELSE greatest(abs(low), abs(high)) <= 0.05 END FROM p WHERE kind = 'swap')"""
_PAIRS = f"WITH r AS ({_RUNS}), {_PAIR_PARTS}"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).withColumn("question_id", F.lit("clarity"))
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "shuffled").when(k == 1, "padded").when(k == 2, "swap").otherwise("paraphrase")
    pair = F.col("doc_id").alias("pair_id")
    path = lambda side: F.concat(F.lit(f"{side}/"), F.col("doc_id").cast("string"), F.lit(".md")).alias(f"{side}_path")
    labels = table(spark, sf_dir, "labels").select(
        pair, F.lit("clarity").alias("question_id"), F.when(k < 2, "down").otherwise("neutral").alias("expected"), kind.alias("kind"),
        F.lit(None).cast("string").alias("doc_id"), path("before"), path("after"), F.lit(3).alias("runs")
    )
    cut = (F.col("doc_id") % 11 == 0).alias("was_truncated")
    before = r.select(pair, "question_id", "run", "value", cut)
    value = F.when((F.col("doc_id") + F.col("run")) % 10 != 3, F.when(k < 2, F.col("value") * 0.5).otherwise(F.col("value") + (F.col("run") - 1) / 64.0 + 0.01))
    after = r.select(pair, "question_id", "run", value.alias("value"), F.lit(False).alias("was_truncated"))
    return validate.pair_results(labels, before, after, _CRITERIA)


@query(
    "q_pair_delta",
    _PAIRS + " SELECT pair_id, kind, expected, CAST(n AS INTEGER) AS n, round(mean_delta, 6) AS mean_delta, round(low, 6) AS low, round(high, 6) AS high, incomplete, was_truncated, guard_ok FROM p"
)
def q_pair_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(
        "pair_id", "kind", "expected", "n", *[F.round(c, 6).alias(c) for c in ("mean_delta", "low", "high")], "incomplete", "was_truncated",
        "guard_ok"
    )


@query(
    "q_active_pairs",
    _PAIRS + " SELECT kind, count(*) AS pairs, count(*) FILTER (WHERE NOT incomplete AND NOT was_truncated) AS active FROM p GROUP BY kind"
)
def q_active_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(validate.active()).alias("active"))


@query(
    "q_pair_groups",
    _PAIRS + " SELECT kind, 'clarity' AS question_id, expected, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, passed FROM g WHERE kind <> 'swap'"
)
def q_pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = validate.groups(_pairs(spark, sf_dir), _CRITERIA).where("kind <> 'swap'")
    return g.select("kind", "question_id", "expected", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "passed")


@query(
    "q_pair_ci_gate",
    _PAIRS + " SELECT 'after/' || CAST(pair_id AS VARCHAR) || '.md' AS pair, n, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN incomplete OR was_truncated THEN NULL ELSE greatest(abs(low), abs(high)) <= 0.05 END AS passed FROM p WHERE kind = 'swap'"
)
def q_pair_ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the kind that is gated pair by pair, each on the interval of its own runs."""
    g = validate.groups(_pairs(spark, sf_dir), _CRITERIA).where("kind = 'swap'")
    return g.select(F.col("worst_pair").alias("pair"), "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "passed")


@query("q_pair_question_stats", _PAIRS + f"""
    , s AS (SELECT count(*) AS n, avg(mean_delta) AS m, coalesce(stddev_samp(mean_delta), 0) AS sd FROM p WHERE NOT incomplete AND NOT was_truncated)
    SELECT 'clarity' AS question_id, n AS pairs, round(m, 6) AS mean_delta, round(m - {_T} * sd / sqrt(n), 6) AS low, round(m + {_T} * sd / sqrt(n), 6) AS high FROM s""")
def q_pair_question_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validate.question_stats(_presence(spark, sf_dir), _pairs(spark, sf_dir)).where("question_id = 'clarity'")
    return s.select("question_id", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_delta", "low", "high")])


@query("q_criteria", _PRESENCE + "," + _PAIR_PARTS + """
    SELECT 'min_detected (rate)' AS criterion, (SELECT coalesce(count(*) FILTER (WHERE verdict = 'detected') / nullif(count(*) FILTER (WHERE expected = 'absent'), 0) >= 0.1, false) FROM x) AS passed
    UNION ALL SELECT 'max_false_alarms', (SELECT count(*) FILTER (WHERE verdict = 'false_alarm') <= 40 FROM x)
    UNION ALL SELECT 'max_neutral_delta', (SELECT coalesce(max(abs(mean_delta)) <= 0.02, false) FROM p WHERE expected = 'neutral' AND NOT incomplete AND NOT was_truncated AND kind <> 'paraphrase')
    UNION ALL SELECT 'min_degradation_drop', (SELECT coalesce(max(mean_delta) <= -0.001, false) FROM p WHERE expected = 'down' AND NOT incomplete AND NOT was_truncated)
    UNION ALL SELECT 'degradation_ci_upper_max', (SELECT count(*) > 0 AND count(*) FILTER (WHERE passed = false) = 0 FROM g WHERE expected = 'down')
    UNION ALL SELECT 'neutral_ci_abs_max', (SELECT count(*) > 0 AND count(*) FILTER (WHERE passed = false) = 0 FROM g WHERE expected = 'neutral')
    UNION ALL SELECT 'pair_guard_neutral_abs_max', (SELECT count(*) > 0 AND count(*) FILTER (WHERE NOT guard_ok) = 0 FROM p WHERE NOT incomplete AND NOT was_truncated AND kind <> 'paraphrase')
    UNION ALL SELECT 'max_spread', (SELECT max(spread) <= 0.2 FROM x)""")
def q_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    rows = validate.criteria_rows(validate.question_stats(_presence(spark, sf_dir), pairs), pairs, validate.groups(pairs, _CRITERIA), _CRITERIA)
    return rows.select("criterion", "passed")


@query("q_guard_note", _PAIRS + """
    , w AS (SELECT CAST(pair_id AS VARCHAR) || '.md (' || CASE WHEN mean_delta < 0 THEN '' ELSE '+' END || printf('%.3f', mean_delta) || ')' AS shown, row_number() OVER (ORDER BY pair_id) AS nth
            FROM p WHERE NOT incomplete AND NOT was_truncated AND kind <> 'paraphrase' AND NOT guard_ok)
    SELECT coalesce(string_agg(shown, ', ' ORDER BY nth), 'all pairs are within the guard') AS note FROM w WHERE nth <= 3""")
def q_guard_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note names the first three pairs outside the guard."""
    pairs = _pairs(spark, sf_dir)
    rows = validate.criteria_rows(validate.question_stats(_presence(spark, sf_dir), pairs), pairs, validate.groups(pairs, _CRITERIA), _CRITERIA)
    return rows.where("criterion = 'pair_guard_neutral_abs_max'").select("note")


@query("q_worst_pair", _PAIRS + """
    , w AS (SELECT kind, pair_id, NOT incomplete AND NOT was_truncated AS counts, CASE WHEN expected = 'down' THEN mean_delta ELSE abs(mean_delta) END AS k, mean_delta FROM p)
    SELECT kind, pair_id, round(mean_delta, 6) AS worst_delta FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY counts DESC, round(k, 9) DESC, pair_id) AS n FROM w) WHERE n = 1""")
def q_worst_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumn("mean_delta", F.round("mean_delta", 9))
    return validate.worst_pairs(pairs).select("kind", "pair_id", F.round("worst_delta", 6).alias("worst_delta"))


@query(
    "q_choice_distribution",
    "SELECT role AS question_id, choice, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY role), 4) AS percent FROM (SELECT role, CASE conv_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS choice FROM conversations) GROUP BY role, choice"
)
def q_choice_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = F.when(F.col("conv_id") % 3 == 0, "a").when(F.col("conv_id") % 3 == 1, "b").otherwise("c")
    return validate.choice_distribution(table(spark, sf_dir, "conversations").select(F.col("role").alias("question_id"), choice.alias("choice")))


# Statistics


_SCORES = "WITH s AS (SELECT d.doc_id, d.lang, l.quality, round(len(list_distinct(string_split(d.text, ' '))) * 1.0 / len(string_split(d.text, ' ')), 2) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.round(F.size(F.array_distinct(words)) * 1.0 / F.size(words), 2).alias("score"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("q_roc_auc", _SCORES + """
    , c AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q FROM s GROUP BY score),
    b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(q) AS BIGINT) AS n_negative, round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 4) AS auc FROM b""")
def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.roc_auc(_scores(spark, sf_dir).withColumn("good", F.col("quality") == 1), [], "score", "good")


@query("q_feasibility_by_lang", _SCORES + """
    , c AS (SELECT lang, score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q FROM s GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    a AS (SELECT lang, sum(p) AS p, sum(q) AS q, CASE WHEN sum(p) = 0 OR sum(q) = 0 THEN 0.5 ELSE round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 4) END AS auc FROM b GROUP BY lang)
    SELECT lang, CAST(p AS BIGINT) AS n_positive, CAST(q AS BIGINT) AS n_negative, auc, auc >= 0.75 AS feasible FROM a""")
def q_feasibility_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.roc_auc(
        _scores(spark, sf_dir).withColumn("good", F.col("quality") == 1), ["lang"], "score", "good"
    ).withColumn("feasible", F.col("auc") >= 0.75)


@query("q_false_alarm", _SCORES + """
    , t AS (SELECT coalesce(median(score), 0.5) AS threshold FROM s WHERE quality = 0 AND doc_id % 2 = 0)
    SELECT round(threshold, 6) AS threshold, round(avg(CASE WHEN score <= threshold THEN 1.0 ELSE 0.0 END), 6) AS false_alarm_rate FROM s, t WHERE quality = 1 AND doc_id % 2 = 1 GROUP BY threshold""")
def q_false_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    found = stats.quantiles(s.where("quality = 0 and doc_id % 2 = 0"), [], "score", 0.5, "threshold")
    threshold = found.agg(F.coalesce(F.max("threshold"), F.lit(0.5)).alias("threshold")).withColumn("one", F.lit(1))
    held = s.where("quality = 1 and doc_id % 2 = 1").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    joined = held.join(F.broadcast(threshold), "one")  # one row
    return joined.groupBy("threshold").agg(
        F.round(F.sum(F.when(F.col("score") <= F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("false_alarm_rate")
    ).withColumn("threshold", F.round("threshold", 6))


_SCORE_PAIRS = "SELECT doc_id, quality, doc_id % 2 = 1 AS is_holdout, ((doc_id * 37) % 101) / 200.0::DOUBLE + 0.45 AS better_score, ((doc_id * 53) % 101) / 200.0::DOUBLE AS worse_score FROM labels"


@query("q_feasibility", f"""
    WITH s AS ({_SCORE_PAIRS}), t AS (SELECT quality, median(worse_score) AS t FROM s WHERE NOT is_holdout GROUP BY quality), h AS (SELECT * FROM s WHERE is_holdout),
    a AS (SELECT b.quality, round(avg(CASE WHEN b.better_score > w.worse_score THEN 1.0 WHEN b.better_score = w.worse_score THEN 0.5 ELSE 0.0 END), 4) AS auc FROM h b JOIN h w ON b.quality = w.quality GROUP BY b.quality),
    f AS (SELECT h.quality, round(avg(CASE WHEN better_score <= coalesce(t.t, 0.5) THEN 1.0 ELSE 0.0 END), 4) AS false_alarm_rate, count(*) AS n_held_out FROM h LEFT JOIN t ON h.quality = t.quality GROUP BY h.quality)
    SELECT a.quality, auc, false_alarm_rate, n_held_out, auc >= 0.75 AND false_alarm_rate <= 0.10 AS feasible FROM a JOIN f ON a.quality = f.quality""")
def q_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pairs = table(spark, sf_dir, "labels").select(
        "quality", (d % 2 == 1).alias("is_holdout"), ((d * 37) % 101 / 200.0 + 0.45).alias("better_score"),
        ((d * 53) % 101 / 200.0).alias("worse_score")
    )
    return stats.feasibility(pairs, ["quality"])


@query("q_seeded_hold_out", """
    WITH i AS (SELECT DISTINCT source, sha256('holdout:' || source) AS h FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY h) AS r, count(*) OVER () AS n FROM i)
    SELECT source, r <= least(greatest(round_even(n * 0.3, 0), 1), n - 1) AS held_out, r > least(greatest(round_even(n * 0.3, 0), 1), n - 1) AS tuning FROM o""")
def q_seeded_hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.seeded_hold_out(table(spark, sf_dir, "documents"), "source")


@query("q_spread_ratio", """
    WITH m AS (SELECT user_id, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY user_id), g AS (SELECT avg(m) AS a, stddev_samp(m) AS sd FROM m)
    SELECT round(a, 6) AS mean_value, round(sd, 6) AS sd, round(abs(a) / sd, 2) AS ratio, round(abs(a) / sd, 2) >= 1.5 AS clearly_larger FROM g""")
def q_spread_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spread_ratio(
        table(spark, sf_dir, "events").where("value is not null"), "user_id", "value"
    ).withColumns({"mean_value": F.round("mean_value", 6), "sd": F.round("sd", 6)})


@query("q_noise_pairs", f"""
    WITH r AS ({_RUNS}) SELECT a.doc_id, a.run AS run_a, b.run AS run_b, round(abs(a.v - b.v), 6) AS diff FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.run < b.run""")
def q_noise_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.noise_pairs(_runs(spark, sf_dir), ["doc_id"], "run", "value").withColumn("diff", F.round("diff", 6))


@query("q_noise_stats", f"""
    WITH r AS ({_RUNS}), d AS (SELECT 'q' || CAST(a.doc_id % 3 AS VARCHAR) AS question_id, abs(a.v - b.v) AS diff FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.run < b.run)
    SELECT question_id, count(*) AS n, round(avg(diff), 6) AS mean_diff, round(max(diff), 6) AS max_diff, round(quantile_cont(diff, 0.99), 6) AS p99 FROM d GROUP BY GROUPING SETS ((question_id), ())""")
def q_noise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stats.noise_pairs(_runs(spark, sf_dir), ["doc_id", "question_id"], "run", "value")
    return stats.noise_stats(pairs, "question_id").select("question_id", "n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "max_diff", "p99")])


# Baseline


@query("q_baseline_diff", """
    WITH b AS (SELECT doc_id, doc_id % 2 AS risk, ((doc_id * 37) % 101) / 100.0::DOUBLE AS prev, ((doc_id * 37 + (doc_id % 5) * 9) % 101) / 100.0::DOUBLE AS cur FROM labels)
    SELECT doc_id, CASE risk WHEN 1 THEN 'risk' ELSE 'good' END AS question_id, prev AS previous, cur AS current, round(cur - prev, 6) AS delta,
           CASE WHEN risk = 1 THEN cur - prev > 0.10 ELSE prev - cur > 0.10 END AS regressed FROM b""")
def q_baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(d % 2 == 1, "risk").otherwise("good").alias("question_id"), ((d * 37) % 101 / 100.0).alias("p"),
        ((d * 37 + (d % 5) * 9) % 101 / 100.0).alias("c")
    )
    question = spark.createDataFrame([("risk", 0.5), ("good", None)], "question_id string, max_threshold double")
    return baseline.diff(
        rows.select("doc_id", "question_id", F.col("c").alias("value")), rows.select("doc_id", "question_id", F.col("p").alias("value")),
        question
    ).withColumn("delta", F.round("delta", 6))


_PATHS = "SELECT DISTINCT regexp_extract(url, '://(.*)$', 1) AS u, page_id FROM pages"


@query("q_baseline_match", f"""
    WITH p AS ({_PATHS}), c AS (SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN u WHEN 1 THEN './' || u WHEN 2 THEN 'docs/' || u ELSE u || '.new' END AS path FROM p),
    v AS (SELECT DISTINCT CASE page_id % 4 WHEN 2 THEN 'repo/docs/' || u ELSE u END AS previous_path FROM p),
    e AS (SELECT path, previous_path FROM c JOIN v ON path = previous_path),
    n AS (SELECT path, previous_path, count(*) OVER (PARTITION BY path) AS k FROM c JOIN v ON regexp_replace(path, '^[./]+', '') = regexp_replace(previous_path, '^[./]+', '') WHERE path NOT IN (SELECT path FROM e)),
    s AS (SELECT path, previous_path, count(*) OVER (PARTITION BY path) AS k FROM c JOIN v
          ON ends_with('/' || regexp_replace(path, '^[./]+', ''), '/' || regexp_replace(previous_path, '^[./]+', '')) OR ends_with('/' || regexp_replace(previous_path, '^[./]+', ''), '/' || regexp_replace(path, '^[./]+', ''))
          WHERE path NOT IN (SELECT path FROM e) AND path NOT IN (SELECT path FROM n)),
    f AS (SELECT path, previous_path, 'exact' AS how FROM e UNION ALL SELECT path, previous_path, 'normalised' FROM n WHERE k = 1 UNION ALL SELECT path, previous_path, 'suffix' FROM s WHERE k = 1)
    SELECT c.path, f.previous_path, coalesce(f.how, 'new') AS how FROM c LEFT JOIN f ON c.path = f.path""")
def q_baseline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://(.*)$", 1).alias("u"), "page_id")
    k = F.col("page_id") % 4
    cur = p.select(
        F.when(k == 0, F.col("u")).when(k == 1, F.concat(F.lit("./"), "u")).when(
            k == 2, F.concat(F.lit("docs/"), "u")
        ).otherwise(F.concat("u", F.lit(".new"))).alias("path")
    )
    prev = p.select(F.when(k == 2, F.concat(F.lit("repo/docs/"), "u")).otherwise(F.col("u")).alias("path"))
    return baseline.matched(cur, prev)


@query(
    "q_exclude_filter",
    "SELECT page_id FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS p FROM pages) WHERE NOT (starts_with(p, 'de/') OR ends_with(p, '.html'))"
)
def q_exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path"))
    return p.where(~X.path_excluded(F.col("path"), ["de", "*.html"]) & ~X.default_ignored(F.col("path"))).select("page_id")


# Corpus


@query("q_heuristic_presence", r"""
    WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '## Risks and drawbacks' WHEN 1 THEN '**Testing**' WHEN 2 THEN 'Summary' || chr(10) || '=====' ELSE 'plain words' END || chr(10) || 'body' AS t FROM documents)
    SELECT doc_id, doc_id % 4 = 0 AS has_risks, doc_id % 4 = 1 AS has_testing, doc_id % 4 = 2 AS has_goal FROM d""")
def q_heuristic_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heuristics(spark, sf_dir).select("doc_id", "has_risks", "has_testing", "has_goal")


def _heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question over the whole text behind a heading that the id picks."""
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "## Risks and drawbacks").when(k == 1, "**Testing**").when(k == 2, "Summary\n=====").otherwise("plain words")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("t"))
    d = d.select("doc_id", "t", chunks.headings(F.col("t")).alias("h"))
    return d.select("doc_id", *[chunks.has_item(F.col("t"), q, F.col("h")).alias(f"has_{q}") for q in V.KEYWORDS])


_HEADS = ["risks and drawbacks", "testing", "summary", None]


def _item_sql(question: str) -> str:
    """Whether an item is there: a keyword in the heading that the id picks, a reference, or an opening of more than 40 characters."""
    tests = [_case("doc_id % 4", [h is not None and any(k in h for k in V.KEYWORDS[question]) for h in _HEADS])]
    if question == "related_issues":
        tests.append(r"regexp_matches(t, '(?i)(^|\s)#\d+\b|\b(fixes|closes|resolves)\b|/(issues|pull)/\d+')")
    if question == "summary":
        tests.append(r"length(regexp_replace(string_split(t, chr(10) || '#')[1], '^\s+|\s+$', '', 'g')) > 40")
    return " OR ".join(tests)


@query("q_heuristic_items", f"""
    WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '## Risks and drawbacks' WHEN 1 THEN '**Testing**' WHEN 2 THEN 'Summary' || chr(10) || '=====' ELSE 'plain words' END || chr(10) || coalesce(text, '') AS t FROM documents)
    SELECT doc_id, {", ".join(f"{_item_sql(q)} AS has_{q}" for q in V.KEYWORDS)} FROM d""")
def q_heuristic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heuristics(spark, sf_dir)


@query("q_holdout_split", """
    WITH s AS (SELECT lang, source, count(*) AS size FROM documents GROUP BY ALL),
    o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY lang ORDER BY sha256('corpus:' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY lang) AS total FROM s)
    SELECT lang, source, size, before < CASE WHEN total >= 2 THEN greatest(round_even(total * 0.3, 0), 1) ELSE 0 END AS held_out FROM o""")
def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.held_out(table(spark, sf_dir, "documents"), ["lang"], "source")


@query("q_tuning_pick", """
    WITH h AS (SELECT lang, source, doc_id, sha256('pick:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h) AS r FROM h),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS rank FROM o WHERE r = 1)
    SELECT lang, source, doc_id, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 2""")
def q_tuning_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.picked(table(spark, sf_dir, "documents"), ["lang"], "source", "doc_id")


@query("q_project_cap", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source HAVING count(*) > 2")
def q_project_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.over_cap(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("q_dedup_content_hash", "SELECT sha256(text || '::' || lang) AS cache_key, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def q_dedup_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("::", "text", "lang"), 256).alias("cache_key"))
    return d.groupBy("cache_key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


@query("q_cache_misses", """
    WITH c AS (SELECT DISTINCT sha256(text || '::v1') AS k FROM documents WHERE doc_id % 3 = 0)
    SELECT lang, count(*) FILTER (WHERE k IS NOT NULL) AS hits, count(*) FILTER (WHERE k IS NULL) AS misses FROM (SELECT lang, c.k FROM documents d LEFT JOIN c ON sha256(d.text || '::v1') = c.k) GROUP BY lang""")
def q_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    cache = docs.where("doc_id % 3 = 0").select(report.cache_key(F.col("text"), "v1").alias("cache_key")).distinct()
    hits, misses = report.with_cache(docs, cache, "v1")
    both = hits.select("lang", F.lit(1).alias("h")).unionByName(misses.select("lang", F.lit(0).alias("h")))
    return both.groupBy("lang").agg(F.count_if(F.col("h") == 1).alias("hits"), F.count_if(F.col("h") == 0).alias("misses"))


@query("q_doc_type", """
    SELECT CASE WHEN contains(p, 'design_doc') THEN 'design_doc' WHEN contains(p, 'article') OR contains(p, 'zenn') THEN 'article' ELSE 'generic' END AS doc_type, count(*) AS n
    FROM (SELECT lower(CASE page_id % 3 WHEN 0 THEN 'Design_Doc/' WHEN 1 THEN 'Articles/' ELSE '' END || url) AS p FROM pages) GROUP BY 1""")
def q_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    p = table(spark, sf_dir, "pages").select(F.concat(F.when(k == 0, "Design_Doc/").when(k == 1, "Articles/").otherwise(""), "url").alias("p"))
    return p.groupBy(X.document_type(F.col("p")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


@query("q_path_normalise", "SELECT page_id, regexp_replace('../.' || regexp_extract(url, '://(.*)$', 1), '^[./]+', '') AS path FROM pages")
def q_path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.normalised_path(F.concat(F.lit("../."), F.regexp_extract("url", "://(.*)$", 1))).alias("path"))


@query(
    "q_line_column",
    "SELECT doc_id, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(list_last(string_split(b, chr(10)))) + 1 AS INTEGER) AS col FROM (SELECT doc_id, left(text, length(text) // 2) AS b FROM documents)"
)
def q_line_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    p = table(spark, sf_dir, "documents").select("doc_id", chunks.line_and_column(F.col("text"), half).alias("p"))
    return p.select("doc_id", F.col("p.line").alias("line"), F.col("p.column").alias("col"))


# Reports and variants


@query(
    "q_annotations",
    _GATE_SQL + " SELECT '::' || CASE WHEN warns THEN 'warning' ELSE 'error' END || ' file=doc-' || CAST(doc_id AS VARCHAR) || ',line=1::' || q || ' fails' AS line FROM a WHERE v < lo OR v > hi"
)
def q_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _gated(spark, sf_dir).where("level is not null")
    return report.annotations(
        v.select(
            "level", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("line"),
            F.lit(None).cast("int").alias("column"), F.concat("question_id", F.lit(" fails")).alias("message")
        )
    )


@query(
    "q_pivot_report",
    _GATE_SQL + " SELECT doc_id, max(v) FILTER (WHERE q = 'has_secrets') AS has_secrets, max(v) FILTER (WHERE q = 'has_pii') AS has_pii, max(v) FILTER (WHERE q = 'clarity') AS clarity FROM a GROUP BY doc_id"
)
def q_pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pivoted(_gate_answers(spark, sf_dir), ["has_secrets", "has_pii", "clarity"])


@query("q_changed_lines", """
    WITH d AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END AS t, coalesce(text, '') AS whole FROM documents)
    SELECT doc_id, CAST(CASE WHEN whole = '' THEN 1 ELSE len(string_split(t, chr(10))) + 1 END AS BIGINT) AS all_changed, CAST(1 AS BIGINT) AS one_added FROM d""")
def q_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines, from the ratio: of every line replaced by another one, and of one line put behind the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    end = F.when(F.col("t").endswith("\n") | (F.col("t") == ""), "").otherwise("\n")
    n = F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n")) - F.col("t").endswith("\n").cast("int"))
    other = F.lit("0123456789" * 9)
    counted = lambda after, of: F.round(corpus.changed_lines(F.col("t"), after) * of).cast("long")
    return d.select("doc_id", counted(other, F.greatest(n, F.lit(1))).alias("all_changed"), counted(F.concat("t", end, other), n + 1).alias("one_added"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n\n").alias("text"))


# What the scan finds, on whole texts with a line put behind them whose content goes by the id


def _behind(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """Documents with a line behind their text."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))


#: Prefixes of credentials, in parts so that no file holds a whole one.
_PARTS = [
    ("AK", "IA"), ("gh", "p_"), ("sk", "_live_"), ("sk", "-"), ("apikey", "_"), ("Bea", "rer "), ("-----BEGIN RSA PRIV", "ATE KEY-----"),
    ("xo", "xb-"), ("gh", "p_example")
]
_CREDENTIAL_TYPES = ["aws_key", "github_token", "secret_key", "secret_key", "api_key", "bearer_token", "private_key", "slack_token", "example_github_token"]
_CREDENTIAL_PLACES = [
    "[REDACTED_AWS_KEY]", "[REDACTED_GH_TOKEN]", "[REDACTED_SECRET_KEY]", "[REDACTED_SECRET_KEY]", "[REDACTED_API_KEY]",
    "Bearer [REDACTED_TOKEN]", "[REDACTED_PRIVATE_KEY]", "[REDACTED_SLACK_TOKEN]", "[EXAMPLE_GH_TOKEN]"
]
_CREDENTIAL_SQL = "CASE doc_id % 9 " + " ".join(
    f"WHEN {i} THEN '{a}' || '{b}' || " + ("upper(left(h, 16))" if i == 0 else "''" if i == 6 else "h || left(h, 8)") for i,
    (a, b) in enumerate(_PARTS)
) + " END"


def _picked(column: Column, values: list[Column]) -> Column:
    out = F.lit(None)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(column == i, v).otherwise(out)
    return out


def _credential() -> Column:
    h = F.md5(F.col("doc_id").cast("string"))
    tail = lambda i: F.upper(F.left(h, F.lit(16))) if i == 0 else F.lit("") if i == 6 else F.concat(h, F.left(h, F.lit(8)))
    return _picked(F.col("doc_id") % 9, [F.concat(F.lit(a + b), tail(i)) for i, (a, b) in enumerate(_PARTS)])


_WITH_CREDENTIAL = f"""
    WITH k AS (SELECT doc_id, lang, coalesce(text, '') AS text, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
    c AS (SELECT *, {_CREDENTIAL_SQL} AS v FROM k)"""
_NEW_LINE = "length(text) - length(replace(text, chr(10), '')) + 2"


@query("q_scan_credentials", _WITH_CREDENTIAL + f"""
    SELECT doc_id, {_case("doc_id % 9", _CREDENTIAL_TYPES)} AS type, {_case("doc_id % 9", _CREDENTIAL_PLACES)} AS placeholder, doc_id % 9 = 8 AS is_example,
           CAST(length(text) + 5 AS INTEGER) AS start, CAST(length(text) + 5 + length(v) AS INTEGER) AS end, CAST({_NEW_LINE} AS INTEGER) AS line, 5 AS "column", CAST(5 + length(v) AS INTEGER) AS end_column FROM c""")
def q_scan_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.candidates(_behind(spark, sf_dir, F.concat(F.lit("key "), _credential(), F.lit(" end")))).where("kind = 'credential'")
    return found.select("doc_id", "type", "placeholder", "is_example", "start", "end", "line", "column", "end_column")


_EMAIL_ROLE = f"(l IN ({_quoted(V.ROLE_WORDS)}) OR {' OR '.join("starts_with(l, '" + a + "') OR ends_with(l, '" + a + "')" for a in V.ROLE_AFFIXES)})"
_PRIVATE_IP = r"'^(10|0)\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^169\.254\.|^198\.1[89]\.|^2[45]\d\.'"


@query("q_redaction_counters", _WITH_CREDENTIAL + rf""",
    e AS (SELECT doc_id, count(*) AS emails, count(*) FILTER (WHERE {_EMAIL_ROLE} AND d NOT IN ({_quoted(V.FREE_MAIL)})) AS roles
          FROM (SELECT doc_id, lower(split_part(m, '@', 1)) AS l, lower(split_part(m, '@', 2)) AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS m FROM k)) GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS ips, count(*) FILTER (WHERE regexp_matches(m, '{_EXAMPLE_IP}')) AS example_ips, count(*) FILTER (WHERE regexp_matches(m, {_PRIVATE_IP})) AS private_ips
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{IPV4}')) AS m FROM k) GROUP BY doc_id),
    s AS (SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS secrets FROM k)
    SELECT k.doc_id, coalesce(emails, 0) + coalesce(ips, 0) + secrets + CASE WHEN k.doc_id % 9 = 8 THEN 0 ELSE 1 END AS total, CAST(CASE WHEN k.doc_id % 9 = 8 THEN 0 ELSE 1 END AS BIGINT) AS credentials,
           coalesce(emails, 0) + coalesce(ips, 0) - coalesce(example_ips, 0) AS pii, coalesce(emails, 0) - coalesce(roles, 0) + coalesce(private_ips, 0) AS pii_personal, coalesce(roles, 0) AS pii_role,
           coalesce(example_ips, 0) + CASE WHEN k.doc_id % 9 = 8 THEN 1 ELSE 0 END AS examples
    FROM k LEFT JOIN e ON k.doc_id = e.doc_id LEFT JOIN i ON k.doc_id = i.doc_id JOIN s ON k.doc_id = s.doc_id""")
def q_redaction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.candidates(_behind(spark, sf_dir, F.concat(F.lit("key "), _credential(), F.lit(" end"))))
    return spans.counters(found).select("doc_id", "total", "credentials", "pii", "pii_personal", "pii_role", "examples")


@query("q_preflight_override", f"""
    WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)@(gmail|yahoo)\\.com')) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS free FROM documents)
    SELECT l.doc_id, q AS question_id, CASE WHEN q = 'has_secrets' AND l.doc_id % 9 <> 8 THEN 'credentials' WHEN q = 'has_pii' AND free > 0 THEN 'pii' END AS overridden_by,
           CASE WHEN q = 'has_secrets' AND l.doc_id % 9 <> 8 OR q = 'has_pii' AND free > 0 THEN 1.0 ELSE ((l.doc_id * 37 + i * 11) % 101) / 100.0::DOUBLE END AS value
    FROM labels l JOIN c USING (doc_id), {_values([("has_secrets", 0), ("has_pii", 1)], "q, i")}""")
def q_preflight_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.when(F.col("doc_id") % 2 == 0, F.lit(" ann@yahoo.com")).otherwise("")
    found = spans.counters(spans.candidates(_behind(spark, sf_dir, F.concat(F.lit("key "), _credential(), F.lit(" end"), mail))))
    answers = _gate_answers(spark, sf_dir).where(F.col("question_id").isin("has_secrets", "has_pii"))
    return gate.overridden(answers, found).select("doc_id", "question_id", "overridden_by", "value")


_URLS = [
    "https://wiki.corp/a?b=1", "http://localhost:8080/x", "https://api.example.com/v", "https://github.com/o/r", "ldap://dir.intra/x",
    "https://site.org/p"
]
_URL_TYPES = ["url_internal", "example_url", "example_url", "example_url", "url_internal", "url_public"]


@query("q_scan_urls", f"""
    WITH u AS (SELECT doc_id, coalesce(text, '') AS text, {_case("doc_id % 6", _URLS)} AS v FROM documents)
    SELECT doc_id, '[URL_1]' AS placeholder, {_case("doc_id % 6", _URL_TYPES)} AS type, doc_id % 6 IN (1, 2) AS is_example_domain, doc_id % 6 IN (0, 4) AS is_internal_tld, doc_id % 6 = 3 AS is_public_common,
           {_case("doc_id % 6", [".corp", None, None, None, ".intra", None])} AS suffix_class, CAST(length(text) + 5 AS INTEGER) AS start, CAST(length(text) + 5 + length(v) AS INTEGER) AS end FROM u""")
def q_scan_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _picked(F.col("doc_id") % 6, [F.lit(u) for u in _URLS])
    found = spans.candidates(_behind(spark, sf_dir, F.concat(F.lit("see "), url, F.lit(".), end")))).where("kind = 'url'")
    return found.select("doc_id", "placeholder", "type", "is_example_domain", "is_internal_tld", "is_public_common", "suffix_class", "start", "end")


_PHONES = ["+81 90-1234-5678", "1-800-555-0199", "090-1234-5678", "0120-123-456", "03-1234-5678"]


@query("q_scan_phones", f"""
    WITH u AS (SELECT doc_id, coalesce(text, '') AS text, {_case("doc_id % 5", _PHONES)} AS v FROM documents)
    SELECT doc_id, '[PHONE_1]' AS placeholder, CASE WHEN doc_id % 5 IN (1, 3, 4) THEN 'phone_support' ELSE 'phone_personal' END AS type, {_case("doc_id % 5", ["international", "US", "JP", "JP", "JP"])} AS country_format,
           doc_id % 5 IN (1, 3) AS is_support_prefix, doc_id % 5 = 4 AS near_support_keyword, doc_id % 5 = 2 AS is_mobile, CAST(length(text) + 62 + CASE WHEN doc_id % 5 = 4 THEN 8 ELSE 0 END AS INTEGER) AS start, CAST(length(v) AS INTEGER) AS n_chars FROM u""")
def q_scan_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = _picked(F.col("doc_id") % 5, [F.lit(p) for p in _PHONES])
    near = F.when(F.col("doc_id") % 5 == 4, "support ").otherwise("")
    found = spans.candidates(_behind(spark, sf_dir, F.concat(F.lit("." * 60 + " "), near, number, F.lit(" " + "." * 60)))).where("kind = 'phone'")
    return found.select(
        "doc_id", "placeholder", "type", "country_format", "is_support_prefix", "near_support_keyword", "is_mobile", "start",
        (F.col("end") - F.col("start")).alias("n_chars")
    )


@query("q_scan_overlap", """
    WITH u AS (SELECT doc_id, length(coalesce(text, '')) + 1 AS p, length(CAST(doc_id AS VARCHAR)) AS n FROM documents)
    SELECT doc_id, 'secret' AS kind, CAST(p AS INTEGER) AS start, CAST(p + 21 + n AS INTEGER) AS end FROM u
    UNION ALL SELECT doc_id, 'url', CAST(p + 26 + n AS INTEGER), CAST(p + 45 + n AS INTEGER) FROM u""")
def q_scan_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address in a secret and an IP in a URL are no spans of their own."""
    line = F.concat(F.lit("password=ann"), F.col("doc_id").cast("string"), F.lit("@mail.org see http://10.0.0.5/x/y end"))
    docs = _behind(spark, sf_dir, line).withColumn("n", F.length("text") - F.length(line))
    return spans.candidates(docs, keep=("doc_id", "n")).where("start >= n").select("doc_id", "kind", "start", "end")


@query("q_secret_features", f"""
    WITH m AS (SELECT lang, unnest(regexp_extract_all(text, '{TOKEN}')) AS v FROM documents),
    s AS (SELECT lang, regexp_extract(v, '"([^"]*)"', 1) AS x FROM m)
    SELECT lang, 'token' AS key_name, CAST(length(x) AS INTEGER) AS value_length, regexp_matches(x, '[a-z]') AS has_lower, regexp_matches(x, '[A-Z]') AS has_upper, regexp_matches(x, '[0-9]') AS has_digit,
           {" OR ".join(f"contains(lower(x), '{w}')" for w in V.SECRET_PLACEHOLDERS)} AS placeholder_syntax, false AS is_known_format, count(*) AS n
    FROM s GROUP BY ALL""")
def q_secret_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.candidates(table(spark, sf_dir, "documents"), keep=("doc_id", "lang")).where("kind = 'secret'")
    has = lambda c: F.array_contains("character_classes", c).alias(f"has_{c}")
    return found.groupBy(
        "lang", F.lower("key_name").alias("key_name"), "value_length", has("lower"), has("upper"), has("digit"), "placeholder_syntax",
        "is_known_format"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("q_placeholder_numbering", rf"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{IPV4}')) AS v, generate_subscripts(regexp_extract_all(text, '{IPV4}'), 1) AS place FROM documents),
    f AS (SELECT doc_id, v, min(place) AS first, count(*) AS occurrences FROM m GROUP BY doc_id, v)
    SELECT doc_id, '[IP_' || CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS VARCHAR) || ']' AS placeholder, occurrences FROM f""")
def q_placeholder_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.candidates(table(spark, sf_dir, "documents")).where("kind = 'ip'")
    return found.groupBy("doc_id", "placeholder").agg(F.count(F.lit(1)).alias("occurrences"))


_MASKED = rf"regexp_replace(regexp_replace(regexp_replace(text, '(?i)(token)\s*=\s*\"[^\"\n]*\"', '\1=[SECRET]', 'g'), '{EMAIL}', '[EMAIL]', 'g'), '{IPV4}', '[IP]', 'g')"


@query("q_masked_text", f"""
    SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) + len(regexp_extract_all(text, '{IPV4}')) + len(regexp_extract_all(text, '{TOKEN}')) AS INTEGER) AS n_spans, sha256({_MASKED}) AS masked_sha256 FROM documents""")
def q_masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked text, its placeholders without their numbers."""
    found = table(spark, sf_dir, "documents").select("doc_id", spans.scan(F.col("text")).alias("s"))
    plain = F.regexp_replace("s.masked", r"\[(EMAIL|IP|SECRET)_\d+\]", "[$1]")
    return found.select("doc_id", F.size("s.spans").alias("n_spans"), F.sha2(plain, 256).alias("masked_sha256"))


def _places_sql(kind: str, pattern: str) -> str:
    return f"SELECT doc_id, text, '{kind}' AS kind, regexp_split_to_array(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS ms FROM documents"


@query("q_span_positions", f"""
    WITH s AS ({_places_sql("email", EMAIL)} UNION ALL {_places_sql("ip", IPV4)} UNION ALL {_places_sql("secret", TOKEN)}),
    u AS (SELECT doc_id, text, kind, parts, ms, unnest(generate_series(1, len(ms))) AS k FROM s WHERE len(ms) > 0),
    p AS (SELECT doc_id, text, kind, list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS a, length(ms[k]) AS n FROM u),
    b AS (SELECT doc_id, kind, a, a + n AS z, left(text, CAST(a AS BIGINT)) AS before, left(text, CAST(a + n AS BIGINT)) AS whole FROM p)
    SELECT doc_id, kind, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS end, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(list_last(string_split(before, chr(10)))) + 1 AS INTEGER) AS "column",
           CAST(length(whole) - length(replace(whole, chr(10), '')) + 1 AS INTEGER) AS end_line, CAST(length(list_last(string_split(whole, chr(10)))) + 1 AS INTEGER) AS end_column FROM b""")
def q_span_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.candidates(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start", "end", "line", "column", "end_line", "end_column")


@query("q_token_containment", """
    SELECT doc_id, true AS in_whole, doc_id % 2 = 0 AS in_part, false AS in_longer FROM documents""")
def q_token_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an unmasked part holds the value that a placeholder of the whole stands for: itself, not a longer one."""
    own = F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("@one.org"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(own, F.lit(" "), F.coalesce("text", F.lit(""))).alias("whole"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see "), F.upper(own))).otherwise("none").alias("part"),
        F.concat(F.lit("x"), own).alias("longer")
    )
    hashed = docs.select("doc_id", *[spans.token_hashes(F.col(c) if c == "whole" else F.lower(c)).alias(c) for c in ("whole", "part", "longer")])
    name = F.lit("[EMAIL_1]")
    return hashed.select("doc_id", *[spans.placed(name, F.col("whole"), F.col(c)).alias(f"in_{c}") for c in ("whole", "part", "longer")])


# Reports of evaluations


@query("q_offline_report", f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS (SELECT doc_id, CAST(len(list_filter(list_distinct(regexp_extract_all(text, '{IPV4}')), lambda v: regexp_matches(v, {_PRIVATE_IP}))) AS BIGINT) AS ips FROM t)
    SELECT doc_id, ips + CASE WHEN doc_id % 5 IN (0, 2) THEN 1 ELSE 0 END AS n_violations, ips = 0 AND doc_id % 5 NOT IN (0, 2) AS passed,
           CASE WHEN doc_id % 5 IN (0, 2) THEN 'PII Exposure: [PHONE_1] is an individual phone number' END AS phone, 'offline-rules' AS model FROM m""")
def q_offline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of the rules, each message once however often a value occurs."""
    number = _picked(F.col("doc_id") % 5, [F.lit(p) for p in _PHONES])
    near = F.when(F.col("doc_id") % 5 == 4, "support ").otherwise("")
    line = F.concat(F.lit("." * 60 + " "), near, number, F.lit(" " + "." * 60 + " "), near, number, F.lit(" " + "." * 60))
    r = evaluate.offline(_behind(spark, sf_dir, line), "safety")
    phone = F.try_element_at(F.filter("violations", lambda v: v.contains("[PHONE_")), F.lit(1))
    return r.select("doc_id", F.size("violations").cast("long").alias("n_violations"), "passed", phone.alias("phone"), "model")


@query("q_mock_report", """
    SELECT doc_id, 0.78::DOUBLE AS composite_score, true AS passed, true AS mock, 0.78::DOUBLE AS has_test_plan FROM documents""")
def q_mock_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.mock(table(spark, sf_dir, "documents").select("doc_id", "text"), "tech-spec")
    return r.select(
        "doc_id", F.round("composite_score", 9).alias("composite_score"), "passed", "mock",
        F.col("answers")["has_test_plan"].alias("has_test_plan")
    )


class LengthProvider:
    """A provider whose answers go by the length of what it is given; it fails on every 17th length."""

    def decide(self, state: dict, questions: dict) -> dict:
        n = len(state["document"])
        if n % 17 == 0:
            raise RuntimeError("refused")
        given = {"score": {"score": 2 * (n % 101) / 100}, "noul": (n % 101) / 100, "choice": {"choice": "informal" if n % 2 else "professional"}}
        return {q: given[d["type"]] for q, d in questions.items()} | {"_usage": {"input_tokens": n, "output_tokens": n % 3, "model": "length"}}


@query("q_online_report", """
    WITH d AS (SELECT conv_id * 100 + turn AS doc_id, length(text) AS n FROM conversations), v AS (SELECT doc_id, n, round((n % 101) / 100.0::DOUBLE, 6) AS v FROM d)
    SELECT doc_id, CASE WHEN n % 17 <> 0 THEN v END AS clarity, CASE WHEN n % 17 <> 0 THEN v END AS composite, CASE WHEN n % 17 <> 0 THEN CASE WHEN n % 2 = 1 THEN 'informal' ELSE 'professional' END END AS tone,
           CASE WHEN n % 17 = 0 THEN 'refused' END AS error, CASE WHEN n % 17 <> 0 THEN true END AS passed, n % 17 <> 0 AND v < 0.6 AS warned,
           CASE WHEN n % 17 <> 0 AND v < 0.6 THEN 'Clarity & Structure: score ' || printf('%.2f', v) || ' is below minimum 0.60 (warning)' END AS warning,
           n % 17 <> 0 AND abs(v - 0.6) <= 0.1 + 1e-9 AS near, CASE WHEN n % 17 <> 0 THEN CAST(n AS BIGINT) END AS input_tokens FROM v""")
def q_online_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents, asked one by one; a refused one is an error of its row."""
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    r = evaluate.online(docs, "quality", LengthProvider, pause=0.0)
    value = F.round(F.try_element_at("answers", F.lit("clarity")), 6)
    return r.select(
        "doc_id", value.alias("clarity"), F.round("composite_score", 6).alias("composite"),
        F.try_element_at("choices", F.lit("tone")).alias("tone"), "error", "passed", (F.size("warnings") > 0).alias("warned"),
        F.try_element_at("warnings", F.lit(1)).alias("warning"), F.array_contains("near_threshold", "clarity").alias("near"), "input_tokens"
    )


@query("q_chunk_max_pool", """
    SELECT conv_id AS doc_id, role AS question_id, max((length(text) * 37 % 101) / 100.0::DOUBLE) AS value FROM conversations GROUP BY ALL""")
def q_chunk_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as its chunks."""
    none = F.lit(None).cast("string")
    answers = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("question_id"), (F.length("text") * 37 % 101 / 100.0).alias("probability"),
        none.alias("choice"), none.alias("error")
    )
    return decide.pooled(answers).select("doc_id", "question_id", "value")


@query(
    "q_token_usage",
    "SELECT conv_id AS doc_id, CAST(nullif(sum(length(text)), 0) AS BIGINT) AS input_tokens, CAST(nullif(sum(CASE WHEN conv_id % 2 = 0 THEN turn ELSE 0 END), 0) AS BIGINT) AS output_tokens FROM conversations GROUP BY conv_id"
)
def q_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.when(F.col("conv_id") % 2 == 0, F.col("turn")).otherwise(0).cast("long")
    answers = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.length("text").cast("long").alias("input_tokens"), out.alias("output_tokens"),
        F.lit("m").alias("model")
    )
    return decide.usage(answers).drop("model")


@query("q_unplaced", """
    SELECT doc_id, doc_id % 3 = 0 AS lost, CASE WHEN doc_id % 3 = 0 THEN '1 redacted item(s) ([IP_9]) were not found in any of 2 chunks and were treated as present in every chunk; any candidate probabilities for them may be less reliable.' END AS message,
           doc_id % 3 = 0 AS is_unplaced FROM documents""")
def q_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two items, one is in a chunk; the other is in none for every third document and went with a comment for the others."""
    text = F.coalesce("text", F.lit(""))
    items = F.array(F.struct(F.lit("[EMAIL_9]").alias("placeholder")), F.struct(F.lit("[IP_9]").alias("placeholder")))
    gone = F.col("doc_id") % 3 != 0
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", items.alias("items"), F.concat(text, F.when(gone, "<!-- [IP_9] -->").otherwise("")).alias("before"), text.alias("after"),
        F.array(F.concat(F.lit("[EMAIL_9] "), text), text).alias("parts")
    )
    names = evaluate.unplaced(F.col("items"), F.col("before"), F.col("after"), F.col("parts"))
    message = evaluate.unplaced_message(names, F.size("parts"))
    return docs.select(
        "doc_id", (F.size(names) > 0).alias("lost"), message.alias("message"),
        F.coalesce(validate.unplaced_warning(message), F.lit(False)).alias("is_unplaced")
    )


@query("q_transient", """
    SELECT page_id, page_id % 4 <> 3 AS again FROM pages""")
def q_transient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which failures are tried again: by status and by what went wrong, whatever URL the message names."""
    messages = ["status 429 at ", "HTTP 503 from ", "Connection reset by ", "refused by "]

    @F.pandas_udf("boolean")
    def again(page: pd.Series, host: pd.Series) -> pd.Series:
        return pd.Series([decide.transient(messages[p % 4] + re.sub(r"\d", "", h)) for p, h in zip(page, host, strict=True)])

    return table(spark, sf_dir, "pages").select("page_id", again("page_id", X.url_host(F.col("url"))).alias("again"))


# Gate and reports again, by the operators


@query("q_union_violations", _GATE_SQL + """
    , b AS (SELECT doc_id, q AS rule, 1 AS source FROM a WHERE v > hi UNION ALL SELECT doc_id, q, 2 FROM a WHERE v < lo)
    SELECT rule, min(source) AS first_source, count(DISTINCT doc_id) AS documents FROM b GROUP BY rule""")
def q_union_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.violations(_gated(spark, sf_dir)).groupBy("rule").agg(F.min("source").alias("first_source"), F.count_distinct("doc_id").alias("documents"))


@query("q_json_report", _GATE_SQL + """
    , r AS (SELECT doc_id, count(*) FILTER (WHERE (v < lo OR v > hi) AND NOT warns) AS violations, count(*) FILTER (WHERE (v < lo OR v > hi) AND warns) AS warnings FROM a GROUP BY doc_id)
    SELECT '{"doc_id":' || doc_id || ',"violations":' || violations || ',"warnings":' || warnings || ',"passed":' || CASE WHEN violations = 0 THEN 'true' ELSE 'false' END || '}' AS json FROM r""")
def q_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_rows(gate.verdicts(_gated(spark, sf_dir)))


@query(
    "q_published",
    "SELECT lang AS preset_name, count(*) AS documents, count(*) FILTER (WHERE doc_id % 3 = 0) AS passed, count(*) FILTER (WHERE doc_id % 3 = 1) AS failed, count(*) FILTER (WHERE doc_id % 3 = 2) AS errors, round(avg(n_chars), 6) AS mean_composite FROM documents GROUP BY lang"
)
def q_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("preset_name"), F.when(k == 0, True).when(k == 1, False).alias("passed"),
        F.when(k == 2, "refused").alias("error"), F.col("n_chars").cast("double").alias("composite_score")
    )
    return report.published(rows).withColumn("mean_composite", F.round("mean_composite", 6))


@query("q_leaks", "SELECT 'text ' || url AS line FROM pages WHERE contains(url, 'casino') OR contains(url, '/de/')")
def q_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select(F.concat(F.lit("text "), "url").alias("line"))
    return report.leaks(lines, ["casino", "/de/"])


@query("q_masked_ids", "SELECT CASE WHEN lang = 'en' THEN CAST(doc_id AS VARCHAR) ELSE '(private)' END AS doc_id, count(*) AS n FROM documents GROUP BY ALL")
def q_masked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.masked_ids(
        table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("lang") == "en"
    ).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("q_run_median", f"WITH r AS ({_RUNS}) SELECT doc_id, round(median(v), 6) AS median_value FROM r GROUP BY doc_id")
def q_run_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_median(_runs(spark, sf_dir), ["doc_id"], "value").withColumn("median_value", F.round("median_value", 6))


@query(
    "q_semi_changed",
    "SELECT d.source, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AND d.doc_id % 3 <> 2 GROUP BY d.source"
)
def q_semi_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files, of which only those that are texts by their names count."""
    end = _picked(F.col("doc_id") % 3, [F.lit(".md"), F.lit(".TXT"), F.lit(".bin")])
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), end).alias("path")
    listed = table(spark, sf_dir, "labels").where("toxic = 1").select(path)
    return files.changed(table(spark, sf_dir, "documents").select("source", path), listed, explicit=False).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_missing_answers",
    "SELECT d.lang, count(*) AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY d.lang"
)
def q_missing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "labels").select("doc_id", F.lit("q").alias("question_id"), F.lit(0).alias("run"), F.lit(1.0).alias("value"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lost = validate.lost_answers(answers, docs.select("doc_id", F.lit("q").alias("question_id")), 1)
    return lost.join(docs, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))


@query(
    "q_min_detected",
    "SELECT lang, CAST(ceil(0.8 * count(*) FILTER (WHERE quality = 0)) AS BIGINT) AS min_detected FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang"
)
def q_min_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return validate.least_detected(j.select("lang", F.when(F.col("quality") == 0, "absent").otherwise("present").alias("expected")), ["lang"], 0.8)


# Baselines of reports


@query("q_baseline_report", """
    WITH b AS (SELECT doc_id, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p, ((doc_id * 37 + (doc_id % 5) * 9) % 101) / 100.0::DOUBLE AS c FROM labels)
    SELECT 'docs/' || doc_id || '.md' AS path, CASE WHEN doc_id % 4 = 3 THEN 'new' ELSE 'compared' END AS status, CASE WHEN doc_id % 4 <> 3 THEN doc_id % 2 = 0 END AS truncation_mismatch,
           CASE WHEN doc_id % 4 <> 3 AND c - p > 0.10 THEN 'Baseline risk rise: ''has_pii'' rose by ' || printf('%.2f', c - p) || ' (prev: ' || printf('%.2f', p) || ', curr: ' || printf('%.2f', c) || ', max allowed rise: 0.10)' END AS violation,
           NOT (doc_id % 4 <> 3 AND c - p > 0.10) AS passed FROM b""")
def q_baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("docs/"), d.cast("string"), F.lit(".md"))
    none = F.array().cast("array<string>")
    now = table(spark, sf_dir, "labels").select(
        name.alias("path"), F.create_map(F.lit("has_pii"), (d * 37 + (d % 5) * 9) % 101 / 100.0).alias("answers"),
        F.lit(True).alias("was_truncated"), none.alias("violations"), none.alias("warnings"), F.lit(True).alias("passed")
    )
    then = table(spark, sf_dir, "labels").where(d % 4 != 3).select(
        F.concat(F.lit("/repo/"), name).alias("path"), F.create_map(F.lit("has_pii"), d * 37 % 101 / 100.0).alias("answers"),
        (d % 2 == 1).alias("was_truncated")
    )
    rows = [q for q in V.QUESTIONS if q[1] == "has_pii"]
    r = baseline.compared(now, then, rows, root="/repo")
    return r.select(
        "path", F.col("baseline.status").alias("status"), F.col("baseline.truncation_mismatch").alias("truncation_mismatch"),
        F.try_element_at("violations", F.lit(1)).alias("violation"), "passed"
    )


@query("q_truncation_mismatch", """
    SELECT 'd/' || doc_id AS path, 'Truncation status differs for ' || doc_id || ' (baseline was_truncated=' || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END || ', current was_truncated=' || CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE 'False' END || '). Scores may be shifted by truncation.' AS message
    FROM labels WHERE (doc_id % 2 = 0) <> (doc_id % 3 = 0)""")
def q_truncation_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("d/"), d.cast("string")).alias("path"), d.cast("string").alias("filename"), (d % 3 == 0).alias("was_truncated"),
        (d % 2 == 0).alias("then")
    )
    return baseline.truncation_mismatch(rows.drop("then"), rows.select("path", F.col("then").alias("was_truncated")))


@query("q_path_resolved", "SELECT page_id, '/root/' || regexp_extract(url, '://[^/?#]*/([^?#]*[^?#/])', 1) AS path FROM pages")
def q_path_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract("url", "://[^/?#]*/([^?#]*[^?#/])", 1)
    given = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("./x/../"), p)).otherwise(F.concat(F.lit("/root/./a/b/../../"), p))
    return table(spark, sf_dir, "pages").select("page_id", baseline.resolved(given, "/root").alias("path"))


# Texts: chunks, sections, edits


def _chunk_end(start: str) -> str:
    """Where a chunk of 2,000 characters that starts there ends: at the last blank line or else line break that leaves 200 of overlap."""
    seg = f"substr(text, {start} + 201, 1800)"
    last = lambda mark: f"{start} + 200 + length({seg}) - strpos(reverse({seg}), {mark}) + 1"
    two, one = "chr(10) || chr(10)", "chr(10)"
    return f"CASE WHEN {start} + 2000 >= length(text) THEN length(text) WHEN contains({seg}, {two}) THEN {last(two)} WHEN contains({seg}, {one}) THEN {last(one)} ELSE {start} + 2000 END"


@query("q_chunks", f"""
    WITH RECURSIVE c AS (
      SELECT doc_id, text, 0 AS chunk, CAST(0 AS BIGINT) AS start, CAST({_chunk_end("CAST(0 AS BIGINT)")} AS BIGINT) AS fin FROM documents
      UNION ALL
      SELECT doc_id, text, chunk + 1, start, CAST({_chunk_end("start")} AS BIGINT) FROM (
        SELECT doc_id, text, chunk, CAST(CASE WHEN contains(seg, chr(10) || chr(10)) THEN low + strpos(seg, chr(10) || chr(10)) + 1 WHEN contains(seg, chr(10)) THEN low + strpos(seg, chr(10)) ELSE low END AS BIGINT) AS start
        FROM (SELECT *, substr(text, low + 1, least(low + 100, fin) - low) AS seg FROM (SELECT *, greatest(start + 1, fin - 200) AS low FROM c WHERE fin < length(text))))
      WHERE start < length(text))
    SELECT doc_id, chunk, CAST(start AS INTEGER) AS start, CAST(fin - start AS INTEGER) AS n_chars, sha256(substr(text, start + 1, fin - start)) AS chunk_sha256 FROM c""")
def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.chunks(F.col("text"), 2000, 200)).alias("chunk", "c"))
    return c.select("doc_id", "chunk", F.col("c.start").alias("start"), F.length("c.text").alias("n_chars"), F.sha2("c.text", 256).alias("chunk_sha256"))


_LINES = r"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
    i AS (SELECT doc_id, list_transform(a, lambda x, k: CASE WHEN (k - 1) % 3 = 0 THEN '## Part ' || (k - 1) || chr(10) || x ELSE x END) AS items,
                 list_filter(list_transform(a, lambda x, k: CASE WHEN (k - 1) % 3 = 0 THEN CASE WHEN regexp_matches(x, '\S') THEN '## Part ' || (k - 1) || chr(10) || x ELSE '## Part ' || (k - 1) END WHEN regexp_matches(x, '\S') THEN x END), lambda x: x IS NOT NULL) AS blocks FROM l),
    s AS (SELECT doc_id, items, blocks, list_transform(generate_series(0, (len(items) - 1) // 3), lambda k: array_to_string(items[3 * k + 1 : 3 * k + 3], chr(10) || chr(10)) || CASE WHEN k < (len(items) - 1) // 3 THEN chr(10) ELSE '' END) AS bodies FROM i)"""


@query("q_ablation", _LINES + """
    , v AS (SELECT doc_id, bodies, unnest(generate_series(1, len(bodies))) AS k FROM s)
    SELECT doc_id, CAST(k - 1 AS INTEGER) AS variant, 'part_' || (3 * (k - 1)) AS removed, sha256(chr(10) || array_to_string(list_concat(bodies[1:k-1], bodies[k+1:]), chr(10))) AS text_sha256 FROM v WHERE len(bodies) > 1
    UNION ALL SELECT doc_id, 0, 'part_0', sha256('') FROM v WHERE len(bodies) = 1""")
def q_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _markdown(spark, sf_dir).select("doc_id", chunks.sections(F.col("text")).alias("s"))
    v = s.select("doc_id", F.posexplode(chunks.ablations(F.col("s.preamble"), F.col("s.sections"))).alias("variant", "a"))
    return v.select("doc_id", "variant", F.col("a.removed").alias("removed"), F.sha2("a.text", 256).alias("text_sha256"))


@query("q_ablation_labels", _LINES + """
    , v AS (SELECT doc_id, unnest(generate_series(1, len(bodies))) AS k FROM s), q AS (SELECT unnest(['part_0', 'part_3']) AS question_id)
    SELECT question_id, CASE WHEN 'part_' || (3 * (k - 1)) = question_id THEN 'absent' ELSE 'present' END AS expected, count(*) AS n FROM v, q GROUP BY ALL""")
def q_ablation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _markdown(spark, sf_dir).select(chunks.sections(F.col("text")).alias("s"))
    v = s.select(F.posexplode(chunks.ablations(F.col("s.preamble"), F.col("s.sections"))).alias("variant", "a")).select("variant", "a.removed")
    return chunks.ablation_labels(v, ["part_0", "part_3"]).groupBy("question_id", "expected").agg(F.count(F.lit(1)).alias("n"))


_FILLER = corpus.FILLERS["en"]
_EDITED = _LINES + rf"""
    , b AS (SELECT doc_id, items, bodies, blocks, list_filter(list_transform(blocks, lambda x, k: CASE WHEN starts_with(ltrim(x), '#') THEN NULL ELSE k END), lambda k: k IS NOT NULL) AS body FROM s),
    e AS (SELECT doc_id, array_to_string(items, chr(10) || chr(10)) AS text,
      array_to_string(list_transform(list_sort(list_transform(blocks, lambda x, k: {{'h': sha256('7:' || (k - 1)), 'x': x}})), lambda y: y.x), chr(10) || chr(10)) AS shuffled,
      array_to_string(list_filter(blocks, lambda x: NOT starts_with(ltrim(x), '#')), chr(10) || chr(10)) AS no_headings,
      array_to_string(flatten(list_transform(blocks, lambda x: [x, '{_FILLER}'])), chr(10) || chr(10)) AS padded,
      array_to_string(CASE WHEN len(body) < 6 THEN blocks ELSE list_filter(list_transform(blocks, lambda x, k: CASE WHEN list_contains(body[len(body) // 3 + 1 : 2 * len(body) // 3], k) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END, chr(10) || chr(10)) AS removed_middle,
      chr(10) || array_to_string(CASE WHEN len(bodies) < 2 THEN bodies ELSE list_concat(bodies[1 : len(bodies) - 2], [bodies[len(bodies)], bodies[len(bodies) - 1]]) END, chr(10)) AS swap_sections,
      array_to_string(list_append(blocks, '{_FILLER}'), chr(10) || chr(10)) AS unrelated_addition FROM b)"""
_EDITS = [*corpus.DEGRADATIONS, *corpus.NEUTRAL_EDITS]


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir).select("doc_id", "text", *[corpus.variant(F.col("text"), k).alias(k) for k in _EDITS])


@query("q_degradations", _EDITED + f" SELECT doc_id, {', '.join(f'sha256({k}) AS {k}' for k in _EDITS)} FROM e")
def q_degradations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir).select("doc_id", *[F.sha2(k, 256).alias(k) for k in _EDITS])


def _heads(text: str) -> str:
    return f"len(list_filter(string_split({text}, chr(10)), lambda x: starts_with(ltrim(x), '#')))"


_DIFFERS = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{'down' if k in corpus.DEGRADATIONS else 'neutral'}' AS expected, {_heads(k)} < {_heads('text')} OR abs(length({k}) - length(text)) > 0.1 * length(text) AS down FROM e" for k in _EDITS
)


@query(
    "q_diff_agreement",
    _EDITED + f" SELECT kind, expected, count(*) AS pairs, count(*) FILTER (WHERE down = (expected = 'down')) AS agrees FROM ({_DIFFERS}) GROUP BY ALL"
)
def q_diff_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the rule agrees with what each kind of edit is: a degradation or neutral."""
    kinds = [
        F.struct(
            F.lit(k).alias("kind"), F.lit("down" if k in corpus.DEGRADATIONS else "neutral").alias("expected"), F.col(k).alias("after")
        ) for k in _EDITS
    ]
    pairs = _edited(spark, sf_dir).select(F.col("text").alias("before"), F.inline(F.array(*kinds)))
    return corpus.diff_agreement(pairs)


@query("q_inserted", r"""
    SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '# T' || chr(10) || '### Non-Goals' || chr(10) || '- new' || chr(10) || text ELSE text END) AS text_sha256, doc_id % 2 = 0 AS found FROM documents""")
def q_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section put behind a heading of the whole text, or nothing where it has none."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# T\n### Non-Goals\n"), "text")).otherwise(F.col("text"))
    put = corpus.inserted(text, r"^### Non-Goals\n", "after", "- new\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(put, text), 256).alias("text_sha256"), put.isNotNull().alias("found"))


@query(
    "q_front_matter",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) ELSE '' END AS front FROM documents"
)
def q_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---\n"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", corpus.front_matter(F.concat(head, F.coalesce("text", F.lit("")))).alias("front"))


@query("q_heuristic_counts", """
    SELECT 'risks' AS question_id, count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0) AS detected, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_absent,
           count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0) AS false_alarms, count(*) FILTER (WHERE doc_id % 3 <> 0) AS n_present FROM documents""")
def q_heuristic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts behind a heading that every fourth one has, against labels that say otherwise for some."""
    head = F.when(F.col("doc_id") % 4 == 0, "## Risks and drawbacks\n").otherwise("plain words\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    labels = docs.select("doc_id", F.lit("risks").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, "absent").otherwise("present").alias("expected"))
    return chunks.presence_counts(docs, labels)


# Corpus tables and sources


@query(
    "q_manifest",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'org/' || source ELSE source END AS project, CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE 'given' END AS edit_source FROM documents WHERE doc_id % 5 <> 0"
)
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests with columns of their own; a fifth of their documents have no file."""
    docs = table(spark, sf_dir, "documents")
    own = F.col("doc_id").cast("string").alias("doc_id")
    one = docs.where("doc_id % 2 = 0").select(own, F.concat(F.lit("Org/"), F.upper("source")).alias("repo"))
    two = docs.where("doc_id % 2 = 1").select(own, F.upper("source").alias("source_repo"), F.lit("given").alias("edit_source"))
    return corpus.manifest(
        [one, two], docs.where("doc_id % 5 <> 0").select(own)
    ).select("doc_id", "project", "edit_source").withColumn("project", F.lower("project"))


@query("q_fetched", "SELECT doc_id, doc_id % 3 <> 0 AS intact FROM documents")
def q_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with other line ends than those whose hash was recorded; a third of them are other texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = docs.select("doc_id", F.sha2(F.replace("text", F.lit("\r"), F.lit("\n")), 256).alias("sha256"))
    raw = docs.select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")).alias("text"))
    return corpus.fetched(raw, parts).select("doc_id", "intact")


@query(
    "q_split_map",
    "SELECT CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'heldout' ELSE 'tuning' END AS split, count(*) AS labels FROM labels GROUP BY ALL"
)
def q_split_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("doc_id").cast("string"), F.lit("/after.md")).alias("path")
    labels = table(spark, sf_dir, "labels")
    docs = labels.where("doc_id % 4 <> 0").select(path, F.when(F.col("doc_id") % 3 == 0, "heldout").otherwise("tuning").alias("split"))
    return corpus.with_split(labels.select(path), docs).groupBy("split").agg(F.count(F.lit(1)).alias("labels"))


@query("q_score_pairs", """
    SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'after' ELSE 'before' END AS better, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'old ' || doc_id END AS before_text, 'new ' || doc_id AS after_text, CASE WHEN doc_id % 5 = 0 THEN 'missing file' END AS error FROM labels""")
def q_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    raw = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("doc_id").alias("id"), F.concat(n, F.lit(".md")).alias("before"), none.alias("after"), none.alias("before_text"),
        F.concat(F.lit("new "), n).alias("after_text"), F.when(F.col("doc_id") % 2 == 1, "before").alias("better"), none.alias("split")
    )
    texts = table(spark, sf_dir, "labels").where("doc_id % 5 <> 0").select(F.concat(n, F.lit(".md")).alias("path"), F.concat(F.lit("old "), n).alias("text"))
    return files.score_pairs(raw, texts).select("id", "better", "before_text", "after_text", "error")


@query(
    "q_label_paths",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/abs/' || doc_id WHEN 1 THEN 'lab/' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS file FROM labels"
)
def q_label_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    labels = table(spark, sf_dir, "labels")
    rows = labels.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/abs/"), n)).otherwise(n).alias("path"))
    listing = labels.where("doc_id % 3 = 1").select(F.concat(F.lit("lab/"), n).alias("path"))
    return files.resolved(rows, listing, "lab").select("doc_id", "file")


@query("q_images", """
    SELECT doc_id, 'a' || doc_id || '.png' AS source, 'image/png' AS mime_type, CAST(2 AS BIGINT) AS byte_size, 'data:image/png;base64,MTI=' AS data_url FROM documents
    UNION ALL SELECT doc_id, 'data:', 'image/gif', 3, 'data:image/gif;base64,MTIz' FROM documents WHERE doc_id % 2 = 0""")
def q_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that whole texts refer to: the first two that are there, one in a file, one written out; not those in code, remote or lost."""
    n = F.col("doc_id").cast("string")
    refs = F.concat(
        F.lit("![x](a"), n, F.lit(".png) `![c](b.png)` ![r](https://h/r.png) ![l](lost.png)"),
        F.when(F.col("doc_id") % 2 == 0, " ![d](data:image/gif;base64,MTIz)").otherwise(""), F.lit("\n")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(refs, F.coalesce("text", F.lit(""))).alias("text"))
    there = docs.select(
        F.concat(F.lit("a"), n, F.lit(".png")).alias("path"), F.encode(F.lit("12"), "UTF-8").alias("content"),
        F.lit(2).cast("long").alias("length")
    )
    return files.images(docs, there, 2).select("doc_id", "source", "mime_type", "byte_size", "data_url")


@query("q_regressions", """
    WITH b AS (SELECT doc_id, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p, ((doc_id * 37 + (doc_id % 5) * 9) % 101) / 100.0::DOUBLE AS c FROM labels)
    SELECT doc_id, round(p, 6) AS previous, round(c, 6) AS current FROM b WHERE c - p > 0.10""")
def q_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression that a stream of answers goes through, over the whole table."""
    d = F.col("doc_id")
    rows = lambda v: table(spark, sf_dir, "labels").select("doc_id", F.lit("risk").alias("question_id"), v.alias("value"))
    question = spark.createDataFrame([("risk", 0.5)], "question_id string, max_threshold double")
    got = incremental.regressions(rows((d * 37 + (d % 5) * 9) % 101 / 100.0), rows(d * 37 % 101 / 100.0), question)
    return got.select("doc_id", F.round("previous", 6).alias("previous"), F.round("current", 6).alias("current"))


@query("q_branch_policy", """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id % 2 = 0 WHEN 1 THEN page_id % 5 <> 0 ELSE true END AS allowed FROM pages""")
def q_branch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    base = F.when(n % 3 == 0, "main").when(n % 3 == 1, "refs/heads/release/v1").otherwise("feature/x")
    head = F.when(n % 3 == 0, F.when(n % 2 == 0, "release-please--v2").otherwise("feature/y")).otherwise(F.when(n % 5 == 0, "main").otherwise("feature/z"))
    return table(spark, sf_dir, "pages").select("page_id", hooks.branch_allowed(base, head).alias("allowed"))


@query(
    "q_incremental",
    "SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '" + EMAIL + "')) FROM documents UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(text, '" + IPV4 + "')) FROM documents UNION ALL SELECT doc_id, 'secret', unnest(regexp_extract_all(text, '" + TOKEN + "')) FROM documents) GROUP BY ALL"
)
def q_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression that the stream applies to each batch, over the whole table."""
    return incremental.outcomes(table(spark, sf_dir, "documents")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_offline_gate(spark, sf_dir)


