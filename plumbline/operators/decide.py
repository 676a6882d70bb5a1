"""Decisions on candidates: by rules alone, by fixed mock probabilities, or by a provider.

A provider has ``decide(state, questions)`` (see :mod:`plumbline.sources.providers`); :func:`provider_answers` calls it once a batch with
retries for transient errors, and puts failures of a document into an ``error`` column instead of failing the task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import fixed as V

# Mock probabilities for a rule-like yes and no by kind.
MOCK = {"email": (0.10, 0.80), "phone": (0.10, 0.85), "ip": (0.85, 0.08), "url": (0.88, 0.08), "secret": (0.10, 0.88)}


def offline_outcome() -> Column:
    """Outcome of a span row by rules; what only a model could decide is undecided."""
    kind = F.col("kind")
    example = F.col("is_example_domain") | F.col("is_public_common") | F.col("ip_type").isin("loopback", "documentation")
    role = F.col("known_role_word") | F.col("matches_custom_role")
    return (
        F.when(kind == "email", F.when(F.col("domain_type") == "free_mail", "personal").when(role, "role").otherwise("undecided"))
        .when(kind == "credential", F.when(F.col("is_example"), "safe").otherwise("secret"))
        .when(kind == "secret", F.when(F.col("placeholder_syntax"), "safe").otherwise("undecided"))
        .when(kind == "phone", F.when(F.col("looks_like_support"), "support").otherwise("personal"))
        .when(kind == "ip", F.when(F.col("ip_type") == "private", "sensitive").otherwise("safe"))
        .when(kind == "url", F.when(F.coalesce(example, F.lit(False)), "safe").when(F.col("is_internal_tld"), "sensitive").otherwise("safe"))
    )


def offline_violates(outcome: Column) -> Column:
    return outcome.isin("personal", "sensitive", "secret")


def mock_probability() -> Column:
    """Fixed probability of the risky outcome."""
    kind = F.col("kind")
    role = F.col("known_role_word") | F.col("matches_custom_role")
    pick = lambda k, test: F.when(test, MOCK[k][0]).otherwise(MOCK[k][1])
    return (
        F.when(kind == "email", pick("email", role))
        .when(kind == "phone", pick("phone", F.col("looks_like_support")))
        .when(kind == "ip", pick("ip", F.col("ip_type") == "private"))
        .when(kind == "url", pick("url", F.col("is_internal_tld")))
        .when(kind == "secret", pick("secret", F.col("placeholder_syntax")))
    )


def online_outcome(probability: Column) -> Column:
    """Outcome where a model answered, with the rules that come before it."""
    kind, risky = F.col("kind"), probability >= V.HALF
    return (
        F.when((kind == "email") & (F.col("domain_type") == "free_mail"), "personal")
        .when(kind == "email", F.when(risky, "personal").when(probability.isNotNull(), "role").otherwise(F.when(F.col("known_role_word") | F.col("matches_custom_role"), "role").otherwise("undecided")))
        .when((kind == "phone") & F.col("is_support_prefix"), "support")
        .when(kind == "phone", F.when(risky, "personal").when(probability.isNotNull(), "support").otherwise("undecided"))
        .when(kind == "credential", "secret")
        .when(kind == "secret", F.when(F.col("placeholder_syntax"), "safe").when(risky, "secret").when(probability.isNotNull(), "safe").otherwise("undecided"))
        .when(kind.isin("ip", "url"), F.when(risky, "sensitive").otherwise("safe"))
    )


def needs_question(kind: Column, of: Callable[[str], Column] = F.col) -> Column:
    """Spans that a model is asked about; the others are decided by rules and never reach it. ``of`` gives a field of the span."""
    harmless = of("is_example_domain") | of("is_public_common") | F.coalesce(of("ip_type").isin("documentation", "loopback"), F.lit(False))
    return F.coalesce(
        F.when(kind == "email", of("domain_type") == "corporate")
        .when(kind == "phone", ~of("is_support_prefix"))
        .when(kind == "ip", ~of("ip_type").isin("documentation", "loopback"))
        .when(kind == "url", ~harmless)
        .when(kind == "secret", ~of("placeholder_syntax")),
        F.lit(False),
    )


def candidate_questions(distinct_spans: DataFrame, batch: int = V.BATCH) -> DataFrame:
    """One row a question: its id and the number of its request; a request has at most ``batch`` questions of one document."""
    order = Window.partitionBy("doc_id").orderBy("kind", "ord")
    asked = distinct_spans.where(needs_question(F.col("kind")))
    return asked.withColumn(
        "question_id", F.concat("kind", F.lit("_"), F.col("ord").cast("string"))
    ).withColumn("batch", F.floor((F.row_number().over(order) - 1) / batch).cast("int"))


def near_half(probability: Column) -> Column:
    return F.abs(probability - V.HALF) <= V.NEAR + V.EPSILON


def transient(message: str) -> bool:
    return any(code in message for code in ("429", "500", "502", "503", "504")) or "timeout" in message.lower() or "connection" in message.lower()


#: What is asked about a span of each kind.
CANDIDATE_TEXT = {
    "email": "Whether the masked address belongs to a person and not to a role",
    "phone": "Whether the masked number belongs to a person and not to a service",
    "ip": "Whether the masked address is internal or sensitive",
    "url": "Whether the masked URL is internal or sensitive",
    "secret": "Whether the masked value is a real secret and not an example",
}
ANSWERS = "doc_id long, question_id string, probability double, choice string, error string, model string, input_tokens long, output_tokens long"


def definition(question_id: str, known: dict[str, dict]) -> dict:
    """Type, instructions and criteria of a question; of a candidate, by its kind."""
    if question_id in known:
        return known[question_id]
    kind, _, n = question_id.rpartition("_")
    return {"type": "noul", "instructions": f"{CANDIDATE_TEXT.get(kind, 'Whether the item is sensitive')}: [{kind.upper()}_{n}]", "criteria": None}


def answer(given: object, question: dict) -> tuple[float | None, str | None]:
    """(value, choice) of what a provider gave: a number, or a mapping with a probability, a score or a choice."""
    if not isinstance(given, dict):
        return (None if given is None else float(given)), None
    if "choice" in given:
        return None, str(given["choice"])
    if "score" in given:
        levels = question.get("criteria") or []
        return min(max(float(given["score"]) / max(len(levels) - 1, 1), 0.0), 1.0), None
    return (None if given.get("probability") is None else float(given["probability"])), None


def provider_answers(requests: DataFrame, make: Callable[[], object], known: dict[str, dict] | None = None, attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """``requests``: doc_id, questions (array of string), state, images (array of string). One row a question: value, choice or error; the
    tokens of a request stand with its first question."""
    known = known or {}
    batches.bounded(requests.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                asked = {q: definition(q, known) for q in r["questions"]}
                state = {"document": r["state"], "images": [] if r["images"] is None else list(r["images"])}
                for k in range(attempts):
                    try:
                        got = provider.decide(state, asked)
                        usage = got.get("_usage") or {}
                        tokens = (usage.get("input_tokens") or 0, usage.get("output_tokens") or 0)
                        for i, (q, question) in enumerate(asked.items()):
                            value, choice = answer(got.get(q), question)
                            lost = "no answer" if value is None and choice is None else None
                            rows.append((r["doc_id"], q, value, choice, lost, usage.get("model"), *(tokens if i == 0 else (0, 0))))
                        break
                    except Exception as error:  # a failing document must not fail the others
                        if k + 1 == attempts or not transient(str(error)):
                            rows += [(r["doc_id"], q, None, None, str(error)[:500], None, 0, 0) for q in asked]
                            break
                        time.sleep(pause * 2**k)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    images = F.col("images") if "images" in requests.columns else F.array().cast("array<string>").alias("images")
    return requests.select("doc_id", "questions", "state", images).mapInPandas(run, ANSWERS)


def pooled(answers: DataFrame) -> DataFrame:
    """One row a document and question: over its chunks the largest value, the last choice in order, and an error if there is one."""
    return answers.groupBy("doc_id", "question_id").agg(F.max("probability").alias("value"), F.max("choice").alias("choice"), F.max("error").alias("error"))


def usage(answers: DataFrame) -> DataFrame:
    """Tokens of each document; null where none were counted."""
    total = lambda c: F.nullif(F.sum(c), F.lit(0).cast("long")).alias(c)
    return answers.groupBy("doc_id").agg(total("input_tokens"), total("output_tokens"), F.max("model").alias("model"))
