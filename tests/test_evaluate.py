from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline import evaluate
from plumbline.functions import fixed as V

KEY = "AKIA" + "Q7" * 8
TEXT = f"Mail joe@gmail.com, amy@corp.com\nand {KEY} {KEY}\npwd=hunter2 10.0.0.5 https://wiki.corp.internal/ <!-- gone --> joe@gmail.com"


def test_offline(spark):
    df = spark.createDataFrame(
        [(1, TEXT, "a"), (2, "fine info@corp.com", "b"), (3, None, "c"), (4, "x" * 30_000, "d")], "doc_id long, text string, path string"
    )
    r = {x.doc_id: x for x in evaluate.offline(df, "quality").collect()}
    assert r[1].violations == [
        "PII Exposure: [EMAIL_1] is an individual address (free-mail)",
        "PII Exposure: [IP_1] is an internal/sensitive IP address",
        "PII Exposure: [URL_1] is an internal/sensitive URL",
        "Credential Exposure: [REDACTED_AWS_KEY] is a known aws_key credential",
    ]
    assert (r[1].passed, r[1].redactions_count, r[1].path, r[1].model) == (False, 8, "a", "offline-rules")
    places = {v.message.split(" ")[2]: (v.line, v.column) for v in r[1].structured_violations}
    assert places["[EMAIL_1]"] == (1, 6) and places["[REDACTED_AWS_KEY]"] == (2, 26)
    assert r[2].passed and r[3].passed and r[4].was_truncated and not r[2].was_truncated
    assert evaluate.exit_code(evaluate.offline(df, "quality")) == 1 and evaluate.exit_code(evaluate.offline(df.where("doc_id = 2"), "quality")) == 0
    assert "text" not in r[1].__fields__ and KEY not in str(r)


def test_mock_never_fails(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    r = evaluate.mock(df, "tech_spec").first()
    assert r.passed and r.mock and r.violations == [] and abs(r.composite_score - 0.78) < 1e-12
    safe = evaluate.mock(df, "safety").first()
    assert safe.composite_score is None and safe.answers == {"has_secrets": 0.05, "has_pii": 0.05, "confidentiality_risk": 0.85}
    prose = spark.createDataFrame([(1, "the password is abc, says Jane Doe")], df.schema)
    assert evaluate.mock(prose, "safety").first().answers["has_secrets"] == 0.9


class Provider:
    """Answers by what the state holds."""

    def decide(self, state, questions):
        text = state["document"]
        assert "hunter2" not in text and len(questions) <= V.BATCH and all(q["instructions"] for q in questions.values())
        if "FAIL" in text:
            raise RuntimeError("400")
        given = {
            "clarity": {"score": 1.1}, "has_secrets": 0.9 if "late secret" in text else 0.1, "has_pii": 0.05, "confidentiality_risk": 0.3,
            "policy_compliance": {"choice": "compliant"}
        }
        return {q: given.get(q, 0.8 if q in ("email_2", "secret_3") else 0.2) for q in questions}


def test_online(spark):
    long = "word " * 100 + "late secret " + "word " * 100
    df = spark.createDataFrame([(1, TEXT), (2, "plain"), (3, long), (4, "FAIL")], "doc_id long, text string")
    r = {x.doc_id: x for x in evaluate.online(df, "safety", Provider, max_chars=400, overlap=40, pause=0.0).collect()}
    assert r[1].violations == [
        "Credential Exposure: 2 credential(s) detected by pre-flight scan (model: 0.10)",
        "PII Exposure: 2 personal PII item(s) detected by pre-flight scan (model: 0.05)",
        "Credential Exposure: [REDACTED_AWS_KEY] is a known format secret",
        "Credential Exposure: [REDACTED_AWS_KEY] is a known format secret",
        "Credential Exposure: [SECRET_3] is an exposed secret (model: 0.80)",
        "PII Exposure: [EMAIL_1] is an individual address (free-mail)",
        "PII Exposure: [EMAIL_2] is an individual address (model: 0.80)",
    ]
    assert r[2].passed and r[2].api_calls == 1 and r[2].error is None and r[2].choices == {"policy_compliance": "compliant"}
    assert r[3].violations == ["Credential Exposure: risk 0.90 exceeds allowed maximum 0.20"] and r[3].was_truncated and r[3].api_calls > 2
    assert r[4].error and r[4].passed is None
    q = evaluate.online(df.where("doc_id = 2"), "quality", Provider, pause=0.0).first()
    assert q.passed and q.warnings == ["Clarity & Structure: score 0.55 is below minimum 0.60 (warning)"] and abs(q.composite_score - 0.55) < 1e-12
    with pytest.raises(ValueError):
        evaluate.online(df, "nothing", Provider)
    assert evaluate.ordered(evaluate.mock(df, "quality")).select(F.first("doc_id")).first()[0] == 1
