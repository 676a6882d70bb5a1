"""How much text a Python worker has at once: a batch of bounded size, however many rows a task has."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline import evaluate
from plumbline.functions import batches
from plumbline.operators import chunks, corpus, spans
from plumbline.plans import catalogue

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS, CHARS = 200, 15_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """3 MB of texts in one file, so that one task reads them."""
    folder = tmp_path_factory.mktemp("batches")
    line = "plain words of a line, ann@gmail.com\n"
    rows = [(i, f"# {i}\n" + line * (CHARS // len(line)), "en") for i in range(ROWS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(ROWS)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def spied(function, where):
    """The function, which also writes down how many characters there are in the batch that it is called for."""

    def spy(*args, **more):
        frame = sys._getframe(1)
        while "texts" not in frame.f_locals:
            frame = frame.f_back
        with open(f"{where}/{os.getpid()}", "a") as out:
            out.write(f"{len(frame.f_locals['texts'])} {sum(map(len, frame.f_locals['texts']))}\n")
        return function(*args, **more)

    return spy


def largest(spark, monkeypatch, tmp_path, folder, query, module, name):
    """Characters of the largest batch of a query whose Python step calls ``name``; every row must have come."""
    spark.conf.unset(NAME)
    monkeypatch.setattr(module, name, spied(getattr(module, name), tmp_path))
    catalogue.QUERIES[query](spark, folder).write.format("noop").mode("overwrite").save()
    seen = [tuple(map(int, line.split())) for file in tmp_path.iterdir() for line in file.read_text().splitlines()]
    assert len(seen) >= ROWS
    return max(chars for _, chars in seen)


def test_session_that_sets_its_own(spark):
    spark.conf.set(NAME, "3m")
    batches.bounded()
    assert spark.conf.get(NAME) == "3m"
    spark.conf.unset(NAME)
    batches.bounded()
    assert spark.conf.get(NAME) == batches.SIZE
    assert SparkSession.active().conf.get(NAME) == batches.SIZE


def test_edits_of_pairs(spark, monkeypatch, tmp_path, folder):
    assert largest(spark, monkeypatch, tmp_path, folder, "q_diff_agreement", corpus, "degraded") < 1.2e6


def test_scan(spark, monkeypatch, tmp_path, folder):
    assert largest(spark, monkeypatch, tmp_path, folder, "q_scan_phones", spans, "scan_text") < 1.2e6


def test_chunks(spark, monkeypatch, tmp_path, folder):
    assert largest(spark, monkeypatch, tmp_path, folder, "q_chunks", chunks, "split_text") < 1.2e6


def test_report(spark, monkeypatch, tmp_path, folder):
    assert largest(spark, monkeypatch, tmp_path, folder, "q_offline_report", spans, "scan_text") < 1.2e6


def test_comments(spark):
    spark.conf.unset(NAME)
    chunks.strip_comments(F.col("text"))
    assert spark.conf.get(NAME) == batches.SIZE


def test_sections(spark, monkeypatch, tmp_path, folder):
    assert largest(spark, monkeypatch, tmp_path, folder, "q_ablation_labels", chunks, "sections_of") < 1.2e6


def test_edits(spark, monkeypatch, tmp_path, folder):
    assert largest(spark, monkeypatch, tmp_path, folder, "q_degradations", corpus, "degraded") < 1.2e6


def test_overrides(spark, monkeypatch, tmp_path, folder):
    assert largest(spark, monkeypatch, tmp_path, folder, "q_preflight_override", spans, "scan_text") < 1.2e6


def test_edits_in_another_session(spark, monkeypatch, tmp_path, folder):
    """The query's session need not be the active one."""
    own = spark.newSession()
    assert SparkSession.active() is spark
    assert largest(own, monkeypatch, tmp_path, folder, "q_degradations", corpus, "degraded") < 1.2e6


def test_scan_in_another_session(spark, folder):
    """Of tables that do not come from the catalogue too."""
    for scan in (spans.candidates, lambda d: evaluate.offline(d, "safety"), lambda d: evaluate.mock(d, "tech-spec")):
        own = spark.newSession()
        scan(own.read.parquet(f"{folder}/documents.parquet"))
        assert SparkSession.active() is spark
        assert own.conf.get(NAME) == batches.SIZE
