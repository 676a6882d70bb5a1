from __future__ import annotations

import re

import numpy as np

import corpus_pipeline
from plumbline.llm import quality

from .test_near_dedup import brute
from .test_packing import check_pieces

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "pii", "packing"]

    good = stages["quality"](spark, docs, SF).cache()
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = lambda t: model.score(np.array([quality.measure(t)]))[0]
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if score(r.text) >= 0.7}

    single = stages["near_dedup"](spark, good, SF).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == set(brute(rows).values())

    private = stages["pii"](spark, single, SF).cache()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in private.collect():
        assert r.n_chars == len(r.text)
        for m in re.findall(r"\S+@\S+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+", before[r.doc_id]):
            assert m not in r.text
    for frame in (good, single, private):
        assert frame.columns == corpus_pipeline.COLUMNS

    check_pieces(stages["packing"](spark, private, SF).collect(), {r.doc_id: r.text for r in private.collect()})


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns
