from __future__ import annotations

import random
import zlib

import numpy as np

from plumbline.llm import quality
from plumbline.llm.queries import op5_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op5_quality(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for k, r in rows.items())
    held = [k for k in labels if rows[k].held_out]
    assert np.mean([rows[k].predicted == labels[k] for k in held]) > 0.95
    good, bad = ([rows[k].score for k in held if labels[k] == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_pairs_are_ranked_and_the_loss_is_at_its_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.MEASURES)))
    y = (x[:, 0] - 2 * x[:, 3] + rng.normal(size=400) * 0.3 > 0).astype(int)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.7) == (y == 1)).mean() > 0.93
    assert model == quality.fit(x, y)


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "a fine text of words", "x"), (1, "a fine text of words", "y"), (2, None, "x"), (3, "", None), (None, "Q" * 100_000, "x")],
        "doc_id long, text string, score string"
    )
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert quality.scored(docs.where("false"), model).count() == 0
    assert sorted(str(r) for r in quality.accepted(docs, model).collect()) == sorted(
        str(d) for d, r in zip(docs.collect(), rows, strict=True) if r.score >= 0.7
    )
    neutral = quality.learn(docs, labels.where("false"))
    assert all(r.score >= 0.7 for r in quality.scored(docs, neutral).collect())
    assert random.Random(0) and len(quality.measure("x")) == len(quality.MEASURES) == len(quality.measure(""))


def test_fit_against_all_pairs_and_cut_against_all_quantiles():
    """The weights are where the loss over every pair of a good and a bad row has no slope, and no other cut separates better."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, len(quality.MEASURES)))
    y = (x[:, 0] + x[:, 1] + rng.normal(size=70) > 1).astype(int)
    model = quality.fit(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    good, bad = z[y == 1], z[y == 0]
    rounds = min(len(good), len(bad))
    assert rounds <= 40  # every pair is in the fit then
    w = np.array(model.weights)
    d = (good[:, None, :] - bad[None, :, :]).reshape(-1, x.shape[1])
    slope = 2.0 * w - d.T @ (1 / (1 + np.exp(d @ w))) / rounds
    assert np.abs(slope).max() < 1e-6
    strength = z @ w
    right = lambda cut: np.mean(strength[y == 1] >= cut) + np.mean(strength[y == 0] < cut)
    assert right(model.cut) >= max(right(c) for c in [*strength, strength.max() + 1]) - 1e-9
    ties = quality.fit(np.repeat(x, 2, axis=0), np.repeat(y, 2))
    assert np.allclose(ties.centre, model.centre) and right(ties.cut) > 0


def test_one_text_an_id_is_collected(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "BAD!! " * 30)] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    whole = quality.fit
    quality.fit = lambda x, y, at: (seen.append(len(x)), whole(x, y, at))[1]
    try:
        quality.learn(docs, labels)
    finally:
        quality.fit = whole
    assert seen == [2]
