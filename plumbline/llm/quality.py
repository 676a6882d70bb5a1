"""Quality scores by Bradley-Terry pairwise ranking.

Each document has a strength, linear in what is measured on its whole text; a document of label 1 is preferred to one of label 0 with
the logistic probability of the difference of their strengths, and the weights are fitted on differences of such pairs. The cut lies at
the quantile of the training strengths that separates the labels best, and strengths are mapped to 0..1 so that the cut falls on a fixed
score. Labels are only read for the fit; the score of a document depends on its text alone.

The fit uses a documented sample: at most ``max_labelled`` labelled ids, chosen by a hash of the id, with one text each. Everything else
covers all rows.

Edge cases: a null or empty text has all measures zero and gets a score. Rows that repeat are scored alike. A label table without both
labels in the training rows gives the neutral model, whose score is 1 for every text. An empty table gives an empty result. Labels that
repeat or contradict count as their maximum; null labels are not used. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

#: Bytes whose shares of the text are measured, each as one class.
CLASSES = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "@", "=", "<>", "()[]{}", "\"'`",
    ":;", "-_/\\+~^", "\t\r\x0b\x0c"
)
MEASURES = (
    *CLASSES, "other bytes", "mean word", "long words", "distinct words", "repeated lines", "packed size", "log length", "empty",
    "capital words", "few words"
)
_CLASS_OF = np.full(256, len(CLASSES) + 1)
for _i, _c in enumerate(CLASSES):
    _CLASS_OF[list(_c.encode())] = _i
_CLASS_OF[128:] = len(CLASSES)


def measure(text: str) -> list[float]:
    """The numbers of one whole text, each about 0 to 5."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * (len(MEASURES) - 3) + [1.0, 0.0, 0.0]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, counts, len(CLASSES) + 2)[:-1] / len(raw)
    words = text.split()
    n = max(1, len(words))
    kinds = set(words)
    lines = text.split("\n")
    rest = [
        (len(text) - len(words) + 1) / n / 5,
        sum(len(w) for w in kinds if len(w) > 14) / max(1, sum(map(len, kinds))),
        len(kinds) / n ** 0.9,
        1 - len(set(lines)) / len(lines),
        len(zlib.compress(raw, 1)) / len(raw),
        math.log1p(len(raw)) / 5,
        0.0,
        sum(1 for w in kinds if w.isupper()) / len(kinds) if kinds else 0.0,
        1 / math.log2(2 + len(kinds)),
    ]
    return [*np.log1p(100 * shares).tolist(), *rest]


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float
    at: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - np.array(self.centre)) / np.array(self.scale)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(strength - self.cut + math.log(self.at / (1 - self.at)), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, at: float = 0.7, pairs_each: int = 40, ridge: float = 2.0, steps: int = 25) -> Model:
    """Newton's method on the pairwise logistic loss. x: measures by row; y: 1 preferred, 0 not."""
    n = x.shape[1]
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model((0.0,) * n, (0.0,) * n, (1.0,) * n, -35.0, at)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    good, bad, every = (good - centre) / scale, (bad - centre) / scale, (x - centre) / scale
    most, least = max(len(good), len(bad)), min(len(good), len(bad))
    rounds = max(1, min(pairs_each, least))
    i = np.arange(most)
    w = np.zeros(n)
    for _ in range(steps):
        gradient, hessian = ridge * w, ridge * np.eye(n)
        for k in range(rounds):  # one pairing of the two classes at a time, so that memory holds one row for each labelled document
            other = (i + k * 7919) % least if k else i % least
            d = good - bad[other] if len(good) == most else good[other] - bad
            p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
            gradient = gradient - d.T @ p / rounds
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / rounds
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    strength = every @ w
    order = np.argsort(strength, kind="stable")
    ranked, label = strength[order], y[order]
    quantile = np.arange(len(ranked) + 1)
    right = np.concatenate(
        [[0], np.cumsum(label == 0)]
    ) / max(1, (label == 0).sum()) + 1 - np.concatenate([[0], np.cumsum(label == 1)]) / max(1, (label == 1).sum())
    best = quantile[right >= right.max() - 1e-12]
    k = int(best[len(best) // 2])
    cut = float(ranked[0] - 1 if k == 0 else ranked[-1] + 1 if k == len(ranked) else (ranked[k - 1] + ranked[k]) / 2)
    return Model(tuple(w.tolist()), tuple(centre.tolist()), tuple(scale.tolist()), cut, at)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([measure(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "measures"]
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, measures array<double>")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 20_000, at: float = 0.7) -> Model:
    """Fit on at most ``max_labelled`` rows of ``labels`` that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max(label_col).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    if not sample:
        return fit(np.zeros((0, len(MEASURES))), np.zeros(0), at)
    label = {r["doc_id"]: r["label"] for r in sample}
    ids = docs.sparkSession.createDataFrame([(k,) for k in label], "doc_id long")
    # Of rows that share an id the text of the smallest hash is measured, so no more rows than ids are collected.
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    rows = measured(texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["measures"]))
    return fit(np.array([r["measures"] for r in rows]).reshape(-1, len(MEASURES)), np.array([int(label[r["doc_id"]] >= 1) for r in rows]), at)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Add ``score`` to the ``keep`` columns of every row."""
    bounded_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x), pa.float64())], [*batch.schema.names[:-1], "score"])

    return docs.select(*keep, text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the model's cut."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(MEASURES))
            yield batch.filter(pa.array(model.score(x) >= model.at, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
