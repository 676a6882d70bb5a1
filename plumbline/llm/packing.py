"""Cost-balanced packing of documents into training sequences.

Every document becomes its token ids and one end id. It is cut every ``capacity`` tokens; each whole cut is a sequence of its own. What
remains of the documents is packed in blocks of at most ``block`` remainders: in descending length, each goes to the sequence of lowest
estimated cost (``linear`` a token plus ``quadratic`` for each pair of tokens of one piece, as attention masked by document costs) that
has room for it, and is cut where none has. A block opens as many full sequences as its tokens fill and, for the rest of under
``capacity`` tokens, one sequence for each power of two in that number, so nothing needs padding.

A block lives in one task and holds a bounded number of tokens; tasks work on their own part of the input, so nothing is shuffled and
no key can be hot. A lost task is redone on the same part and gives the same sequences again.

Edge cases: a null text is an empty one, whose only token is the end id. A null id is carried. Rows that repeat are documents of their
own. An empty table gives an empty result. Only the id and the text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64())
    ]
)


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Place remainders, all shorter than ``capacity``: (remainder, start in it, length, sequence, offset) of each piece."""
    total = sum(lengths)
    room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    room = np.array(room, np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    out = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[i]
        while left:
            fits = room >= left
            s = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            n = min(left, int(room[s]))
            out.append((i, start, n, s, int(size[s] - room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


class _Rows:
    """Output rows, handed on in batches of bounded bytes."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.bytes += len(row[3]) + 64

    def take(self) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _ARROW, strict=True)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def pack(
    docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 0, block: int = 4096, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """One row for each piece: its document, place and ids (little-endian unsigned 32-bit), its sequence and place there."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        sequence = TaskContext.get().partitionId() << 33
        rows, waiting = _Rows(), []

        def packed() -> None:
            nonlocal sequence
            last = -1
            for i, start, n, s, offset in assign([len(w[2]) for w in waiting], capacity):
                doc_id, before, ids, tokens = waiting[i]
                rows.add(doc_id, before + start, n, ids[start : start + n].astype("<u4").tobytes(), tokens, sequence + s, offset)
                last = max(last, s)
            sequence += last + 1
            waiting.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py()), np.array([end_id], enc.dtype))
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    rows.add(doc_id, start, capacity, ids[start : start + capacity].astype("<u4").tobytes(), len(ids), sequence, 0)
                    sequence += 1
                    if rows.bytes > 4 << 20:
                        yield rows.take()
                if whole < len(ids):
                    waiting.append((doc_id, whole, ids[whole:].copy(), len(ids)))
                if len(waiting) >= block:
                    packed()
                if rows.bytes > 4 << 20:
                    yield rows.take()
        if waiting:
            packed()
        if rows.rows:
            yield rows.take()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, SCHEMA)
