"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives a single-pass Viterbi.

A text is its bytes behind one blank (the marker of a word start). The automaton reads them once; at each position the output links of
its state list, longest first, the pieces that end there, and each relaxes the best score of the position. A byte without any piece is
encoded by its byte piece at a score below all others. The best path is read back from the end. Ties keep the longest last piece.

No piece has a blank behind another character, so the best path of a text is that of its words, each with the blanks before it, one after
another. Distinct words of a batch are encoded once, all in step: position by position, arrays of states, scores and back pointers.

Decoding joins the bytes of the pieces and takes the first blank off; it returns the text exactly, whatever it holds.

Edge cases: a null or empty text has no ids; no ids decode to an empty text. Blanks, controls and the marker character itself come back
unchanged. A null list of ids decodes to null. Rows that repeat are encoded alike. An empty table gives an empty result. Words of any
length are read; one beyond 512 bytes goes through the same recurrence alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

MARKER = "▁"
_SEGMENT = re.compile(rb" *[^ ]+| +$")
_SLICE, _CHUNK, _CELLS, _LONG = 150_000, 16_384, 400_000, 512
_CODECS: dict[int, Codec] = {}


def pieces_of(path: str) -> list[tuple[int, bytes, float, bool]]:
    """(id, bytes, score, is a byte piece) of a SentencePiece model file, without control, unknown and unused pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append((i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]), 0.0, True))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            out.append((i, sp.id_to_piece(i).replace(MARKER, " ").encode(), sp.get_score(i), False))
    return out


class Codec:
    def __init__(self, pieces: list[tuple[int, bytes, float, bool]]):
        plain = [(i, b, s) for i, b, s, is_byte in pieces if not is_byte]
        if any(b" " in b.lstrip(b" ") for _, b, _ in plain):
            raise ValueError("a piece has a blank behind another character")
        self.byte_id = np.full(256, -1, np.int32)
        for i, b, _, is_byte in pieces:
            if is_byte:
                self.byte_id[b[0]] = i
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        self.byte_score = min(s for _, _, s in plain) - 10.0
        size = max(i for i, *_ in pieces) + 1
        self.bytes_of = [b""] * size
        for i, b, *_ in pieces:
            self.bytes_of[i] = b
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        self.spelled = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.at = np.cumsum(self.width) - self.width
        self._build(plain)

    def _build(self, plain: list[tuple[int, bytes, float]]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float, int]] = {}
        for i, b, score in plain:
            s = 0
            for c in b:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                s = children[s][c]
            if s not in ends or score > ends[s][1]:
                ends[s] = (i, score, len(b))
        n = len(children)
        self.goto = np.zeros((n, 256), np.uint16 if n <= 1 << 16 else np.int32)
        self.piece, self.score, self.length, self.output = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int32)
        for s, (i, score, length) in ends.items():
            self.piece[s], self.score[s], self.length[s] = i, score, length
        fail, queue = [0] * n, [0]
        for s in queue:
            row = self.goto[fail[s]].copy() if s else self.goto[0]
            for c, child in children[s].items():
                fail[child] = int(row[c]) if s else 0
                f = fail[child]
                self.output[child] = f if self.piece[f] >= 0 else self.output[f]
                row[c] = child
                queue.append(child)
            self.goto[s] = row
        self.first = np.where(self.piece >= 0, np.arange(n), self.output).astype(np.int32)

    def _together(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``text`` in descending length, padded: (ids, ids of each row, score of each row)."""
        n, longest = text.shape
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, longest + 1), np.int32)
        state = np.zeros(n, np.int64)
        for t in range(longest):
            m = int(np.searchsorted(-lengths, -t, side="left"))  # rows longer than t
            c = text[:m, t]
            state = self.goto[state[:m], c].astype(np.int64)
            now, chosen = best[:m, t] + self.byte_score, self.byte_id[c]
            out = self.first[state]
            rows = np.flatnonzero(out)
            out = out[rows]
            while len(rows):
                offer = best[rows, t + 1 - self.length[out]] + self.score[out]
                better = offer > now[rows]
                now[rows[better]], chosen[rows[better]] = offer[better], self.piece[out[better]]
                out = self.output[out]
                on = out > 0
                rows, out = rows[on], out[on]
            best[:m, t + 1], back[:m, t + 1] = now, chosen
        place, rows, steps, counts = lengths.copy(), np.arange(n), [], np.zeros(n, np.int64)
        while len(rows):
            ids = back[rows, place[rows]]
            steps.append((rows, ids))
            counts[rows] += 1
            place[rows] -= self.width[ids]
            rows = rows[place[rows] > 0]
        ids = np.empty(int(counts.sum()), np.int32)
        end = np.cumsum(counts) - 1
        for k, (rows, some) in enumerate(steps):
            ids[end[rows] - k] = some
        return ids, counts, best[np.arange(n), lengths]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode each of an array of distinct words behind one blank."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets) + 1
        order = np.argsort(-lengths, kind="stable")
        ids, counts, scores = [], np.zeros(len(words), np.int64), np.zeros(len(words))
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            n = 1 if longest > _LONG else max(1, min(_CHUNK, _CELLS // longest))
            rows = order[at : at + n]
            size = lengths[rows]
            text = np.full((len(rows), int(size[0])), 32, np.uint8)
            inside = np.arange(1, size[0])[None, :] < size[:, None]
            source = offsets[rows][:, None] + np.arange(size[0] - 1)[None, :]
            text[:, 1:][inside] = raw[source[inside]]
            found, counts[rows], scores[rows] = self._together(text, size)
            ids.append(found)
            at += n
        ends = np.cumsum(counts[order])
        start = np.empty(len(words), np.int64)
        start[order] = ends - counts[order]
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        return flat[_spread(start, counts)], counts, scores

    def encode(self, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
        """(ids, scores) of runs of texts."""
        several = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        first = 0
        while first < len(texts):
            last = min(len(texts), max(first + 1, int(np.searchsorted(offsets, offsets[first] + _SLICE, side="right")) - 1))
            if several[first]:
                last = first + 1
                parts = pa.array([s[1:].decode() for s in _SEGMENT.findall(b" " + texts[first].as_py().encode())], pa.string())
                bounds = np.array([0, len(parts)])
            else:
                stop = np.flatnonzero(several[first:last])
                last = first + int(stop[0]) if len(stop) else last
                parts = split.values.slice(offsets[first], offsets[last] - offsets[first])
                bounds = offsets[first : last + 1] - offsets[first]
            coded = parts.dictionary_encode()
            uids, ucounts, uscores = self.words(coded.dictionary)
            ustart, index = np.cumsum(ucounts) - ucounts, coded.indices.to_numpy()
            empty = pc.equal(texts.slice(first, last - first), "").to_numpy(zero_copy_only=False)
            counts = ucounts[index]
            counts[bounds[:-1][empty]] = 0
            row = np.repeat(np.arange(last - first), np.diff(bounds))
            per_row = np.bincount(row, counts, last - first).astype(np.int64)
            score = np.bincount(row, uscores[index], last - first)
            score[empty] = 0
            ids = uids[_spread(ustart[index], counts)]
            yield pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.array(ids, pa.int32())
            ), pa.array(score, pa.float64())
            first = last

    def decode(self, ids: np.ndarray) -> str:
        return self.spelled[_spread(self.at[ids], self.width[ids])].tobytes()[1:].decode("utf-8", "replace")


def _spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run."""
    return np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _codec(pieces) -> Codec:
    """One codec a Python worker and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(pieces)
    return _CODECS[key]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) and ``score`` (of the best path) to the ``keep`` columns; ``model`` is the path of a model file, read
    by the driver."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces_of(model))
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            first = 0
            for ids, score in codec.encode(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, len(ids)) for c in batch.columns[:-1]], ids, score], [*batch.schema.names[:-1], "ids", "score"]
                )
                first += len(ids)

    return docs.select(*keep, text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """Add ``text`` to the ``keep`` columns."""
    bounded_batches(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(pieces_of(model))
    fields = [coded.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [codec.decode(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))],
                [*batch.schema.names[:-1], "text"]
            )

    return coded.select(*keep, F.col(ids_col).alias("_ids")).mapInArrow(run, schema)
