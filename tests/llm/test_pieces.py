from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece

from plumbline.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = pieces.pieces_of(MODEL)
CODEC = pieces.Codec(PIECES)
BEST = {}
for _i, _b, _s, _byte in PIECES:
    if not _byte and (_b not in BEST or _s > BEST[_b][1]):
        BEST[_b] = (_i, _s)
LONGEST = max(map(len, BEST))
RNG = random.Random(11)
TEXTS = [
    "", "a", " ", "  ", "   x", "x   ", "The quick  brown fox", " lead", "tab\tnew\nline ", "▁", "a▁b", "\u0000\u0001", "漢字かな交じり", "😀🏽",
    "naïve café", "q" * 1500, "word " * 300, "�", "'s don't", "é"
]
TEXTS += ["".join(RNG.choice(["the", " ", "  ", "er", "ing", "é", "漢", "\n", "▁", "Q", "12", "."]) for _ in range(RNG.randint(1, 50))) for _ in range(150)]


def brute(text):
    """Plain Viterbi: every piece at every position, longest first."""
    if not text:
        return [], 0.0
    raw = b" " + text.encode()
    best, back = [0.0], [None]
    for end in range(1, len(raw) + 1):
        now, chosen = best[end - 1] + CODEC.byte_score, (int(CODEC.byte_id[raw[end - 1]]), 1)
        for n in range(min(LONGEST, end), 0, -1):
            if hit := BEST.get(raw[end - n : end]):
                if best[end - n] + hit[1] > now:
                    now, chosen = best[end - n] + hit[1], (hit[0], n)
        best.append(now)
        back.append(chosen)
    ids, at = [], len(raw)
    while at:
        i, n = back[at]
        ids.append(i)
        at -= n
    return ids[::-1], best[-1]


def encoded(texts):
    out = []
    for ids, score in CODEC.encode(pa.array(texts, pa.string())):
        out += list(zip(ids.to_pylist(), score.to_pylist(), strict=True))
    return out


def test_against_brute_force_and_round_trip(monkeypatch):
    for size in (300_000, 40):
        monkeypatch.setattr(pieces, "_SLICE", size)
        monkeypatch.setattr(pieces, "_CHUNK", 7 if size == 40 else 16_384)
        got = encoded(TEXTS)
        assert len(got) == len(TEXTS)
        for text, (ids, score) in zip(TEXTS, got, strict=True):
            want, best = brute(text)
            assert ids == want and abs(score - best) < 1e-6 * max(1, abs(best)), text
            assert CODEC.decode(np.array(ids, np.int64)) == text


def test_decoding_agrees_with_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("The quick brown fox", "naïve café 漢字", "a b c"):
        assert sp.decode(encoded([text])[0][0]) == text == CODEC.decode(np.array(sp.encode(text), np.int64))


def test_columns(spark):
    rows = [(1, "some text", "x"), (1, "some text", "x"), (None, None, None), (3, "", "y"), (4, "w " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = pieces.encode(df, MODEL)
    assert coded.columns == ["doc_id", "ids", "score"]
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(coded, MODEL).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert pieces.encode(df.where("false"), MODEL).count() == 0
