from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.tokens import Encoder

JSON = open(public_tokenizers.path("byte_bpe_50k.json")).read()
LIBRARY = Tokenizer.from_str(JSON)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "a", "one two  three", " lead", "trail ", "x\ny z\n\nq", "tab\tx y", "don't we'll 12 345!! ¿qué?",
        "a<|endoftext|>b <|endoftext|> c", "é😀 漢字 かな", "a　b c", "it 's  \n 's x", " a b", "a  b", "a\xa0 b", "a \x1c b", "a\r\n b"
    ]
)
def test_ids_equal_the_library(text):
    assert Encoder(JSON).ids(text).tolist() == plain(text)


def test_ids_of_random_texts_and_long_runs():
    rng, enc = random.Random(5), Encoder(JSON)
    assert enc.fast is not None
    for _ in range(300):
        text = "".join(
            rng.choice(
                ["the ", "x", "'s", " ", "\n", "12", "é", ". ", "Word", "\t", "\u2003", "漢字", "<|endoftext|>"]
            ) for _ in range(rng.randint(0, 60))
        )
        assert enc.ids(text).tolist() == plain(text)
    for text in ("a" * 20_000, " " * 100_000 + "x", "ab " * 50_000, "\n" * 30_000, "!?" * 10_000):
        assert enc.ids(text).tolist() == plain(text)


def check_pieces(rows, texts):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    for k, text in texts.items():
        assert sum((ids for _, ids, _ in sorted(pieces[k])), []) == [*plain(text), 0]
        assert {n for _, _, n in pieces[k]} == {len(plain(text)) + 1}


def test_pack_round_trip(spark):
    rng = random.Random(2)
    texts = {
        i: " ".join(rng.choices(["alpha", "beta", "Γ", "longerword", "x\ny"], k=rng.choice([0, 1, 5, 300, 1500]))) for i in range(150)
    } | {150: "z " * 9000, 151: ""}
    rows = [(k, v, "en", 1) for k, v in texts.items()] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, start long").repartition(3)
    got = packing.pack(df, JSON, block=40).collect()
    check_pieces(got, texts | {None: ""})
    assert packing.pack(df.where("false"), JSON).count() == 0


def test_assign_takes_the_cheapest_with_room():
    placed = packing.assign([600, 500, 400, 300, 248], 1024)
    assert sum(n for _, _, n, _, _ in placed) == 2048
    assert [(i, s) for i, _, _, s, _ in placed][:4] == [(0, 0), (1, 1), (2, 1), (3, 0)]
