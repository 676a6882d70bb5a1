from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bagminhash, near_dedup
from plumbline.llm.common import bitmap, bitmap_size, materialise, maybe_in, release

WORD = re.compile(r"[^\W_]+")


def multiset(text):
    words = WORD.findall((text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def alike(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(rows, threshold=0.8):
    """Class of each row: components of links between multisets; texts without words by themselves."""
    keys, members = {}, defaultdict(list)
    for i, (_, text) in enumerate(rows):
        bag = multiset(text)
        members[frozenset(bag.items()) if bag else text or ""].append(i)
        keys[i] = bag
    groups = list(members.values())
    parent = list(range(len(groups)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for g, rows_of in enumerate(groups):
        for s in keys[rows_of[0]]:
            index[s].add(g)
    for g, rows_of in enumerate(groups):
        bag = keys[rows_of[0]]
        for o in {o for s in bag for o in index[s] if o > g}:
            if alike(bag, keys[groups[o][0]]) >= threshold:
                parent[max(root(g), root(o))] = min(root(g), root(o))
    least = defaultdict(list)
    for g, rows_of in enumerate(groups):
        least[root(g)] += rows_of
    return {i: min((rows[j][0] for j in rows_of if rows[j][0] is not None), default=None) for rows_of in least.values() for i in rows_of}


def edits(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice("abcdefghij") * 3 + str(rng.randrange(10**6))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=6))
    rows, k = [], 0
    passage = [word() for _ in range(60)]
    for g in range(30):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((k := k + 1, " ".join(edits(rng, base, rng.choice([0, 0, 1, 2, 5])))))
    cloud = [word() for _ in range(150)]
    rows += [(k := k + 1, " ".join(edits(rng, cloud, rng.randint(0, 6)))) for _ in range(120)]
    rows += [(k := k + 1, " ".join(passage + [word() for _ in range(rng.randint(5, 60))])) for _ in range(80)]
    rows += [(k := k + 1, "The same text, again and AGAIN") for _ in range(50)] + [(k := k + 1, "the same text again and again!!")]
    rows += [(k := k + 1, t) for t in ("", None, "", "!!", "??", "!!", "one", "One.", "two words")]
    return rows


def agree(got, want):
    return Counter((g, w) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("block", [500, 20])
def test_classes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "_ROWS", block)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1, r[0]) for r in rows], "doc_id long, text string, class_id string, _key int, node long").repartition(3)
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    wrong = [(rows[i], got[rows[i][0]], w) for i, w in want.items() if got[rows[i][0]] != w]
    assert not wrong
    kept = near_dedup.deduplicate(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values())) and kept[0].__fields__ == df.columns
    assert all(r._key == 1 and r.class_id == "x" and r.node == r.doc_id for r in kept)


def test_classes_on_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert all(got[rows[i][0]] == w for i, w in want.items())


def test_repeated_and_null_ids_and_empty_table(spark):
    text = "some words that are long enough to make runs"
    df = spark.createDataFrame(
        [
            (1, text), (1, text), (1, "another text of some words here"), (None, text), (None, "only here and nowhere else at all"),
            (7, None)
        ],
        "doc_id long, text string"
    )
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.deduplicate(df).collect()), key=str)
    assert kept == sorted([(1, text), (1, "another text of some words here"), (None, "only here and nowhere else at all"), (7, None)], key=str)
    assert near_dedup.classes(df).count() == 6
    assert near_dedup.classes(df.where("false")).count() == 0 and near_dedup.deduplicate(df.where("false")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    for a, b in (((1, 1, 1, 1, 0, 0), (1, 1, 1, 0, 1, 1)), ((9, 2, 1, 0, 5, 1), (3, 2, 0, 4, 7, 1)), ((1, 30), (1, 10))):
        estimates = []
        for _ in range(30):
            hashed = np.sort(rng.integers(0, 2**63, len(a), dtype=np.uint64))
            rows = np.repeat([0, 1], len(a))
            counts = np.array([*a, *b])
            keep = counts > 0
            s = bagminhash.signatures(rows[keep], np.tile(hashed, 2)[keep], counts[keep], 2, 256)
            estimates.append((s[0] == s[1]).mean())
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(np.mean(estimates) - true) < 4 * (true * (1 - true) / 256 / 30) ** 0.5 + 0.005


def test_shared_elements_against_sets():
    rng = random.Random(5)
    base = set(rng.sample(range(10**6), 300))
    make = lambda: np.array(sorted({x for x in base if rng.random() < 0.9} | set(rng.sample(range(10**6), rng.randint(0, 40)))), np.uint32)
    left = [make() for _ in range(30)] + [np.zeros(0, np.uint32), np.arange(5, dtype=np.uint32)]
    for right in ([make() for _ in range(50)] + [np.zeros(0, np.uint32)], [np.arange(3, dtype=np.uint32)], [np.zeros(0, np.uint32)]):
        got = np.stack(list(near_dedup.shared_elements(left, right)))
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_rows_of_the_block_step_are_linear_in_a_cloud_below_the_threshold(spark):
    """Near copies of one text that are just not linked: each is sent twice under each leader, however many there are."""
    sent = []
    for n in (500, 1000, 2000):
        led = spark.range(1, n).select(F.lit(0).cast("long").alias("leader"), F.col("id").alias("node"))
        nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(400).cast("long").alias("n"))
        sent.append(near_dedup._dealt(led, nodes.select("node", F.col("node").alias("component")), nodes).count())
    assert sent == [2 * 499 - 1, 2 * 999 - 1, 2 * 1999 - 1]


def test_bitmap_rules_out_no_key(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("k"))
    bits = bitmap_size(500)
    rows = spark.range(2000).select("id", F.xxhash64("id").alias("k"))
    got = maybe_in(rows, "k", bitmap(keys, "k", bits), bits).collect()
    assert all(r["bitmap:hit"] for r in got if r.id < 500) and sum(r["bitmap:hit"] for r in got) < 510 and len(got) == 2000
    assert (bitmap_size(0), bitmap_size(10**6), bitmap_size(10**12)) == (1 << 22, 1 << 24, 1 << 28)


def test_checkpoint_files_go_when_they_are_released(spark):
    df = materialise(spark.range(10))
    file = df._jdf.logicalPlan().rdd().getCheckpointFile().get().replace("file:", "")
    assert os.path.isdir(file)
    release(df)
    assert not os.path.exists(file)
