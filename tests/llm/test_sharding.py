from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

from plumbline.llm import sharding
from plumbline.llm.queries import op6_sharding


def shards_of(spark, rows, n=24):
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, shard int").repartition(3)
    return sharding.numbered(sharding.assign(sharding.metadata(df), n), rows_per_bucket=50).collect()


def test_bytes_are_near_equal_and_copies_stay(spark):
    rng = random.Random(1)
    rows = [
        (i, "".join(rng.choices("abcé ", k=int(rng.paretovariate(1.2) * 30) % 2000))) for i in range(4000)
    ] + [(10_000 + i, "copy " * 20) for i in range(25)] + [(1, None), (2, ""), (2, "")]
    got = shards_of(spark, rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    size, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert any(r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) for t in texts[r.doc_id])
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_hash].add(r.shard)
    assert len(got) == len(rows) and set(size) == set(range(24))
    assert max(size.values()) < 1.1 * min(size.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_large_groups_stay_whole_up_to_a_shard(spark):
    """Copies that hold nearly a whole shard stay together, and the shards are still near equal."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abc ", k=200))) for i in range(1600)]
    for g, copies in enumerate((180, 120, 60, 40)):
        rows += [(10_000 * (g + 1) + i, f"group {g} " + "x" * 191) for i in range(copies)]
    got = shards_of(spark, rows, 10)
    homes, size = defaultdict(set), defaultdict(int)
    for r in got:
        homes[r.text_hash].add(r.shard)
        size[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values()) and len(size) == 10
    assert max(size.values()) < 1.03 * min(size.values())


def test_cuts_against_brute_force(spark):
    """Every cut is along the widest dimension, and its left side has the wanted bytes but for one text or a thousandth of a shard."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdefg ", k=rng.randint(0, 400)))) for i in range(1500)] + [(9000 + i, "tie") for i in range(9)]
    meta = sharding.metadata(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = []
    whole = sharding.Tree.column
    sharding.Tree.column = lambda self, node=None: (seen.append(self) if node is None else None, whole(self, node))[1]
    try:
        got = sharding.assign(meta, 7).collect()
    finally:
        sharding.Tree.column = whole
    tree = seen[-1]
    scale = lambda v: min(max(math.floor(v * sharding._SCALE), 0), sharding._SCALE) << 32
    points = [
        (
            (scale(math.log2(r["size"]) / 31.0) | r.text_hash & 0xFFFFFFFF, scale(r.text_crc32 / 2**32) | r.text_hash & 0xFFFFFFFF),
            r["size"], r.shard
        ) for r in got
    ]
    total = sum(p[1] for p in points)
    spread = [max(p[0][d] for p in points) - min(p[0][d] for p in points) for d in (0, 1)]
    stack, cuts = [((0, 7), points)], 0
    while stack:
        (low, high), some = stack.pop()
        if high - low == 1:
            assert all(p[2] == low for p in some)
            continue
        cuts += 1
        d, value = tree.cuts[low, high]
        assert d == max((0, 1), key=lambda d: ((max(p[0][d] for p in some) - min(p[0][d] for p in some)) / spread[d], -d))
        mid = low + (high - low) // 2
        left, right = [p for p in some if p[0][d] <= value], [p for p in some if p[0][d] > value]
        off = abs(sum(p[1] for p in left) - sum(p[1] for p in some) * (mid - low) / (high - low))
        assert off <= max(1e-3 * total / 7, max(p[1] for p in some))
        stack += [((low, mid), left), ((mid, high), right)]
    assert cuts == 6


def test_repeated_rows_are_counted_and_ties_and_equal_dimensions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_COPIES", 50)
    rows = [(1, "same")] * 400 + [(2, "other")] * 30 + [(i, "aaaa") for i in range(3, 60)]
    got = shards_of(spark, rows, 3)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_sharding(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    homes, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "bytes", None) and 0 <= r.shard < 24
        homes[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_text_with_most_bytes_is_shared_out(spark):
    rows = [(i, "hot text " * 30) for i in range(3000)] + [(5000 + i, f"other {i} " * 5) for i in range(800)]
    size = defaultdict(int)
    for r in shards_of(spark, rows, 8):
        size[r.shard] += r.size
    assert len(size) == 8 and max(size.values()) < 1.1 * min(size.values())


def test_small_and_empty_tables(spark):
    assert [(r.shard, r.slot) for r in shards_of(spark, [(1, "only")])][0][1] == 0
    assert len(shards_of(spark, [(None, None), (None, None), (3, "x")])) == 3
    assert shards_of(spark, []) == []
