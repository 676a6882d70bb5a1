from __future__ import annotations

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.queries import op1_simhash

SCHEMA = "doc_id long, text string, lang string, _text string, fp_hi string"


def edited(rows):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(x64((r[1] or "").encode())), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_text_against_plain_python(spark):
    rng = random.Random(1)
    words = ["alpha", "Béta", "γάμμα", "😀x", "delta", "of", "the", "12"]
    rows = [(i * 7, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(None, "no id here"), (5, None), (7, rows[1][1]), (7, rows[1][1]), (9999, ""), (1, "w " * 30000)]
    df = spark.createDataFrame([(*r, "en", "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = simhash.with_neighbours(df).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted([tuple(r) for r in got], key=str) == edited(rows)


def test_equal_texts_and_single_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, "one two three four"), (3, ""), (4, None), (5, "!!")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(got) == 5
    one = simhash.with_neighbours(df.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert simhash.with_neighbours(df.where("false")).count() == 0


def test_tables_miss_no_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(40)]
    values = set(base)
    for b in base:
        for _ in range(12):
            v = b
            for bit in rng.sample(range(128), rng.randint(1, 9)):
                v ^= 1 << bit
            values.add(v)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = sorted(values)
    df = spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in values], "fp_hi long, fp_lo long")
    for radius in (3, 6):
        want = {(a, b) for a in values[::5] for b in values if (a ^ b).bit_count() <= radius}
        got = simhash.within_radius(
            df.join(
                spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in values[::5]], df.schema), ["fp_hi", "fp_lo"],
                "left_semi"
            ),
            df, radius
        ).collect()
        unsigned = lambda h, l: ((h & (2**64 - 1)) << 64) | (l & (2**64 - 1))
        pairs = [(unsigned(r.q_hi, r.q_lo), unsigned(r.fp_hi, r.fp_lo)) for r in got]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    spans, tables = simhash.table_plan(6, 30_000_000_000)
    assert len(tables[0]) * (128 // len(spans)) >= 35


def x64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def le(v, n=8):
    return (v & (2 ** (8 * n) - 1)).to_bytes(n, "little")


def brute(text):
    """The 128 bits of a text, vote by vote."""
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    codes = [1 << 4] + ([(x64(w.encode()) & ~15) + min(len(w), 15) for w in words] or [x64(text.encode()) & ~15]) + [2 << 4]
    votes = [0] * 128
    for a, b in zip(codes, codes[1:], strict=False):
        weight = 1 + ((a & 15) + (b & 15) >> 3)
        bits = x64(le(b), x64(le(a))) << 64 | x64(le(1, 4), x64(le(a), x64(le(b))))
        for k in range(128):
            votes[k] += weight if bits >> k & 1 else -weight
    return sum(1 << k for k in range(128) if votes[k] > 0)


def near(a, b):
    return 1 - (a ^ b).bit_count() / 128


def test_bits_and_likeness_against_brute_force(spark):
    rng = random.Random(6)
    words = ["alpha", "Béta", "γάμμα", "delta", "of", "the", "12", "fantastically", "i"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 31, 32, 33, 34, 90]))) for _ in range(60)] + ["!!", "", "x " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        own, edit = brute(t), brute(t[: len(t) - half] + after[:half])
        r = got[i]
        assert r.fingerprint == f"{own:032x}" and r.edited_fingerprint == f"{edit:032x}"
        assert r.near_edited == near(own, edit) and r.near_next == near(own, brute(after))


def test_one_more_word_moves_as_many_bits_at_any_length():
    rng = random.Random(9)
    words = ["".join(rng.choices("bcdfgaeiou", k=rng.randint(2, 9))) for _ in range(400)]
    moved = {}
    for n in (29, 30, 31, 32, 33, 34):
        texts = [rng.choices(words, k=n + 1) for _ in range(60)]
        moved[n] = sum((brute(" ".join(t[:-1])) ^ brute(" ".join(t))).bit_count() for t in texts) / 60
    assert max(moved.values()) < 1.35 * min(moved.values()), moved


def test_hot_ids_and_copies_are_split(spark, monkeypatch):
    """An id with most rows is cut by the hash of the text; a text and id that fill a bucket alone become one row. Neither changes a result."""
    rng = random.Random(2)
    some = [f"text number {i} {rng.random()}" for i in range(400)]
    rows = [(5, t) for t in some] + [(None, t) for t in some[:150]] + [(9, "the same again")] * 700 + [
        (i * 3, some[i]) for i in range(100)
    ] + [(5, some[0]), (5, some[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cuts, alone = simhash._cuts(df.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"), F.xxhash64("text").alias("_tie")), rows_per_bucket=50)
    assert [k for k, _ in cuts].count(5) >= 6 and [k for k, _ in cuts].count(-(2**63)) >= 2 and [k for k, _ in alone] == [9]
    plain = sorted(map(tuple, simhash.with_neighbours(df).collect()), key=str)
    whole = simhash._cuts
    monkeypatch.setattr(simhash, "_cuts", lambda source: whole(source, rows_per_bucket=50))
    monkeypatch.setattr(simhash, "_COPIES", 100)
    split = sorted(map(tuple, simhash.with_neighbours(df).collect()), key=str)
    assert split == plain and len(split) == len(rows)


def test_query_finds_all_near_documents(spark):
    """near_ids and near_docs of the query against every pair."""
    rows = [r.asDict() for r in op1_simhash(spark, "/root/testdata/sf0.001").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    bits = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert bits == {i: brute(t or "") for i, t in docs.items()}
    classes = {}
    for i in sorted(bits):
        classes.setdefault(bits[i], i)
    for r in rows:
        assert r["class_id"] == classes[bits[r["doc_id"]]]
        if r["doc_id"] % 100:
            assert r["near_ids"] is None and r["near_docs"] is None
        else:
            found = [i for i in bits if (bits[i] ^ bits[r["doc_id"]]).bit_count() <= simhash.RADIUS]
            assert r["near_docs"] == len(found) and r["near_ids"] == sorted({classes[bits[i]] for i in found})


def test_wide_radius_misses_no_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(20)]
    values = set(base)
    for b in base:
        for _ in range(30):
            values.add(b ^ sum(1 << bit for bit in rng.sample(range(128), rng.randint(1, 26))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    unsigned = lambda h, l: ((h & (2**64 - 1)) << 64) | (l & (2**64 - 1))
    frame = lambda vs: spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in vs], "fp_hi long, fp_lo long")
    values = sorted(values)
    assert len(simhash.probe_plan(simhash.RADIUS, 10_000)[0]) == 8 and len(simhash.probe_plan(simhash.RADIUS, 10**10)[0]) == 6
    for radius, rows in ((7, None), (13, None), (simhash.RADIUS, None), (simhash.RADIUS, 10**10)):
        want = {(a, b) for a in values[::5] for b in values if (a ^ b).bit_count() <= radius}
        got = [(unsigned(r.q_hi, r.q_lo), unsigned(r.fp_hi, r.fp_lo)) for r in simhash.within_radius(frame(values[::5]), frame(values), radius, rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_search_finds_planted_near_copies_by_id(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(3000)]
    rows, want = [], {}
    for k in range(25):
        text = rng.choices(words, k=300)
        edited = list(text)
        for at in (20, 90, 160, 230):  # 4 * 5 of 296 runs of five words: Jaccard 276 / 316 = 0.87
            edited[at] = "changed"
        rows += [(100 * k, " ".join(text)), (100 * k + 1, " ".join(edited)), (100 * k + 2, " ".join(text)), (100 * k + 3, " ".join(rng.choices(words, k=300)))]
        want[100 * k] = ([100 * k, 100 * k + 1], 3)
    rows.append((None, rows[0][1]))
    want[0] = ([0, 1], 4)
    found = simhash.search(simhash.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string")), F.col("doc_id") % 100 == 0).collect()
    got = {r.doc_id: (r.near_ids, r.near_docs) for r in found if r.doc_id is not None and r.doc_id % 100 == 0}
    assert len(found) == len(rows) and got == want
    assert all(r.near_ids is None for r in found if r.doc_id is None or r.doc_id % 100)
    assert {r.doc_id: r.class_id for r in found}[2] == 0 and {r.doc_id: r.class_id for r in found}[None] == 0
    none = simhash.search(simhash.with_neighbours(spark.createDataFrame([], "doc_id long, text string")), F.col("doc_id") % 100 == 0)
    assert none.count() == 0


def test_cloud_is_dealt_over_parts(spark):
    rng = random.Random(1)
    base = rng.getrandbits(128)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 9))) for _ in range(400)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = lambda vs: spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in vs], "fp_hi long, fp_lo long")
    want = sum((a ^ b).bit_count() <= simhash.RADIUS for a in values[::5] for b in values)
    got = simhash.within_radius(frame(values[::5]), frame(values), split=20)
    assert got.count() == got.distinct().count() == want
    assert simhash.within_radius(frame(values[:1]).where("false"), frame(values[:1]).where("false")).count() == 0
