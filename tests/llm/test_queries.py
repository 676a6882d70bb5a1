"""The registered queries against plain Python, and the stages of the pipeline on rows that are out of the ordinary."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.common import table

from .test_near_dedup import brute as brute_classes
from .test_pieces import brute as brute_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


def test_packing(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    rows = queries.op4_packing(spark, SF).collect()
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for k, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for start, n, crc, total in sorted(pieces[k]):
            assert (start, total) == (at, len(ids)) and n > 0
            assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + n]))
            at += n
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= 1024 and math.log2(at).is_integer()  # a power of two, so there is no padding


def test_near_duplicates(spark, texts):
    rows = [(k, t) for k, t in texts.items()]
    want = brute_classes(rows)
    got = queries.op9_near_dedup(spark, SF).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for i in want.values():
        sizes[i] += 1
    by_id = {rows[i][0]: c for i, c in want.items()}
    for r in got:
        assert (r.class_id, r.class_rows, r.kept) == (by_id[r.doc_id], sizes[by_id[r.doc_id]], r.doc_id == by_id[r.doc_id])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_pieces(spark, texts):
    import xxhash

    got = {r.doc_id: r for r in queries.op10_pieces(spark, SF).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        r = got[k]
        sha = hashlib.sha256(text.encode()).hexdigest()
        assert (r.text_sha256, r.decoded_sha256) == (sha, sha)
    for k in sorted(texts, key=lambda k: len(texts[k]))[:60]:
        ids, score = brute_pieces(texts[k])
        seed = 42
        for i in ids:  # the hash of an array goes on from element to element
            seed = xxhash.xxh64_intdigest(int(i).to_bytes(4, "little"), seed)
        assert got[k].n_ids == len(ids) and got[k].ids_hash == signed(seed) and abs(got[k].score - score) < 1e-6


def test_licences_and_media_and_sharding_cover_all_rows(spark, texts):
    for query in (queries.op8_licenses, queries.op7_media, queries.op6_sharding, queries.op5_quality):
        assert sorted(r.doc_id for r in query(spark, SF).select("doc_id").collect()) == sorted(texts)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_long_texts_repeats_and_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS).where("doc_id < 40")
    odd = [
        (None, None, None, None, None), (None, "no id", "en", "a", 5), (9001, "", None, None, 0),
        (9002, "word " * 60_000, "en", "b", 300_000), (9003, "Again and again the same.", "en", "c", 25),
        (9003, "Again and again the same.", "en", "c", 25)
    ]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    clashing = rows.withColumns({c: F.lit("x") for c in ("_text", "words", "near_dedup:id", "pii:rewritten", "score", "ids", "bag", "hot_join:value")})
    got = stage(spark, clashing, SF)
    out = got.collect()
    assert len(out) > 0
    if name == "packing":
        tokens = {(r.doc_id, r.start): r.length for r in out}
        assert tokens and {r.doc_id for r in out} == {r.doc_id for r in rows.collect()}
    else:
        assert got.columns == corpus_pipeline.COLUMNS
    if name == "near_dedup":
        assert sum(r.doc_id == 9003 for r in out) == 1 and sum(r.text == "no id" for r in out) == 1
    if name == "pii":
        assert len(out) == rows.count() and sum(r.text is None for r in out) == 1 + docs.where("text is null").count()
    assert stage(spark, clashing.where("false"), SF).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    table(spark, SF, "documents").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_the_small_table(spark, texts):
    """The rows of run() are those of the stages one after another, and of the folders only what it reads stays."""
    import os

    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).replace("file:", "")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(kept) < len(texts) and {r.doc_id for r in got.select("doc_id").distinct().collect()} == set(kept)
    left = [p for n in set(os.listdir(folder)) - before if n.startswith("pipeline-") for p in os.listdir(os.path.join(folder, n))]
    assert left == ["pii"]


@pytest.mark.parametrize("name", ["op2_url_filter", "op9_near_dedup"])
def test_against_sql(spark, name):
    import duckdb

    from plumbline.llm.sql import SQL

    connection = duckdb.connect()
    for t in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = connection.sql(SQL[name])
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(result.columns)
    shown = lambda v: repr(round(v, 7)) if isinstance(v, float) else str(v)
    assert sorted([shown(r[c]) for c in result.columns] for r in found.collect()) == sorted([shown(v) for v in r] for r in result.fetchall())
