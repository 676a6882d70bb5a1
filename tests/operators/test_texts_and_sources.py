from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import features as X
from plumbline.operators import chunks, corpus, report
from plumbline.sources import files
from plumbline.streaming import incremental


def test_chunks_cover_the_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "\n", "\n\n", "x" * 30]) for _ in range(rng.randint(0, 120)))
        limit, overlap = rng.randint(20, 400), rng.randint(0, 80)
        parts = chunks.split_text(text, limit, overlap)
        assert all(len(c) <= limit and text[s : s + len(c)] == c for s, c in parts)
        end = 0
        for s, c in parts:
            assert s <= end
            end = s + len(c)
        assert end == len(text)
    with pytest.raises(ValueError):
        chunks.split_text("x", 0)


def test_guard_comments_sections_headings(spark):
    long = "a" * 30 + "b" * 30
    text = "pre\n## One\nbody\n```\n## not\n```\n## 二つ\nmore\n**Bold**\nTitle\n=====\n# h"
    df = spark.createDataFrame([(long, "x <!-- c --> `<!-- k -->` <!-- open", text)], "a string, b string, c string")
    r = df.select(
        chunks.guarded(F.col("a"), 20).alias("g"), chunks.strip_comments(F.col("b")).alias("s"), chunks.sections(F.col("c")).alias("x"),
        chunks.headings(F.col("c")).alias("h")
    ).first()
    assert r.g == "a" * 10 + "\n\n... [TRUNCATED 40 CHARACTERS TO PREVENT TOKEN OVERFLOW] ...\n\n" + "b" * 10
    assert r.s == "x  `<!-- k -->` <!-- open"
    assert r.x.preamble == "pre" and [s.title for s in r.x.sections] == ["One", "二つ"] and "## not" in r.x.sections[0].body
    assert r.h == ["One", "not", "二つ", "Bold", "Title", "h"]
    v = df.select(chunks.sections(F.col("c")).alias("x")).select(F.inline(chunks.ablations(F.col("x.preamble"), F.col("x.sections")))).collect()
    assert [x.removed for x in v] == ["one", ""] and "## One" not in v[0].text and "## One" in v[1].text


def test_edits():
    text = "# T\n\na\n\nb\n\nc\n\nd\n\ne\n\nf"
    assert corpus.degraded(text, "no_headings").startswith("a") and corpus.degraded(text, "removed_middle") == "# T\n\na\n\nb\n\ne\n\nf"
    assert sorted(corpus.blocks_of(corpus.degraded(text, "shuffled"))) == sorted(corpus.blocks_of(text))
    assert corpus.degraded("p\n## a\n1\n## b\n2\n## c\n3", "swap_sections") == "p\n## a\n1\n## c\n3\n## b\n2"
    assert len(corpus.blocks_of(corpus.degraded(text, "padded"))) == 14


def test_held_out_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), f"p{rng.randint(0, 9)}") for _ in range(120)]
    df = spark.createDataFrame(rows, "cell string, project string")
    got = {(r.cell, r.project): r.held_out for r in corpus.held_out(df, ["cell"], "project").collect()}
    import hashlib

    for cell in "ab":
        sizes = {p: sum(r == (cell, p) for r in rows) for p in {p for c, p in rows if c == cell}}
        target, before = max(1, round(0.3 * sum(sizes.values()))), 0
        for p in sorted(sizes, key=lambda p: hashlib.sha256(f"corpus:{p}".encode()).hexdigest()):
            assert got[cell, p] == (before < target)
            before += sizes[p]


def test_paths_and_globs(spark):
    rows = [("docs/a.md",), ("docs/sub/b.md",), ("x/node_modules/c.md",), ("readme.txt",)]
    df = spark.createDataFrame(rows, "p string")
    kept = lambda patterns: {r.p for r in df.where(~X.path_excluded(F.col("p"), patterns)).collect()}
    assert kept(["docs"]) == {"x/node_modules/c.md", "readme.txt"} and kept(["*.md"]) == {"readme.txt"} and kept(["sub/"]) == {
        "docs/a.md", "x/node_modules/c.md", "readme.txt"
    }
    assert df.where(X.default_ignored(F.col("p"))).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "b.md").write_text("no")
    df = files.text_files(spark, [str(tmp_path / "*.md"), str(tmp_path / "*" / "*.md")])
    assert [(r.filename, r.text) for r in df.collect()] == [("a.md", "one\ntwo")]
    got = files.labels(
        spark,
        "preset: safety\ndocuments:\n- path: x\n  expect: {has_pii: present, tone: absent}\npairs:\n- {before: a, after: b, expect: {clarity: down}, kind: k}\n"
    )
    assert got["documents"].count() == 2 and got["pairs"].first().kind == "k"
    for bad in ("wrong: 1", "documents:\n- path: x\n  expect: {q: maybe}"):
        with pytest.raises(ValueError):
            files.labels(spark, bad)
    from plumbline.operators import gate

    assert [
        r.question_id for r in files.unknown_questions(
            got["documents"], gate.questions(spark, "quality").unionByName(gate.questions(spark, "safety"))
        ).collect()
    ] == ["tone"]
    rows = files.preset("name: own\nquestions:\n  a: {type: noul, min_threshold: 0.4}\n")
    assert gate.questions(spark, "own", rows).first().min_threshold == 0.4


def test_images(spark):
    docs = spark.createDataFrame(
        [(1, "![a](x.png) `![c](no.png)` <img src='y.jpg'> ![b](http://h/z.png) ![d](w.bmp)\n```\n![e](x.png)\n```")],
        "doc_id long, text string"
    )
    pics = spark.createDataFrame([("x.png", bytearray(b"12"), 2), ("y.jpg", bytearray(b"3"), 99_999_999)], "path string, content binary, length long")
    got = files.images(docs, pics).collect()
    assert [(r.source, r.mime_type, r.data_url) for r in got] == [("x.png", "image/png", "data:image/png;base64,MTI=")]


def test_report(spark):
    v = spark.createDataFrame(
        [("error", "a.md", 3, 4, "m"), ("warning", "b.md", None, None, "n")],
        "level string, path string, line int, column int, message string"
    )
    assert [r.line for r in report.annotations(v).collect()] == ["::error file=a.md,line=3,col=4::m", "::warning file=b.md::n"]
    a = spark.createDataFrame([(1, "q", 0.5), (2, "r", 0.25)], "doc_id long, question_id string, value double")
    assert report.markdown(a, ["q", "r"]).splitlines()[2:] == ["| 1 | 0.50 | - |", "| 2 | - | 0.25 |"]
    assert report.leaks(report.annotations(v), ["b.md"]).count() == 1


def test_stream_equals_batch_and_skips_what_is_known(spark, tmp_path):
    rows = [(1, "mail joe@gmail.com"), (2, "10.0.0.1 and x@corp.com"), (3, "nothing")]
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(src)
    for _ in range(2):
        incremental.run_once(incremental.documents(spark, src, df.schema), out, check).awaitTermination()
    got = spark.read.parquet(f"{out}/spans").drop("epoch")
    want = incremental.outcomes(df)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    spark.createDataFrame([(9, rows[0][1]), (10, "new 10.9.9.9")], "doc_id long, text string").write.mode("append").parquet(src)
    incremental.run_once(incremental.documents(spark, src, df.schema), out, check).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(f"{out}/spans").collect()} == {1, 2, 10}


def test_project_config(tmp_path):
    from plumbline.sources import project

    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    assert project.loaded(inner) is None
    (tmp_path / "pyproject.toml").write_text(
        '[tool.plumbline]\npreset = "quality"\n[tool.plumbline.questions.clarity]\nmin_threshold = 0.8\n[tool.plumbline.questions.own]\ntype = "noul"\n'
    )
    name, rows = project.loaded(inner)
    assert name == "quality" and [(r[1], r[5]) for r in rows] == [("clarity", 0.8), ("tone", None), ("own", None)] and rows[0][3] == "Clarity & Structure"
    (inner / ".plumbline.yaml").write_text("name: mine\nquestions:\n  q: {type: score, max_threshold: 0.4}\n")
    assert project.loaded(inner) == ("mine", [("mine", "q", "score", None, None, None, 0.4, None, False, [])])
    for bad in ({"preset": "none"}, {"questions": {"x": {"label": "y"}}}):
        with pytest.raises(ValueError):
            project.merged(bad)


def test_score_pairs_and_label_paths(spark):
    raw = spark.createDataFrame(
        [("1", "d", "a.md", None, None, "new", None, "tuning"), ("2", None, None, "gone.md", "x", None, "before", None)],
        "id string, doc_id string, before string, after string, before_text string, after_text string, better string, split string"
    )
    texts = spark.createDataFrame([("a.md", "old")], "path string, text string")
    got = {r.id: r for r in files.score_pairs(raw, texts).collect()}
    assert (got["1"].before_text, got["1"].after_text, got["1"].better, got["1"].split, got["1"].error) == ("old", "new", "after", None, None)
    assert (got["2"].doc_id, got["2"].better, got["2"].error) == ("2", "before", "missing file")
    labels = spark.createDataFrame([("x.md",), ("y.md",), ("/abs.md",)], "path string")
    listing = spark.createDataFrame([("lab/x.md",), ("y.md",)], "path string")
    assert {r.path: r.file for r in files.resolved(labels, listing, "lab/").collect()} == {"x.md": "lab/x.md", "y.md": "y.md", "/abs.md": "/abs.md"}


def test_single_document_is_on_both_sides(spark):
    one = spark.createDataFrame([("a",), ("a",)], "k string")
    assert [tuple(r) for r in corpus.seeded_hold_out(one, "k").collect()] == [("a", True, True)]


def test_cut_hash_against_sorting(spark):
    ids = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("_h"))
    every = sorted(r["_h"] for r in ids.collect())
    for rank in (1, 7, 1000, 2000):
        assert corpus._cut_hash(ids, rank, few=3) == every[rank - 1]


def test_corpus_building(spark):
    df = spark.createDataFrame([("# T\n### Non-Goals\nold\n### Non-Goals\n",), ("nothing",)], "t string")
    put = lambda where: [r[0] for r in df.select(corpus.inserted(F.col("t"), r"^### Non-Goals\n", where, "- $1 new\n")).collect()]
    assert put("after") == ["# T\n### Non-Goals\n- $1 new\nold\n### Non-Goals\n", None]
    assert put("before") == ["# T\n- $1 new\n### Non-Goals\nold\n### Non-Goals\n", None]
    one = spark.createDataFrame([("d1", "Org/Repo", None), ("d2", None, "given")], "doc_id string, repo string, edit_source string")
    two = spark.createDataFrame([("d3", "Src/X"), ("gone", "Y")], "doc_id string, source_repo string")
    files_ = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "doc_id string")
    got = {r.doc_id: (r.project, r.edit_source) for r in corpus.manifest([one, two], files_).collect()}
    assert got == {"d1": ("org/repo", "unknown"), "d2": (None, "given"), "d3": ("src/x", "unknown")}
    import hashlib

    raw = spark.createDataFrame([("d1", "a\r\nb\rc"), ("d2", "x")], "doc_id string, text string")
    parts = spark.createDataFrame([("d1", hashlib.sha256(b"a\nb\nc").hexdigest().upper()), ("d2", "0")], "doc_id string, sha256 string")
    assert {r.doc_id: (r.text, r.intact) for r in corpus.fetched(raw, parts).collect()} == {"d1": ("a\nb\nc", True), "d2": ("x", False)}
    labels = spark.createDataFrame([("p1",), ("p2",)], "path string")
    docs = spark.createDataFrame([("p1", "tuning"), ("p1", "tuning")], "path string, split string")
    assert {r.path: r.split for r in corpus.with_split(labels, docs).collect()} == {"p1": "tuning", "p2": None}
    cell = spark.createDataFrame([("c", f"p{i}", i == 0) for i in range(7)], "cell string, project string, pair boolean")
    held = lambda **kw: corpus.held_out(cell, ["cell"], "project", **kw).where("held_out").count()
    assert held() == 2 and held(paired=F.col("pair")) == 3
    assert corpus.FILLERS["ja"] in corpus.degraded("a\n\nb", "padded", lang="ja")


def test_heuristic_counts_and_ablation_labels(spark):
    docs = spark.createDataFrame([(1, "## Risks\nx"), (2, "plain")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(1, "risks", "present"), (2, "risks", "absent"), (1, "testing", "present")], "doc_id long, question_id string, expected string"
    )
    got = {r.question_id: (r.detected, r.n_absent, r.false_alarms, r.n_present) for r in chunks.presence_counts(docs, labels).collect()}
    assert got == {"risks": (1, 1, 0, 1), "testing": (0, 0, 1, 1)}
    v = spark.createDataFrame([(0, "risks"), (1, "goal")], "variant int, removed string")
    assert {
        (r.variant, r.question_id): r.expected for r in chunks.ablation_labels(v, ["risks", "goal"]).collect()
    } == {(0, "risks"): "absent", (0, "goal"): "present", (1, "risks"): "present", (1, "goal"): "absent"}
    with pytest.raises(Exception, match="at most 3"):
        docs.select(chunks.guarded(F.col("text"), 3, strict=True)).collect()


def test_token_containment_without_mask(spark):
    from plumbline.operators import spans

    df = spark.createDataFrame([("mail joe@gmail.com and 10.0.0.1", "see JOE@gmail.com", "10.0.0.11 xjoe@gmail.com")], "whole string, a string, b string")
    whole = spans.token_hashes(F.col("whole"))
    at = lambda p, c: spans.placed(F.lit(p), F.col("w"), spans.token_hashes(F.col(c)))
    r = df.withColumn("w", whole).select(at("[EMAIL_1]", "whole"), at("[EMAIL_1]", "b"), at("[IP_1]", "b"), at("[IP_1]", "whole")).first()
    assert tuple(r) == (True, False, False, True)


def test_replayed_batch_is_written_once(spark, tmp_path):
    """A crash after a batch is written, before its commit is recorded, repeats the batch."""
    import shutil

    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    df = spark.createDataFrame([(1, "mail joe@gmail.com"), (2, "x 10.0.0.1")], "doc_id long, text string")
    df.write.parquet(src)
    incremental.run_once(incremental.documents(spark, src, df.schema), out, check).awaitTermination()
    before = sorted(map(str, spark.read.parquet(f"{out}/spans").collect()))
    shutil.rmtree(f"{check}/commits")
    incremental.run_once(incremental.documents(spark, src, df.schema), out, check).awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{out}/spans").collect())) == before and len(before) == 2
    assert spark.read.parquet(f"{out}/keys").count() == 2


def test_regressions_of_a_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    now = spark.createDataFrame([(1, "g", 0.5), (1, "r", 0.5), (2, "g", 0.9), (3, "g", 0.1)], "doc_id long, question_id string, value double")
    now.write.parquet(src)
    before = spark.createDataFrame([(1, "g", 0.9), (1, "r", 0.45), (2, "g", 0.8)], now.schema)
    question = spark.createDataFrame([("g", None), ("r", 0.3)], "question_id string, max_threshold double")
    stream = incremental.regressions(incremental.documents(spark, src, now.schema), before, question)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r.doc_id, r.question_id, r.regressed) for r in got] == [(1, "g", True)]
    assert sorted(map(str, got)) == sorted(map(str, incremental.regressions(now, before, question).collect()))
