from __future__ import annotations

import os
import random
import re
import time

import pytest

from plumbline.llm import licenses
from plumbline.llm.queries import op8_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(text):
    words = WORD.findall(lowered(text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "MIT License mit licenseé MIT-LICENSE mit LICENSE", "the GNU General Public License, version 3.", "general public", "İ MIT license Ünï",
    "x " * 50_000 + "Apache License", "a\x00b mit\x7flicense", "Released under the MIT License. Licensed under CC BY-NC 4.0.",
]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_base_against_plain_python(spark):
    got = run(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        starts = [b.start for b in r.base]
        assert (r.n_words, len(r.base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b.label for b in r.base}))) == plain(text)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert ("cc-by-nc" in r.labels) == ("licensed under cc by-nc 4.0" in texts[r.doc_id].lower())


def test_matching_statistics_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        templates = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
        auto = licenses.Automaton(templates)
        text = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(40)]
        runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        longest = [max((n for n in range(1, i + 1) if tuple(text[i - n : i]) in runs), default=0) for i in range(1, len(text) + 1)]
        want = {(i + 1, n) for i, n in enumerate(longest) if n >= 2 and (i + 1 == len(text) or longest[i + 1] != n + 1)}
        at = [i for i, w in enumerate(text) if w in auto.next[0]]
        got = list(auto.matches(text, at, 2))
        assert {(end, n) for end, n, _ in got} == want
        for end, n, state in got:
            assert auto.places[state] == {(t, j) for t, w in enumerate(templates) for j in range(n, len(w) + 1) if w[j - n : j] == text[end - n : end]}


def test_edited_templates_are_still_covered(spark):
    label, text = licenses.TEMPLATES[0]
    words = text.split()
    edited = " ".join(words[:20] + ["inserted"] + words[20:40] + words[41:])
    got = run(spark, ["intro " + edited + " outro", " ".join(words[:10]), "licensed under cc by 4.0", "licensed under cc by-nc 4.0"])
    assert [s.label for s in got[0].spans] == [label] and got[0].spans[0].start == 1 and got[0].spans[0].coverage < 1
    assert got[1].spans == []
    assert [s.label for s in got[2].spans] == ["cc-by"] and [s.label for s in got[3].spans] == ["cc-by-nc"]


def test_chains_against_all_pairs():
    """Closing chains early changes no span: the same rule with all chains kept, and spans chosen by comparing all."""
    rng = random.Random(3)
    scanner = licenses.Scanner([("a", "one two three four five six"), ("b", "four five six seven"), ("c", "two three four")], shortest=2, gap=3, enough=0.6)
    for _ in range(300):
        words = [rng.choice(b"one two three four five six seven other more".split()) for _ in range(60)]
        if rng.random() < 0.7:
            for _ in range(4):
                i = rng.randrange(50)
                words[i : i + 6] = rng.choice(scanner.words)[: len(words[i : i + 6])]
        at = [i for i, w in enumerate(words) if w in scanner.known]
        chains = {}
        for end, run, state in scanner.automaton.matches(words, at, 2):
            for t, place in scanner.automaton.places[state]:
                start, begin = end - run, place - run
                fits = [c for c in chains.get(t, ()) if 0 <= start - c[1] <= 3 and 0 <= begin - c[2] <= 3]
                if fits:
                    c = max(sorted(fits, key=lambda c: c[1]), key=lambda c: c[3])
                    c[1], c[2], c[3] = end, place, c[3] + run
                else:
                    chains.setdefault(t, []).append([start, end, place, run])
        found = [licenses.Span(scanner.labels[t], c[0], c[1], c[3] / max(len(scanner.words[t]), c[1] - c[0])) for t, some in chains.items() for c in some]
        chosen = []
        for s in sorted((s for s in found if s.coverage >= 0.6), key=lambda s: (-s.coverage, s.start - s.end, s.start, s.label)):
            if all(s.end <= c.start or s.start >= c.end for c in chosen):
                chosen.append(s)
        assert scanner.spans(words) == sorted(chosen, key=lambda s: s.start)


def test_time_is_linear_in_repeated_lines():
    scanner, took = licenses.Scanner(), []
    words = licenses.words_of("Released under the MIT License. ")
    for n in (4_000, 16_000):
        began = time.perf_counter()
        assert len(scanner.spans(words * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no folder of licence texts here")
def test_whole_licence_texts_from_a_folder(spark):
    whole = licenses.folder_templates("/usr/share/common-licenses")
    texts = dict(whole)
    df = spark.createDataFrame([(i, "intro " + t + " outro") for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, templates=[*licenses.TEMPLATES, *whole]).collect()}
    for i, label in enumerate(texts):
        assert max(got[i].spans, key=lambda s: s.end - s.start).label == label
