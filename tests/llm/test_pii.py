from __future__ import annotations

import calendar
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import pii
from plumbline.llm.common import deep_expressions
from plumbline.llm.queries import op3_pii

KEY = "test key"
SF = "/root/testdata/sf0.001"


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if c >= "5" else 0) for i, c in enumerate(reversed(s))) % 10 == 0


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def one(spark, texts, **kw):
    return pii.pseudonymise(frame(spark, texts), KEY, **kw).orderBy("doc_id").collect()


VALUES = {
    "card": ["4111111111111111", "4111-1111-1111-1111", "378282246310005", "6011 1111 1111 1117"],
    "ip": ["10.0.0.1", "192.168.17.254", "255.255.255.255"],
    "ipv6": ["2001:db8:0:1:1a2b:0:FFFF:9", "fe80::1", "2001:db8::"],
    "date": ["2024-02-29", "31/12/1999", "01.02.1887", "2199/12/31", "12-25-2001"],
    "phone": ["+1 (017) 555-7713", "(415) 555-2671", "415-555-2671", "+4930123456789"],
    "email": ["le.93@mail0.example.com", "A.b+c@x-y.org", "éa@b.de", "иван@почта.рф", "用户@例子.中国"],
    "number": ["123-45-6789"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "9233A8ECF7C5B09FE5949719B6B82BC439E93"],
}


def shape(kind, text):
    """What must stay: digits and letters by class, for octets their dots."""
    if kind == "ip":
        return re.sub(r"\d+", "9", text)
    if kind == "secret":
        return re.sub(r"[0-9A-Fa-f]", "9", text)
    return "".join("9" if c.isdecimal() else "a" if c.islower() else "A" if c.isupper() else "字" if c.isalpha() else c for c in text)


def test_values_change_within_their_format_and_invert(spark):
    texts = [f"<{v}>, (" for vs in VALUES.values() for v in vs]
    kinds = [k for k, vs in VALUES.items() for _ in vs]
    out = one(spark, texts)
    for text, kind, r in zip(texts, kinds, out, strict=True):
        assert r.kinds == kind and r.n_values == 1 and r.text != text, (text, r)
        assert shape(kind, r.text) == shape(kind, text), (text, r.text)
        value = r.text[1:-4]
        if kind == "card":
            assert luhn(re.sub(r"\D", "", value))
        if kind == "ip":
            assert all(0 <= int(o) <= 255 for o in value.split("."))
    assert [r.text for r in one(spark, [r.text for r in out], invert=True)] == texts


def test_clean_texts_stay(spark):
    clean = [
        "no data", "room 42 in 2024", "4111111111111112", "1234567890123456 x", "999.1.1.1", "1.2.3", "31/02/2001", "02/30/2001", "a@b",
        "v1.2.3.4.5", "000-12-3456", "x4111111111111111", "deadbeef", "f" * 40, "q" * 200_000, "1 " * 5000, "", "std::vector", "face::beef",
        "12:34:56", "00:1a:2b:3c:4d:5e", "1:2:3:4:5:6:7:8"
    ]
    for text, r in zip(clean, one(spark, clean), strict=True):
        assert r.text == text and r.n_values == 0 and r.kinds == ""


def test_equal_values_stay_linked_and_nulls_pass(spark):
    df = spark.createDataFrame(
        [
            (1, "x 10.1.2.3 y 10.1.2.3", "k"), (2, "10.1.2.3", None), (2, "10.1.2.3", None), (None, None, "z"),
            (3, "call +1 (212) 555-0100 or mail a.b@c.org### 4111111111111111$$$", "q")
        ],
        "doc_id long, text string, kinds string"
    )
    rows = pii.pseudonymise(df, KEY).collect()
    ips = {x for r in rows if r.text for x in re.findall(r"\d+\.\d+\.\d+\.\d+", r.text)}
    assert len(ips) == 1 and "10.1.2.3" not in ips
    assert [r.n_values for r in rows if r.doc_id is None] == [0] and [r.text for r in rows if r.doc_id is None] == [None]
    assert [r.kinds for r in rows if r.doc_id == 3] == ["card,email,phone"]
    assert pii.pseudonymise(df.where("false"), KEY).count() == 0
    assert pii.pseudonymise(df, "other").where("doc_id = 2").first().text != [r.text for r in rows if r.doc_id == 2][0]


def permuted(spark, values, kind):
    """Pseudonyms of distinct values, and whether they invert and are valid again."""
    with deep_expressions(spark):
        _permuted(spark, values, kind)


def _permuted(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(8).withColumn("kind", pii.kind_of(F.col("v"))).withColumn(
        "new", pii.pseudonym(F.col("v"), F.lit(kind), KEY)
    )
    df = df.select("v", "kind", "new", pii.kind_of(F.col("new")).alias("again"), pii.pseudonym(F.col("new"), F.lit(kind), KEY, invert=True).alias("back"))
    bad = df.where(f"kind <> '{kind}' or again <> '{kind}' or back <> v or kind is null or again is null").collect()
    assert not bad, bad[:5]
    assert df.select("new").distinct().count() == len(values)


@pytest.mark.parametrize(
    "form",
    [
        "{y:04}-{m:02}-{d:02}", "{y:04}/{m:02}/{d:02}", "{y:04}.{m:02}.{d:02}", "{d:02}-{m:02}-{y:04}", "{d:02}/{m:02}/{y:04}",
        "{d:02}.{m:02}.{y:04}", "{m:02}-{d:02}-{y:04}", "{m:02}/{d:02}/{y:04}"
    ]
)
def test_dates_are_permuted(spark, form):
    every = {form.format(y=y, m=m, d=d) for y in range(1800, 2200) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1)}
    assert len(every) == 146_097
    permuted(spark, sorted(every), "date")


def test_day_and_month_first_dates_do_not_collide(spark):
    every = {
        f"{a:02}-{b:02}-{y}" for y in range(1990, 2030) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1) for a,
        b in ((m, d), (d, m))
    }
    permuted(spark, sorted(every), "date")


def test_numbers_are_permuted(spark):
    rng = random.Random(4)
    valid = [a for a in range(1, 900) if a != 666]
    values = {f"{rng.choice(valid):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(101_000)}
    permuted(spark, sorted(values)[:100_000], "number")


def test_addresses_with_letters_never_stay(spark):
    rng = random.Random(2)
    letters = "aZéßøłőабяЖґαωΣאתابжकखกขアンあん漢字한국ⴀꙀⰀ𐐀ʬ"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 6))) + "@" + "".join(rng.choices("abcé漢", k=4)) + ".org" for _ in range(600)]
    out = one(spark, texts)
    assert all(r.text != t and r.n_values == 1 for r, t in zip(out, texts, strict=True))
    assert len({r.text for r in out}) == len(set(texts))


def test_cards_between_other_numbers(spark):
    texts = {
        "4111 1111 1111 1111 123": "card",
        "4111 1111 1111 1111 192.168.1.1": "card,ip",
        "4111 1111 1111 1111 123-45-6789 x": "card,number",
        "123 4111 1111 1111 1111": "card",
        "5500 0000 0000 0004 4111 1111 1111 1111": "card",
    }
    for (text, kinds), r in zip(texts.items(), one(spark, list(texts)), strict=True):
        assert r.kinds == kinds and "4111 1111 1111 1111" not in r.text and "6789" not in r.text and "192.168" not in r.text, (text, r)


def test_pair_network_is_a_permutation(spark):
    n = pii._HIGH * pii._LOW
    df = spark.range(n).select(pii.permute_pair(F.floor(F.col("id") / pii._LOW), F.col("id") % pii._LOW, (pii._HIGH, pii._LOW), KEY, F.lit("t")).alias("p"))
    assert df.distinct().count() == n


def test_query_inverts_and_is_native(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op3_pii(spark, SF)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    back = pii.pseudonymise(found.select("doc_id", "text"), "example key", invert=True).collect()
    assert {r.doc_id: r.text for r in back} == docs and len(rows) == len(docs)
    assert all((r.n_values > 0) == (r.text != docs[r.doc_id]) for r in rows)
