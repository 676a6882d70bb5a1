"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern and confirmed by validation: card numbers by the Luhn sum, IPv4 addresses by their octets, IPv6 addresses by
their groups, dates by the calendar, phone numbers by their digit count, social security numbers by their reserved groups, e-mail
addresses and long hexadecimal secrets by shape. A confirmed value is replaced by another of the same format. The replacement is a keyed
permutation of the format's valid values: an alternating Feistel network of eight rounds whose round function is SHA-256 of key, kind,
round and the other half. So equal values get equal pseudonyms in every document, different values different ones, and the holder of the
key can invert them.

* characters (e-mail, phone, card, secret, IPv6): each half is shifted character by character within its class: digits, lower-case or
  upper-case letters, or the letters of its alphabet (``RANGES``); others stay. A card's last digit is computed again, so the pseudonym
  passes the Luhn sum too. A phone's country code stays.
* IPv4: the halves are the two upper and the two lower octets.
* social security numbers: the halves are area with group (898 x 99 valid ones) and serial (9,999).
* dates in 1800-2199: year first or day first, the halves are the quotient and the remainder by 773 of the day (189 x 773 days). Two digits
  first and a second part over 12 are month first: those dates have a day of 13 or more, and are permuted among themselves (9 x 9,833).

Where a run of card length fails the Luhn sum, the longest part between its blanks or hyphens (groups of three digits or more) that is a
card is taken, and what follows is scanned again; so a card with a security code, or with another value behind it, is found.

Edge cases: a null text stays null with no values; an empty one stays empty. Numbers that fail validation are left alone, and so are
IPv6 addresses whose first group has under four digits or that have no decimal digit. An address whose local part has letters or digits,
none of them in ``RANGES``, gets a keyed hash instead, which cannot be inverted. ``n_values`` counts values that changed. Digits right
behind a card's blank or hyphen can make one with it (one time in ten), before or after; the whole text then inverts only value by value.
Rows that repeat get the same result. Other columns are carried unchanged; if the input already has a column of an added name, it is
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deep_expressions

ROUNDS = 8
_W = r"[\p{L}\p{N}]"
_ALONE = (rf"(?<!{_W})", rf"(?!{_W})")
_HEX4 = "[0-9A-Fa-f]{1,4}"
#: Kind: what must not stand before, the shape, what must not stand behind. The first that fits at a place counts.
PATTERNS = {
    "email": (r"(?<![\p{L}\p{N}._%+\-])", r"[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]++\.)+\p{L}{2,}", ""),
    "secret": (_ALONE[0], r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)", _ALONE[1]),
    "ipv6": (r"(?<![\p{L}\p{N}:])", rf"[0-9A-Fa-f]{{4}}(?:(?::{_HEX4}){{7}}|(?::{_HEX4}){{0,5}}::(?:{_HEX4}(?::{_HEX4}){{0,5}})?)", r"(?![\p{L}\p{N}:])"),
    "ip": (_ALONE[0] + r"(?<!\d\.)", r"\d{1,3}(?:\.\d{1,3}){3}", r"(?!\d)(?!\.\d)" + _ALONE[1]),
    "date": (_ALONE[0], r"(?:\d{4}(?<s>[-/.])\d{2}\k<s>\d{2}|\d{2}(?<t>[-/.])\d{2}\k<t>\d{4})", _ALONE[1]),
    "phone": ("", rf"(?:(?:(?<!{_W})\+\d{{1,3}}[ .\-]?|(?<![\p{{L}}\p{{N}}+]))(?:\(\d{{2,4}}\)[ .\-]?|\d{{3}}[ .\-])\d{{3,4}}[ .\-]\d{{4}}|(?<!{_W})\+\d{{8,15}})", r"(?![ \-]\d{4}[ \-]\d{4})" + _ALONE[1]),
    "number": (_ALONE[0], r"\d{3}-\d{2}-\d{4}", _ALONE[1]),
    "card": (_ALONE[0], r"\d(?:[ \-]?\d){12,18}", r"(?!\.\d)" + _ALONE[1]),
}
ANY = "|".join(f"(?:{before}{shape}{behind})" for before, shape, behind in PATTERNS.values())
_FIRST_DAY, _HIGH, _LOW = "1800-01-01", 189, 773
_LATE_HIGH, _LATE_LOW = 9, 9_833
_AREAS, _GROUPS, _SERIALS = 898, 99, 9_999
# First and last code points of runs of digits or letters of one class.
RANGES = [
    (0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0xDF, 0xF6), (0xF8, 0xFF), (0xC0, 0xD6), (0xD8, 0xDE), (0x100, 0x17F), (0x180, 0x1BA), (0x1CD, 0x233),
    (0x3B1, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3AC, 0x3AF), (0x430, 0x45F), (0x400, 0x42F), (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA),
    (0x621, 0x63A), (0x641, 0x64A), (0x660, 0x669), (0x905, 0x939), (0x966, 0x96F), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x1E00, 0x1EFF), (0x3041, 0x3096),
    (0x30A1, 0x30FA), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A),
]
_HEX = "0123456789abcdef"
_MOVABLE = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in RANGES) + "]"


def _drawn(key: str, tweak: Column, step: Column, other: Column, size: Column | int) -> Column:
    """Keyed pseudo-random number below ``size`` (at most 2**40)."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, step.cast("string"), other.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed, and written into the plan, once."""
    return F.transform(F.array(value), use)[0]


def permute_pair(high: Column, low: Column, sizes: tuple[int, int], key: str, tweak: Column, invert: bool = False) -> Column:
    """Struct (h, l): the alternating Feistel network on Z_a x Z_b with modular addition."""
    sign = -1 if invert else 1
    steps = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if invert else range(ROUNDS))])

    def one(state: Column, step: Column) -> Column:
        h, l = state["h"], state["l"]
        return F.when(
            step % 2 == 0, F.struct(F.pmod(h + sign * _drawn(key, tweak, step, l, sizes[0]), F.lit(sizes[0])).alias("h"), l.alias("l"))
        ).otherwise(F.struct(h.alias("h"), F.pmod(l + sign * _drawn(key, tweak, step, h, sizes[1]), F.lit(sizes[1])).alias("l")))

    return F.aggregate(steps, F.struct(high.cast("long").alias("h"), low.cast("long").alias("l")), one)


def _class_of(c: Column, kind: Column) -> Column:
    """Struct (at, first, size) of a character: its place in its class, the class's first code point (-1: a hexadecimal digit of a secret)
    and size; null if it stays."""
    point = F.ascii(c)
    of = lambda a, b: F.struct((point - a).alias("at"), F.lit(a).alias("first"), F.lit(b - a + 1).alias("size"))
    hexed = F.struct((F.instr(F.lit(_HEX), c) - 1).alias("at"), F.lit(-1).alias("first"), F.lit(16).alias("size"))
    plain = [(kind == "secret", F.when(F.instr(F.lit(_HEX), c) > 0, hexed)), (point.between(0x30, 0x39), of(0x30, 0x39))]
    plain += [
        ((kind == "ipv6") & point.between(a, b), of(a, b)) for a, b in ((0x61, 0x66), (0x41, 0x46))
    ] + [(point.between(a, b), of(a, b)) for a, b in RANGES[1:3]]
    others = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in RANGES[3:]])
    other = let(
        F.get(F.filter(others, lambda r: point.between(r["a"], r["b"])), F.lit(0)),
        lambda r: F.when(r.isNotNull(), F.struct((point - r["a"]).alias("at"), r["a"].alias("first"), (r["b"] - r["a"] + 1).alias("size")))
    )
    out = F.when(point > 0x7F, other)
    for test, found in reversed(plain):
        out = F.when(test, found).otherwise(out)
    return out


def permute_characters(value: Column, key: str, kind: Column, invert: bool = False) -> Column:
    """The alternating Feistel network on the two halves of a string; each character moves within its class."""
    sign = -1 if invert else 1
    steps = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if invert else range(ROUNDS))])

    def moved(half: Column, other: Column, step: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            def put(k: Column) -> Column:
                to = F.pmod(k["at"] + sign * _drawn(key, kind, step * 1_000_000 + i, other, k["size"]), k["size"])
                return F.when(k.isNull(), c).when(
                    k["first"] < 0, F.substring(F.lit(_HEX), (to + 1).cast("int"), F.lit(1))
                ).otherwise(F.decode(F.unhex(F.lpad(F.hex(k["first"] + to), 4, "0")), "UTF-16BE"))

            return let(_class_of(c, kind), put)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step_of(state: Column, step: Column) -> Column:
        left = step % 2 == 0
        pair = F.struct(F.when(left, state["l"]).otherwise(state["r"]).alias("own"), F.when(left, state["r"]).otherwise(state["l"]).alias("other"))
        new = let(pair, lambda p: moved(p["own"], p["other"], step))
        return let(new, lambda n: F.struct(F.when(left, n).otherwise(state["l"]).alias("l"), F.when(left, state["r"]).otherwise(n).alias("r")))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(steps, start, step_of, lambda s: F.concat(s["l"], s["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of a digit string whose last digit counts once."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c >= "5", 9).otherwise(0))
    )
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & (_luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$")


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda o: o.try_cast("int"))


def _date(value: Column) -> Column:
    """Struct (year_first, late, day): whether the year comes first, whether the month comes before the day although it does not, and the
    days since the first one of the window; null if it is no date of the window."""

    def of(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        late = ~year_first & (p[1] > "12")
        y, m, d = F.when(year_first, p[0]).otherwise(p[2]), F.when(late, p[0]).otherwise(p[1]), F.when(year_first, p[2]).when(late, p[1]).otherwise(p[0])
        days = F.datediff(F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("date"), F.lit(_FIRST_DAY).cast("date"))
        return let(days, lambda n: F.when((n >= 0) & (n < _HIGH * _LOW), F.struct(year_first.alias("year_first"), late.alias("late"), n.alias("day"))))

    return let(F.split(value, "[-/.]"), of)


def _pseudonym_date(value: Column, key: str, invert: bool) -> Column:
    first = F.lit(_FIRST_DAY).cast("date")

    def any_day(day: Column) -> Column:
        pair = permute_pair(F.floor(day / _LOW), day % _LOW, (_HIGH, _LOW), key, F.lit("date"), invert)
        return let(pair, lambda p: F.date_add(first, (p["h"] * _LOW + p["l"]).cast("int")))

    def late_day(day: Column) -> Column:
        """Days of 13 and later, numbered from 0: 12 are left out in this month and in each before it."""
        rank = let(F.date_add(first, day), lambda date: day - 12 * ((F.year(date) - 1800) * 12 + F.month(date)))
        pair = let(rank, lambda r: permute_pair(F.floor(r / _LATE_LOW), r % _LATE_LOW, (_LATE_HIGH, _LATE_LOW), key, F.lit("date, month first"), invert))
        before = lambda month: F.datediff(F.add_months(first, month), first) - 12 * month

        def back(new: Column) -> Column:
            about = let(
                F.floor(new / (_LATE_HIGH * _LATE_LOW / 4800)).cast("int"),
                lambda k: F.when(before(k + 1) <= new, k + 1).when(before(k) <= new, k).otherwise(k - 1)
            )
            return let(about, lambda month: F.date_add(F.add_months(first, month), 12 + new - before(month)))

        return let(let(pair, lambda p: (p["h"] * _LATE_LOW + p["l"]).cast("int")), back)

    def of(d: Column) -> Column:
        sep = F.when(d["year_first"], F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
        written = lambda date, *forms: F.concat(
            F.date_format(date, forms[0]), sep, F.date_format(date, forms[1]), sep, F.date_format(date, forms[2])
        )
        new = F.when(d["late"], late_day(d["day"])).otherwise(any_day(d["day"]))
        return let(
            new,
            lambda n: F.when(
                d["year_first"], written(n, "yyyy", "MM", "dd")
            ).when(d["late"], written(n, "MM", "dd", "yyyy")).otherwise(written(n, "dd", "MM", "yyyy"))
        )

    return let(_date(value), of)


def _pseudonym_number(value: Column, key: str, invert: bool) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    part = lambda start, n: F.substring(value, start, n).try_cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    high = (area - 1 - (area > 666).cast("int")) * _GROUPS + group - 1
    put = lambda n, width: F.lpad(n.cast("string"), width, "0")

    def of(pair: Column) -> Column:
        new = F.floor(pair["h"] / _GROUPS) + 1
        return F.concat(put(new + (new >= 666).cast("int"), 3), F.lit("-"), put(pair["h"] % _GROUPS + 1, 2), F.lit("-"), put(pair["l"] + 1, 4))

    return let(permute_pair(high, serial - 1, (_AREAS * _GROUPS, _SERIALS), key, F.lit("number"), invert), of)


def kind_of(value: Column) -> Column:
    """The validated kind of a matched value, or null."""
    whole = {k: value.rlike(f"^(?:{shape})$") for k, (_, shape, _) in PATTERNS.items()}
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(whole["secret"] & value.rlike("[0-9]") & value.rlike("[a-fA-F]"), F.lit("secret"))
        .when(whole["ipv6"], F.when(value.rlike("[0-9]") & (F.size(F.array_remove(F.split(value, ":"), "")) <= F.when(value.contains("::"), 7).otherwise(8)), F.lit("ipv6")))
        .when(whole["ip"], F.when(F.forall(_octets(value), lambda o: o <= 255), F.lit("ip")))
        .when(whole["date"], F.when(_date(value).isNotNull(), F.lit("date")))
        .when(whole["number"], F.when(~value.rlike(r"^(000|666|9\d\d)|-00-|-0000$"), F.lit("number")))
        .when(whole["card"] & _is_card(value), F.lit("card"))
        .when(whole["phone"] & F.length(_digits(value)).between(8, 15), F.lit("phone"))
    )


def pseudonym(value: Column, kind: Column, key: str, invert: bool = False) -> Column:
    """The replacement of a validated value; ``invert`` undoes it."""

    def ip(o: Column) -> Column:
        pair = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, F.lit("ip"), invert)
        return let(pair, lambda p: F.concat_ws(".", F.shiftright(p["h"], 8), p["h"] % 256, F.shiftright(p["l"], 8), p["l"] % 256))

    # What stays in front, and what is moved; of an address without movable local part, its domain.
    local = F.substring_index(value, "@", 1)
    fixed = (kind == "email") & local.rlike(_W) & ~local.rlike(_MOVABLE)
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .\-(])", 0)
    hashed = F.concat(F.lit("x"), F.left(F.sha2(F.concat(F.lit(key + "|address|"), value).cast("binary"), 256), F.lit(16)), F.lit("@"))
    head = F.when(fixed, hashed).when(kind == "phone", country).otherwise("")
    body = F.when(fixed, F.substring_index(value, "@", -1)).when(
        kind == "phone", F.substring(value, F.length(country) + 1, F.length(value))
    ).when(kind == "card", F.substring(value, F.lit(1), F.length(value) - 1)).when(kind == "secret", F.lower(value)).otherwise(value)
    check = lambda b: ((10 - _luhn_sum(F.concat(_digits(b), F.lit("0"))) % 10) % 10).cast("string")
    moved = let(
        body,
        lambda b: let(
            permute_characters(b, key, kind, invert),
            lambda n: F.when(kind == "card", F.concat(n, check(n))).when(
                (kind == "secret") & (value != F.lower(value)), F.upper(n)
            ).otherwise(F.concat(head, n))
        )
    )
    return (
        F.when(kind == "ip", let(_octets(value), ip))
        .when(kind == "date", _pseudonym_date(value, key, invert))
        .when(kind == "number", _pseudonym_number(value, key, invert))
        .when(kind.isNotNull(), moved)
        .otherwise(value)
    )


def _card_within(value: Column) -> Column:
    """Struct (from, to) of the longest card between separators of a run that is none as a whole, or null."""
    n = F.length(value)
    alone = lambda at: (at < 1) | (at > n) | F.substring(value, at, F.lit(1)).isin(" ", "-")
    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda i: alone(i - 1) & F.substring(value, i, F.lit(3)).rlike(r"^\d{3}$"))
    ends = F.filter(places, lambda j: alone(j + 1) & F.substring(value, F.greatest(j - 2, F.lit(1)), F.lit(3)).rlike(r"^\d{3}$"))
    runs = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.filter(ends, lambda j: j - i >= 12),
                lambda j: F.struct((j - i).alias("n"), (-i).alias("first"), i.alias("from"), j.alias("to"))
            )
        )
    )
    best = F.array_max(F.filter(runs, lambda r: _is_card(F.substring(value, r["from"], r["to"] - r["from"] + 1))))
    return F.when(value.rlike(r"^\d[\d \-]{12,}$") & value.rlike(r"\d{3}[ \-]\d{3}"), best)


def _rewritten(text: Column, key: str, invert: bool, again: bool = True) -> Column:
    """Struct (text, kinds): the text with its values replaced, and the kinds of those that changed, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), 0), lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    found = F.transform(
        found,
        lambda m: F.struct(
            m["value"].alias("value"), m["kind"].alias("kind"), pseudonym(m["value"], m["kind"], key, invert).alias("new"),
            (
                F.when(m["kind"].isNull(), _card_within(m["value"])) if again else F.lit(None).cast("struct<from: int, to: int>")
            ).alias("card")
        )
    )
    none = F.array().cast("array<string>")

    def one(m: Column, behind: Column) -> Column:
        plain = F.struct(F.concat(m["new"], behind).alias("text"), F.when(m["new"] != m["value"], F.array(m["kind"])).otherwise(none).alias("kinds"))
        if not again:
            return plain
        value, card = m["value"], m["card"]
        number = F.substring(value, card["from"], card["to"] - card["from"] + 1)
        rest = _rewritten(F.concat(F.substring(value, card["to"] + 1, F.length(value)), behind), key, invert, again=False)
        bound = F.transform(
            F.array(rest),
            lambda r: F.struct(
                F.concat(
                    F.substring(value, F.lit(1), card["from"] - 1), pseudonym(number, F.lit("card"), key, invert), r["text"]
                ).alias("text"),
                F.concat(F.array(F.lit("card")), r["kinds"]).alias("kinds")
            )
        )
        return F.when(card.isNotNull(), bound[0]).otherwise(plain)

    parts = F.split(text, ANY, -1)
    pieces = F.zip_with(found, F.slice(parts, 2, F.size(parts)), one)
    whole = F.transform(
        F.array(pieces),
        lambda p: F.struct(
            F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(p, lambda x: x["text"]), "")).alias("text"),
            F.flatten(F.transform(p, lambda x: x["kinds"])).alias("kinds")
        )
    )
    return whole[0]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", invert: bool = False, with_kinds: bool = True) -> DataFrame:
    """Replace ``text_col``; add n_values (replaced values) and kinds (their kinds, sorted, comma-joined)."""
    text = F.col(text_col)
    may = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    own = "pii:rewritten"
    with deep_expressions(docs.sparkSession):
        found = docs.withColumn(own, F.when(may, _rewritten(text, key, invert)))
    rewritten = F.col(f"`{own}`")
    out = found.withColumn(text_col, F.coalesce(rewritten["text"], text))
    if with_kinds:
        kinds = F.coalesce(rewritten["kinds"], F.array().cast("array<string>"))
        out = out.withColumn("n_values", F.size(kinds)).withColumn("kinds", F.array_join(F.array_sort(F.array_distinct(kinds)), ","))
    return out.drop(own)
