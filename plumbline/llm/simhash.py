"""Document fingerprints: SimHash votes and exact search by block tables, in DataFrame functions only.

A text's words stand between a mark of its start and one of its end, and every run of two of these is a term, whatever the length of the
text. A term's weight (1 to 4) grows with the letters in it, because long words are rare ones; its 128 hash bits vote with that weight,
once for each occurrence, and a bit of the fingerprint is set where the weighted ones outnumber the zeros. Four votes share one 64-bit sum
(lanes of 16 bits) over at most 8,192 terms, so a term costs 32 sums and not 128; the sums of a text are added up in wider lanes.

Edge cases: a null text is an empty one. A text without words is hashed as one word, so all empty texts share a fingerprint. Equal texts
have equal fingerprints. Rows that repeat, or share an id, are kept and ordered by (id, hash of the text, text); a null id counts as the
smallest. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, materialise, release, text_or_empty

BITS = 128
#: Texts with a five-word Jaccard similarity of at least 0.8 in the given documents are at most 19 bits apart (median 10).
RADIUS = 23
_CHUNK, _LANES, _WIDE = 13, 0x0001000100010001, 0x0000FFFF0000FFFF
_SMALLEST = -(2**63)
_COPIES = 100_000


def term_words(text: Column) -> Column:
    """One long a word: its hash with the length (15 at most) in the low four bits, between the marks of start and end."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-16)) + F.least(F.length(w), F.lit(15)))
    none = F.array(F.xxhash64(text).bitwiseAND(F.lit(-16)))
    mark = lambda n: F.array(F.lit(n << 4).cast("long"))
    return F.concat(mark(1), F.when(F.size(words) > 0, hashed).otherwise(none), mark(2))


def vote(df: DataFrame, keys: list[str], text: str, carried: dict[str, Column] | None = None) -> DataFrame:
    """Fingerprint ``text`` of each row; ``keys`` tell the rows apart. Returns keys, fp_hi, fp_lo and the carried long columns."""
    carried = carried or {}
    words = df.select(*keys, *[c.alias(n) for n, c in carried.items()], term_words(F.col(text)).alias("_w"))
    run = lambda k: F.slice("_w", k, F.size("_w") - 1)
    terms = words.select(*keys, *carried, F.posexplode(F.arrays_zip(run(1).alias("a"), run(2).alias("b"))).alias("_p", "_t"))
    a, b = F.col("_t.a"), F.col("_t.b")
    weight = (F.lit(1) + F.shiftright(a.bitwiseAND(F.lit(15)) + b.bitwiseAND(F.lit(15)), 3)).cast("long")
    terms = terms.select(
        *keys, *carried, F.shiftright("_p", _CHUNK).alias("_c"), F.xxhash64(a, b).alias("_h"), F.xxhash64(b, a, F.lit(1)).alias("_l"),
        weight.alias("_v")
    )
    sums = [F.sum(F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_LANES)) * F.col("_v")).alias(f"{x}{k}") for x in ("_h", "_l") for k in range(16)]
    narrow = terms.groupBy(*keys, "_c").agg(F.sum("_v").alias("_n"), *[F.max(n).alias(n) for n in carried], *sums)
    lanes = lambda x, shift: F.sum(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(_WIDE)))
    summed = narrow.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), *[F.max(n).alias(n) for n in carried],
        *[lanes(f"{x}{k}", s).alias(f"{x}{k}_{s}") for x in ("_h", "_l") for k in range(16) for s in (0, 16)]
    )

    def packed(x: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(16):
            for s in (0, 16):
                pair = F.col(f"{x}{k}_{s}")
                for shift, ones in ((k + s, pair.bitwiseAND(F.lit(0xFFFFFFFF))), (k + s + 32, F.shiftrightunsigned(pair, 32))):
                    out = out.bitwiseOR(F.when(ones * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")))
        return out

    return summed.select(*keys, *carried, packed("_h").alias("fp_hi"), packed("_l").alias("fp_lo"))


def hexed(high: Column, low: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(high), 16, "0")), F.lower(F.lpad(F.hex(low), 16, "0")))


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def likeness(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """Share of equal bits, 0 to 1; unrelated texts come out near 0.5."""
    return F.lit(1.0) - distance(a_hi, a_lo, b_hi, b_lo) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fp_hi, fp_lo, fingerprint (32 hex digits). Rows that repeat stay apart."""
    keyed = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), text_or_empty(text_col).alias("_text"))
    out = vote(keyed, [id_col, "_row"], "_text")
    return out.select(id_col, "fp_hi", "fp_lo", hexed(F.col("fp_hi"), F.col("fp_lo")).alias("fingerprint"))


def _as_longs(sha: Column) -> dict[str, Column]:
    return {f"_s{i}": F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)}


def _cuts(source: DataFrame, rows_per_bucket: int = 500, max_buckets: int = 20_000) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ascending (key, tie) that cut the rows, ordered by (_key, _tie), into buckets of near equal counts, each starting at its cut; and the
    (key, tie) of the texts that fill a bucket alone. At most twice ``max_buckets`` numbers reach the driver. The tie of a cut is the
    smallest number where its id is not split; ids that hold several buckets are split by the hash of the text."""
    stats = source.agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("low")).first()
    if not stats["n"]:
        return [(_SMALLEST, _SMALLEST)], []
    buckets = min(max_buckets, max(1, -(-stats["n"] // rows_per_bucket)))
    shares = [i / buckets for i in range(1, buckets)]
    found = source.agg(F.percentile_approx("_key", shares, max(10_000, 20 * buckets)).alias("q")).first()["q"] if shares else []
    hot = {k: n for k, n in Counter(found or []).items() if n > 1}
    plain = {(k, _SMALLEST) for k in {stats["low"], *(found or [])} - set(hot)}
    if not hot:
        return sorted(plain), []
    split = source.sparkSession.createDataFrame(list(hot.items()), "_key long, _parts int")
    texts = materialise(source.join(F.broadcast(split), "_key").groupBy("_key", "_parts", "_tie").agg(F.count(F.lit(1)).alias("n")))
    part = F.floor((F.col("_tie") / 2.0**64 + 0.5) * F.col("_parts"))
    starts = texts.groupBy("_key", part.alias("part")).agg(F.min("_tie").alias("tie")).collect()
    alone = texts.where(F.col("n") > max(rows_per_bucket, stats["n"] // buckets)).select("_key", "_tie").collect()
    release(texts)
    return sorted(plain | {(r["_key"], r["tie"]) for r in starts}), [tuple(r) for r in alone]


def _numbers(values: list[int]) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _bucket(cuts: list[tuple[int, int]]) -> Column:
    """Index of the last cut that is not above (_key, _tie): a binary search inside one native expression."""
    n = len(cuts)
    if n == 1:
        return F.lit(0)
    keys, ties = _numbers([k for k, _ in cuts]), _numbers([t for _, t in cuts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])

    def step(low: Column, by: Column) -> Column:
        at = F.least(low + by, F.lit(n - 1)) + 1
        key = F.element_at(keys, at)
        reached = (key < F.col("_key")) | ((key == F.col("_key")) & (F.element_at(ties, at) <= F.col("_tie")))
        return F.when((low + by < n) & reached, low + by).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def _edited(text: Column, after: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def _both(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints of ``_text`` and ``_edited`` (null: not wanted) of each row, with the length and the hash of the edited text."""
    longs = _as_longs(F.sha2(F.encode("_edited", "UTF-8"), 256))
    body = lambda which, c: F.struct(F.lit(which).alias("which"), F.col(c).alias("body"))
    bodies = F.when(F.col("_edited").isNull(), F.array(body(0, "_text"))).otherwise(F.array(body(0, "_text"), body(1, "_edited")))
    rows = rows.select(
        *keys, F.length("_text").cast("long").alias("_n_chars"), *[c.alias(k) for k, c in longs.items()],
        F.inline(bodies).alias("_which", "_body")
    )
    carried = {c: F.col(c) for c in ("_n_chars", *longs)}
    voted = vote(rows, [*keys, "_which"], "_body", carried)
    edited = F.col("_which") == 1
    return voted.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in carried],
        *[F.max(F.when(edited if e else ~edited, F.col(f))).alias(f"{e}{f}") for e in ("", "e_") for f in ("fp_hi", "fp_lo")]
    )


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last half replaced by the start of the next document in id order; the last is followed by the first. The order
    is cut into buckets of near equal counts by id, and where one id fills several by the hash of the text, each with the first row of the
    next bucket as a guest. So no task sees more than its bucket, and the whole texts move once. Rows of an equal text and id that fill a
    bucket alone become one row in that order; all but the last of them are followed by themselves.
    """
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_SMALLEST)).alias("_key"), F.col(id_col).cast("long").isNull().alias("_null"),
        text_or_empty(text_col).alias("_text")
    )
    source = source.withColumn("_tie", F.xxhash64("_text"))
    cuts, alone = _cuts(source.select("_key", "_tie"))
    copies = None
    if alone:
        repeated = source.sparkSession.createDataFrame(alone, "_key long, _tie long")
        copies = source.join(F.broadcast(repeated), ["_key", "_tie"]).groupBy("_key", "_null", "_tie").agg(
            F.max("_text").alias("_text"), F.count(F.lit(1)).alias("_copies")
        )
        copies = materialise(copies.select("_key", "_null", "_text", "_tie", "_copies"))
        source = source.join(F.broadcast(repeated), ["_key", "_tie"], "left_anti").select("_key", "_null", "_text", "_tie").unionByName(copies.drop("_copies"))
    n = len(cuts)
    placed = source.withColumn("_bucket", _bucket(cuts))
    start = lambda i: F.element_at(_numbers([c[i] for c in cuts]), F.col("_bucket") + 1)
    first = (F.col("_key") == start(0)) & ((start(1) == _SMALLEST) | (F.col("_tie") == start(1)))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("_bucket") + (n - 1), F.lit(n)).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    rows = placed.select("_key", "_null", "_text", F.inline(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("_b", "_guest"))
    order = Window.partitionBy("_b").orderBy("_guest", "_key", F.xxhash64("_text"), "_text")
    rows = rows.select(
        "_b", "_guest", "_key", "_null", "_text", F.row_number().over(order).alias("_rn"),
        F.coalesce(F.lead("_text").over(order), F.lit("")).alias("_next")
    )
    keys = ["_b", "_rn", "_guest", "_key", "_null"]
    merged = _both(rows.select(*keys, "_text", F.when(~F.col("_guest"), _edited(F.col("_text"), F.col("_next"))).alias("_edited")), keys)
    after = Window.partitionBy("_b").orderBy("_rn")
    merged = merged.withColumn("n_hi", F.lead("fp_hi").over(after)).withColumn("n_lo", F.lead("fp_lo").over(after)).where(~F.col("_guest"))
    out = _shown(merged, id_col)
    if copies is None:
        return out
    keys = ["_key", "_null", "_copies"]
    same = _both(
        copies.select(*keys, "_text", _edited(F.col("_text"), F.col("_text")).alias("_edited")), keys
    ).withColumns({"n_hi": F.col("fp_hi"), "n_lo": F.col("fp_lo")})
    more = F.col("_copies") - 1
    parts = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((more - 1) / _COPIES))).alias("_part")).repartition("_key", "_part")
    parts = parts.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_COPIES).cast("long"), more - F.col("_part") * _COPIES))).alias("_nth"))
    return out.unionByName(_shown(parts, id_col))


def _shown(merged: DataFrame, id_col: str) -> DataFrame:
    return merged.select(
        F.when(~F.col("_null"), F.col("_key")).alias(id_col),
        F.col("_n_chars").alias("n_chars"),
        F.concat(*[F.lower(F.lpad(F.hex(f"_s{i}"), 16, "0")) for i in range(4)]).alias("edited_sha256"),
        hexed(F.col("fp_hi"), F.col("fp_lo")).alias("fingerprint"),
        hexed(F.col("e_fp_hi"), F.col("e_fp_lo")).alias("edited_fingerprint"),
        likeness(F.col("fp_hi"), F.col("fp_lo"), F.col("e_fp_hi"), F.col("e_fp_lo")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp_hi"), F.col("fp_lo"), F.col("n_hi"), F.col("n_lo")), F.lit(1.0)).alias("near_next"),
        "fp_hi",
        "fp_lo",
    )


def table_plan(radius: int, rows: int, bits: int = BITS) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks (start, end) and the block sets whose tables together miss no pair within ``radius``.

    With B blocks, at least B - radius of them are untouched by ``radius`` flipped bits, so one table for each set of B - radius blocks
    suffices. More blocks give longer keys and more tables: the fewest tables whose key has a bit for each doubling of the rows.
    """
    need = max(1.0, log2(max(2, rows)))
    for blocks in range(radius + 1, min(bits, radius + 5) + 1):
        exact = blocks - radius
        if exact * (bits // blocks) >= need or comb(blocks + 1, radius) > 330:
            break
    cuts = [i * bits // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False)), list(combinations(range(blocks), exact))


def _block(high: Column, low: Column, start: int, end: int) -> Column:
    """Bits start..end-1 of the fingerprint; bit 0 is the lowest of ``low``."""
    mask = F.lit((1 << (end - start)) - 1)
    if start >= 64:
        return F.shiftrightunsigned(high, start - 64).bitwiseAND(mask)
    if end <= 64:
        return F.shiftrightunsigned(low, start).bitwiseAND(mask)
    return F.shiftrightunsigned(low, start).bitwiseOR(F.shiftleft(high, 64 - start)).bitwiseAND(mask)


def probe_plan(radius: int, rows: int, bits: int = BITS) -> tuple[list[tuple[int, int]], int]:
    """Blocks (start, end) and how many bits of a block a query flips, so that no pair within ``radius`` is missed.

    Of B blocks at least one has at most radius // B of the flipped bits. Fewer blocks are longer: a query has more keys, and each meets fewer
    fingerprints. The plan, for two or three flips, is the one with the fewest keys and comparisons among ``rows`` fingerprints.
    """

    def plan(most: int) -> tuple[float, int]:
        blocks = radius // (most + 1) + 1
        width, flips = bits // blocks, radius // blocks
        return blocks * sum(comb(width, k) for k in range(flips + 1)) * (1 + rows / 2**width), blocks

    blocks = min(plan(2), plan(3))[1]
    cuts = [i * bits // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False)), radius // blocks


def _split(left: DataFrame, right: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Add ``part``: rows of ``right`` with a (table, key) that has more than ``rows``, or eight times the mean, are dealt over parts, and the
    queries of that key go to each of them. Of K keys at most K / 8 are listed."""
    counts = right.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n")).first()[0] or 0
    most = max(rows, int(8 * mean))
    hot = materialise(counts.where(F.col("n") > most).select("table", "key", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    right = right.join(F.broadcast(hot), ["table", "key"], "left").withColumn("part", F.pmod(F.xxhash64("fp_hi", "fp_lo"), parts).cast("int")).drop("parts")
    left = left.join(F.broadcast(hot), ["table", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left, right


def within_radius(queries: DataFrame, against: DataFrame, radius: int = RADIUS, split: int = 10_000, rows: int | None = None) -> DataFrame:
    """All pairs of a query fingerprint and a fingerprint at most ``radius`` bits away, each pair once.

    Both inputs have distinct (fp_hi, fp_lo); the result has q_hi, q_lo, fp_hi, fp_lo and distance. The tables are the rows of one
    exploded join on (table, key); a pair counts in the first table that holds it, so it is never emitted twice. Up to 6 bits the
    tables are sets of equal blocks; beyond, single blocks, in which a query looks up every value a few bits away. ``rows`` is the number of
    fingerprints to plan for, if not that of ``against``.
    """
    x, y = F.col("q_hi").bitwiseXOR(F.col("fp_hi")), F.col("q_lo").bitwiseXOR(F.col("fp_lo"))
    firsts = []
    if radius <= 6:
        spans, tables = table_plan(radius, against.count() if rows is None else rows)
        same = [_block(x, y, s, e) == 0 for s, e in spans]
        for t, chosen in enumerate(tables):
            hit = same[chosen[0]]
            for b in chosen[1:]:
                hit = hit & same[b]
            firsts.append(F.when(hit, F.lit(t)))
    else:
        spans, flips = probe_plan(radius, against.count() if rows is None else rows)
        tables = [(b,) for b in range(len(spans))]
        firsts = [F.when(F.bit_count(_block(x, y, s, e)) <= flips, F.lit(t)) for t, (s, e) in enumerate(spans)]

    def keyed(df: DataFrame, high: str, low: str) -> DataFrame:
        blocks = [_block(F.col(high), F.col(low), s, e) for s, e in spans]
        key = lambda chosen: F.xxhash64(*[blocks[b] for b in chosen]) if radius <= 6 else blocks[chosen[0]]
        return df.select(high, low, F.inline(F.array(*[F.struct(F.lit(t).alias("table"), key(chosen).alias("key")) for t, chosen in enumerate(tables)])))

    left = keyed(queries.select(F.col("fp_hi").alias("q_hi"), F.col("fp_lo").alias("q_lo")), "q_hi", "q_lo")
    if radius > 6:
        near = F.lit(None).cast("array<long>")
        for t, (s, e) in enumerate(spans):
            masks = [sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in combinations(range(e - s), k)]
            near = F.when(F.col("table") == t, F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")).otherwise(near)
        left = left.select("q_hi", "q_lo", "table", "key", F.explode(near).alias("_mask")).select(
            "q_hi", "q_lo", "table", F.col("key").bitwiseXOR(F.col("_mask")).alias("key")
        )
    right = keyed(against.select("fp_hi", "fp_lo"), "fp_hi", "fp_lo")
    left, right = _split(left, right, split)
    apart = distance(F.col("q_hi"), F.col("q_lo"), F.col("fp_hi"), F.col("fp_lo"))
    pairs = right.join(
        left,
        (left["table"] == right["table"]) & (left["key"] == right["key"]) & (left["part"] == right["part"]) & (apart <= radius) & (
            F.coalesce(*firsts) == left["table"]
        )
    )
    return pairs.select("q_hi", "q_lo", "fp_hi", "fp_lo", apart.alias("distance"))


def search(marked: DataFrame, is_query: Column, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """Add ``class_id``, the smallest id that has the row's fingerprint, and for the rows that ``is_query`` picks, searched against the whole
    table (null for the others): ``near_ids``, the class_id of every fingerprint within ``radius`` bits, its own included, in ascending
    order, and ``near_docs``, the number of documents that have one of them. So copies are never listed one by one, and no link between
    different fingerprints is lost. The class of null ids alone is null and comes first."""
    marked = materialise(marked)
    classes = materialise(
        marked.groupBy("fp_hi", "fp_lo").agg(
            F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("docs"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked")
        )
    )
    pairs = within_radius(classes.where("asked"), classes, radius)
    ids = F.sort_array(F.transform(F.collect_list(F.struct("class_id")), lambda s: s["class_id"]))
    near = pairs.join(classes.drop("asked"), ["fp_hi", "fp_lo"]).groupBy("q_hi", "q_lo").agg(F.sum("docs").alias("near_docs"), ids.alias("near_ids"))
    placed = hot_join(marked, classes.select("fp_hi", "fp_lo", "class_id", "docs"), ["fp_hi", "fp_lo"], "docs", marked.count(), F.col(id_col))
    asked = placed.where(is_query).join(near, (F.col("fp_hi") == near["q_hi"]) & (F.col("fp_lo") == near["q_lo"]), "left").drop("q_hi", "q_lo")
    none = [F.lit(None).cast(near.schema[c].dataType).alias(c) for c in ("near_docs", "near_ids")]
    return asked.unionByName(placed.where(~F.coalesce(is_query, F.lit(False))).select("*", *none))
