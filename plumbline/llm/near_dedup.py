"""Near-duplicate documents: BagMinHash signatures, bands, and verified overlap of shingle multisets.

A document is the multiset of its runs of five words (lower case, letters and digits; a shorter text is one run). Two documents are
linked when the weighted Jaccard similarity of their multisets is 0.8 or more; a class is a connected component of links.

1. One pass over the whole texts gives each document the hash of its multiset, 24 band keys and a sketch of one byte for each of the 144
   signature components. Documents with equal multisets become one node.
2. Nodes that share a band key are a bucket. The bucket's leader is the node with most neighbours over all its bands; each member is
   paired with the leaders of its buckets. Pairs whose sketches cannot belong to a similarity of 0.8 (4.5 standard deviations) go, the
   others are verified on the multisets. This is linear in the bucket, however large, and links nearly all.
3. What the leaders left apart: of each leader's members, those outside the largest component are compared with all others, in blocks of
   bounded rows and shingles inside a task. A block takes the shingles that most of its rows have as a base and indexes only how each row
   differs from it, so that near copies that are not linked cost their differences and not their lengths; that gives every overlap
   exactly. A block hands on only the links that join components, never its pairs. So every pair that shares a band is either connected
   or verified. One block holds 20,000 rows or 1.5 million shingles; beyond, a cloud of near copies below the threshold, in which nothing
   can be linked, is sent once for each block of its other side.

With 24 bands of six, a pair at similarity 0.8 shares a band with probability 0.9993. A multiset's elements are verified as 32-bit
hashes, which changes an overlap by under one element in ten thousand pairs of ordinary texts.

Edge cases: a null text is an empty one. A text without words is alike only to itself, letter by letter, so empty and null texts are one
class. Rows that repeat, or share an id, are documents of their own. A null id is carried, and counts as smallest within its class only if
all are null. Other columns are not read by :func:`classes` and are kept by :func:`deduplicate`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import bags, band_keys, mix, shingles, signatures
from .common import bitmap, bitmap_size, bounded_batches, materialise, maybe_in, release, text_or_empty
from .components import components

WIDTH, BANDS, EACH, THRESHOLD = 5, 24, 6, 0.8
SIZE = BANDS * EACH
BAND_COLUMNS = [f"b{i}" for i in range(BANDS)]
SKETCH_COLUMNS = [f"s{i}" for i in range(SIZE // 8)]
_SLICE = 200_000
_NO_ID = -(2**63)
#: Columns that the input is given for a while; no table has such names.
_OWN = ("near_dedup:id", "near_dedup:key", "near_dedup:nth")
_ROWS, _SHINGLES = 20_000, 1_500_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets) of runs of rows with about ``_SLICE`` words, so that temporary arrays stay small."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    words = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SLICE, side="right")) - 1)
        last = min(last, len(column))
        yield row, words[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def _profile(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row: two hashes of its multiset, its size, signature."""
    n = len(offsets) - 1
    rows, hashed, counts = bags(*shingles(words, offsets, WIDTH))
    with np.errstate(over="ignore"):
        high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(high, rows, mix(hashed + counts.astype(np.uint64)))
        np.add.at(low, rows, mix(hashed * np.uint64(3) + counts.astype(np.uint64) * np.uint64(7)))
    size = np.bincount(rows, counts, n).astype(np.int64)
    return high, low, size, signatures(rows, hashed, counts, n, SIZE)


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_key, multiset hash (bag_hi, bag_lo), size n, band keys and sketch. n is 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, words, offsets in _slices(batch.column(2)):
                high, low, size, signature = _profile(words, offsets)
                keys = band_keys(signature, BANDS, EACH)
                sketch = (mix(signature) & np.uint64(255)).astype(np.uint8).view(np.int64)
                parts.append((high.view(np.int64), low.view(np.int64), size, keys, sketch))
            if not parts:
                continue
            high, low, size, keys, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
            text_key = batch.column(1).to_numpy(zero_copy_only=False)
            high, low = np.where(size > 0, high, text_key), np.where(size > 0, low, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), *map(pa.array, (high, low, size)),
                    *[pa.array(np.ascontiguousarray(keys[:, i])) for i in range(BANDS)],
                    *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH_COLUMNS))]
                ],
                names
            )

    names = ["doc_id", "text_key", "bag_hi", "bag_lo", "n", *BAND_COLUMNS, *SKETCH_COLUMNS]
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), word_hashes(text).alias("words")
    ).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _equal_bytes(prefix_a: str, prefix_b: str) -> Column:
    """How many of the sketch bytes of two rows are equal."""
    ones = F.lit(0x0101010101010101)
    total = F.lit(SIZE)
    for c in SKETCH_COLUMNS:
        x = F.col(prefix_a + c).bitwiseXOR(F.col(prefix_b + c))
        for shift in (4, 2, 1):  # the lowest bit of a byte gathers its eight bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(ones))
    return total


def _least_equal(threshold: float) -> int:
    at = threshold + (1 - threshold) / 256
    return int(SIZE * at - 4.5 * (SIZE * at * (1 - at)) ** 0.5)


def _multisets(texts: DataFrame) -> DataFrame:
    """(node, bag): sorted distinct 32-bit element hashes, an element counted w times being w elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, words, offsets in _slices(batch.column(1)):
                rows, hashed, counts = bags(*shingles(words, offsets, WIDTH))
                copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                with np.errstate(over="ignore"):
                    element = (mix(np.repeat(hashed, counts) + copy.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
                ends = np.searchsorted(np.repeat(rows, counts), np.arange(len(offsets)))
                out += [np.sort(element[ends[i] : ends[i + 1]]).tobytes() for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "bag"])

    return texts.select("node", word_hashes(F.col("text")).alias("words")).mapInArrow(run, "node long, bag binary")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two multisets of :func:`_multisets`."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum()) if len(both) else 0
    return shared / max(1, len(x) + len(y) - shared)


def _verified(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(x.as_buffer(), y.as_buffer()) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def _index(bags: list[np.ndarray], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How each bag differs from ``base``: (distinct elements, first place of each, rows by element, differences of each row)."""
    differ = [np.setxor1d(x, base, assume_unique=True) for x in bags]
    sizes = np.array([len(d) for d in differ], np.int64)
    elements, rows = np.concatenate(differ), np.repeat(np.arange(len(bags), dtype=np.int32), sizes)
    order = np.argsort(elements, kind="stable")
    elements = elements[order]
    first = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]])) if len(elements) else np.zeros(0, np.int64)
    return elements[first], np.append(first, len(elements)), rows[order], sizes


def shared_elements(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each left bag, its number of common elements with every right bag (sets of sorted distinct numbers)."""
    values, counts = np.unique(np.concatenate(right), return_counts=True)
    base = values[2 * counts > len(right)]
    elements, first, rows, sizes = _index(right, base)
    lengths = np.array([len(x) for x in right], np.int64)
    for x in left:
        own = np.setxor1d(x, base, assume_unique=True)
        at = np.searchsorted(elements, own)
        at = at[(at < len(elements)) & (elements[np.minimum(at, len(elements) - 1)] == own)] if len(elements) else at[:0]
        start, n = first[at], first[at + 1] - first[at]
        places = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(rows[places], minlength=len(right))
        yield (len(x) + lengths - (len(own) + sizes - 2 * both)) // 2


def _compared(threshold: float):
    """For one block of a leader's members: links that join components which the block's pairs connect."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["node"], kind="stable")
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        links = []
        if len(left) and len(right):
            nodes, comps, minor = right["node"].to_numpy(), right["component"].to_numpy(), right["minor"].to_numpy()
            raw = right["bag"].tolist()
            bags = [np.unique(np.frombuffer(x, np.uint32)) for x in raw]
            lengths = np.array([len(x) for x in bags])
            mine = [np.unique(np.frombuffer(x, np.uint32)) for x in left["bag"]]
            for node, comp, own, bag, shared in zip(left["node"], left["component"], left["bag"], mine, shared_elements(mine, bags), strict=True):
                alike = shared / np.maximum(1, len(bag) + lengths - shared)
                rows = np.flatnonzero((alike >= threshold - 0.01) & (comps != comp) & (~minor | (nodes > node)))
                for j in rows[np.argsort(-alike[rows], kind="stable")]:
                    a, b = root(int(comp)), root(int(comps[j]))
                    if a != b and similarity(own, raw[j]) >= threshold:
                        parent[max(a, b)] = min(a, b)
                        links.append((int(node), int(nodes[j])))
            del raw, bags, mine
        del frame, left, right
        pa.default_memory_pool().release_unused()  # the worker is used again, and its memory counts all the while
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _dealt(led: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leader, i, j, side, node, component, minor): the blocks in which members of different components are compared."""
    rest = led.join(labels, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("component"))
    rest = rest.join(nodes.select("node", "n"), "node")
    by_component = rest.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    groups = (
        by_component.groupBy("leader")
        .agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("rows", F.col("component").alias("c"))).alias("largest"), F.sum("rows").alias("all_rows"), F.sum("shingles").alias("all_shingles"))
        .where("components > 1")
        .select("leader", F.col("largest.c").alias("major"), F.col("largest.rows").alias("major_rows"), "all_rows", "all_shingles")
    )
    blocks = lambda rows: F.greatest(
        F.ceil(rows / _ROWS), F.ceil(F.col("all_shingles") * rows / F.col("all_rows") / _SHINGLES), F.lit(1)
    ).cast("int")
    groups = groups.select(
        "leader", "major", blocks(F.col("all_rows") - F.col("major_rows")).alias("left_blocks"),
        blocks(F.col("all_rows")).alias("right_blocks")
    )
    placed = rest.join(groups, "leader").withColumn("minor", F.col("component") != F.col("major"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    right = F.transform(
        F.sequence(F.lit(0), F.col("left_blocks") - 1),
        lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), own("right_blocks").alias("j"))
    )
    left = F.transform(F.sequence(F.lit(0), F.col("right_blocks") - 1), lambda j: F.struct(F.lit(0).alias("side"), own("left_blocks").alias("i"), j.alias("j")))
    return placed.select("leader", "node", "component", "minor", F.inline(F.when(F.col("minor"), F.concat(left, right)).otherwise(right)))


def _blockwise(led: DataFrame, labels: DataFrame, nodes: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Links between components that meet under a leader and were not compared through it."""
    full = _dealt(led, labels, nodes).join(bag, "node")
    return full.groupBy("leader", "i", "j").applyInPandas(_compared(threshold), "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_key, class_key (tells classes apart), class_id (the smallest doc_id of the class) and class_rows
    (documents in the class)."""
    bounded_batches(docs.sparkSession)
    found = materialise(profiles(docs, id_col, text_col))
    # Of the copies of a text one is read again: the one of the smallest id, known by a hash of text and id.
    nodes = found.groupBy("bag_hi", "bag_lo").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("text_key", "doc_id")).alias("copy"), F.count(F.lit(1)).alias("copies"),
        *[F.max(c).alias(c) for c in ("n", *BAND_COLUMNS, *SKETCH_COLUMNS)]
    )
    nodes = materialise(nodes.withColumns({"node": F.monotonically_increasing_id(), "copy": F.xxhash64("copy.text_key", "copy.doc_id")}))
    least = _least_equal(threshold)

    keyed = nodes.where("n > 0").select("node", F.explode(F.array(*BAND_COLUMNS)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    members = materialise(keyed.join(shared, "key"))
    central = members.groupBy("node").agg(F.sum("rows").alias("score"))
    leaders = members.join(central, "node").groupBy("key").agg(
        F.max(F.struct("score", (-F.col("node")).alias("low"))).alias("most")
    ).select("key", (-F.col("most.low")).alias("leader"))
    led = materialise(members.join(leaders, "key").where("node <> leader").select("leader", "node").distinct())
    pairs = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    sketch = lambda p: nodes.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), *[F.col(c).alias(f"{p}_{c}") for c in SKETCH_COLUMNS])
    likely = pairs.join(sketch("a"), "a").join(sketch("b"), "b")
    likely = likely.where((F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n")) & (_equal_bytes("a_", "b_") >= least)).select("a", "b")

    wanted = materialise(members.select("node").distinct().join(nodes.select("node", "copy"), "node"))
    bits = bitmap_size(wanted.count())
    text = text_or_empty(text_col)
    whole = docs.select(F.xxhash64(F.xxhash64(text), F.col(id_col).cast("long")).alias("copy"), text.alias("text"))
    whole = maybe_in(whole, "copy", bitmap(wanted, "copy", bits), bits).where("`bitmap:hit`").select("copy", "text")
    bag = materialise(_multisets(whole.dropDuplicates(["copy"]).join(wanted, "copy")))
    release(members, wanted)

    links = materialise(_verified(likely, bag, threshold))
    labels = components(links)
    more = materialise(_blockwise(led, labels, nodes, bag, threshold))
    if more.limit(1).count():
        old, labels = labels, components(links.unionByName(more))
        release(old)
    grouped = nodes.select(
        "node", "bag_hi", "bag_lo", "first_id", "copies"
    ).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = materialise(grouped)
    release(led, bag, links, more, labels, nodes)
    totals = materialise(grouped.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_rows")))
    of_bag = materialise(grouped.join(totals, "component").select("bag_hi", "bag_lo", F.col("component").alias("class_key"), "class_id", "class_rows"))
    release(grouped, totals)
    return found.select("doc_id", "text_key", "bag_hi", "bag_lo").join(of_bag, ["bag_hi", "bag_lo"]).select(
        "doc_id", "text_key", "class_key", "class_id", "class_rows"
    )


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id (of rows that repeat, one)."""
    several = materialise(classes(docs, threshold, id_col, text_col).where("class_rows > 1"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("text_key").alias("key")))
    own_id, own_key, nth = _OWN
    kept = several.groupBy("class_key").agg(first.alias("first")).select(F.col("first.id").alias(own_id), F.col("first.key").alias(own_key))
    touched = several.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(own_id), F.col("text_key").alias(own_key))
    gone = touched.join(kept, [own_id, own_key], "left_anti").distinct()
    tagged = docs.withColumns({own_id: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), own_key: F.xxhash64(text_or_empty(text_col))})
    bits = bitmap_size(several.count())
    tagged = maybe_in(tagged, own_key, bitmap(touched, own_key, bits), bits)
    alone = tagged.where("not `bitmap:hit`")  # in a class of its own for sure: stays without a shuffle
    rest = tagged.where("`bitmap:hit`").join(gone, [own_id, own_key], "left_anti")
    rest = rest.withColumn(nth, F.row_number().over(Window.partitionBy(own_id, own_key).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return alone.select(*docs.columns).unionByName(rest.select(*docs.columns))
