"""Shards of near equal bytes by a k-d tree over document metadata.

A tree node is cut at the weighted quantile of bytes along its widest dimension that gives each side the bytes its leaves are to hold,
until every leaf is one shard. Each dimension is a number of the text (by default the logarithm of its size, and its CRC) scaled to 30
bits, with 32 bits of the text's hash below it, so different texts hardly tie and equal texts always go the same way. The quantile is found
by histograms: one distributed sum of bytes by node, dimension and bin gives the extents of all nodes of a level, and narrows every node at
once, until the bin holds less than a thousandth of a shard; the driver only sees nodes x dimensions x bins numbers. The assignment of a
row is one native expression over its own numbers.

Equal texts stay together. Those that hold more than a sixteenth of a shard's bytes, at most 16 for each shard, are placed first, largest
to the emptiest shard, and the leaves of the tree hold what is left of each shard. Only a text whose copies hold more than a whole shard
is dealt over several, by the hash of the id.

Edge cases: a null text has size 8, like an empty one. Null ids are numbered like others. Rows that repeat are rows of their own. With
fewer texts than shards some shards stay empty. Where dimensions are equally wide the first is cut. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

BINS = 1024
_SCALE = (1 << 30) - 1
_COPIES = 100_000


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    raw = F.encode(text_or_empty(text_col), "UTF-8")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("text_hash")
    )


def dimensions() -> list[Column]:
    """Numbers of a text between 0 and 1."""
    return [F.log2(F.col("size").cast("double")) / 31.0, F.col("text_crc32") / float(1 << 32)]


class Tree:
    """``cuts`` maps a node, a range of leaves, to (dimension, last value that goes left); ``room`` has the bytes that each leaf is to hold."""

    def __init__(self, room: list[float]):
        self.room, self.leaves = room, len(room)
        self.cuts: dict[tuple[int, int], tuple[int, int]] = {}

    def share(self, node: tuple[int, int]) -> float:
        """What part of a node's bytes belongs to its left half."""
        low, high = node
        whole = sum(self.room[low:high])
        return sum(self.room[low : low + (high - low) // 2]) / whole if whole else 0.5

    def column(self, node: tuple[int, int] | None = None) -> Column:
        """The first leaf of the node that a row has reached."""
        node = node or (0, self.leaves)
        if node not in self.cuts:
            return F.lit(node[0])
        low, high = node
        mid = low + (high - low) // 2
        d, value = self.cuts[node]
        return F.when(F.col(f"_c{d}") <= value, self.column((low, mid))).otherwise(self.column((mid, high)))


def _histogram(placed: DataFrame, ranges: dict[int, dict[int, tuple[int, int]]], dims: int) -> dict[tuple[int, int], list]:
    """For each first leaf and dimension of ``ranges``, bins (number, bytes, lowest, highest value) within its range."""
    entries = []
    for d in range(dims):
        low, width = F.lit(0).cast("long"), F.lit(None).cast("long")
        for first, of in ranges.items():
            if d in of:
                at = F.col("_node") == first
                low, width = F.when(at, F.lit(of[d][0])).otherwise(low), F.when(at, F.lit(_width(of[d]))).otherwise(width)
        placed = placed.withColumns({f"_lo{d}": low, f"_w{d}": width})
        entries.append(F.struct(F.lit(d).alias("dim"), F.col(f"_c{d}").alias("v"), F.expr(f"(_c{d} - _lo{d}) div _w{d}").alias("bin")))
    binned = placed.select("_node", "size", F.inline(F.array(*entries))).where(F.col("bin").between(0, BINS - 1))
    out: dict[tuple[int, int], list] = {}
    for r in binned.groupBy("_node", "dim", "bin").agg(F.sum("size").alias("bytes"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        out.setdefault((r["_node"], r["dim"]), []).append((r["bin"], r["bytes"], r["low"], r["high"]))
    return {k: sorted(v) for k, v in out.items()}


def _width(span: tuple[int, int]) -> int:
    return max(1, -(-(span[1] - span[0] + 1) // BINS))


def _level(rows: DataFrame, whole: list[int], tree: Tree, nodes: dict[tuple[int, int], list[tuple[int, int]]], tolerance: float) -> None:
    """Cut every node of one level; ``nodes`` has the bounds of each dimension in a node, ``whole`` their widths over all rows."""
    dims = len(whole)
    placed = rows.withColumn("_node", tree.column())
    found = _histogram(placed, {low: dict(enumerate(spans)) for (low, _), spans in nodes.items()}, dims)
    open_ = {}
    for node in nodes:
        first = node[0]
        if (first, 0) not in found:
            tree.cuts[node] = (0, 0)
            continue
        width = lambda d: (found[first, d][-1][3] - found[first, d][0][2]) / (whole[d] or 1)  # noqa: B023, E731
        widest = max(range(dims), key=lambda d: (width(d), -d))
        open_[first] = {
            "node": node, "dim": widest, "left": 0, "want": sum(b[1] for b in found[first, widest]) * tree.share(node),
            "bins": found[first, widest]
        }
    while open_:
        for first, o in list(open_.items()):
            total = o["left"]
            for _, size, low, high in o["bins"]:
                if total + size >= o["want"]:
                    break
                total += size
            if size <= tolerance or low == high:
                # The nearer side of the last bin.
                tree.cuts[o["node"]] = (o["dim"], high if total + size - o["want"] <= o["want"] - total else low - 1)
                del open_[first]
            else:
                o["left"], o["range"] = total, (low, high)
        if open_:
            finer = _histogram(placed, {first: {o["dim"]: o["range"]} for first, o in open_.items()}, dims)
            for first, o in open_.items():
                o["bins"] = finer[first, o["dim"]]


def _parts(meta: DataFrame, target: float) -> tuple[list[tuple[float, int, int]], dict[int, int]]:
    """(bytes, text, part) of texts that hold much of a shard, largest first, and into how many parts each of them is cut."""
    large = meta.groupBy("text_hash").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("b") > target / 16).collect()
    cut = {r["text_hash"]: -(-r["b"] // int(target)) if r["n"] > 1 and r["b"] > target else 1 for r in large}
    parts = [(r["b"], r["text_hash"], 0) for r in large if cut[r["text_hash"]] == 1]
    several = [(h, n) for h, n in cut.items() if n > 1]
    if several:
        counts = meta.sparkSession.createDataFrame(several, "text_hash long, _n long")
        by = meta.join(F.broadcast(counts), "text_hash").groupBy(
            "text_hash", F.pmod(F.xxhash64("doc_id"), "_n").alias("part")
        ).agg(F.sum("size").alias("b")).collect()
        parts += [(r["b"], r["text_hash"], r["part"]) for r in by]
    return sorted(parts, reverse=True), cut


def assign(meta: DataFrame, shards: int = 24, dims: list[Column] | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Add ``shard`` to rows of :func:`metadata`. ``dims``: columns between 0 and 1 that depend on the text alone."""
    meta = materialise(meta)
    total = meta.agg(F.sum("size").alias("b")).first()["b"]
    if not total:
        return meta.withColumn("shard", F.lit(0))
    target = total / shards
    parts, cut = _parts(meta, target)
    load, home = [0.0] * shards, {}
    for size, text, part in parts:
        s = min(range(shards), key=lambda s: (load[s], s))
        load[s] += size
        home[text, part] = s
    # The level up to which the other texts fill the shards.
    level, filled = 0.0, sorted(load)
    for k in range(1, shards + 1):
        level = (total - sum(load) + sum(filled[:k])) / k
        if k == shards or level <= filled[k]:
            break
    tree = Tree([max(0.0, level - x) for x in load])
    dims = dims or dimensions()
    below = F.col("text_hash").bitwiseAND(F.lit(0xFFFFFFFF))
    scaled = [
        F.shiftleft(
            F.least(F.greatest(F.floor(d * _SCALE), F.lit(0)), F.lit(_SCALE)).cast("long"), 32
        ).bitwiseOR(below).alias(f"_c{i}") for i,
        d in enumerate(dims)
    ]
    other = meta.where(~F.col("text_hash").isin(list(cut))) if cut else meta
    rows = materialise(other.select("*", *scaled))
    ends = rows.agg(*[f(f"_c{d}").alias(f"{n}{d}") for d in range(len(dims)) for n, f in (("low", F.min), ("high", F.max))]).first()
    spans = [(ends[f"low{d}"] or 0, ends[f"high{d}"] or 0) for d in range(len(dims))]
    whole, nodes = [high - low for low, high in spans], {(0, shards): spans}
    while nodes := {n: s for n, s in nodes.items() if n[1] - n[0] > 1}:
        _level(rows, whole, tree, nodes, tolerance * target)
        below_ = {}
        for (low, high), of in nodes.items():
            mid, (d, value) = low + (high - low) // 2, tree.cuts[low, high]
            below_[low, mid] = [(a, min(b, value)) if i == d else (a, b) for i, (a, b) in enumerate(of)]
            below_[mid, high] = [(max(a, value + 1), b) if i == d else (a, b) for i, (a, b) in enumerate(of)]
        nodes = below_
    out = rows.withColumn("shard", tree.column()).drop(*[f"_c{i}" for i in range(len(dims))])
    if not cut:
        return out
    homes = F.create_map(*[x for t, n in cut.items() for x in (F.lit(t), F.array(*[F.lit(home.get((t, p), 0)) for p in range(n)]))])
    placed = F.element_at(homes, F.col("text_hash"))
    whole_texts = meta.where(F.col("text_hash").isin(list(cut))).withColumn(
        "shard", F.element_at(placed, (F.pmod(F.xxhash64("doc_id"), F.size(placed).cast("long")) + 1).cast("int"))
    )
    return out.unionByName(whole_texts)


def numbered(rows: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard. Rows that repeat are counted, numbered as one and repeated afterwards; buckets of the others
    by a hash of the row are numbered one after another."""
    columns = rows.columns
    distinct = materialise(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_m")))
    buckets = max(1, distinct.count() // rows_per_bucket)
    dealt = distinct.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    order = Window.partitionBy("shard").orderBy("_bucket")
    before = dealt.groupBy("shard", "_bucket").agg(F.sum("_m").alias("_n")).withColumn(
        "_before", F.sum("_n").over(order) - F.col("_n")
    ).select("shard", "_bucket", "_before")
    within = dealt.withColumn(
        "_nth",
        F.sum("_m").over(
            Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
        ) - F.col("_m")
    )
    start = within.join(before, ["shard", "_bucket"]).select(*columns, "_m", (F.col("_before") + F.col("_nth")).alias("_start"))

    def repeated(df: DataFrame) -> DataFrame:
        return df.select(*columns, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_m") - 1)).alias("slot"))

    if not distinct.where(F.col("_m") > _COPIES).limit(1).count():
        return repeated(start)
    start = materialise(start)
    many = start.where(F.col("_m") > _COPIES).select(
        *columns, "_m", "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(_COPIES).cast("long"))).alias("_from")
    )
    parts = many.select(
        *columns, F.least(F.col("_m") - F.col("_from"), F.lit(_COPIES).cast("long")).alias("_m"),
        (F.col("_start") + F.col("_from")).alias("_start")
    ).repartition("shard", "_start")
    return repeated(start.where(F.col("_m") <= _COPIES)).unionByName(repeated(parts))
