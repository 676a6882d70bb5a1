"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder named in ``spark.checkpoint.dir``; set one of our own only where none is set, and only where driver and
    executors are one process (tests, benches)."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage; its shuffle files, which nothing can read any more, go."""
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(_CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*done: DataFrame) -> None:
    """Delete the files of results of :func:`materialise` that no later job reads."""
    for df in done:
        file = df._jdf.logicalPlan().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most ``size`` between the JVM and Python, unless the session sets its own; Spark's 64 MB a batch, several
    times over for each running task, is much beside an executor of a few GB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b", "64MB", "64m", batches.SIZE):
        spark.conf.set(name, size)


@contextmanager
def deep_expressions(spark: SparkSession) -> Iterator[None]:
    """Let the analyzer take the rounds that lambdas within lambdas need; each level is resolved in rounds of its own."""
    name = "spark.sql.analyzer.maxIterations"
    before = spark.conf.get(name, "100")
    spark.conf.set(name, str(max(2000, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hot_join(
    left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, spread: Column, share: int = 1000, least: int = 10_000
) -> DataFrame:
    """Left join with a ``right`` side of one row a key, whose column ``rows`` says how many rows of ``left`` have the key.

    Keys of over ``total / share`` rows and over ``least``, fewer than ``share`` whatever the size, are joined by broadcast; the others by
    sorting, in which the rows of those keys are dealt by the hash of ``spread``. Where no key is that hot there is no broadcast at all. The
    column ``rows`` is dropped.
    """
    values = [c for c in right.columns if c not in (*on, rows)]
    hot = right.where((F.col(rows) * share > total) & (F.col(rows) > least))
    if not hot.limit(1).count():
        return left.join(right.drop(rows).hint("merge"), on, "left").select(*left.columns, *values)
    packed = lambda df, name: df.select(*on, F.struct(*values).alias(name))
    marked = left.join(F.broadcast(packed(hot, "hot_join:hot")), on, "left")
    salt = F.when(F.col("hot_join:hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1)))
    cold = packed(right, "hot_join:value").withColumn("hot_join:salt", F.lit(0).cast("long"))
    joined = marked.withColumn("hot_join:salt", salt).join(cold.hint("merge"), [*on, "hot_join:salt"], "left")
    value = F.coalesce(F.col("hot_join:hot"), F.col("hot_join:value"))
    return joined.withColumn("hot_join:value", value).select(*left.columns, *[F.col("hot_join:value")[v].alias(v) for v in values])


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: A bitmap has 16 bits a key, but at least the first and at most the second number (32 MB), whatever the number of keys.
FEWEST_BITS, MOST_BITS = 1 << 22, 1 << 28
_BLOCK = 1 << 15


def bitmap_size(keys: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * keys).bit_length()))


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap of the hashes in the long column ``key``, as at most ``bits`` / 32,768 rows of 4 KB."""
    place = F.pmod(F.col(key), F.lit(bits).cast("long"))
    return keys.groupBy(F.shiftright(place, 15).cast("int").alias("bitmap:block")).agg(F.bitmap_construct_agg(place % _BLOCK).alias("bitmap:bits"))


def maybe_in(df: DataFrame, key: str, found: DataFrame, bits: int) -> DataFrame:
    """Add ``bitmap:hit``: false only if ``key`` is not among the bitmap's. Rows that it rules out need not be shuffled for an exact join;
    beyond ``MOST_BITS`` / 16 keys it rules out fewer and fewer, and the join does the rest. The broadcast has a fixed bound."""
    place = F.pmod(F.col(key), F.lit(bits).cast("long"))
    joined = df.withColumn("bitmap:block", F.shiftright(place, 15).cast("int")).join(F.broadcast(found), "bitmap:block", "left")
    byte = F.conv(F.hex(F.substring(F.col("bitmap:bits"), (F.floor(place % _BLOCK / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (place % 8).cast("int")) == 1
    return joined.withColumn("bitmap:hit", F.coalesce(hit, F.lit(False))).drop("bitmap:block", "bitmap:bits")
