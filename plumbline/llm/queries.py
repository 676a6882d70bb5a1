"""The queries of this subpackage by name; :mod:`.sql` has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, media, near_dedup, packing, pieces, pii, quality, sharding, simhash, url_filter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_neighbours(table(spark, sf_dir, "documents"))
    return simhash.search(found, F.col("doc_id") % 100 == 0).drop("fp_hi", "fp_lo")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Words that mark a page as bad where its visible text has them.
BAD_WORDS = ("casino", "casinos", "bets", "betting", "pills", "adult", "poker", "viagra", "jackpot", "xxx", "porn", "payday", "replica", "spam", "ads")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_filter.content_label(F.col("html"), BAD_WORDS))
    return found.withColumn("purity", F.round("purity", 9))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with pseudonyms; in production the key comes from the session's ``plumbline.pii.key``."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("plumbline.pii.key", "example key"))


def _tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), _tokenizer_json())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scores = quality.scored(docs, model)
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.at).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.numbered(sharding.assign(sharding.metadata(table(spark, sf_dir, "documents")), 24))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard")
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's ``plumbline.licenses.folder`` may name a folder of whole licence texts, which are added to the templates."""
    folder = spark.conf.get("plumbline.licenses.folder", None)
    found = licenses.scan(table(spark, sf_dir, "documents"), templates=licenses.TEMPLATES + (licenses.folder_templates(folder) if folder else []))
    starts = F.transform("base", lambda b: b["start"])
    base = F.transform("base", lambda b: b["label"])
    more = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_rows", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
    coded = pieces.encode(docs, model, ("doc_id", "text_sha256")).select(
        "doc_id", "text_sha256", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "score", "ids"
    )
    back = pieces.decode(coded, model, ("doc_id", "n_ids", "ids_hash", "score", "text_sha256"))
    return back.select("doc_id", "n_ids", "ids_hash", "score", "text_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_media": op7_media,
    "op8_licenses": op8_licenses,
    "op9_near_dedup": op9_near_dedup,
    "op10_pieces": op10_pieces,
}
