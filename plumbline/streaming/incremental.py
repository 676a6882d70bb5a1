"""Incremental scans: new documents of a folder are scanned once, by content; each batch is appended to a table of results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import baseline
from ..operators.decide import offline_outcome
from ..operators.spans import candidates


def documents(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def outcomes(docs: DataFrame) -> DataFrame:
    """The scan is stateless, so it is the same expression on a stream and on a table."""
    return candidates(docs).withColumn("outcome", offline_outcome()).select("doc_id", "kind", "type", "start", "end", "placeholder", "outcome")


def regressions(answers: DataFrame, previous: DataFrame, question: DataFrame) -> DataFrame:
    """What has become worse, of a stream (or table) of answers (doc_id, question_id, value) against those of an earlier report: a join of the
    stream with a table, without state."""
    return baseline.diff(answers, previous, question).where("regressed")


def run_once(docs: DataFrame, results: str, checkpoint: str) -> StreamingQuery:
    """Scan what is new since the last call; texts seen before under any id are left out."""

    def write(batch: DataFrame, epoch: int) -> None:
        """A batch has a folder of its own, which a replay after a crash replaces."""
        spark = batch.sparkSession
        keyed = batch.withColumn("content_key", F.sha2("text", 256)).dropDuplicates(["content_key"])
        try:
            seen = spark.read.parquet(f"{results}/keys").where(F.col("epoch") != epoch)
            keyed = keyed.join(seen.select("content_key"), "content_key", "left_anti")
        except AnalysisException as error:  # the first batch has no table yet
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        # Written before the keys are replaced, which the selection reads.
        outcomes(keyed.drop("content_key")).write.mode("overwrite").parquet(f"{results}/spans/epoch={epoch}")
        keyed.select("content_key").write.mode("overwrite").parquet(f"{results}/keys/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
