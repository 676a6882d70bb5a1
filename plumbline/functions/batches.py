"""Size of the Arrow batches in which texts go to Python and come back."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch. What Python makes of it (strings, spans, several edits of each text) is many times as much in each running task.
SIZE = "1m"
_NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own default, and what the training-data operators put in its place.
_GIVEN = (None, "67108864b", "64MB", "64m", "8m")


def bounded(spark: SparkSession | None = None) -> None:
    """Batches of about ``SIZE``, or of one row where it has more, in the given or else the active session, unless that sets its own. Spark's
    default is 10,000 rows or 64 MB, so that a worker's memory would grow with the rows of a task until that is reached."""
    conf = (spark or SparkSession.active()).conf
    if conf.get(_NAME, None) in _GIVEN:
        conf.set(_NAME, SIZE)
