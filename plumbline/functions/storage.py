"""Results that several steps read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder named in ``spark.checkpoint.dir`` and cut its lineage, so that what made it runs once.

    Where no folder is set, one is made, but only where driver and executors are one process.
    """
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    return df.checkpoint(eager=True)
