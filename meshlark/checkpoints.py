"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def persist(df: DataFrame) -> DataFrame:
    """A checkpoint in ``spark.checkpoint.dir``; where the session names none, in a folder of our own on one machine (tests), and an error on a cluster.

    Spark carries its guess of the size on with a checkpoint, and that of a join is the product of both sides: in a loop of joins
    its digits multiply every round until the driver has no memory left.  So the rows come back as a table of unknown size.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshlark-"))
    cut = df.checkpoint(eager=True)._jdf  # noqa: SLF001
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(cut.queryExecution().toRdd(), cut.schema(), False), df.sparkSession)  # noqa: SLF001
