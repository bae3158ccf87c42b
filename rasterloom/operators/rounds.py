"""Lineage cuts for operators that work in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(rows: DataFrame) -> DataFrame:
    """rows, computed once and kept in the folder of spark.checkpoint.dir, which driver and executors share.

    A folder of its own is made only where the session names none and runs on one machine.
    """
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="raster-checkpoint-"))
    return rows.checkpoint()
