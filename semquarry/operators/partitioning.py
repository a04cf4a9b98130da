"""How rows are dealt to tasks, and stored between them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a kernel in Python, dealt to all cores where its input has fewer splits than there are cores.

    Such an input is small, and its shuffle is nothing beside the kernel; larger ones stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def stored(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder, and read from there, so that what follows does not make it again.

    Only where no folder is named and the master is local a temporary one is taken.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="semquarry-"))
    return df.checkpoint(eager=True)
