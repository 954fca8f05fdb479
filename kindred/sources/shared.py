"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder to ``spark.checkpoint.dir``; only a local master, as in tests, may leave that unset, and then gets a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kindred-")
    context.setCheckpointDir(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    use_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder; its lineage ends there."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()
