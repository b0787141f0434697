"""Cutting the lineage of a DataFrame in the folder that the cluster names for it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read from there.

    Where the setting is absent a temporary folder takes its place on a local master; on a cluster
    executors would write to different disks, so there it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(base)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the folder that ``spark.checkpoint.dir`` names, by the rule of :func:`settled`."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
