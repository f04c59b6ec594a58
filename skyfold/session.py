"""Session set-up, and the one way in which this package cuts lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "skyfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, one in the warehouse of a session on one machine.

    A cluster has to name a folder that all executors share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints/{uuid.uuid4().hex}"
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a scan of few row groups would leave the others
    idle in a costly stage of Python. Larger inputs are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
