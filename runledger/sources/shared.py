"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode only, as
    in tests: on a cluster a local folder is not shared. Checkpoints go there too."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if given is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="runledger-"))
    return (given or sc.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
