"""Disk that operators leave, and results by other means."""

import time

from runledger.llm import common


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f}


def test_cuts_leave_no_shuffle_files(spark):
    """What a cut shuffled goes when it is written: an operator of many cuts does not add them up."""
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    out = common.cut(spark.range(1000).repartition(4).groupBy("id").count(), "counts")
    for _ in range(40):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    assert not left and spark.conf.get(CLEANUP) == setting
    assert out.count() == 1000
