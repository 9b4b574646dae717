"""What the helpers of the session leave on disk."""

import os
import time

from pyspark.sql import functions as F

from sigreview.session import SHUFFLES_END, pin


def _shuffle_files(spark):
    """Names of the shuffle files in Spark's local folders."""
    utils = spark._jvm.org.apache.spark.util.Utils
    folders = list(utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf()))
    return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}


def test_a_pin_leaves_no_shuffle_files(spark):
    setting, before = spark.conf.get(SHUFFLES_END, None), _shuffle_files(spark)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    joined = counted.hint("merge").join(spark.range(2000).withColumnRenamed("id", "k"), "k")
    written = [pin(joined) for _ in range(2)]  # the same rows may be written again
    until = time.monotonic() + 20
    while _shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLES_END, None) == setting
    assert [w.agg(F.sum("count")).first()[0] for w in written] == [1000, 1000]
