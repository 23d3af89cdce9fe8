"""The shared folder and what writing to it leaves behind."""

import time

from pyspark.sql import functions as F

from spanwise.session import SHUFFLES_GO, materialise


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO, None)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("rest")).count()
    found = materialise(counted, "counted")
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(SHUFFLES_GO, None) == setting
    # The frame that was written can still be read, and so can the table.
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, found.collect()))
