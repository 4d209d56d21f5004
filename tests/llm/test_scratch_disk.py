"""Materialised tables: the disk that their writes leave."""

import time

from pyspark.sql import functions as F

from jobsift.llm.common import materialise


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_"):
            found.add(name)
    return found


def test_materialised_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(5000).withColumn("k", F.col("id") % 700).groupBy("k").agg(F.sum("id").alias("s"))
    made = materialise(df.repartition(5, "s"))
    again = materialise(df)  # the same frame once more
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert made.count() == again.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
