import time

from pyspark.sql import functions as F

from keyscape.session import materialize


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf, before = spark.conf.get(key, "false"), _shuffle_files(spark)
    sums = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    out = materialize(sums, "sums")
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(key, "false") == conf
    assert out.count() == 100 and out.agg(F.sum("s")).first()[0] == 4999 * 2500
