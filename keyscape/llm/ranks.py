"""Rank of every row within its group, with no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyscape.session import materialize

PART_ROWS = 1_000_000


def rank_within(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the row's place from 0 in its group by ``order``.

    One range-partitioned sort by (groups, order, input position), written once; a
    large group spans several parts, also when all its rows tie. The place is the
    offset within the part plus the rows of the group in earlier parts, of which
    there are no more than parts and groups together. Nulls form a group.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
    by = [*groups, *order, "_at"]
    spread = (
        df.withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_at")
    )
    stored = materialize(spread.withColumn("_tag", F.monotonically_increasing_id()), "ranks")
    stored = stored.withColumn("_part", F.shiftright("_tag", 33))
    sums = stored.groupBy(*groups, "_part").agg(
        F.min("_tag").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = materialize(sums.withColumn(
        "_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))), "rank-parts")
    sums = sums.select(*[F.col(g).alias(f"_g_{g}") for g in groups],
                       F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return stored.join(sums, same).select(
        *df.columns, (F.col("_tag") - F.col("_first") + F.col("_before")).alias(name))
