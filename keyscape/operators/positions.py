"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape.session import materialize


def with_position(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add the 1-based position of every row in ``order``.

    Range-partitioned sort, written once; each row keeps (partition, offset)
    and the driver only sees one row count per partition.
    """
    tag = F.monotonically_increasing_id()
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(spread.withColumn("_tag", tag), "position")
    part = F.shiftright("_tag", 33)
    counts = sorted(
        (r["p"], r["n"])
        for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    )
    base, offsets = 0, []
    for p, n in counts:
        offsets.append((p, base))
        base += n
    # one row per partition of the sort, whatever the number of rows
    table = df.sparkSession.createDataFrame(offsets, "_p bigint, _base bigint")
    within = F.col("_tag").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.join(F.broadcast(table), part == F.col("_p"))
        .withColumn(name, F.col("_base") + within + 1)
        .drop("_tag", "_p", "_base")
    )
