"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.llm.joins import compact
from keyscape.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of ``edges`` (a, b): root is the smallest node that
    can be reached. Labels move along edges and then jump to the label's label, so
    rounds grow with the logarithm of a path. Each round is one written table."""
    both = edges.where("a <> b")
    both = materialize(
        both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(), "cc-edges")
    n = both.count()
    state = materialize(compact(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("a")).alias("root")), n), "cc-labels")
    while True:
        seen = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = state.join(seen, "node").select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        state = materialize(compact(hooked.join(jump, "root").select(
            "node", F.col("far").alias("root"), "old"), n), "cc-labels")
        if state.where("root <> old").isEmpty():
            return state.select("node", "root")
        state = state.select("node", "root")
