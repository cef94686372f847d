"""Longitudinal standing of hosts over a sequence of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape import config


def stability(
    nodes: DataFrame, meta: DataFrame, top_n: int = config.DRIFT_TOP_N
) -> DataFrame:
    """``nodes``: (snapshot_id, ip, rank, role); ``meta``: (snapshot_id, created_at).

    Ranked counts and first/last flags are one small row per snapshot, so the
    only shuffle of nodes is the final one by address.
    """
    ranked = nodes.filter(F.col("rank") > 0).groupBy("snapshot_id").agg(
        F.count("*").alias("ranked")
    )
    ends = meta.agg(F.min(F.struct("created_at", "snapshot_id")).alias("a"),
                    F.max(F.struct("created_at", "snapshot_id")).alias("b"))
    marks = meta.select("snapshot_id", F.lit(1).alias("one")).join(
        ends.select(F.lit(1).alias("one"), F.col("a.snapshot_id").alias("first"),
                    F.col("b.snapshot_id").alias("last")), "one")
    info = marks.join(ranked, "snapshot_id", "left").select(
        "snapshot_id", "ranked",
        (F.col("snapshot_id") == F.col("first")).alias("is_first"),
        (F.col("snapshot_id") == F.col("last")).alias("is_last"))
    has = F.col("rank") > 0
    share = F.when(F.col("ranked") > 1,
                   (F.col("ranked") - F.col("rank")) / (F.col("ranked") - 1)).otherwise(1.0)
    rows = nodes.join(info, "snapshot_id").withColumn("pct", F.when(has, share))
    named = F.when(F.col("role") != config.ROLE_UNKNOWN, F.col("role"))
    out = rows.groupBy("ip").agg(
        F.count("*").alias("occurrences"),
        F.count_if(has & (F.col("rank") <= top_n)).alias("top_n_occurrences"),
        F.coalesce(F.max("pct"), F.lit(0.0)).alias("best_percentile"),
        F.coalesce(F.min("pct"), F.lit(0.0)).alias("worst_percentile"),
        F.coalesce(F.median("pct"), F.lit(0.0)).alias("median_percentile"),
        (F.coalesce(F.min(named) == F.max(named), F.lit(True))).alias("role_consistent"),
        F.max("is_first").alias("f"), F.max("is_last").alias("l"),
    )
    label = (
        F.when(F.col("f") & F.col("l"), "persistent")
        .when(F.col("l"), "emerging").otherwise("transient")
    )
    return out.withColumn("classification", label).drop("f", "l")
