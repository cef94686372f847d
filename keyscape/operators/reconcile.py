"""Documented assets against observed hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions.text import normalize_role
from keyscape.operators import ranges
from keyscape.operators.roles import role_names


def silent(assets: DataFrame, nodes: DataFrame, zero_coverage: DataFrame) -> DataFrame:
    """Documented, never seen; flagged when inside an uncovered CIDR."""
    unseen = assets.join(nodes.select("ip"), "ip", "left_anti")
    blind = ranges.contained_in(unseen, "ip", zero_coverage, "cidr").withColumn(
        "in_blind_spot", F.lit(True))
    return unseen.join(blind, "ip", "left").fillna({"in_blind_spot": False})


def undocumented(assets: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(assets.select("ip"), "ip", "left_anti")


def contradicted(
    assets: DataFrame, nodes: DataFrame, unknown_contradicts: bool = False
) -> DataFrame:
    """Documented role disagrees with every observed one. A host known only as
    Unknown never contradicts unless asked for."""
    observed = nodes.select("ip", role_names().alias("observed"))
    rows = assets.withColumn("expected", normalize_role("role")).filter(
        F.col("expected") != "").join(observed, "ip")
    rows = rows.filter((F.size("observed") > 0) & ~F.array_contains("observed", F.col("expected")))
    if not unknown_contradicts:
        rows = rows.filter(F.col("observed") != F.array(F.lit(config.ROLE_UNKNOWN)))
    return rows.select("ip", "hostname", F.col("role").alias("documented"), "expected", "observed")
