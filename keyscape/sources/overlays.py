"""Operator overlays from one small registry document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
devices ARRAY<STRUCT<name: STRING, type: STRING, ips: ARRAY<STRING>>>,
labels MAP<STRING, ARRAY<STRING>>,
role_overrides MAP<STRING, STRING>,
dismissed_hints ARRAY<STRING>,
pinned ARRAY<STRING>,
segments ARRAY<STRUCT<cidr: STRING, name: STRING>>,
approved_providers ARRAY<STRING>,
show_all_private BOOLEAN
"""


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def tables(doc: DataFrame) -> dict[str, DataFrame]:
    """Exploded overlay tables. Unknown fields, such as notes, are not read."""
    devices = doc.select(F.posexplode("devices").alias("device_id", "d"))
    return {
        "devices": devices.select("device_id", F.col("d.name").alias("device"),
                                  F.col("d.type").alias("device_type"), F.explode("d.ips").alias("ip")),
        "labels": doc.select(F.explode("labels").alias("ip", "l")).select("ip", F.explode("l").alias("label")),
        "overrides": doc.select(F.explode("role_overrides").alias("ip", "role_override")),
        "dismissed": doc.select(F.explode("dismissed_hints").alias("key")),
        "pins": doc.select(F.explode("pinned").alias("ip")),
        "segments": doc.select(F.inline("segments")),
        "approved": doc.select(F.explode("approved_providers").alias("provider")),
    }
