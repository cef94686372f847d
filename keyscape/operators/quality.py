"""Discovery counts, coverage and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.functions import ip as ipf
from keyscape.operators import ranges
from keyscape.sources.telemetry import FieldMap, physical_column

# What stays blind when a log type is missing.
BLIND = {
    "conn": "no dependency edges at all",
    "dns": "DNS server role inference blind",
    "kerberos": "domain controller inference blind",
    "smb": "file server inference blind",
    "ssl": "web server inference blind on TLS",
    "http": "web server inference blind on HTTP",
    "dhcp": "DHCP server inference and lease identity blind",
    "ldap": "domain controller corroboration blind",
    "x509": "TLS certificate continuity blind",
    "ssh": "SSH host-key continuity blind",
}


class WrongFieldMap(ValueError):
    """Rows are in the window, yet no group could be formed from them."""


class EmptyScan(ValueError):
    """No edge is left within the window and the scope."""


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows of every value, or of the ``top`` most frequent ones, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(top) if top else counts


def dataset_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    return value_counts(df, "dataset", top)


def sensor_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    return value_counts(df, "sensor", top)


def mac_coverage(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count("src_mac").alias("with_src_mac"),
        F.count("dst_mac").alias("with_dst_mac"),
    )


def dataset_resolution(counts: DataFrame, fields: FieldMap) -> DataFrame:
    """Which accepted dataset names exist per log type, and what a missing one
    leaves blind. The candidate table is the fixed field map."""
    spark = counts.sparkSession
    rows = [(k, v, i) for k, vs in fields.datasets.items() for i, v in enumerate(vs)]
    wanted = spark.createDataFrame(rows, "kind string, dataset string, ord int")
    joined = wanted.join(counts, "dataset", "left")
    found = F.array_sort(
        F.collect_list(F.when(F.col("n").isNotNull(), F.struct("ord", "dataset")))
    )
    out = joined.groupBy("kind").agg(found.alias("f"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    blind = F.create_map(*[F.lit(x) for kv in BLIND.items() for x in kv])
    return out.select(
        "kind",
        F.transform("f", lambda x: x["dataset"]).alias("found"),
        "n",
        F.when(F.size("f") == 0, F.element_at(blind, F.col("kind"))).otherwise("").alias("blind"),
    )


def field_presence(df: DataFrame, fields: FieldMap, concepts: list[str]) -> DataFrame:
    """Per concept: whether the column exists and how many rows fill it."""
    aggs, exists = [F.count("*").alias("total")], {}
    for c in concepts:
        col = physical_column(df, fields.columns[c])
        exists[c] = col is not None
        aggs.append((F.count(col) if col is not None else F.lit(0)).cast("bigint").alias(c))
    row = df.agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(c).alias("concept"), F.lit(fields.columns[c]).alias("column"),
                 F.lit(exists[c]).alias("present"), F.col(c).alias("filled"),
                 F.col("total").alias("total"))
        for c in concepts
    ])
    return row.select(F.inline(entries))


def require_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Fail loudly when rows exist but nothing could be grouped."""
    if groups.isEmpty() and not rows.isEmpty():
        raise WrongFieldMap("rows in the window but no groups: check the field map")
    return groups


def evidence_mix(edges: DataFrame) -> DataFrame:
    return edges.groupBy("evidence").agg(F.count("*").alias("edges"))


def overlay_integrity(devices: DataFrame) -> DataFrame:
    """Violations among operator devices (device, ip): blank or repeated names,
    unparseable addresses, one address owned twice."""
    named = devices.select("device_id", F.trim("device").alias("device")).distinct()
    blank = named.filter(F.coalesce("device", F.lit("")) == "").select(
        F.lit("blank-name").alias("problem"), F.col("device_id").cast("string").alias("subject")
    )
    repeated = (
        named.filter(F.col("device") != "").groupBy(F.lower("device").alias("subject"))
        .agg(F.count("*").alias("n")).filter("n > 1")
        .select(F.lit("repeated-name").alias("problem"), "subject")
    )
    bad = devices.filter(~ipf.is_ip("ip")).select(
        F.lit("bad-address").alias("problem"), F.col("ip").alias("subject")
    ).distinct()
    shared = (
        devices.filter(ipf.is_ip("ip")).select("ip", "device_id").distinct()
        .groupBy("ip").agg(F.count("*").alias("n")).filter("n > 1")
        .select(F.lit("shared-address").alias("problem"), F.col("ip").alias("subject"))
    )
    return blank.unionByName(repeated).unionByName(bad).unionByName(shared)


def zero_coverage(
    scope: DataFrame, nodes: DataFrame, lengths: list[int] | None = None
) -> DataFrame:
    """In-scope CIDRs without any observed host."""
    hosts = nodes.select("ip").distinct()
    seen = ranges.match(hosts, "ip", scope, "cidr", lengths).select("cidr").distinct()
    return scope.select("cidr").distinct().join(seen, "cidr", "left_anti")
