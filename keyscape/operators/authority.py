"""Providers of sensitive services."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyscape.functions import ip as ipf
from keyscape.functions import ports, text
from keyscape.operators.drift import sensitive_pairs
from keyscape.operators.edges import confirmed, evidence_level
from keyscape.operators.roles import top_role
from keyscape.session import materialize

SAMPLE_CLIENTS = 5


def sensitive_edges(edges: DataFrame) -> DataFrame:
    return confirmed(edges).filter(ports.is_sensitive("port") & ipf.terrain_addr("dst"))


def service_authority(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per (responder, port): clients, strongest evidence, span, host
    facts. Pairs are reduced before clients are counted."""
    pairs = sensitive_edges(edges).groupBy("dst", "port", "src").agg(
        F.max(text.evidence_strength("evidence")).alias("g"),
        F.max(F.coalesce("evidence", F.lit("")) != "").alias("graded"),
        F.min("first_seen").alias("f"), F.max("last_seen").alias("l"),
    )
    grouped = pairs.groupBy("dst", "port").agg(
        F.count("*").alias("clients"), F.max("g").alias("g"), F.max("graded").alias("graded"),
        F.min("f").alias("first_seen"), F.max("l").alias("last_seen"),
    )
    hosts = nodes.select(
        F.col("ip").alias("dst"), F.get("hostnames", F.lit(0)).alias("hostname"),
        top_role().alias("role"), "rank",
    )
    return grouped.join(hosts, "dst", "left").select(
        F.col("dst").alias("ip"), F.coalesce("hostname", F.lit("")).alias("hostname"),
        F.coalesce("role", F.lit("Unknown")).alias("role"),
        ports.service_name("port").alias("service"), "port",
        F.when(F.col("graded"), evidence_level(F.col("g"))).otherwise("").alias("evidence"),
        "clients", "first_seen", "last_seen", F.coalesce("rank", F.lit(0)).alias("rank"),
    )


def provider_enrichment(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sample clients, client subnets and sensors per provider. Each list comes
    from its own distinct pairs; samples are limited before they move."""
    keys = ["ip", "port"]
    rows = sensitive_edges(edges).withColumnRenamed("dst", "ip")
    pairs = rows.select(*keys, "src").distinct()
    order = Window.partitionBy(*keys).orderBy("src")
    sample = (
        pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_CLIENTS)
        .groupBy(*keys).agg(F.array_sort(F.collect_list("src")).alias("sample_clients"))
    )
    known = nodes.select(F.col("ip").alias("src"), "subnet")
    subnets = (
        pairs.join(known, "src").filter("subnet <> ''").select(*keys, "subnet").distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_list("subnet")).alias("subnets"))
    )
    sensors = (
        rows.select(*keys, F.explode("sensors").alias("sensor")).distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_list("sensor")).alias("sensors"))
    )
    none = F.array().cast("array<string>")
    return (
        sample.join(subnets, keys, "left").join(sensors, keys, "left")
        .select(*keys, "sample_clients", F.coalesce("subnets", none).alias("subnets"),
                F.coalesce("sensors", none).alias("sensors"))
    )


def provider_classes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clients of a service with the same set of two or more providers, as classes:
    members (service, src, cls) and providers (service, cls, ip, port, clients); ``cls`` is
    the smallest client.

    Clients are first grouped by the size of their set and an order-free digest of it. A
    group is one class if all its clients have each of its providers, which counts show:
    clients of n providers each, n providers in all. Where a digest stands for several sets,
    every client is a class of its own. No set is ever collected.
    """
    pairs = materialize(sensitive_pairs(edges).select(
        ports.service_name("port").alias("service"), "src", F.col("dst").alias("ip"), "port"), "provider-pairs")
    a, b = F.xxhash64("ip", "port"), F.xxhash64("port", "ip", F.lit("second"))
    signed = pairs.groupBy("service", "src").agg(
        F.count("*").alias("n"),
        F.sum(a.cast("decimal(20,0)")).alias("a"), F.sum(b.cast("decimal(20,0)")).alias("b"),
    ).filter("n > 1")
    return _verified(pairs, signed)


def _verified(pairs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of the clients (service, src, n, and the digest a, b)."""
    digest = ["service", "n", "a", "b"]
    first = signed.groupBy(*digest).agg(F.min("src").alias("cls"))
    grouped = materialize(signed.join(first, digest).select("service", "src", "n", "cls"), "provider-groups")
    counted = materialize(pairs.join(grouped, ["service", "src"]).groupBy("service", "cls", "n", "ip", "port").agg(
        F.count("*").alias("clients")), "provider-counts")
    mixed = counted.groupBy("service", "cls", "n").agg(F.count("*").alias("_all")).filter("_all > n").select("service", "cls")
    split = grouped.join(mixed, ["service", "cls"], "left_semi").select("service", "src", F.col("src").alias("cls"))
    whole = grouped.join(mixed, ["service", "cls"], "left_anti").select("service", "src", "cls")
    own = pairs.join(split, ["service", "src"]).select("service", "cls", "ip", "port", F.lit(1).cast("bigint").alias("clients"))
    providers = counted.join(mixed, ["service", "cls"], "left_anti").select("service", "cls", "ip", "port", "clients")
    return whole.unionByName(split), providers.unionByName(own)


def alternate_providers(edges: DataFrame) -> DataFrame:
    """Other providers of the same service that share a client: those of every class a
    provider is in. One class stands for all its clients, so only distinct provider sets
    take part."""
    kept = provider_classes(edges)[1].select("service", "cls", "ip", "port")
    other = kept.select("service", "cls", F.col("ip").alias("o_ip"), F.col("port").alias("o_port"))
    linked = (
        kept.join(other, ["service", "cls"])
        .filter((F.col("ip") != F.col("o_ip")) | (F.col("port") != F.col("o_port")))
        .select("ip", "port", text.provider_key("o_ip", "o_port").alias("alt")).distinct()
    )
    return linked.groupBy("ip", "port").agg(
        F.array_sort(F.collect_list("alt")).alias("alternate_providers")
    )


def sole_providers(authority: DataFrame) -> DataFrame:
    """Providers that are the only one of their service."""
    single = authority.groupBy("service").agg(
        F.count("*").alias("n"), F.min("ip").alias("ip"), F.min("port").alias("port")
    )
    return single.filter("n = 1").select("service", "ip", "port")
