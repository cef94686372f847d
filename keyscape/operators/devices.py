"""Operator devices: same-device hints, overlays, collapsed nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyscape.functions import ip as ipf
from keyscape.functions.text import vendor_for_mac

# Tier of an operator-corrected role.
OVERRIDE_TIERS = {
    "domaincontroller": "core", "dnsserver": "core", "fileserver": "service",
    "database": "service", "webserver": "service", "jumpbox": "service",
    "mailserver": "service", "printer": "client", "camera": "client",
    "workstation": "client",
}
NOT_DEVICE_LABELS = ["gateway", "networkgear", "unknown"]


def hint_classes(pairs: DataFrame, kind: str, devices: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(key, value, n) of every value of ``pairs`` (value, ip) that suggests one device: it
    stands for two addresses or more that are not all one device's already, and nobody has
    dismissed it. Counts only, however many addresses share a value."""
    owner = devices.select("ip", "device").distinct()
    grouped = pairs.distinct().join(owner, "ip", "left").groupBy("value", "ip").agg(
        F.min("device").alias("lo"), F.max("device").alias("hi")).groupBy("value").agg(
        F.count("*").alias("n"), F.count_if(F.col("lo").isNull()).alias("loose"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    linked = (F.col("loose") == 0) & (F.col("lo") == F.col("hi"))
    return (
        grouped.filter((F.col("n") >= 2) & ~linked)
        .withColumn("key", F.concat(F.lit(f"{kind}:"), F.col("value")))
        .join(dismissed.select("key"), "key", "left_anti").select("key", "value", "n"))


def hint_members(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, ip) of the addresses behind hints."""
    return pairs.join(classes.select("key", "value"), "value").select("key", "ip").distinct()


def _listed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    ips = hint_members(pairs, classes).groupBy("key").agg(F.array_sort(F.collect_list("ip")).alias("ips"))
    return classes.join(ips, "key")


def hostname_pairs(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("hostnames").alias("value"), "ip")


def mac_pairs(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.coalesce("mac", F.lit("")) != "").select(F.col("mac").alias("value"), "ip")


def hostname_hints(nodes, devices, dismissed) -> DataFrame:
    """Hints with their addresses in one array each, for a reader; ``hint_classes`` and
    ``hint_members`` are the same without arrays."""
    pairs = hostname_pairs(nodes)
    return _listed(pairs, hint_classes(pairs, "hostname", devices, dismissed)).select(
        "key", F.col("value").alias("name"), "ips")


def mac_hints(nodes, devices, dismissed) -> DataFrame:
    pairs = mac_pairs(nodes)
    vendor = vendor_for_mac("value")
    return _listed(pairs, hint_classes(pairs, "mac", devices, dismissed)).select(
        "key", F.when(vendor != "", vendor).otherwise(F.col("value")).alias("name"), "ips")


def custom_label(role) -> Column:
    """An override that names a device rather than a kind of host."""
    low = F.lower(F.coalesce(role, F.lit("")))
    return (low != "") & ~low.isin(NOT_DEVICE_LABELS + list(OVERRIDE_TIERS))


def operator_facts(devices, overrides, labels) -> DataFrame:
    """One row per address: device, type, corrected role, labels. Notes are left out. Of
    several devices or roles given to one address the last by name counts."""
    named = devices.groupBy("ip").agg(F.max(F.struct("device", "device_type")).alias("d")).select("ip", "d.*")
    roles = overrides.groupBy("ip").agg(F.max("role_override").alias("role_override"))
    marks = labels.groupBy("ip").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return named.join(roles, "ip", "full").join(marks, "ip", "full").select(
        "ip", F.coalesce("device", F.lit("")).alias("device"),
        F.coalesce("device_type", F.lit("")).alias("device_type"),
        F.coalesce("role_override", F.lit("")).alias("role_override"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def pin_set(pins, devices, overrides) -> DataFrame:
    """Hosts that keep their own map node."""
    custom = overrides.filter(custom_label(F.col("role_override"))).select("ip")
    return pins.select("ip").unionByName(devices.select("ip")).unionByName(custom).distinct()


def overlay(map_nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Operator facts onto map nodes (``id`` is the address)."""
    tiers = F.create_map(*[F.lit(x) for kv in OVERRIDE_TIERS.items() for x in kv])
    mine = facts.select(F.col("ip").alias("id"), F.col("device").alias("_d"),
                        F.col("device_type").alias("_t"), "role_override", "labels")
    joined = map_nodes.join(mine, "id", "left")
    return joined.withColumns({
        "device": F.coalesce(F.nullif("_d", F.lit("")), "device"),
        "device_type": F.coalesce(F.nullif("_t", F.lit("")), "device_type"),
        "role_override": F.coalesce("role_override", F.lit("")),
        "labels": F.coalesce("labels", F.array().cast("array<string>")),
        "tier": F.coalesce(F.element_at(tiers, F.lower("role_override")), "tier"),
    }).drop("_d", "_t")


def _collapse_name() -> Column:
    return F.when(F.col("device") != "", F.col("device")).when(
        custom_label(F.col("role_override")), F.col("role_override"))


def collapse_map(nodes: DataFrame) -> DataFrame:
    """(id, target) of every host that merges into a device node."""
    single = (F.col("agg_count") == 0) & ~F.col("gateway") & ipf.is_ip("id")
    named = nodes.filter(single).select("id", _collapse_name().alias("name")).filter("name IS NOT NULL")
    sizes = named.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    return named.join(sizes, "name").select(
        "id", "name", F.concat(F.lit("dev:"), F.lower(F.hex(F.encode("name", "utf-8")))).alias("target"))


def collapse_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Map nodes with every multi-address device as one node: best composite and
    rank, united services and labels."""
    rows = nodes.join(mapping, "id")
    ranked = F.when(F.col("rank") > 0, F.col("rank"))
    merged = rows.groupBy("target", "name").agg(
        F.count("*").alias("agg_count"), F.max("composite").alias("composite"),
        F.coalesce(F.min(ranked), F.lit(0)).alias("rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("services")))).alias("services"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.min("role_override").alias("lo"), F.max("role_override").alias("hi"),
        F.min_by("role", F.struct(F.coalesce(ranked, F.lit(2**31 - 1)), "id")).alias("role"),
        F.min_by("tier", F.struct(F.coalesce(ranked, F.lit(2**31 - 1)), "id")).alias("tier"))
    made = merged.select(
        F.col("target").alias("id"), F.concat(F.lit("devg:"), F.substring("target", 5, 10**6)).alias("group"),
        F.concat(F.col("agg_count").cast("string"), F.lit(" IPs")).alias("label"), "role", "tier",
        "composite", "rank", "agg_count", F.col("name").alias("device"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("role_override"),
        "services", "labels")
    kept = nodes.join(mapping.select("id"), "id", "left_anti").select(*made.columns)
    return kept.unionByName(made)


def rewrite_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Map edges redirected to device nodes and merged."""
    to = mapping.select("id", "target")
    rows = (
        edges.join(to.select(F.col("id").alias("src"), F.col("target").alias("_s")), "src", "left")
        .join(to.select(F.col("id").alias("dst"), F.col("target").alias("_d")), "dst", "left")
        .withColumn("src", F.coalesce("_s", "src")).withColumn("dst", F.coalesce("_d", "dst"))
        .filter(F.col("src") != F.col("dst")))
    flag = F.when(F.col("drift") != "", F.col("drift"))
    merged = rows.groupBy("src", "dst", "class").agg(
        F.first("color").alias("color"), F.sum("hosts").alias("hosts"), F.sum("conns").alias("conns"),
        F.max("width").alias("width"), F.min(flag).alias("lo"), F.max(flag).alias("hi"))
    label = F.when(F.col("hosts") > 1, F.concat(
        F.col("hosts").cast("string"), F.lit(" hosts → "), F.col("class"))).otherwise(F.col("class"))
    drift = F.when(F.col("lo") != F.col("hi"), "changed").otherwise(F.coalesce("lo", F.lit("")))
    return merged.select("src", "dst", "class", "color", label.alias("label"), "hosts", "conns",
                         "width", drift.alias("drift"))


def membership(nodes: DataFrame, hidden: DataFrame, mapping: DataFrame, facts: DataFrame) -> DataFrame:
    """Hosts behind every node that stands for several, as one table: (parent, level, pos, id,
    label, role, tier, composite, rank, device, device_type, role_override, labels).

    ``hidden`` (agg_id, ip, ...) are the hosts behind aggregates, ``mapping`` those that merge
    into a device node; operator facts are laid over both. ``pos`` is the place in the
    parent's list: by rank, those without one last, then by address. A host has one parent.
    """
    shown = ["id", "label", "role", "tier", "composite", "rank"]
    behind = hidden.withColumnRenamed("ip", "id").select(
        F.col("agg_id").alias("parent"), F.lit("aggregate").alias("level"), *shown,
        F.lit("").alias("device"), F.lit("").alias("device_type"))
    merged = nodes.join(mapping.select("id", F.col("target").alias("parent")), "id").select(
        "parent", F.lit("device").alias("level"), *shown, "device", "device_type")
    rows = overlay(behind.unionByName(merged), facts)
    order = Window.partitionBy("parent").orderBy(
        F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.lit(2**31 - 1)), "id")
    return rows.withColumn("pos", F.row_number().over(order)).select(
        "parent", "level", "pos", *shown, "device", "device_type", "role_override", "labels")


def device_groups(mapping: DataFrame) -> DataFrame:
    """The group of its own that every device node is in, named like the device."""
    return mapping.select(
        F.concat(F.lit("devg:"), F.substring("target", 5, 10**6)).alias("id"), F.col("name").alias("label")).distinct()
