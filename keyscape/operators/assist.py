"""Bounded evidence pack and checks on what comes back for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions.text import edge_id, vendor_for_mac


def pack_nodes(nodes: DataFrame, allow: DataFrame | None = None,
               limit: int = config.PACK_MAX_NODES) -> DataFrame:
    """Highest ranked hosts, unranked last; a top-k report."""
    if allow is not None:
        nodes = nodes.join(allow.select("ip").distinct(), "ip", "left_semi")
    last = F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.lit(2**31 - 1))
    return nodes.orderBy(last, "ip").limit(limit).select(
        F.col("ip").alias("id"), "hostnames", "subnet", "roles", "composite", "rank", "mac",
        vendor_for_mac(F.coalesce("mac", F.lit(""))).alias("vendor"))


def pack_edges(edges: DataFrame, picked: DataFrame, limit: int = config.PACK_MAX_EDGES) -> DataFrame:
    """Busiest edges between picked hosts (at most ``PACK_MAX_NODES`` of them)."""
    ids = picked.select("id")
    rows = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return rows.orderBy(F.desc("conn_count"), "src", "dst", "port", "proto").limit(limit).select(
        edge_id("src", "dst", "port").alias("id"), "src", "dst", "port", "service", "conn_count")


def payload(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("payload"))


def rejected_citations(findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``findings``: (title, node_ids, edge_ids). Rows that cite nothing or cite
    something that is not in the pack."""
    empty = findings.filter(
        F.size(F.coalesce("node_ids", F.array())) + F.size(F.coalesce("edge_ids", F.array())) <= 0
    ).select("title", F.lit("no citations").alias("problem"), F.lit("").alias("id"))
    cited_nodes = findings.select("title", F.explode("node_ids").alias("id")).distinct().join(
        nodes.select("id").distinct(), "id", "left_anti")
    cited_edges = findings.select("title", F.explode("edge_ids").alias("id")).distinct().join(
        edges.select("id").distinct(), "id", "left_anti")
    return (
        empty.unionByName(cited_nodes.select("title", F.lit("unknown node").alias("problem"), "id"))
        .unionByName(cited_edges.select("title", F.lit("unknown edge").alias("problem"), "id")))


def checked_tags(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """Clean tag rows and name the first problem of each; empty means accepted."""
    cleaned = F.array_distinct(F.filter(
        F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    rows = tags.select(
        F.trim("node_id").alias("node_id"), cleaned.alias("tags"), "confidence",
        F.trim("rationale").alias("rationale"))
    known = nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("_known")).distinct()
    problem = (
        F.when(F.col("_known").isNull(), "unknown node")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence outside 0..1")
        .when(F.coalesce("rationale", F.lit("")) == "", "no rationale")
        .when(F.size("tags") == 0, "no tags").otherwise(""))
    return rows.join(known, "node_id", "left").withColumn("problem", problem).drop("_known")


def merge_suggestions(old: DataFrame, new: DataFrame, targets: DataFrame) -> DataFrame:
    """New suggestions replace those of the targeted hosts; others stay."""
    kept = old.join(targets.select("node_id").distinct(), "node_id", "left_anti")
    return new.unionByName(kept)


def attach_suggestions(map_nodes: DataFrame, tags: DataFrame, model: str = "") -> DataFrame:
    mine = tags.select(
        F.col("node_id").alias("id"), F.col("tags").alias("suggested_tags"),
        F.col("confidence").alias("suggestion_confidence"),
        F.col("rationale").alias("suggestion_rationale"), F.lit(model).alias("suggestion_model"))
    return map_nodes.join(mine, "id", "left")
