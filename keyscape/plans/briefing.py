"""Briefing map: detailed, or the overview when asked for."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import ip as ipf
from keyscape.operators import assist, devices, drift, mapview
from keyscape.operators.edges import services
from keyscape.operators.mapview import PRIVATE_WORDS, PUBLIC_WORDS, MapOptions


def build(
    nodes, edges, gateways, zero_coverage, options: MapOptions | None = None, overview: bool = False
) -> dict[str, DataFrame]:
    """Map tables with the services of every node. ``overview`` is the caller's choice at
    any size; focus on a CIDR always keeps full detail."""
    options = options or MapOptions()
    keyword = options.focus in (None, "", *PRIVATE_WORDS, *PUBLIC_WORDS)
    draw = mapview.overview if overview and keyword else mapview.detailed
    model = draw(nodes, edges, gateways, zero_coverage, options)
    served = services(edges).withColumnRenamed("ip", "id")
    model["nodes"] = model["nodes"].join(served, "id", "left").withColumn(
        "services", F.coalesce("services", F.array().cast("array<string>")))
    return model


def drift_flags(old: dict, new: dict) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, node flags, edge flags) of a drift map: vanished hosts and
    edges are appended to the current snapshot."""
    gone = drift.disappeared(old["nodes"], new["nodes"])
    changed = drift.rank_changes(old["nodes"], new["nodes"])
    flags = (
        drift.appeared(old["nodes"], new["nodes"]).select("ip", F.lit("new").alias("flag"))
        .unionByName(gone.select("ip", F.lit("vanished").alias("flag")))
        .unionByName(changed.select("ip", F.when(F.col("delta") > 0, "rank-up").otherwise("rank-down").alias("flag"))))
    gained = drift.new_edges_to_top(old["edges"], new["edges"], new["nodes"])
    lost = drift.vanished_critical_edges(old["edges"], new["edges"], old["nodes"])
    key = ["src", "dst", "port"]
    edge_flags = gained.select(*key, F.lit("new").alias("flag")).unionByName(
        lost.select(*key, F.lit("vanished").alias("flag")))
    nodes = new["nodes"].unionByName(gone, allowMissingColumns=True)
    edges = new["edges"].select(*key, "conn_count").unionByName(lost.select(*key, "conn_count"))
    return nodes, edges, flags, edge_flags


def reconcile_flags(undocumented: DataFrame, contradicted: DataFrame) -> DataFrame:
    """A contradiction wins over a missing entry."""
    rows = undocumented.select("ip", F.lit("undocumented").alias("flag")).unionByName(
        contradicted.select("ip", F.lit("contradicted").alias("flag")))
    return rows.groupBy("ip").agg(F.min("flag").alias("flag"))


def ghosts(silent: DataFrame, groups: DataFrame, prefix: int = config.GROUP_PREFIX) -> DataFrame:
    """Silent assets that have a shown group to stand in."""
    placed = silent.withColumn("id", F.concat(F.lit("g:"), ipf.subnet_of("ip", prefix)))
    # The wording of the notes.
    note = F.when(
        F.col("in_blind_spot"),
        "documented but silent in the observation window — inside a possible sensor blind spot; "
        "verify coverage before calling it decommissioned",
    ).otherwise("documented but silent in the observation window")
    return placed.join(groups.select("id"), "id", "left_semi").select(
        F.concat(F.lit("asset:"), "ip").alias("id"), F.col("id").alias("group"),
        F.when(F.coalesce("hostname", F.lit("")) != "", F.concat("hostname", F.lit("\n"), "ip"))
        .otherwise(F.col("ip")).alias("label"), note.alias("note"))


def segment_labels(assets: DataFrame, prefix: int = config.GROUP_PREFIX) -> DataFrame:
    """Group names from the asset list: the first row that names a segment."""
    rows = assets.filter(F.coalesce("segment", F.lit("")) != "").select(
        ipf.subnet_of("ip", prefix).alias("cidr"), "segment", "row").filter("cidr <> ''")
    return rows.groupBy("cidr").agg(F.min_by("segment", "row").alias("label"))


def reconcile_findings(silent: DataFrame, undocumented: DataFrame, contradicted: DataFrame, shown: DataFrame) -> DataFrame:
    """(pos, finding): a line for each kind of disagreement that there is, with its count and
    how many silent assets are ``shown`` as ghosts."""
    # The wording of the lines.
    kinds = [
        (silent, lambda n, g: F.concat(n, F.lit(" documented assets produced no observed traffic ("), g, F.lit(
            " shown ghosted; cross-check blind spots before calling them decommissioned)"))),
        (undocumented, lambda n, g: F.concat(n, F.lit(" observed hosts are not in the asset list"))),
        (contradicted, lambda n, g: F.concat(n, F.lit(" hosts contradict their documented role"))),
    ]
    ghosted = shown.agg(F.count("*").cast("string").alias("g"))
    out = None
    for pos, (df, line) in enumerate(kinds):
        # one row on either side
        counted = df.agg(F.count("*").alias("n")).select("n", F.lit(1).alias("one")).join(
            ghosted.withColumn("one", F.lit(1)), "one").filter("n > 0")
        rows = counted.select(F.lit(pos).alias("pos"), line(F.col("n").cast("string"), F.col("g")).alias("finding"))
        out = rows if out is None else out.unionByName(rows)
    return out


def reconcile_map(
    nodes: DataFrame, edges: DataFrame, gateways: DataFrame, zero_coverage: DataFrame, assets: DataFrame,
    silent: DataFrame, undocumented: DataFrame, contradicted: DataFrame,
    options: MapOptions | None = None, overview: bool = False,
) -> dict[str, DataFrame]:
    """The map with hosts flagged by the asset list, ``ghosts`` of silent assets in groups
    that are shown, groups named by its segments unless they have a name already, and
    ``reconcile_findings``. An overview has no ghosts, its groups are coarser; the findings
    carry the counts."""
    options = options or MapOptions()
    named = segment_labels(assets, options.prefix)
    if options.labels is not None:
        known = options.labels.filter(F.coalesce("label", F.lit("")) != "").select("cidr", "label")
        named = known.unionByName(named.join(known, "cidr", "left_anti"))
    options = replace(options, node_flags=reconcile_flags(undocumented, contradicted), labels=named)
    model = build(nodes, edges, gateways, zero_coverage, options, overview)
    shown = ghosts(silent, model["groups"], options.prefix)
    model["ghosts"] = shown.limit(0) if overview else shown
    model["reconcile_findings"] = reconcile_findings(silent, undocumented, contradicted, model["ghosts"])
    return model


def finish(
    model: dict[str, DataFrame], tags: DataFrame | None = None, model_name: str = "", facts: DataFrame | None = None
) -> dict[str, DataFrame]:
    """What every view gets at the end: suggested tags (node_id, tags, confidence, rationale)
    of the model that made them, then the operator's facts on the nodes."""
    nodes = model["nodes"]
    if tags is not None:
        nodes = assist.attach_suggestions(nodes, tags, model_name)
    if facts is not None:
        nodes = devices.overlay(nodes, facts)
    return {**model, "nodes": nodes}
