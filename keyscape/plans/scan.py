"""Scan: telemetry of one window to a scored, role-typed snapshot."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.operators import edges as edge_ops
from keyscape.operators import evidence, graph, quality, roles, scoring, temporal
from keyscape.session import materialize
from keyscape.sources import snapshots, telemetry
from keyscape.sources.telemetry import FieldMap


@dataclass
class Telemetry:
    """Canonical inputs of one scan; only ``conn`` is required."""

    conn: DataFrame
    logs: DataFrame | None = None
    leases: DataFrame | None = None
    ssl: DataFrame | None = None
    certs: DataFrame | None = None
    ssh: DataFrame | None = None


@dataclass
class ScanOptions:
    """``scope``: CIDRs, none for all. ``as_of`` and ``window_seconds``: rows no older than
    that before the instant, all if either is missing; ``window`` is the label that is
    stored. ``betweenness``: "pivots" or "exact", at every size. ``temporal_top``:
    profiles of the highest ranks only, None for all, 0 for none."""

    tz: str = "UTC"
    scope: list[str] = field(default_factory=list)
    as_of: str | None = None
    window_seconds: int | None = None
    window: str = "336h0m0s"
    cluster: str = ""
    centrality: bool = True
    betweenness: str = "pivots"
    pivot_count: int = config.BETWEENNESS_PIVOTS
    temporal_top: int | None = None
    created_at: str | None = None
    metadata: bool = True


LOG_KINDS = ("kerberos", "ldap", "dns", "smb", "ssl", "http", "dhcp")


def from_source(df: DataFrame, fields: FieldMap | None = None) -> Telemetry:
    """Telemetry from one table of raw events of all datasets, by its field map."""
    fields = fields or FieldMap()
    rows = telemetry.canonical(df, fields)
    of = lambda kind: telemetry.of_dataset(rows, fields, kind)
    kinds = F.array(*[F.when(F.col("dataset").isin(fields.datasets[k]), k) for k in LOG_KINDS])
    lease = F.col("kind") == "dhcp"
    logs = rows.select("*", F.explode(kinds).alias("kind")).filter(F.col("kind").isNotNull()).select(
        "kind", F.when(lease, F.col("dhcp_server")).otherwise(F.col("dst")).alias("responder"),
        F.when(lease, F.col("dhcp_client")).otherwise(F.col("src")).alias("client"), "ts")
    return Telemetry(
        conn=of("conn"), logs=logs,
        leases=of("dhcp").select("dhcp_server", "assigned_ip", "lease_hostname", "lease_mac", "ts"),
        ssl=of("ssl").select("dst", "server_name", "ts"),
        certs=of("x509").select("message", "san_dns", "subject", "ts"),
        ssh=of("ssh").select("dst", "host_key", "ts"))


def windowed(t: Telemetry, options: ScanOptions) -> Telemetry:
    """Every log that has an instant, within the window."""
    if not options.as_of or not options.window_seconds:
        return t

    def cut(df: DataFrame | None) -> DataFrame | None:
        if df is None or "ts" not in df.columns:
            return df
        return telemetry.in_window(df, options.as_of, options.window_seconds)

    return Telemetry(*[cut(getattr(t, f)) for f in ("conn", "logs", "leases", "ssl", "certs", "ssh")])


def scan_to_store(
    df: DataFrame, root: str, sid: str, options: ScanOptions | None = None,
    fields: FieldMap | None = None,
) -> dict[str, DataFrame]:
    """Raw events to a stored snapshot; the tables as read back."""
    spark = df.sparkSession
    tables = scan(from_source(df, fields), options)
    snapshots.save(tables, root, sid)
    return {name: snapshots.read(spark, root, name, sid) for name in tables}


def identify(nodes: DataFrame, t: Telemetry, addresses: DataFrame | None = None) -> DataFrame:
    """Identity of every node; a missing log leaves its columns empty. ``addresses``:
    ``address_counts`` of the connection log, if they are at hand."""
    spark = nodes.sparkSession
    empty = lambda ddl: spark.createDataFrame([], ddl)
    leases = (
        evidence.dhcp_leases(t.leases) if t.leases is not None
        else empty("ip string, hostname string, mac string"))
    tls = (
        evidence.tls_fingerprints(
            materialize(evidence.tls_names(t.ssl, nodes), "tls-names"), evidence.certificates(t.certs))
        if t.ssl is not None and t.certs is not None
        else empty("ip string, tls_fingerprints array<string>"))
    ssh = (
        evidence.ssh_host_keys(t.ssh) if t.ssh is not None
        else empty("ip string, ssh_host_keys array<string>"))
    if addresses is None:
        addresses = evidence.address_counts(t.conn)
    macs = evidence.macs_of(addresses.groupBy("dst", "dst_mac").agg(F.sum("n").alias("n")))
    return evidence.enrich_nodes(nodes, macs, leases, tls, ssh)


def scan(t: Telemetry, options: ScanOptions | None = None) -> dict[str, DataFrame]:
    """``nodes``, ``edges``, ``gateways`` and ``meta`` of one snapshot.

    Everything is within the window. Edges and responders are within the scope, too;
    hardware addresses, leases, host keys and activity profiles are not cut by it. The
    connection log is reduced once to edges, which are written; everything about the
    graph reads that table. No edge left is an error.
    """
    options = options or ScanOptions()
    t = windowed(t, options)
    conn = telemetry.in_scope(t.conn, options.scope)
    logs = t.logs
    if logs is not None:
        logs = telemetry.in_scope(logs, options.scope, "client", "responder")
    edges, nodes = edge_ops.stored_edges(conn)
    quality.require_groups(conn, edges)
    if edges.isEmpty():
        raise quality.EmptyScan("no edges within the window and scope")
    nodes = materialize(nodes, "nodes")
    measures = materialize(edge_ops.host_measures(edges), "measures")
    pagerank = between = None
    if options.centrality:
        wedges = materialize(graph.weighted_edges(edges), "wedges")
        pagerank = graph.pagerank(nodes, wedges)
        between = graph.betweenness(nodes, wedges, options.betweenness, options.pivot_count)
    scored = scoring.rank(scoring.composite(scoring.components(nodes, edges, pagerank, between, measures)))
    scored = scoring.score_drivers(scored)
    top = None
    if options.temporal_top is not None:
        top = scoring.top_ranked(scored, options.temporal_top).select("ip")
    if options.temporal_top == 0:
        profiles = temporal.profiles(t.conn.limit(0), options.tz)
    else:
        profiles = materialize(temporal.profiles(t.conn, options.tz, only=top), "profiles")
    edges = temporal.attach(edges, profiles)
    if logs is not None:
        cardinality = evidence.responder_clients(logs)
    else:
        cardinality = edges.sparkSession.createDataFrame([], "kind string, responder string, clients bigint")
    held = roles.infer(roles.facts(nodes.select("ip"), edges, cardinality, measures))
    addresses = materialize(evidence.address_counts(t.conn), "addresses")
    full = identify(scored, t, addresses).join(held, "ip", "left")
    gateways = materialize(evidence.gateway_candidates(addresses), "gateways")
    tables = {
        "nodes": full.drop(*[c for c in full.columns if c.startswith("part_")]),
        "edges": edges,
        "gateways": gateways,
    }
    if options.metadata:
        tables["meta"] = metadata(edges, nodes, options)
    return tables


def metadata(edges: DataFrame, nodes: DataFrame, options: ScanOptions) -> DataFrame:
    """One metadata row. Sensor names and scope CIDRs are short lists."""
    spark = nodes.sparkSession
    scope = spark.createDataFrame([(c,) for c in options.scope], "cidr string")
    lengths = sorted({ipaddress.ip_network(c, strict=False).prefixlen for c in options.scope})
    gaps = quality.zero_coverage(scope, nodes, lengths).agg(
        F.array_sort(F.collect_list("cidr")).alias("zero_coverage_cidrs"))
    sensors = edges.select(F.explode("sensors").alias("sensor")).agg(
        F.array_sort(F.collect_set("sensor")).alias("sensors"))
    one = F.lit(1).alias("one")
    created = (
        F.lit(options.created_at).cast("timestamp") if options.created_at else F.current_timestamp())
    listed = F.array(*[F.lit(c) for c in options.scope]).cast("array<string>")
    return sensors.select("*", one).join(gaps.select("*", one), "one").select(
        created.alias("created_at"), F.lit(options.window).alias("window"), listed.alias("scope"),
        F.lit(options.cluster).alias("cluster_name"), "sensors", "zero_coverage_cidrs",
        F.lit(options.centrality and options.betweenness == "pivots").alias("betweenness_sampled"), F.lit("keyscape").alias("tool"))
