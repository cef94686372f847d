"""Checked queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import ip as ipf
from keyscape.functions import ports, text
from keyscape.functions.columns import joined
from keyscape.operators import (
    assist, authority, declared, devices, drift, edges as E, evidence, graph, leads, mapview,
    quality, ranges, reconcile, roles, scoring, stability, temporal,
)
from keyscape.operators.mapview import MapOptions
from keyscape.plans import briefing, hunt, policy
from keyscape.plans.scan import ScanOptions, scan_to_store
from keyscape.session import durable_dir, materialize
from keyscape.sources import assets as asset_source
from keyscape.sources import configs, snapshots, telemetry
from keyscape.streaming import partials
from keyscape.testbed import inputs as I
from keyscape.testbed import projection as P

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def r6(c):
    return F.round(c, 6)


# --- edges, evidence, coverage --------------------------------------------

@query
def top_servers(spark, sf):
    """Responders by confirmed dependents: the flagship question."""
    e = I.edges(spark, sf)
    n = E.critical_in_degree(e).join(E.subnet_spread(e), "ip")
    return n.filter(ipf.terrain_addr("ip")).select("ip", "dependents", "spread")


@query
def edges(spark, sf):
    return I.edges(spark, sf).select(
        "src", "dst", "port", "proto", "service", "evidence", "conn_count", "bytes_out", "bytes_in",
        stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"),
        F.array_join("sensors", ",").alias("sensors"))


def _streamed(spark, sf, kind="flow"):
    """The log (or its protocol logs) as files, streamed into partials in several batches."""
    root = f"{durable_dir(spark)}/partials-{uuid.uuid4().hex}"
    log = I.conn(spark, sf)
    rows = log.select("ts", "src", "dst", "port", "proto", "service", "state", "bytes_out", "bytes_in", "sensor", "dst_mac", "dataset",
                      F.when(F.col("proto").isNotNull(), F.col("dst_mac")).alias("src_mac")) if kind == "flow" else P.protocol_logs(log)
    rows.repartition(6).write.parquet(f"{root}/log")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/log")
    partials.append(stream, kind, root).awaitTermination()
    return partials.read(spark, root, kind), spark.read.schema(rows.schema).parquet(f"{root}/log")


@query
def streamed_edges(spark, sf):
    """Edges of the whole log, merged from the partials of a stream."""
    return partials.edges(_streamed(spark, sf)[0]).select(
        "src", "dst", "port", "proto", "service", "evidence", "conn_count", "bytes_out", "bytes_in",
        stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"),
        F.array_join("sensors", ",").alias("sensors"))


@query
def streamed_identity(spark, sf):
    """Hardware addresses, gateways, sensors, datasets and coverage from the same partials."""
    flow = materialize(_streamed(spark, sf)[0], "flow")
    macs, gateways = partials.identity(flow)
    return macs.select(F.lit("mac").alias("what"), F.col("ip").alias("key"), F.col("mac").alias("value"), F.lit(0).cast("bigint").alias("n")).unionByName(
        gateways.select(F.lit("gateway").alias("what"), F.col("sensor").alias("key"), F.col("mac").alias("value"), F.col("ip_count").alias("n"))).unionByName(
        partials.discovery(flow).select("what", F.lit("").alias("key"), "value", "n"))


@query
def streamed_profiles(spark, sf):
    """Activity by hour and weekday, from the partials."""
    out = partials.profiles(_streamed(spark, sf)[0])
    return out.select("ip", F.array_join("hours", ",").alias("hours"), F.array_join("dow", ",").alias("dow"))


@query
def window_edges(spark, sf):
    """Edges of a window that starts and ends within an hour."""
    flow, log = _streamed(spark, sf)
    return partials.edges(partials.window(flow, log, "flow", "1996-03-05 09:30:00", "1997-06-10 14:00:01")).select(
        "src", "dst", "port", "proto", "evidence", "conn_count", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"))


@query
def window_clients(spark, sf):
    """Distinct clients of every responder in each of five windows of 14 days, and how often
    and when its pairs were seen."""
    pairs, log = _streamed(spark, sf, "pairs")
    pairs = materialize(pairs, "pairs")
    out = None
    for day in ("1993-02-01", "1994-05-10", "1995-11-20", "1996-08-15", "1998-03-01"):
        start = F.lit(day).cast("timestamp")
        seen = partials.window(pairs, log, "pairs", start, start + F.expr("INTERVAL 14 DAYS"))
        counts = partials.cardinality(seen, 1).join(partials.seen_between(seen).groupBy("kind", "responder").agg(
            F.sum("n").alias("n"), stamp(F.max("last_seen")).alias("last_seen")), ["kind", "responder"])
        rows = counts.select(F.lit(day).alias("day"), "kind", "responder", "clients", F.array_join("sample_hosts", ",").alias("most_seen"), "n", "last_seen")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def edge_cap(spark, sf):
    kept, flag = E.cap_edges(I.edges(spark, sf), 1000)
    return kept.select("src", "dst", "port", "proto", "conn_count")


@query
def evidence_mix(spark, sf):
    return quality.evidence_mix(I.edges(spark, sf))


@query
def dataset_counts(spark, sf):
    log = I.conn(spark, sf)
    rows = log.select("dataset").unionByName(P.protocol_logs(log).select(F.col("kind").alias("dataset")))
    return quality.dataset_counts(rows)


@query
def dataset_resolution(spark, sf):
    log = I.conn(spark, sf)
    rows = log.select("dataset").unionByName(P.protocol_logs(log).select(
        F.concat(F.lit("zeek."), "kind").alias("dataset")))
    out = quality.dataset_resolution(quality.dataset_counts(rows), telemetry.FieldMap())
    return out.select("kind", F.array_join("found", ",").alias("found"), "n", "blind")


@query
def sensor_counts(spark, sf):
    return quality.sensor_counts(I.conn(spark, sf))


@query
def mac_coverage(spark, sf):
    log = I.conn(spark, sf).withColumn("src_mac", F.when(F.col("proto").isNotNull(), F.col("dst_mac")))
    return quality.mac_coverage(log)


@query
def field_presence(spark, sf):
    log = I.conn(spark, sf).select(F.col("src").alias("source.ip"), F.struct(F.struct(
        F.col("proto").alias("transport")).alias("inner")).alias("network"))
    fields = telemetry.FieldMap().override({"proto": "network.inner.transport"})
    return quality.field_presence(log, fields, ["src", "proto", "service"])


@query
def zero_coverage(spark, sf):
    return quality.zero_coverage(I.scope(spark), E.endpoints(I.edges(spark, sf)))


@query
def field_map_scan(spark, sf):
    """Physical names (one nested, one flat with dots) onto concepts."""
    raw = I.conn(spark, sf).select(
        F.col("ts").alias("@timestamp"), F.struct(F.col("dataset")).alias("event"),
        F.col("src").alias("source.ip"), F.struct(F.col("dst").alias("ip"), F.col("port")).alias("destination"))
    log = telemetry.canonical(raw, telemetry.FieldMap(), ["ts", "dataset", "src", "dst", "port", "proto"])
    log = telemetry.of_dataset(log, telemetry.FieldMap(), "conn")
    return log.groupBy("dst", "port").agg(F.count("*").alias("n"), F.count("proto").alias("with_proto"))


@query
def window_filter(spark, sf):
    log = telemetry.in_window(I.conn(spark, sf), "1999-01-01 00:00:00", 365 * 24 * 3600)
    return log.groupBy("snapshot").agg(F.count("*").alias("n"), stamp(F.min("ts")).alias("first"))


@query
def scope_filter(spark, sf):
    log = telemetry.in_scope(I.conn(spark, sf), ["10.1.0.0/16", "10.0.1.0/25", "8.8.8.8/32"])
    return log.groupBy("src").agg(F.count("*").alias("n"))


@query
def focus_private(spark, sf):
    e = I.stored_edges(spark, sf)
    n = mapview.focus_nodes(E.endpoints(e), "private")
    return mapview.focus_edges(e, n).groupBy("dst").agg(F.count("*").alias("n"))


@query
def focus_cidr(spark, sf):
    e = I.stored_edges(spark, sf)
    n = mapview.focus_nodes(E.endpoints(e), "10.0.0.0/22")
    return mapview.focus_edges(e, n).groupBy("src", "dst").agg(F.sum("conn_count").alias("conns"))


# --- scalar functions ------------------------------------------------------

@query
def ip_functions(spark, sf):
    hosts = I.conn(spark, sf).select(F.explode(F.array("src", "dst")).alias("ip")).distinct()
    return hosts.select(
        "ip", ipf.ip_key("ip").alias("ip_key"), ipf.subnet("ip").alias("subnet"),
        ipf.terrain_addr("ip").alias("terrain"), ipf.is_private("ip").alias("private"),
        ipf.subnet_of("ip", 20).alias("wide"), ipf.subnet_of("ip", 26).alias("fine"))


@query
def ipv6_functions(spark, sf):
    """IPv6 texts made from every customer key, in shortened forms."""
    c = F.col("c_custkey")
    h = F.lower(F.hex(c % 65536))
    addr = F.when(c % 3 == 0, F.concat(F.lit("2001:db8::"), h)).when(
        c % 3 == 1, F.concat(F.lit("fd00:"), h, F.lit(":0:0:1::5"))).otherwise(F.concat(F.lit("fe80::1:"), h))
    rows = P.table(spark, sf, "customer").select("c_custkey", addr.alias("ip"))
    return rows.select("c_custkey", ipf.ip_key("ip").alias("ip_key"), ipf.terrain_addr("ip").alias("terrain"),
                       ipf.is_private("ip").alias("private"))


@query
def cidr_functions(spark, sf):
    """Ranges of CIDRs of every length made from supplier addresses."""
    s = F.col("s_suppkey")
    cidr = F.concat(P.server_ip(s), F.lit("/"), (s % 33).cast("string"))
    rows = P.table(spark, sf, "supplier").select("s_suppkey", ipf.cidr_range(cidr).alias("r"), cidr.alias("cidr"))
    return rows.select("s_suppkey", "r.lo", "r.hi", "r.bits",
                       ipf.contains("cidr", F.lit("10.0.0.17")).alias("holds"))


@query
def port_functions(spark, sf):
    rows = I.conn(spark, sf).select("port").distinct()
    cls = ports.service_class("port")
    return rows.select(
        "port", cls.alias("cls"), ports.class_label(cls).alias("label"), ports.class_color(cls).alias("color"),
        ports.service_name("port").alias("service"), ports.known_service("port").alias("known"),
        ports.is_critical("port").alias("critical"), ports.is_auth_edge("port").alias("auth"),
        ports.is_admin("port").alias("admin"), ports.is_sensitive("port").alias("sensitive"),
        ports.is_gear("port").alias("gear"), ports.is_mail("port").alias("mail"))


@query
def mac_vendor(spark, sf):
    rows = I.conn(spark, sf).select("dst_mac").distinct()
    return rows.select("dst_mac", text.vendor_for_mac("dst_mac").alias("vendor"),
                       text.vendor_for_mac(F.upper(F.regexp_replace("dst_mac", ":", "-"))).alias("dashed"))


@query
def role_text(spark, sf):
    p = P.table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", F.element_at(F.array(*[F.lit(x) for x in (
            "datacenter", "Backup-DC", "Active Directory", "ns dns1", "DNS/DHCP", "file share", "mysql01", "Oracle",
            "bastion", "web+nginx", "printer")]), (F.col("p_partkey") % 11 + 1).cast("int"))).alias("t"))
    return p.select("p_partkey", text.normalize_role("t").alias("role"))


@query
def string_functions(spark, sf):
    s = F.col("s_suppkey")
    t = s.cast("string")
    rows = P.table(spark, sf, "supplier").select(
        "s_suppkey", P.server_ip(s).alias("ip"), (s % 3000).cast("int").alias("port"),
        F.concat(F.lit("O=X, CN= Web"), t, F.lit(" , C=Y")).alias("subject"),
        F.array(F.concat(F.lit(" B"), t), F.lit("a"), F.lit("")).alias("sans"),
        F.concat(t, F.lit("-"), (s * 7 % 500).cast("string")).alias("span"), F.col("s_name"))
    rng = text.port_range("span")
    return rows.select(
        "s_suppkey", text.subject_cn("subject").alias("cn"),
        F.array_join(text.certificate_names("sans", "subject"), ",").alias("names"),
        text.glob_match(F.lit("supplier#*5"), F.lower("s_name")).alias("globbed"),
        rng["lo"].alias("lo"), rng["hi"].alias("hi"), text.controller_address("ip").alias("addr"),
        text.provider_key("ip", "port").alias("provider"), text.edge_id("ip", F.lit("x"), "port").alias("edge"),
        text.x509_fingerprint(F.concat(F.lit('{"fingerprint":"f'), t, F.lit('"}'))).alias("fp"),
        stamp(text.epoch_millis((s - 50) * 1000000)).alias("at"),
        text.tier_of(F.when(s % 2 == 0, "Unknown").otherwise("Database"), (s % 10) / 10).alias("tier"),
        r6(text.role_confidence(s % 30, 3)).alias("confidence"),
        text.rule_evidence("s_name", F.lit("dir/a.cfg"), s, F.lit("deny ip any any"),
                           F.when(s % 2 == 0, "partial").otherwise("full")).alias("rule"))


@query
def mask_functions(spark, sf):
    """Netmasks and wildcards of every length, some made non-contiguous."""
    s = F.col("s_suppkey")
    mask = ipf.key_to_text(ipf.range_hi(ipf.ip_key(F.lit("0.0.0.0")), (s % 33).cast("int")))
    odd = F.when(s % 7 == 3, "255.0.255.0").otherwise(mask)
    return P.table(spark, sf, "supplier").select(
        "s_suppkey", ipf.wildcard_to_bits(odd).alias("wild"), ipf.mask_to_bits(odd).alias("mask"))


# --- protocol evidence and identity ---------------------------------------

@query
def responder_cardinality(spark, sf):
    out = evidence.responder_cardinality(P.protocol_logs(I.conn(spark, sf)))
    return out.select("kind", "responder", "clients", F.array_join("sample_hosts", ",").alias("sample_hosts"))


@query
def top_clients(spark, sf):
    return evidence.top_values(I.conn(spark, sf), ["dst"], "src", 3).select("dst", "src", "n", "pos")


@query
def gateway_candidates(spark, sf):
    return evidence.gateway_candidates(I.conn(spark, sf))


@query
def node_mac(spark, sf):
    return evidence.node_macs(I.conn(spark, sf))


@query
def dhcp_leases(spark, sf):
    return evidence.dhcp_leases(P.leases(I.conn(spark, sf)))


@query
def tls_names(spark, sf):
    log = I.conn(spark, sf)
    known = E.endpoints(I.edges(spark, sf)).filter(ipf.is_private("ip"))
    return evidence.tls_names(P.server_names(log), known)


@query
def certificates(spark, sf):
    out = evidence.certificates(P.certificates(spark, sf))
    return out.select("fingerprint", "subject", F.array_join("names", ",").alias("names"))


@query
def tls_match(spark, sf):
    names = evidence.tls_names(P.server_names(I.conn(spark, sf)))
    out = evidence.tls_fingerprints(names, evidence.certificates(P.certificates(spark, sf)))
    return out.select("ip", F.array_join("tls_fingerprints", ",").alias("fingerprints"))


@query
def ssh_keys(spark, sf):
    return evidence.ssh_host_keys(P.host_keys(I.conn(spark, sf))).select(
        "ip", F.array_join("ssh_host_keys", ",").alias("keys"))


@query
def node_identity(spark, sf):
    n = I.snapshot(spark, sf)["nodes"]
    return n.select("ip", "mac", joined(F.col("hostnames")).alias("hostnames"),
                    F.size("tls_fingerprints").alias("certs"), F.size("ssh_host_keys").alias("keys"))


# --- nodes and graph shape -------------------------------------------------

@query
def nodes(spark, sf):
    return E.endpoints(I.edges(spark, sf)).select(
        "ip", "subnet", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"),
        F.array_join("sensors", ",").alias("sensors"))


@query
def client_counts(spark, sf):
    return E.client_counts(I.edges(spark, sf))


@query
def admin_shape(spark, sf):
    return E.admin_shape(I.edges(spark, sf))


@query
def critical_in_degree(spark, sf):
    return E.critical_in_degree(I.edges(spark, sf))


@query
def subnet_spread(spark, sf):
    return E.subnet_spread(I.edges(spark, sf))


@query
def services(spark, sf):
    return E.services(I.edges(spark, sf)).select("ip", F.array_join("services", ",").alias("services"))


@query
def temporal_hist(spark, sf):
    return temporal.histograms(I.conn(spark, sf), "UTC").select(
        "ip", F.array_join("hours", ",").alias("hours"), F.array_join("dow", ",").alias("dow"))


@query
def temporal_class(spark, sf):
    return temporal.profiles(I.conn(spark, sf), "UTC").select("ip", F.col("class").alias("shape"))


@query
def temporal_edges(spark, sf):
    """Profiles of the 50 busiest responders on their inbound edges."""
    log, e = I.conn(spark, sf), I.stored_edges(spark, sf)
    top = e.groupBy(F.col("dst").alias("ip")).agg(F.sum("conn_count").alias("n")).orderBy(
        F.desc("n"), "ip").limit(50).select("ip")
    out = temporal.attach(e, temporal.profiles(log, "UTC", only=top))
    return out.filter("temporal IS NOT NULL").groupBy("dst", F.col("temporal.class").alias("shape")).agg(
        F.count("*").alias("n"))


@query
def weighted_edges(spark, sf):
    return graph.weighted_edges(I.edges(spark, sf)).select("src", "dst", r6("weight").alias("weight"))


@query
def pagerank_fixed(spark, sf):
    e = I.stored_edges(spark, sf)
    out = graph.pagerank(E.endpoints(e), graph.weighted_edges(e), rounds=10)
    return out.select("ip", F.round("pagerank", 9).alias("pagerank"))


@query
def pagerank(spark, sf):
    e = I.stored_edges(spark, sf)
    return graph.pagerank(E.endpoints(e), graph.weighted_edges(e)).select(
        "ip", F.round("pagerank", 6).alias("pagerank"))


@query
def betweenness(spark, sf):
    e = I.stored_edges(spark, sf)
    out = graph.betweenness(E.endpoints(e), graph.weighted_edges(e), "exact")
    return out.select("ip", r6("betweenness").alias("betweenness"))


@query
def betweenness_pivots(spark, sf):
    e = I.stored_edges(spark, sf)
    out = graph.betweenness(E.endpoints(e), graph.weighted_edges(e), "pivots", 64)
    return out.select("ip", r6("betweenness").alias("betweenness"))


@query
def mission(spark, sf):
    e = I.stored_edges(spark, sf)
    scope = P.table(spark, sf, "supplier").filter("s_acctbal > 9500").select(P.server_ip(F.col("s_suppkey")).alias("ip"))
    out = graph.mission_proximity(E.endpoints(e), e, scope)
    return out.select("ip", "in_scope", "depth", r6("mission_score").alias("mission_score"))


# --- scores and roles ------------------------------------------------------

def _scored(spark, sf):
    """Scores with a fixed-round PageRank, which plain SQL can repeat."""
    e = I.stored_edges(spark, sf)
    n = E.endpoints(e)
    pr = graph.pagerank(n, graph.weighted_edges(e), rounds=10)
    return scoring.rank(scoring.composite(scoring.components(n, e, pr)))


@query
def terrain_scores(spark, sf):
    return _scored(spark, sf).select("ip", "dependents", "spread", "terrain", r6("composite").alias("composite"))


@query
def rank(spark, sf):
    return I.snapshot(spark, sf)["nodes"].select("ip", "rank", r6("composite").alias("composite"))


@query
def score_drivers(spark, sf):
    out = scoring.score_drivers(_scored(spark, sf))
    return out.filter(F.size("terrain_evidence") > 0).select(
        "ip", "rank", F.size("terrain_evidence").alias("n"), F.element_at("terrain_evidence", 1).alias("first"))


@query
def top_ranked(spark, sf):
    return scoring.top_ranked(I.snapshot(spark, sf)["nodes"], 10).select("ip", "rank")


@query
def role_assertions(spark, sf):
    e = I.stored_edges(spark, sf)
    card = evidence.responder_cardinality(P.protocol_logs(I.conn(spark, sf)))
    out = roles.infer(roles.facts(E.endpoints(e).select("ip"), e, card))
    return out.select("ip", F.inline("roles")).select(
        "ip", "role", r6("confidence").alias("confidence"), F.array_join("evidence", ";").alias("evidence"))


@query
def top_role(spark, sf):
    n = I.snapshot(spark, sf)["nodes"]
    return n.select("ip", roles.top_role().alias("role"), F.array_join(roles.role_names(), ",").alias("roles"),
                    text.tier_of(roles.top_role(), "composite").alias("tier"))


@query
def snapshot_scan(spark, sf):
    """The whole scan with both centralities."""
    n = I.snapshot(spark, sf, centrality=True, temporal_top=None)["nodes"]
    return n.select("ip", "rank", "dependents", r6("pagerank").alias("pagerank"), r6("betweenness").alias("betweenness"),
                    r6("composite").alias("composite"), roles.top_role().alias("role"))


@query
def snapshot_meta(spark, sf):
    m = I.snapshot(spark, sf, metadata=True, scope=P.SCOPE)["meta"]
    return m.select(stamp("created_at").alias("created_at"), "window", F.array_join("scope", ",").alias("scope"),
                    F.array_join("sensors", ",").alias("sensors"), "cluster_name",
                    F.array_join("zero_coverage_cidrs", ",").alias("zero_coverage"))


@query
def snapshot_catalogue(spark, sf):
    """Three snapshots of the log, saved and listed."""
    root = f"{durable_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    for k in (1, 2, 3):
        snapshots.save(I.snapshot(spark, sf, k, metadata=True), root, f"000{k}")
    return snapshots.catalogue(spark, root).select(
        "snapshot_id", stamp("created_at").alias("created_at"), "window", "nodes", "edges")


@query
def snapshot_store(spark, sf):
    """Hosts of all snapshots as read back: the second one's first attempt was never
    published, and was repeated; a fourth one is staged only. No snapshot has gateways."""
    root = f"{durable_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    for k in (1, 2, 3):
        s = I.snapshot(spark, sf, k, metadata=True)
        s["gateways"] = s["gateways"].limit(0)
        if k == 2:
            snapshots.stage(s, root, "0002")
        snapshots.save(s, root, f"000{k}")
    snapshots.stage(s, root, "0004")
    empty = snapshots.read(spark, root, "gateways").groupBy("snapshot_id").count()
    nodes = snapshots.read(spark, root, "nodes")
    return nodes.join(empty.withColumnRenamed("count", "gateways"), "snapshot_id", "left").select(
        "snapshot_id", "ip", "rank", r6("composite").alias("composite"), F.coalesce("gateways", F.lit(0)).alias("gateways"))


@query
def stored_scan(spark, sf):
    """Raw events by their physical names to a stored snapshot of a window and a scope."""
    raw = I.conn(spark, sf).select(
        F.col("ts").alias("@timestamp"), F.struct("dataset").alias("event"), F.struct(F.col("sensor").alias("name")).alias("observer"),
        F.struct(F.col("src").alias("ip"), F.col("bytes_out").alias("bytes")).alias("source"),
        F.struct(F.col("dst").alias("ip"), "port", F.col("bytes_in").alias("bytes"), F.col("dst_mac").alias("mac")).alias("destination"),
        F.struct(F.col("proto").alias("transport"), F.col("service").alias("protocol")).alias("network"),
        F.col("state").alias("connection.state"))
    options = ScanOptions(scope=["10.1.0.0/16", "10.0.3.0/24"], as_of="2000-01-01 00:00:00", window_seconds=1000 * 86400,
                          centrality=False, temporal_top=0, created_at="2009-01-01 00:00:00")
    tables = scan_to_store(raw, f"{durable_dir(spark)}/snapshots-{uuid.uuid4().hex}", "0012", options)
    return tables["nodes"].select("snapshot_id", "ip", "rank", r6("composite").alias("composite"), "mac")


# --- drift -----------------------------------------------------------------

def _pair(spark, sf, **options):
    return I.snapshot(spark, sf, 1, **options), I.snapshot(spark, sf, 2, **options)


@query
def drift_nodes(spark, sf):
    a = E.endpoints(I.edges(spark, sf, 1))
    b = E.endpoints(I.edges(spark, sf, 2))
    return drift.appeared(a, b).select("ip", F.lit("appeared").alias("change")).unionByName(
        drift.disappeared(a, b).select("ip", F.lit("disappeared").alias("change")))


@query
def drift_ranks(spark, sf):
    a, b = _pair(spark, sf)
    return drift.rank_changes(a["nodes"], b["nodes"])


@query
def drift_roles(spark, sf):
    a, b = _pair(spark, sf)
    return drift.role_changes(a["nodes"], b["nodes"]).select(
        "ip", F.array_join("from_roles", ",").alias("from_roles"), F.array_join("to_roles", ",").alias("to_roles"))


@query
def drift_identity(spark, sf):
    a, b = _pair(spark, sf)
    return drift.identity_changes(a["nodes"], b["nodes"]).select(
        "ip", "protocol", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query
def drift_edges(spark, sf):
    a, b = _pair(spark, sf)
    gained = drift.new_edges_to_top(a["edges"], b["edges"], b["nodes"])
    lost = drift.vanished_critical_edges(a["edges"], b["edges"], a["nodes"])
    return gained.withColumn("change", F.lit("new")).unionByName(lost.withColumn("change", F.lit("vanished"))).select(
        "change", "src", "dst", "port")


@query
def new_providers(spark, sf):
    a, b = _pair(spark, sf)
    return drift.new_providers(a["edges"], b["edges"], a["nodes"], b["nodes"])


@query
def displacement(spark, sf):
    a, b = _pair(spark, sf)
    out = drift.displacement(a["edges"], b["edges"], b["nodes"])
    source = F.transform("migrated_from", lambda m: F.concat_ws(
        ":", m["ip"], m["port"].cast("string"), m["clients"].cast("string")))
    return out.select("ip", "port", "service", "clients_added", F.array_join(source, ",").alias("migrated_from"), "rank")


@query
def drift_order(spark, sf):
    """The place of every provider, displacement, edge and rank change in its list."""
    a, b = _pair(spark, sf)
    an, bn, ae, be = a["nodes"], b["nodes"], a["edges"], b["edges"]
    signals = {
        "providers": drift.new_providers(ae, be, an, bn), "displacement": drift.displacement(ae, be, bn),
        "ranks": drift.rank_changes(an, bn), "gained": drift.new_edges_to_top(ae, be, bn)}
    out = None
    for signal, df in signals.items():
        rows = drift.in_order(signal, df)
        ip = F.col("ip") if "ip" in rows.columns else F.col("dst")
        port = F.col("port").cast("int") if "port" in rows.columns else F.lit(0)
        src = F.col("src") if "src" in rows.columns else F.lit("")
        part = rows.select(F.lit(signal).alias("signal"), F.col("pos").cast("bigint").alias("pos"), ip.alias("ip"), src.alias("src"), port.alias("port"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def compat_warnings(spark, sf):
    a, b = _pair(spark, sf, metadata=True)
    return drift.compatibility_warnings(a["meta"], b["meta"])


@query
def drift_findings(spark, sf):
    a, b = _pair(spark, sf, metadata=True)
    an, bn, ae, be = a["nodes"], b["nodes"], a["edges"], b["edges"]
    return drift.findings(
        drift.compatibility_warnings(a["meta"], b["meta"]), a["meta"], drift.appeared(an, bn), drift.disappeared(an, bn),
        drift.rank_changes(an, bn), drift.new_edges_to_top(ae, be, bn), drift.vanished_critical_edges(ae, be, an),
        drift.identity_changes(an, bn), drift.new_providers(ae, be, an, bn), drift.displacement(ae, be, bn))


@query
def node_stability(spark, sf):
    parts, meta = None, []
    for k in (1, 2, 3):
        s = I.snapshot(spark, sf, k, metadata=True)
        rows = s["nodes"].select(F.lit(str(k)).alias("snapshot_id"), "ip", "rank", roles.top_role().alias("role"))
        parts = rows if parts is None else parts.unionByName(rows)
        meta.append(s["meta"].select(F.lit(str(k)).alias("snapshot_id"), "created_at"))
    out = stability.stability(parts, meta[0].unionByName(meta[1]).unionByName(meta[2]))
    return out.select("ip", "occurrences", "top_n_occurrences", r6("best_percentile").alias("best"),
                      r6("worst_percentile").alias("worst"), r6("median_percentile").alias("median_pct"),
                      "role_consistent", "classification")


# --- authority and leads ---------------------------------------------------

@query
def service_authority(spark, sf):
    s = I.snapshot(spark, sf)
    return authority.service_authority(s["edges"], s["nodes"]).select(
        "ip", "role", "service", "port", "evidence", "clients", stamp("first_seen").alias("first_seen"),
        stamp("last_seen").alias("last_seen"), "rank")


@query
def provider_enrichment(spark, sf):
    e = I.stored_edges(spark, sf)
    out = authority.provider_enrichment(e, E.endpoints(e))
    return out.select("ip", "port", F.array_join("sample_clients", ",").alias("sample_clients"),
                      F.array_join("subnets", ",").alias("subnets"), F.array_join("sensors", ",").alias("sensors"))


@query
def provider_classes(spark, sf):
    """Clients with one set of providers of a service, and what is in the set."""
    members, providers = authority.provider_classes(I.stored_edges(spark, sf))
    sizes = providers.groupBy("service", "cls").agg(
        F.count("*").alias("providers"), F.min("clients").alias("least"), F.max("clients").alias("most"))
    return members.join(sizes, ["service", "cls"])


@query
def alternate_providers(spark, sf):
    out = authority.alternate_providers(I.stored_edges(spark, sf))
    return out.select("ip", "port", F.array_join("alternate_providers", ",").alias("alternates"))


@query
def sole_providers(spark, sf):
    """Sole providers among the edges of one sensor."""
    s = I.stored_edges(spark, sf)
    rows = s.filter(F.array_contains("sensors", "sensor-0"))
    n = E.endpoints(rows).select("ip", F.array().cast("array<string>").alias("hostnames"), F.array(F.struct(
        F.lit("Unknown").alias("role"))).alias("roles"), F.lit(0).alias("rank"))
    return authority.sole_providers(authority.service_authority(rows, n))


@query
def hunt_leads(spark, sf):
    a, b = _pair(spark, sf)
    docs = I.assets(spark, sf)
    tables = I.declared(spark, sf, I.POLICY)
    found = policy.policy(tables, b["edges"])["violations"]
    approved = P.table(spark, sf, "supplier").filter("s_acctbal > 9000").select(
        text.provider_key(P.server_ip(F.col("s_suppkey")), F.lit(88)).alias("provider"))
    out = hunt.hunt(
        b["nodes"], b["edges"], drift.new_providers(a["edges"], b["edges"], a["nodes"], b["nodes"]),
        reconcile.undocumented(docs, b["nodes"]), reconcile.contradicted(docs, b["nodes"]), found, approved)
    return leads.ordered(out).select(
        "priority", "reason", "ip", "service", "port", "evidence", "clients", F.size("subnets").alias("subnets"), "rank",
        "inventory_status", "query", "rule_evidence", F.array_join("sample_clients", ",").alias("sample_clients"),
        F.size("alternate_providers").alias("alternates"))


# --- reconciliation --------------------------------------------------------

@query
def asset_rows(spark, sf):
    """Asset cells with a header row, a bad row and repeats, parsed."""
    docs = P.table(spark, sf, "supplier")
    s = F.col("s_suppkey")
    ip = F.when(s % 20 == 7, F.lit("n/a")).when(s % 20 == 8, P.server_ip(s - 1 - s % 2)).otherwise(P.server_ip(s))
    rows = docs.select((s + 2).alias("row"), F.lit("aa:bb").alias("c0"), ip.alias("c1"), F.col("s_name").alias("c2"),
                       F.concat(F.lit("v"), (s % 4).cast("string")).alias("c3"), F.lit("DNS").alias("c4"))
    head = docs.filter("s_suppkey = 0").select(
        F.lit(1).cast("bigint").alias("row"), F.lit("MAC Address").alias("c0"), F.lit("﻿IP").alias("c1"),
        F.lit("Asset Name").alias("c2"), F.lit("VLAN Name").alias("c3"), F.lit("Description").alias("c4"))
    good, bad = asset_source.parse(materialize(head.unionByName(rows), "cells"))
    return good.select("row", "ip", "hostname", "role", "segment", F.lit("").alias("warning")).unionByName(
        bad.select("row", F.lit("").alias("ip"), F.lit("").alias("hostname"), F.lit("").alias("role"),
                   F.lit("").alias("segment"), "warning"))


@query
def reconcile_silent(spark, sf):
    n = E.endpoints(I.stored_edges(spark, sf))
    gaps = quality.zero_coverage(I.scope(spark), n)
    return reconcile.silent(I.assets(spark, sf), n, gaps).select("ip", "hostname", "role", "in_blind_spot")


@query
def reconcile_undocumented(spark, sf):
    return reconcile.undocumented(I.assets(spark, sf), E.endpoints(I.edges(spark, sf))).select("ip", "subnet")


@query
def reconcile_contradicted(spark, sf):
    n = I.snapshot(spark, sf)["nodes"]
    both = reconcile.contradicted(I.assets(spark, sf), n, True).join(
        reconcile.contradicted(I.assets(spark, sf), n).select("ip", F.lit(True).alias("strict")), "ip", "left")
    return both.select("ip", "documented", "expected", F.array_join("observed", ",").alias("observed"),
                       F.coalesce("strict", F.lit(False)).alias("strict"))


# --- declared configs ------------------------------------------------------

@query
def config_rules(spark, sf):
    return I.declared(spark, sf)["rules"].select(
        "device", "ruleset", "idx", "action", "r_proto", "r_src", "r_dst", "port_lo", "port_hi", "caveat")


@query
def config_interfaces(spark, sf):
    t = I.declared(spark, sf)
    return t["interfaces"].join(t["prefixes"].select("source", "iface", "cidr"), ["source", "iface"]).select(
        "device", "name", "cidr", "shutdown", "mac", "model")


@query
def config_warnings(spark, sf):
    return I.declared(spark, sf)["warnings"]


@query
def config_vendor(spark, sf):
    files = I.router_files(spark, sf).unionByName(I.controller_files(spark, sf)).unionByName(
        P.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"),
                                               F.col("text").alias("content")))
    return configs.route(files).groupBy("vendor").agg(F.count("*").alias("files"))


@query
def device_identity(spark, sf):
    t = I.declared(spark, sf)
    return declared.device_identity(t["devices"], t["interfaces"]).select("device", "device_type", "routes")


@query
def device_match(spark, sf):
    t = I.declared(spark, sf, I.INVENTORY)
    n = I.snapshot(spark, sf)["nodes"]
    out = declared.device_matches(t["devices"], t["interfaces"], t["prefixes"], n)
    return out.select("device", "source", F.array_join("ips", ",").alias("ips"), "by_mac")


@query
def adopted_devices(spark, sf):
    t = I.declared(spark, sf, I.INVENTORY)
    return declared.adopted_devices(t["devices"], t["interfaces"], t["prefixes"], I.snapshot(spark, sf)["nodes"])


@query
def declared_gateways(spark, sf):
    t = I.declared(spark, sf, I.INVENTORY)
    return declared.declared_gateways(
        t["devices"], t["interfaces"], t["prefixes"], E.endpoints(I.stored_edges(spark, sf)))


@query
def silent_subnets(spark, sf):
    """Declared networks against the hosts of server subnet 0 only seen there."""
    t = I.declared(spark, sf, I.INVENTORY)
    n = E.endpoints(I.stored_edges(spark, sf)).filter(~F.col("ip").startswith("10.2."))
    own = declared.owned_prefixes(t["interfaces"], t["prefixes"], t["vlans"])
    gaps = spark.createDataFrame([("10.2.0.0/22",), ("10.9.0.0/24",)], "cidr string")
    return declared.silent_subnets(own, n, gaps)


@query
def undeclared_cidrs(spark, sf):
    t = I.declared(spark, sf, I.INVENTORY)
    own = declared.owned_prefixes(t["interfaces"], t["prefixes"], t["vlans"])
    return declared.undeclared_cidrs(own, E.endpoints(I.stored_edges(spark, sf)))


@query
def policy_violations(spark, sf):
    out = policy.policy(I.declared(spark, sf, I.POLICY), I.stored_edges(spark, sf))["violations"]
    return out.select("device", "ruleset", "line", "raw", "src", "dst", "port", "proto", "confidence")


@query
def unused_permits(spark, sf):
    return policy.policy(I.declared(spark, sf, I.POLICY), I.stored_edges(spark, sf))["unused_permits"].select(
        "device", "ruleset", "idx", "raw")


@query
def skipped_rules(spark, sf):
    return declared.skipped_rules(I.declared(spark, sf)["rules"])


@query
def declared_findings(spark, sf):
    s = I.snapshot(spark, sf)
    t = I.declared(spark, sf)
    gaps = quality.zero_coverage(I.scope(spark), s["nodes"])
    inv, pol = policy.inventory(t, s["nodes"], gaps), policy.policy(t, s["edges"])
    return declared.findings(
        t["devices"], t["warnings"], inv["matches"], inv["adopted"], inv["gateways"], inv["silent_subnets"],
        inv["undeclared_cidrs"], pol["violations"], pol["unused_permits"], pol["skipped_rules"])


# --- briefing map ----------------------------------------------------------

def _map(spark, sf, **options):
    s = I.snapshot(spark, sf)
    gaps = quality.zero_coverage(I.scope(spark), s["nodes"])
    return s, mapview.detailed(s["nodes"], s["edges"], s["gateways"], gaps, MapOptions(**options))


@query
def segment_lookup(spark, sf):
    n = E.endpoints(I.stored_edges(spark, sf))
    out = mapview.grouping(n, MapOptions(segments=I.segments(spark, sf)))
    return out.select("ip", "cidr")


@query
def map_groups(spark, sf):
    n = E.endpoints(I.stored_edges(spark, sf))
    opts = MapOptions(segments=I.segments(spark, sf), labels=briefing.segment_labels(I.assets(spark, sf)))
    return mapview.groups(mapview.grouping(n, opts), opts).select(
        "id", "cidr", "label", "hosts", F.array_join("sensors", ",").alias("sensors"), "sparse")


@query
def map_nodes(spark, sf):
    _, m = _map(spark, sf)
    return m["nodes"].select("id", "group", "label", "role", "tier", r6("composite").alias("composite"), "gateway",
                             "agg_count", "vendor")


@query
def map_members(spark, sf):
    _, m = _map(spark, sf)
    return m["members"].select("agg_id", "ip", "role", "tier", "rank")


@query
def map_edges(spark, sf):
    _, m = _map(spark, sf)
    return m["edges"].select("src", "dst", "class", "label", "hosts", "conns", r6("width").alias("width"))


@query
def map_edge_members(spark, sf):
    s = I.snapshot(spark, sf)
    ends = materialize(mapview.endpoints(mapview.prepare(s["nodes"], MapOptions())), "ends")
    return mapview.edge_members(s["edges"], ends, "g:10.1.0.0/24:clients", "10.0.0.26", "auth")


@query
def map_inferred_gateways(spark, sf):
    e = I.stored_edges(spark, sf)
    g = mapview.with_group_ids(mapview.grouping(E.endpoints(e), MapOptions())).withColumn("visible", F.lit(True))
    boxes = mapview.groups(mapview.grouping(E.endpoints(e), MapOptions()), MapOptions())
    return mapview.inferred_gateways(boxes, mapview.crossing_groups(e, mapview.endpoints(g))).select("id", "group")


@query
def map_blind_spots(spark, sf):
    gaps = quality.zero_coverage(I.scope(spark), E.endpoints(I.edges(spark, sf)))
    return mapview.blind_spots(gaps)


@query
def map_declared(spark, sf):
    """Declared gateways and imported devices on the detailed map."""
    t = I.declared(spark, sf, I.INVENTORY)
    s = I.snapshot(spark, sf)
    parts = t["devices"], t["interfaces"], t["prefixes"]
    adopted = declared.adopted_devices(*parts, s["nodes"]).filter("observed_ip <> ''").groupBy(
        F.col("observed_ip").alias("ip")).agg(F.max(F.struct("name", "model")).alias("d")).select("ip", "d.*")
    gates = materialize(declared.declared_gateways(*parts, s["nodes"]), "gateways")
    gaps = quality.zero_coverage(I.scope(spark), s["nodes"])
    m = mapview.detailed(s["nodes"], s["edges"], s["gateways"], gaps, MapOptions(devices=adopted, gateways=gates))
    return m["nodes"].filter("gateway OR device <> ''").select("id", "group", "label", "role", "tier", "device", "gateway")


@query
def map_overview(spark, sf):
    s = I.snapshot(spark, sf)
    gaps = quality.zero_coverage(I.scope(spark), s["nodes"])
    m = mapview.overview(s["nodes"], s["edges"], s["gateways"], gaps, mapview.condensed())
    return m["nodes"].select("id", "group", "label", "role", "agg_count")


@query
def map_overview_groups(spark, sf):
    e = I.stored_edges(spark, sf)
    n = mapview._flagged(mapview.grouping(E.endpoints(e), MapOptions()), MapOptions())
    kept, omitted = mapview.overview_segments(n, config.MAP_SEGMENT_MAX_GROUPS)
    return kept.select("cidr", "hosts", "marked")


@query
def map_edge_budget(spark, sf):
    s = I.snapshot(spark, sf)
    gaps = quality.zero_coverage(I.scope(spark), s["nodes"])
    m = mapview.overview(s["nodes"], s["edges"], s["gateways"], gaps, mapview.condensed())
    return m["edges"].select("src", "dst", "class", "hosts", "conns")


@query
def map_omitted(spark, sf):
    """What the limits of a condensed overview leave out."""
    s = I.snapshot(spark, sf)
    m = mapview.overview(s["nodes"], s["edges"], s["gateways"], I.scope(spark), mapview.condensed())
    return m["omitted"].select("segments", "hosts")


@query
def map_services(spark, sf):
    """The composed map: everything in full detail, with the services of each node."""
    s = I.snapshot(spark, sf)
    m = briefing.build(s["nodes"], s["edges"], s["gateways"], I.scope(spark))
    return m["nodes"].filter(F.size("services") > 0).select(
        "id", F.array_join(F.array_sort("services"), ",").alias("services"))


@query
def map_drift(spark, sf):
    a, b = _pair(spark, sf, metadata=True)
    n, e, flags, edge_flags = briefing.drift_flags(a, b)
    m = mapview.detailed(n, e, b["gateways"], b["meta"].select(F.explode("zero_coverage_cidrs").alias("cidr")),
                         MapOptions(node_flags=materialize(flags, "flags"), edge_flags=edge_flags))
    return m["nodes"].filter("drift <> ''").select("id", "group", "drift")


@query
def map_reconcile(spark, sf):
    s = I.snapshot(spark, sf)
    docs = I.assets(spark, sf)
    flags = briefing.reconcile_flags(reconcile.undocumented(docs, s["nodes"]), reconcile.contradicted(docs, s["nodes"]))
    m = mapview.detailed(s["nodes"], s["edges"], s["gateways"], I.scope(spark), MapOptions(node_flags=flags))
    quiet = reconcile.silent(docs, s["nodes"], quality.zero_coverage(I.scope(spark), s["nodes"]))
    shown = briefing.ghosts(quiet, m["groups"])
    return m["nodes"].filter("drift <> ''").groupBy("drift").agg(F.count("*").alias("n")).unionByName(
        shown.agg(F.count("*").alias("n")).select(F.lit("silent").alias("drift"), "n"))


@query
def reconcile_lines(spark, sf):
    """Finding lines of the detailed map and of the overview, which has no ghosts."""
    s = I.snapshot(spark, sf)
    docs = I.assets(spark, sf)
    quiet = reconcile.silent(docs, s["nodes"], quality.zero_coverage(I.scope(spark), s["nodes"]))
    found = [reconcile.undocumented(docs, s["nodes"]), reconcile.contradicted(docs, s["nodes"])]
    out = None
    for wide in (False, True):
        m = briefing.reconcile_map(s["nodes"], s["edges"], s["gateways"], I.scope(spark), docs, quiet, *found, overview=wide)
        rows = m["reconcile_findings"].select(F.lit("overview" if wide else "detailed").alias("map"), "pos", "finding")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- devices ---------------------------------------------------------------

@query
def same_device_hints(spark, sf):
    n = I.snapshot(spark, sf)["nodes"]
    dismissed = P.table(spark, sf, "part").filter("p_size < 5").select(
        F.concat(F.lit("hostname:h"), (F.col("p_partkey") % 50).cast("string")).alias("key")).distinct()
    own = I.devices(spark, sf)
    out = devices.hostname_hints(n, own, dismissed).unionByName(devices.mac_hints(n, own, dismissed))
    return out.select("key", "name", F.array_join("ips", ",").alias("ips"))


@query
def hint_classes(spark, sf):
    """Values that suggest one device, with counts, and their addresses as rows."""
    n = I.snapshot(spark, sf)["nodes"]
    none = spark.createDataFrame([], "key string")
    out = None
    for kind, pairs in (("hostname", devices.hostname_pairs(n)), ("mac", devices.mac_pairs(n))):
        found = devices.hint_classes(pairs, kind, I.devices(spark, sf), none)
        rows = devices.hint_members(pairs, found).join(found.select("key", "n"), "key")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def operator_facts(spark, sf):
    out = devices.operator_facts(I.devices(spark, sf), I.overrides(spark, sf), I.labels(spark, sf))
    return out.select("ip", "device", "device_type", "role_override", F.array_join("labels", ",").alias("labels"))


@query
def pin_set(spark, sf):
    pins = P.table(spark, sf, "supplier").filter("s_acctbal > 9000").select(P.server_ip(F.col("s_suppkey")).alias("ip"))
    return devices.pin_set(pins, I.devices(spark, sf), I.overrides(spark, sf))


@query
def overlay_integrity(spark, sf):
    s = F.col("s_suppkey")
    rows = P.table(spark, sf, "supplier").select(
        F.floor(s / F.lit(3)).alias("device_id"),
        F.when(s % 9 < 3, "").otherwise(F.concat(F.lit("Dev"), (F.floor(s / F.lit(3)) % 20).cast("string"))).alias("device"),
        F.when(s % 11 == 0, F.lit("bad")).otherwise(P.server_ip(s - s % 4)).alias("ip"))
    return quality.overlay_integrity(rows)


def _device_nodes(spark, sf, members=False):
    s, m = _map(spark, sf, pinned=devices.pin_set(I.devices(spark, sf).select("ip"), I.devices(spark, sf), I.overrides(spark, sf)))
    facts = devices.operator_facts(I.devices(spark, sf), I.overrides(spark, sf), I.labels(spark, sf))
    served = E.services(s["edges"]).withColumnRenamed("ip", "id")
    rows = devices.overlay(m["nodes"], facts).join(served, "id", "left").withColumn(
        "services", F.coalesce("services", F.array().cast("array<string>")))
    stored = materialize(rows, "map-nodes")
    return (stored, m["members"], facts) if members else (stored, m["edges"])


@query
def device_members(spark, sf):
    """Everybody behind an aggregate or a device node, with operator facts."""
    n, hidden, facts = _device_nodes(spark, sf, members=True)
    mapping = devices.collapse_map(n)
    rows = devices.membership(n, hidden, mapping, facts)
    groups = devices.device_groups(mapping).select(F.concat(F.lit("dev:"), F.substring("id", 6, 10**6)).alias("parent"), F.col("label").alias("group"))
    return rows.join(groups, "parent", "left").select(
        "parent", "level", "pos", "id", "rank", "device", F.array_join("labels", ",").alias("labels"), "role_override", "group")


@query
def device_collapse(spark, sf):
    n, _ = _device_nodes(spark, sf)
    out = devices.collapse_nodes(n, devices.collapse_map(n))
    return out.filter("id LIKE 'dev:%'").select(
        "id", "label", "device", "agg_count", r6("composite").alias("composite"), "rank",
        F.array_join("services", ",").alias("services"), F.array_join("labels", ",").alias("labels"), "role_override")


@query
def device_edges(spark, sf):
    n, e = _device_nodes(spark, sf)
    out = devices.rewrite_edges(e, devices.collapse_map(n))
    return out.select("src", "dst", "class", "hosts", "conns", "label")


# --- evidence pack ---------------------------------------------------------

@query
def evidence_pack_nodes(spark, sf):
    return assist.pack_nodes(I.snapshot(spark, sf)["nodes"]).select("id", "subnet", "rank", "mac", "vendor")


@query
def evidence_pack_edges(spark, sf):
    s = I.snapshot(spark, sf)
    return assist.pack_edges(s["edges"], assist.pack_nodes(s["nodes"])).select("id", "conn_count", "service")


@query
def citation_check(spark, sf):
    e = I.stored_edges(spark, sf)
    c = F.col("c_custkey")
    found = P.table(spark, sf, "customer").select(
        F.col("c_name").alias("title"),
        F.when(c % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(P.client_ip(c), F.lit("10.250.0.1"))).alias("node_ids"),
        F.when(c % 4 == 1, F.array(text.edge_id(P.client_ip(c), P.server_ip(c % 100), F.lit(53)), F.lit("10.250.0.1>10.250.0.2:1")))
        .otherwise(F.array().cast("array<string>")).alias("edge_ids"))
    return assist.rejected_citations(found, E.endpoints(e).select(F.col("ip").alias("id")),
                                     e.select(text.edge_id("src", "dst", "port").alias("id")))


@query
def tag_check(spark, sf):
    s = F.col("s_suppkey")
    tags = P.table(spark, sf, "supplier").select(
        F.concat(F.lit(" "), P.server_ip(s)).alias("node_id"),
        F.when(s % 6 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(" DB "), F.lit("db"), F.lit("Core"))).alias("tags"),
        ((s % 12) / 10).alias("confidence"), F.when(s % 4 == 0, " ").otherwise("seen").alias("rationale"))
    known = E.endpoints(I.edges(spark, sf)).filter("ip < '10.0.2'").select(F.col("ip").alias("id"))
    return assist.checked_tags(tags, known).select("node_id", F.array_join("tags", ",").alias("tags"), "problem")


@query
def suggested_nodes(spark, sf):
    """Map nodes with the tags that were suggested for them, then the operator's overlay."""
    n, _, facts = _device_nodes(spark, sf, members=True)
    s = F.col("s_suppkey")
    tags = P.table(spark, sf, "supplier").filter(s % 3 == 0).select(
        P.server_ip(s).alias("node_id"), F.array(F.lit("db"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("tags"),
        (s % 10 / 10).alias("confidence"), F.col("s_name").alias("rationale"))
    out = briefing.finish({"nodes": n.drop("role_override", "labels")}, tags, "m1", facts)["nodes"]
    return out.filter("suggestion_model IS NOT NULL").select(
        "id", F.array_join("suggested_tags", ",").alias("tags"), r6("suggestion_confidence").alias("confidence"), "suggestion_rationale", "device")


@query
def suggestion_merge(spark, sf):
    s = F.col("s_suppkey")
    sup = P.table(spark, sf, "supplier")
    old = sup.select(P.server_ip(s).alias("node_id"), F.lit("old").alias("tag"))
    new = sup.filter("s_acctbal > 5000").select(P.server_ip(s).alias("node_id"), F.lit("new").alias("tag"))
    targets = sup.filter("s_acctbal > 4000").select(P.server_ip(s).alias("node_id"))
    return assist.merge_suggestions(old, new, targets)
