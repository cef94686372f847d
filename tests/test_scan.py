"""Scans of a window and a scope, stored snapshots, and what has no cap."""

import json

import pytest
from pyspark.sql import functions as F

from keyscape.functions import ports, text
from keyscape.operators import assist, drift, evidence, graph, mapview, quality
from keyscape.plans import briefing
from keyscape.plans.scan import ScanOptions, Telemetry, from_source, scan, scan_to_store
from keyscape.sources import assets, configs, snapshots, telemetry
from keyscape.sources.telemetry import FieldMap, load_field_map

CONN = ("ts timestamp, src string, dst string, port int, proto string, service string, state string, "
        "bytes_out bigint, bytes_in bigint, sensor string, dst_mac string")


def conn(spark, rows):
    full = [(ts, src, dst, port, "tcp", "app", "SF", 1, 1, "s1", mac) for ts, src, dst, port, mac in rows]
    return spark.createDataFrame(full, CONN.replace("ts timestamp", "ts string")).withColumn(
        "ts", F.col("ts").cast("timestamp"))


ROWS = [
    ("2024-01-10 10:00:00", "10.1.0.5", "10.0.0.1", 88, "m1"),
    ("2024-01-10 11:00:00", "10.1.0.6", "10.0.0.1", 88, "m1"),
    ("2024-01-10 12:00:00", "10.7.0.9", "10.8.0.1", 445, "m2"),
    ("2023-01-01 12:00:00", "10.1.0.7", "10.0.0.2", 53, "m3"),
    ("2024-01-10 13:00:00", "10.7.0.9", "10.0.0.1", 88, "m4"),
    ("2024-01-10 14:00:00", "10.7.0.9", "10.0.0.1", 88, "m4"),
]


def options(**more):
    return ScanOptions(**{"centrality": False, "created_at": "2024-02-01 00:00:00", **more})


def test_scope_and_window_remove_edges_and_hosts(spark):
    log = conn(spark, ROWS)
    logs = log.select(F.lit("kerberos").alias("kind"), F.col("dst").alias("responder"),
                      F.col("src").alias("client"), "ts")
    every = scan(Telemetry(log, logs), options())
    assert every["edges"].count() == 5
    cut = scan(Telemetry(log, logs), options(
        scope=["10.1.0.0/16"], as_of="2024-01-31 00:00:00", window_seconds=30 * 86400))
    assert {(r.src, r.dst) for r in cut["edges"].collect()} == {
        ("10.1.0.5", "10.0.0.1"), ("10.1.0.6", "10.0.0.1")}
    nodes = {r.ip: r for r in cut["nodes"].collect()}
    assert set(nodes) == {"10.1.0.5", "10.1.0.6", "10.0.0.1"}
    # hardware addresses and profiles aren't cut by the scope
    assert nodes["10.0.0.1"].mac == "m1"
    total = cut["edges"].select(F.col("temporal.hours").alias("h")).first().h
    assert sum(total) == 4
    assert cut["meta"].first().scope == ["10.1.0.0/16"]


def test_clients_are_counted_without_a_table_of_them(spark, monkeypatch):
    logs = spark.createDataFrame(
        [("dns", "r", "a"), ("dns", "r", "a"), ("dns", "r", "b"), ("dns", "r", None), ("ssl", "r", None), ("dns", None, "a")],
        "kind string, responder string, client string")
    want = evidence.responder_cardinality(logs).select("kind", "responder", "clients").collect()
    monkeypatch.setattr(evidence, "materialize", None)
    assert sorted(evidence.responder_clients(logs).collect()) == sorted(want) == [("dns", "r", 2), ("ssl", "r", 0)]


@pytest.mark.parametrize("more", [
    {"scope": ["10.99.0.0/16"]}, {"as_of": "2030-01-01 00:00:00", "window_seconds": 86400}])
def test_an_empty_scan_is_an_error(spark, more):
    with pytest.raises(quality.EmptyScan):
        scan(Telemetry(conn(spark, ROWS)), options(**more))


def test_same_schema_with_and_without_profiles(spark):
    log = Telemetry(conn(spark, ROWS))
    tables = [scan(log, options(temporal_top=top))["edges"] for top in (0, None)]
    assert tables[0].dtypes == tables[1].dtypes


def test_raw_events_to_a_stored_snapshot(spark, tmp_path):
    raw = conn(spark, ROWS).select(
        F.col("ts").alias("@timestamp"), F.lit("zeek.conn").alias("event.dataset"),
        F.col("src").alias("source.ip"), F.col("dst").alias("destination.ip"),
        F.col("port").alias("where.port"), F.col("state").alias("connection.state"),
        F.col("sensor").alias("observer.name"))
    lease = raw.limit(1).withColumn("event.dataset", F.lit("dhcp")).withColumn(
        "dhcp.assigned_ip", F.lit("10.1.0.5")).withColumn("dhcp.host_name", F.lit("pc5")).withColumn(
        "server.address", F.lit("10.0.0.3")).withColumn("client.address", F.lit("10.1.0.5"))
    raw = raw.unionByName(lease, allowMissingColumns=True)
    path = tmp_path / "fields.json"
    path.write_text(json.dumps({"columns": {"port": "where.port", "proto": ""}}))
    fields = load_field_map(str(path))
    assert fields.columns["proto"] == FieldMap().columns["proto"]
    logs = from_source(raw, fields).logs.collect()
    assert [(r.kind, r.responder, r.client) for r in logs] == [("dhcp", "10.0.0.3", "10.1.0.5")]
    root = str(tmp_path / "snapshots")
    tables = scan_to_store(raw, root, "0012", options(), fields)
    assert tables["edges"].count() == 5
    hosts = {r.ip: r.hostnames for r in tables["nodes"].collect()}
    assert hosts["10.1.0.5"] == ["pc5"]
    with pytest.raises(ValueError, match="exists"):
        snapshots.save({"meta": tables["meta"].drop("snapshot_id", "nodes_count", "edges_count")}, root, "0012")
    listed = snapshots.catalogue(spark, root).first()
    assert (listed.snapshot_id, listed.nodes, listed.edges) == ("0012", len(hosts), 5)
    assert snapshots.read(spark, root, "nodes", "12").count() == 0


def test_no_cap_on_sensors_and_datasets(spark):
    rows = spark.range(500).select(
        F.format_string("s%d", F.col("id") % 101).alias("sensor"),
        F.format_string("d%d", F.col("id") % 201).alias("dataset"))
    assert quality.sensor_counts(rows).count() == 101
    assert quality.dataset_counts(rows).count() == 201
    assert [r.sensor for r in quality.sensor_counts(rows, 2).collect()] == ["s0", "s1"]


def test_wide_asset_list_with_line_breaks(spark, tmp_path):
    path = tmp_path / "assets.csv"
    head = [f"note {k}" for k in range(39)] + ["IP"]
    cells = ['"two\nlines"'] + ["x"] * 38
    path.write_text("\n".join([",".join(head), ",".join([*cells, "10.0.0.1"]), ",".join(["x"] * 39 + ["10.0.0.2"])]))
    rows = assets.read_rows(spark, str(path))
    assert len(rows.columns) == 41
    good, bad = assets.parse(rows)
    assert sorted((r.ip, r.row) for r in good.collect()) == [("10.0.0.1", 2), ("10.0.0.2", 3)]
    assert bad.count() == 0


def test_order_of_a_policy_with_many_networks(spark):
    nets = [f"10.{k}.0.0/16" for k in range(70)]
    side = lambda values: {"zoneId": "z", "trafficFilter": {"type": "IP_ADDRESS", "ipAddressFilter": {
        "type": "IP_ADDRESSES", "items": [{"type": "SUBNET", "value": v} for v in values]}}}
    doc = {"data": [{"id": "z", "name": "Z", "networkIds": []}, {
        "id": "p", "name": "many", "enabled": True, "index": 1, "action": {"type": "BLOCK"},
        "source": side(nets), "destination": side(nets[:2])}]}
    t = configs.controller_tables(spark.createDataFrame(
        [("ctl", "f", json.dumps(doc))], "source string, file string, content string"))
    got = [(r.r_src, r.r_dst) for r in t["rules"].orderBy("idx").collect()]
    assert got == [(a, b) for a in nets for b in nets[:2]]


def test_betweenness_mode_is_explicit(spark):
    v = spark.createDataFrame([(x,) for x in "abc"], "ip string")
    w = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError, match="mode"):
        graph.betweenness(v, w, "auto")
    one = graph.betweenness(v, w, "pivots", 1).collect()
    assert {r.ip: r.betweenness for r in one} == {"a": 0.0, "b": 3.0, "c": 0.0}


def test_overview_keeps_all_unless_limited(spark):
    nodes = spark.createDataFrame(
        [(f"10.0.{n}.{h}", n * 8 + h, 0.1) for n in range(1, 6) for h in range(1, 9)],
        "ip string, rank int, composite double").withColumns({
            "mac": F.lit(""), "hostnames": F.array().cast("array<string>"), "sensors": F.array(F.lit("s")),
            "roles": F.array().cast("array<struct<role:string,confidence:double,evidence:array<string>>>")})
    edges = spark.createDataFrame([("10.0.1.1", "10.0.2.1", 88, 10)], "src string, dst string, port int, conn_count bigint")
    gates = spark.createDataFrame([], "sensor string, mac string, ip_count bigint")
    gaps = spark.createDataFrame([], "cidr string")
    whole = mapview.overview(nodes, edges, gates, gaps, mapview.MapOptions())
    assert whole["omitted"].first()[:2] == (0, 0) and whole["groups"].count() == 5
    few = mapview.overview(nodes, edges, gates, gaps, mapview.MapOptions(max_segments=3, hosts_per_segment=2))
    assert few["omitted"].first()[:2] == (3, 36) and few["groups"].count() == 3


def _map_nodes(spark, ips):
    return spark.createDataFrame([(ip, k + 1, 0.1) for k, ip in enumerate(ips)], "ip string, rank int, composite double").withColumns({
        "mac": F.lit(""), "hostnames": F.array().cast("array<string>"), "sensors": F.array(F.lit("s")),
        "roles": F.array().cast("array<struct<role:string,confidence:double,evidence:array<string>>>")})


@pytest.mark.parametrize("wide", [False, True])
def test_reconciled_map_flags_ghosts_labels_and_findings(spark, wide):
    """Ghosts stand only in groups that are shown, and in no overview; findings always count."""
    nodes = _map_nodes(spark, ["10.0.1.1", "10.0.1.2", "10.0.2.1", "10.0.2.2"])
    edges = spark.createDataFrame([("10.0.1.1", "10.0.2.1", 88, 10)], "src string, dst string, port int, conn_count bigint").withColumn(
        "evidence", F.lit("protocol-confirmed"))
    gates = spark.createDataFrame([], "sensor string, mac string, ip_count bigint")
    gaps = spark.createDataFrame([], "cidr string")
    docs = spark.createDataFrame([("10.0.1.9", "srv9", "x", "Lab", 3), ("10.0.1.8", "", "x", "Other", 4), ("10.0.2.9", "", "x", "Shop", 5),
                                  ("10.9.9.9", "far", "x", "Far", 6)], "ip string, hostname string, role string, segment string, row int")
    quiet = docs.withColumn("in_blind_spot", F.col("ip") == "10.0.1.8")
    flags = lambda *ips: spark.createDataFrame([(i,) for i in ips], "ip string")
    options = mapview.MapOptions(labels=spark.createDataFrame([("10.0.2.0/24", "Mine")], "cidr string, label string"))
    m = briefing.reconcile_map(nodes, edges, gates, gaps, docs, quiet, flags("10.0.1.1", "10.0.2.1"), flags("10.0.2.1"), options, wide)
    drift = {r.id: r.drift for r in m["nodes"].filter("drift <> ''").collect()}
    assert drift == {"10.0.1.1": "undocumented", "10.0.2.1": "contradicted"}
    labels = {r.cidr: r.label for r in m["groups"].collect()}
    assert labels["10.0.1.0/24"] == "10.0.1.0/24 — Lab" and labels["10.0.2.0/24"] == "10.0.2.0/24 — Mine"
    ghosts = {r.id: (r.group, r.label, r.note) for r in m["ghosts"].collect()}
    said = "documented but silent in the observation window"
    assert ghosts == ({} if wide else {
        "asset:10.0.1.9": ("g:10.0.1.0/24", "srv9\n10.0.1.9", said), "asset:10.0.2.9": ("g:10.0.2.0/24", "10.0.2.9", said),
        "asset:10.0.1.8": ("g:10.0.1.0/24", "10.0.1.8", said + " — inside a possible sensor blind spot; verify coverage before calling it decommissioned")})
    lines = [r.finding for r in m["reconcile_findings"].orderBy("pos").collect()]
    assert lines == [
        f"4 documented assets produced no observed traffic ({0 if wide else 3} shown ghosted; cross-check blind spots before calling them decommissioned)",
        "2 observed hosts are not in the asset list", "1 hosts contradict their documented role"]
    none = briefing.reconcile_findings(quiet.limit(0), flags(), flags("10.0.2.1"), m["ghosts"].limit(0)).collect()
    assert [(r.pos, r.finding) for r in none] == [(2, "1 hosts contradict their documented role")]


def test_suggestions_and_operator_facts_on_nodes(spark):
    nodes = spark.createDataFrame([("10.0.0.1", "service", "", ""), ("10.0.0.2", "client", "", "")], "id string, tier string, device string, device_type string")
    tags = spark.createDataFrame([("10.0.0.1", ["db"], 0.5, "why"), ("10.9.9.9", ["x"], 1.0, "gone")],
                                 "node_id string, tags array<string>, confidence double, rationale string")
    facts = spark.createDataFrame([("10.0.0.2", "Box", "server", "Database", ["l"])],
                                  "ip string, device string, device_type string, role_override string, labels array<string>")
    got = {r.id: r for r in briefing.finish({"nodes": nodes}, tags, "m1", facts)["nodes"].collect()}
    assert (got["10.0.0.1"].suggested_tags, got["10.0.0.1"].suggestion_model, got["10.0.0.1"].suggestion_rationale) == (["db"], "m1", "why")
    assert got["10.0.0.2"].suggested_tags is None and got["10.0.0.2"].suggestion_model is None
    assert (got["10.0.0.2"].device, got["10.0.0.2"].tier, got["10.0.0.2"].labels) == ("Box", "service", ["l"])
    assert briefing.finish({"nodes": nodes})["nodes"].columns == nodes.columns


def test_small_helpers(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", 1), (None, 2)], "x string, y int")
    assert [r.x for r in telemetry.present(rows, "x", "y").collect()] == ["b"]
    why = spark.createDataFrame([
        (["first", "second"], [("R", 0.5, ["seen"])]), ([], [("R", 0.5, ["seen"])]), ([], []), (None, None)],
        "d array<string>, r array<struct<role:string,confidence:double,evidence:array<string>>>")
    assert [r.w for r in why.select(text.why("d", "r").alias("w")).collect()] == ["first", "seen", "", ""]
    assert json.loads(assist.payload(rows.filter("y = 1")).first().payload) == {"x": "b", "y": 1}
    (tmp_path / "edge.cfg").write_text("hostname edge\ninterface Gi0\n")
    files = configs.route(configs.read_files(spark, str(tmp_path)))
    assert [(r.source, r.vendor) for r in files.collect()] == [("edge.cfg", "cisco-ios")]
    with pytest.raises(quality.WrongFieldMap):
        quality.require_groups(rows, rows.limit(0))
    assert quality.require_groups(rows.limit(0), rows.limit(0)).count() == 0


def test_drift_lists_have_one_order(spark):
    rows = spark.createDataFrame([("10.0.0.2", 53, 5), ("10.0.0.1", 88, 5), ("10.0.0.1", 53, 5), ("10.0.0.9", 53, 7)], "ip string, port int, clients int")
    got = drift.in_order("providers", rows.repartition(3)).orderBy("pos").collect()
    assert [(r.pos, r.ip, r.port) for r in got] == [(1, "10.0.0.9", 53), (2, "10.0.0.1", 53), (3, "10.0.0.1", 88), (4, "10.0.0.2", 53)]
    moves = spark.createDataFrame([
        ("b", 1, 3, []), ("a", 1, 0, [("x", 1, 2), ("y", 1, 2)]), ("c", 1, 3, [("x", 1, 1)]), ("d", 1, 0, [])],
        "ip string, port int, clients_added bigint, migrated_from array<struct<ip:string,port:int,clients:bigint>>")
    got = drift.in_order("displacement", moves).orderBy("pos")
    assert [r.ip for r in got.collect()] == ["a", "c", "b", "d"] and got.columns == [*moves.columns, "pos"]
    edges = spark.createDataFrame([("s2", "d1", 1), ("s1", "d2", 1), ("s1", "d1", 9), ("s1", "d1", 2)], "src string, dst string, port int")
    got = drift.in_order("gained", edges).orderBy("pos").collect()
    assert [(r.dst, r.src, r.port) for r in got] == [("d1", "s1", 2), ("d1", "s1", 9), ("d1", "s2", 1), ("d2", "s1", 1)]
    assert drift.in_order("identity", spark.createDataFrame([], "ip string, protocol string")).count() == 0


def test_port_tables_are_what_they_should_be(spark):
    """Expectations as plain values, not read from the tables they check."""
    want = {
        88: ("kerberos", True), 389: ("ldap", True), 53: ("dns", True), 445: ("smb", True),
        3389: ("rdp", False), 443: ("https", False), 22: ("ssh", False), 5432: ("postgres", True),
        51515: ("port-51515", False)}
    rows = spark.createDataFrame([(p,) for p in want], "port int").select(
        "port", ports.service_name("port"), ports.is_critical("port"))
    assert {r[0]: (r[1], r[2]) for r in rows.collect()} == want
