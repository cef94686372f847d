"""Operator devices: merged nodes, their members and groups, hints, overlays."""

import pytest
from pyspark.sql import functions as F

from keyscape.operators import devices

NODE = ("id string, group string, label string, role string, tier string, composite double, rank int, agg_count bigint, "
        "gateway boolean, device string, device_type string, services array<string>")
FACTS = "ip string, device string, device_type string, role_override string, labels array<string>"
HIDDEN = "agg_id string, ip string, label string, role string, tier string, composite double, rank int, vendor string"


def host(ip, rank, role="Unknown", services=(), gateway=False, agg=0):
    return (ip, f"g:{ip}", ip, role, "client", 1 - rank * 0.1, rank, agg, gateway, "", "", list(services))


@pytest.fixture
def world(spark):
    nodes = spark.createDataFrame([
        host("192.168.20.1", 1, "Network gear", ["ssh"]), host("10.10.40.1", 2, "DNS", ["dns"]), host("10.18.61.1", 0, "Web", ["dns", "http"]),
        host("10.0.1.10", 4), host("10.0.2.10", 5), host("10.0.3.10", 6), host("10.0.4.10", 7), host("10.0.5.1", 8, gateway=True),
        host("10.0.5.2", 9), host("g:10.0.9.0/24:clients", 0, agg=2)], NODE)
    facts = spark.createDataFrame([
        ("192.168.20.1", "UDM", "router", "", ["a"]), ("10.10.40.1", "UDM", "router", "", ["b", "a"]), ("10.18.61.1", "UDM", "router", "", []),
        ("10.0.1.10", "", "", "Till", []), ("10.0.2.10", "", "", "Till", []), ("10.0.3.10", "", "", "Printer", []),
        ("10.0.4.10", "", "", "Printer", []), ("10.0.5.1", "Solo", "box", "", []), ("10.0.5.2", "Solo", "box", "", []),
        ("10.0.9.7", "UDM", "router", "Camera", ["hidden"])], FACTS)
    hidden = spark.createDataFrame([
        ("g:10.0.9.0/24:clients", "10.0.9.8", "pc8", "Unknown", "client", 0.1, 0, ""),
        ("g:10.0.9.0/24:clients", "10.0.9.7", "pc7", "Unknown", "client", 0.2, 30, "")], HIDDEN)
    return devices.overlay(nodes, facts), hidden, facts


def test_addresses_of_a_device_become_one_node(world):
    nodes, _, _ = world
    mapping = devices.collapse_map(nodes)
    out = {r.device or r.id: r for r in devices.collapse_nodes(nodes, mapping).collect()}
    udm = out["UDM"]
    assert (udm.id, udm.agg_count, udm.label, udm.rank, udm.composite) == ("dev:55444d", 3, "3 IPs", 1, 1.0)
    assert (udm.services, udm.labels, udm.role) == (["dns", "http", "ssh"], ["a", "b"], "Network gear")
    # a label that names a device merges too, one that names a kind of host does not
    assert (out["Till"].agg_count, out["Till"].role_override) == (2, "Till")
    assert {"10.0.3.10", "10.0.4.10", "g:10.0.9.0/24:clients"} <= set(out)
    # a gateway and a single address stay
    assert out["Solo"].id in ("10.0.5.1", "10.0.5.2") and "10.10.40.1" not in out
    groups = {r.id: r.label for r in devices.device_groups(mapping).collect()}
    assert groups == {udm.group: "UDM", out["Till"].group: "Till"}


def test_members_at_every_level_carry_the_overlay(world):
    nodes, hidden, facts = world
    rows = devices.membership(nodes, hidden, devices.collapse_map(nodes), facts).collect()
    listed = {}
    for r in sorted(rows, key=lambda r: (r.parent, r.pos)):
        listed.setdefault(r.parent, []).append(r.id)
    assert listed == {
        "dev:55444d": ["192.168.20.1", "10.10.40.1", "10.18.61.1"], "dev:54696c6c": ["10.0.1.10", "10.0.2.10"],
        "g:10.0.9.0/24:clients": ["10.0.9.7", "10.0.9.8"]}
    own = {r.id: r for r in rows}
    assert all(own[i].device == "UDM" for i in listed["dev:55444d"])
    assert (own["10.0.9.7"].device, own["10.0.9.7"].labels, own["10.0.9.7"].tier, own["10.0.9.7"].level) == (
        "UDM", ["hidden"], "client", "aggregate")
    assert (own["10.0.9.8"].device, own["10.0.9.8"].labels) == ("", [])
    assert len(own) == len(rows)


def test_hostname_and_hardware_hints(spark):
    nodes = spark.createDataFrame([
        ("192.168.20.1", ["udm"], "24:5a:4c:11:22:33"), ("10.10.40.1", ["udm"], "24:5a:4c:11:22:33"), ("10.18.61.1", ["udm", "udm"], ""),
        ("10.0.0.5", ["nas"], "aa:bb:cc:dd:ee:ff"), ("10.0.0.6", [], None), ("10.0.0.7", ["printer"], "aa:bb:cc:00:00:01"),
        ("10.0.0.8", ["printer"], "aa:bb:cc:00:00:01")], "ip string, hostnames array<string>, mac string")
    own = lambda rows: spark.createDataFrame(rows, "ip string, device string")
    gone = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    hints = lambda o, g: {r.key: r.ips for r in devices.hostname_hints(nodes, o, g).collect()}
    udm = ["10.10.40.1", "10.18.61.1", "192.168.20.1"]
    assert hints(own([]), gone()) == {"hostname:udm": udm, "hostname:printer": ["10.0.0.7", "10.0.0.8"]}
    assert hints(own([]), gone("hostname:printer")) == {"hostname:udm": udm}
    assert hints(own([(i, "router") for i in udm]), gone("hostname:printer")) == {}
    assert hints(own([(i, "router") for i in udm[:2]]), gone("hostname:printer")) == {"hostname:udm": udm}
    assert hints(own([(udm[0], "a"), (udm[1], "b"), (udm[2], "a")]), gone("hostname:printer")) == {"hostname:udm": udm}
    found = {r.key: (r["name"], r.ips) for r in devices.mac_hints(nodes, own([]), gone()).collect()}
    assert found == {"mac:24:5a:4c:11:22:33": ("Ubiquiti", ["10.10.40.1", "192.168.20.1"]),
                     "mac:aa:bb:cc:00:00:01": ("aa:bb:cc:00:00:01", ["10.0.0.7", "10.0.0.8"])}


def test_a_value_of_very_many_addresses_stays_rows(spark):
    pairs = spark.range(30_000).select(F.lit("localhost").alias("value"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("ip"))
    none = spark.createDataFrame([], "ip string, device string")
    classes = devices.hint_classes(pairs.unionByName(pairs), "hostname", none, spark.createDataFrame([], "key string"))
    assert [tuple(r) for r in classes.collect()] == [("hostname:localhost", "localhost", 30_000)]
    assert devices.hint_members(pairs, classes).count() == 30_000


def test_operator_facts_have_one_row_per_address(spark):
    """An address with two corrected roles, devices and labels is one row, so no map node is doubled."""
    own = spark.createDataFrame([("a", "dev-1", "server"), ("a", "dev-2", "server")], "ip string, device string, device_type string")
    roles = spark.createDataFrame([("a", "Printer"), ("a", "box-1"), ("b", "box-2"), ("b", "box-2")], "ip string, role_override string")
    labels = spark.createDataFrame([("a", "y"), ("a", "x")], "ip string, label string")
    got = sorted((*r[:4], tuple(r[4])) for r in devices.operator_facts(own, roles, labels).collect())
    assert got == [("a", "dev-2", "server", "box-1", ("x", "y")), ("b", "", "", "box-2", ())]
