"""Declared policy: scopes of rulesets, first match through the index, CIDR joins."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from keyscape.operators import declared, ranges
from keyscape.plans.policy import policy

ANY = "0.0.0.0/0"
EMPTY = {
    "devices": "source string, device string, vendor string",
    "interfaces": "source string, device string, iface string, shutdown boolean",
    "prefixes": "source string, device string, iface string, cidr string, pos int",
    "bindings": "source string, iface string, ruleset string, direction string",
    "vlans": "source string, device string, subnet string, purpose string, ord int",
    "rulesets": "source string, device string, ruleset string, default_action string",
    "rules": "source string, device string, ruleset string, idx int, action string, r_proto string, r_src string, "
             "r_dst string, port_lo int, port_hi int, line int, raw string, caveat string",
}


def tables(spark, devices):
    """Tables of [(name, vendor, interfaces [(cidrs, bindings, down)], vlans [(cidr, purpose)],
    {ruleset: (default, [(action, proto, src, dst, port, line, caveat)])})]."""
    rows = {t: [] for t in EMPTY}
    for name, vendor, interfaces, vlans, rulesets in devices:
        rows["devices"].append((name, name, vendor))
        for k, (cidrs, bindings, down) in enumerate(interfaces):
            rows["interfaces"].append((name, name, f"Gi{k}", down))
            rows["prefixes"] += [(name, name, f"Gi{k}", c, n) for n, c in enumerate(cidrs)]
            rows["bindings"] += [(name, f"Gi{k}", r, d) for r, d in bindings]
        rows["vlans"] += [(name, name, c, p, k) for k, (c, p) in enumerate(vlans)]
        for ruleset, (default, rules) in rulesets.items():
            rows["rulesets"].append((name, name, ruleset, default))
            rows["rules"] += [
                (name, name, ruleset, k, action, proto, src, dst, port, port, line, f"{action} {line}", caveat)
                for k, (action, proto, src, dst, port, line, caveat) in enumerate(rules)]
    return {t: spark.createDataFrame(rows[t], ddl) for t, ddl in EMPTY.items()}


def judged(spark, devices, flows):
    edges = spark.createDataFrame(
        [(s, d, port, proto, "", "", 1, None, None) for s, d, port, proto in flows],
        "src string, dst string, port int, proto string, service string, evidence string, conn_count bigint, "
        "first_seen timestamp, last_seen timestamp")
    out = policy(tables(spark, devices), edges)
    denied = [(r.ruleset, r.line, r.src, r.dst, r.port, r.confidence) for r in out["violations"].collect()]
    unused = [(r.ruleset, r.line) for r in out["unused_permits"].collect()]
    return sorted(denied), sorted(unused), out["skipped_rules"].first()[0]


def edge_router(direction="in"):
    return ("edge", "cisco-ios", [(["10.0.1.1/24"], [("EDGE_IN", direction)], False)], [], {"EDGE_IN": ("deny", [
        ("deny", "tcp", "10.0.1.0/24", ANY, 445, 10, ""), ("permit", "ip", ANY, ANY, 0, 20, "")])})


def test_transport_of_the_edge_decides(spark):
    flows = [("10.0.1.5", "10.0.2.9", 445, p) for p in ("udp", "icmp")]
    assert judged(spark, [edge_router()], flows)[0] == []
    flows = [("10.0.1.5", "10.0.2.9", 445, ""), ("10.0.1.6", "10.0.2.9", 445, "tcp"), ("10.0.1.6", "10.0.2.9", 80, "")]
    denied, unused, _ = judged(spark, [edge_router()], flows)
    assert denied == [("EDGE_IN", 10, "10.0.1.5", "10.0.2.9", 445, "full"), ("EDGE_IN", 10, "10.0.1.6", "10.0.2.9", 445, "full")]
    assert unused == []


def test_out_looks_at_the_server_side(spark):
    flows = [("10.0.9.9", "10.0.1.5", 445, ""), ("10.0.1.5", "10.0.9.9", 445, ""), ("10.0.1.4", "10.0.1.5", 445, "")]
    assert judged(spark, [edge_router("out")], flows)[0] == []
    other = ("core", "cisco-ios", [(["10.0.1.1/24"], [("OUT", "out")], False)], [], {"OUT": ("permit", [
        ("deny", "ip", "10.0.9.0/24", ANY, 0, 7, "")])})
    assert judged(spark, [other], flows)[0] == [("OUT", 7, "10.0.9.9", "10.0.1.5", 445, "full")]
    down = ("core", "cisco-ios", [(["10.0.1.1/24"], [("OUT", "out")], True)], [], other[4])
    assert judged(spark, [down], flows)[0] == []


def test_implicit_deny_and_unused_permit(spark):
    lock = ("lock", "cisco-ios", [(["10.0.1.1/24"], [("LOCK", "in")], False)], [], {"LOCK": ("deny", [
        ("permit", "tcp", "10.0.1.0/24", ANY, 22, 5, "")])})
    denied, unused, _ = judged(spark, [lock], [("10.0.1.5", "10.0.2.9", 445, ""), ("10.0.1.5", "10.0.1.9", 445, ""),
                                               ("10.0.1.5", "not an address", 445, "")])
    assert denied == [("LOCK", 0, "10.0.1.5", "10.0.2.9", 445, "full")] and unused == [("LOCK", 5)]


def controller(vlans, rulesets):
    return ("udm", "unifi", [], vlans, rulesets)


def test_corporate_guest_and_unknown_purposes(spark):
    drop = lambda port: ("permit", [("deny", "tcp", ANY, ANY, port, 1, "")])
    dev = controller([("10.0.1.0/24", "corporate"), ("10.0.40.0/24", "guest"), ("10.0.5.0/24", None)],
                     {"LAN_IN": drop(22), "GUEST_IN": drop(445)})
    flows = [("10.0.1.5", "10.0.2.9", 22, ""), ("10.0.40.5", "10.0.2.9", 445, ""), ("10.0.40.5", "10.0.40.9", 445, ""),
             ("10.0.1.5", "10.0.2.9", 445, ""), ("10.0.5.5", "10.0.1.9", 22, ""), ("10.0.1.5", "10.0.1.9", 22, "")]
    denied = judged(spark, [dev], flows)[0]
    assert [(r, s, p) for r, _, s, _, p, _ in denied] == [
        ("GUEST_IN", "10.0.40.5", 445), ("LAN_IN", "10.0.1.5", 22), ("LAN_IN", "10.0.5.5", 22)]


def test_wan_in_judges_only_what_comes_from_outside(spark):
    dev = controller([("10.0.1.0/24", "")], {"WAN_IN": ("permit", [("deny", "ip", ANY, "10.0.1.0/24", 445, 0, "")])})
    flows = [("203.0.113.7", "10.0.1.9", 445, ""), ("10.0.1.5", "10.0.1.9", 445, ""), ("203.0.113.7", "203.0.113.8", 445, "")]
    assert [r[2] for r in judged(spark, [dev], flows)[0]] == ["203.0.113.7"]


def test_zone_judges_what_leaves_one_network(spark):
    dev = controller([("10.0.1.0/24", ""), ("10.0.2.0/24", "")], {"ZONE:a->b": ("permit", [
        ("deny", "ip", ANY, ANY, 445, 3, "")])})
    flows = [("10.0.1.5", "10.0.2.9", 445, ""), ("10.0.1.5", "10.0.1.9", 445, ""), ("203.0.113.7", "10.0.2.9", 445, ""),
             ("10.0.2.5", "203.0.113.7", 445, ""), ("203.0.113.7", "203.0.113.8", 445, "")]
    assert [(r[2], r[3]) for r in judged(spark, [dev], flows)[0]] == [
        ("10.0.1.5", "10.0.2.9"), ("10.0.2.5", "203.0.113.7"), ("203.0.113.7", "10.0.2.9")]


def test_rules_with_a_caveat_are_skipped(spark):
    mix = ("mix", "cisco-ios", [(["10.0.1.1/24"], [("MIX", "in")], False)], [], {"MIX": ("deny", [
        ("deny", "tcp", "10.0.1.0/24", ANY, 0, 5, "unresolved"), ("deny", "tcp", "10.0.1.0/24", ANY, 445, 10, ""),
        ("permit", "ip", ANY, ANY, 0, 20, "")])})
    denied, unused, skipped = judged(spark, [mix], [("10.0.1.5", "10.0.2.9", 445, "")])
    assert denied == [("MIX", 10, "10.0.1.5", "10.0.2.9", 445, "partial")] and skipped == 1 and unused == []


def test_first_match_equals_brute_force(spark):
    """Rulesets with networks of many lengths, in both families, against reading the rules
    in order."""
    r = random.Random(5)
    nets = [ANY, "::/0", "10.0.0.0/8", "10.0.0.0/15", "10.0.1.0/24", "10.0.1.128/25", "10.0.2.9/32", "fd00::/8",
            "fd00:1::/32", "fd00:1::9/128", "172.16.0.0/12"]
    hosts = ["10.0.1.5", "10.0.1.200", "10.0.2.9", "10.1.7.7", "172.20.1.1", "8.8.8.8", "fd00:1::9", "fd00:2::1", "2001:db8::1"]
    devices = []
    for d in range(6):
        rules = [(r.choice(["permit", "deny"]), r.choice(["ip", "tcp", "udp"]), r.choice(nets), r.choice(nets),
                  r.choice([0, 0, 53, 445]), 10 * k, r.choice(["", "", "", "odd"])) for k in range(r.randint(0, 12))]
        devices.append((f"d{d}", "cisco-ios", [([r.choice(nets[2:6]), "fd00:1::1/32"], [("R", r.choice(["in", "out"]))], False)],
                        [], {"R": (r.choice(["permit", "deny"]), rules)}))
    flows = [(s, d, p, proto) for s in hosts for d in hosts for p in (53, 445, 80) for proto in ("", "tcp", "icmp")]
    inside = lambda ip, cidr: ipaddress.ip_address(ip) in ipaddress.ip_network(cidr, strict=False)
    want = []
    for name, _, ((cidrs, ((_, direction),), _),), _, rulesets in devices:
        default, rules = rulesets["R"]
        for s, d, port, proto in flows:
            own, far = (s, d) if direction == "in" else (d, s)
            if not any(inside(own, c) for c in cidrs) or any(inside(far, c) for c in cidrs):
                continue
            lines = []
            for p in [proto] if proto else ["tcp", "udp"]:
                hit = next((x for x in rules if not x[6] and x[1] in ("ip", p) and inside(s, x[2]) and inside(d, x[3])
                            and x[4] in (0, port)), None)
                if (hit[0] if hit else default) == "deny":
                    lines.append(hit[5] if hit else 0)
            if lines:
                partial = any(x[6] for x in rules)
                want.append((name, lines[0], s, d, port, proto, "partial" if partial else "full"))
    edges = spark.createDataFrame(flows, "src string, dst string, port int, proto string")
    for c in ("service", "evidence", "conn_count", "first_seen", "last_seen"):
        edges = edges.withColumn(c, F.lit(None).cast("string"))
    out = policy(tables(spark, devices), edges)["violations"]
    got = [(x.device, x.line, x.src, x.dst, x.port, x.proto, x.confidence) for x in out.collect()]
    assert len(want) > 200 and sorted(got) == sorted(want)


def test_rows_of_an_edge_depend_on_its_own_ruleset_only(spark):
    """A second ruleset with networks of all lengths adds nothing to the first one's ends."""
    rules = tables(spark, [edge_router(), ("wide", "cisco-ios", [], [], {"W": ("deny", [
        ("permit", "ip", f"10.0.0.0/{b}", ANY, 0, b, "") for b in range(33)])})])["rules"]
    ends = spark.createDataFrame([("edge", "EDGE_IN", "10.0.1.5"), ("wide", "W", "10.0.1.5")], "source string, ruleset string, ip string")
    got = {r.source: len(r.nets) for r in declared._chains(ends, rules, "r_src", "nets").collect()}
    assert got == {"edge": 2, "wide": 24}


# --- addresses in CIDRs ----------------------------------------------------

@pytest.mark.parametrize("limit", [0, 100_000])
def test_match_equals_brute_force(spark, limit):
    r = random.Random(2)
    v4 = lambda: ipaddress.ip_address((10 << 24) + r.getrandbits(12) * 4099 % (1 << 24))
    v6 = lambda: ipaddress.ip_address((0xFD << 120) + r.getrandbits(9) * 7919)
    hosts = [str(v4()) for _ in range(150)] + [str(v6()) for _ in range(50)] + ["10.0.0.0", "10.255.255.255", "x", None]
    cidrs = {f"{v4()}/{r.randint(0, 32)}" for _ in range(60)} | {f"{v6()}/{r.randint(0, 128)}" for _ in range(40)}
    cidrs |= {ANY, "::/0", "10.0.0.0/8", "10.0.0.0/32", "10.255.255.255/32", "bad", "10.0.0.0/33"}
    left = spark.createDataFrame([(h, k) for k, h in enumerate([*hosts, hosts[0]])], "ip string, k int")
    right = spark.createDataFrame([(c, c[-1:]) for c in cidrs] + [(ANY, "again")], "cidr string, tag string")
    got = ranges.match(left, "ip", right, "cidr", broadcast_cidrs=limit)
    assert got.columns[:2] == ["ip", "k"]
    found = sorted((x.k, x.cidr, x.tag) for x in got.collect())
    want = []
    for k, h in enumerate([*hosts, hosts[0]]):
        for c, tag in [(c, c[-1:]) for c in cidrs] + [(ANY, "again")]:
            try:
                if ipaddress.ip_address(h) in ipaddress.ip_network(c, strict=False):
                    want.append((k, c, tag))
            except ValueError:
                pass
    assert found == sorted(want)


def test_the_widest_network_is_no_single_key(spark):
    """A million hosts in 0.0.0.0/0: they are dealt by token and range, evenly."""
    hosts = spark.range(1_000_000, numPartitions=4).select(F.concat_ws(
        ".", F.lit("10"), *[F.shiftright("id", s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)]).alias("ip"))
    nets = spark.createDataFrame([(ANY,), ("10.0.0.0/8",), ("10.3.7.0/24",), ("192.168.0.0/16",)], "cidr string")
    tokens = ranges.network_tokens(hosts, "ip", nets, "cidr", [0, 8, 16, 24])
    sizes = {(r["_token"], r["_part"]): r["count"] for r in tokens.groupBy("_token", "_part").count().collect()}
    whole = {t: sum(n for (x, _), n in sizes.items() if x == t) for t in {t for t, _ in sizes}}
    assert sorted(whole.values()) == [256, 1_000_000, 1_000_000]
    assert max(sizes.values()) < 1_000_000 / 4 * 1.5


def test_undeclared_cidrs_look_at_each_subnet_once(spark):
    """Subnets are written before their CIDRs are parsed: nothing is parsed for every host."""
    owned = spark.createDataFrame([("10.0.0.0/16",), ("10.1.1.0/25",)], "cidr string")
    nodes = spark.createDataFrame([("10.0.0.0/24",), ("10.0.0.0/24",), ("10.1.1.0/24",), ("",), (None,)], "subnet string")
    out = declared.undeclared_cidrs(owned, nodes)
    assert [r.cidr for r in out.collect()] == ["10.1.1.0/24"]
    assert any("/subnets-" in f for f in out.inputFiles())


def test_flows_of_a_class_share_one_answer(spark):
    """Rules are looked up for classes of flows; violations take no aggregation of flows, and an
    end that is no address, a missing port and a missing transport are judged as before."""
    t = tables(spark, [edge_router()])
    ends = [f"10.0.1.{n}" for n in range(2, 30)]
    flows = [(s, f"10.0.{n}.9", port, proto) for n, s in enumerate(ends, 2) for port in (445, 80) for proto in ("tcp", "udp", "")]
    flows += [("10.0.1.9", "printer", 445, "tcp"), ("printer", "10.0.1.9", 445, "tcp"), ("10.0.1.9", None, 445, "tcp"),
              ("10.0.1.9", "8.8.8.8", None, "tcp"), ("10.0.1.9", "8.8.8.8", 445, None)]
    edges = spark.createDataFrame(flows, "src string, dst string, port int, proto string").withColumn("conn_count", F.lit(1))
    apps = declared.applications(*[t[n] for n in ("devices", "interfaces", "prefixes", "bindings", "vlans", "rulesets")])
    decided = declared.decisions(edges, apps, t["rules"], t["rulesets"])
    got = decided.select("src", "dst", "port", "proto", "p", "first_denied", "rule.line").collect()
    assert len(got) == 28 * 2 * 4 + 3
    for r in got:
        denied = r.p == "tcp" and r.port == 445
        assert r.line == (10 if denied else 20)
        assert r.first_denied == (0 if r.port == 445 and r.proto != "udp" else None)
    out = declared.violations(decided, t["rules"])
    assert out.count() == 28 * 2 + 1
    assert "SortAggregate [app" not in out._jdf.queryExecution().toString() and "SortAggregate(key=[app" not in (
        out._jdf.queryExecution().executedPlan().toString())
