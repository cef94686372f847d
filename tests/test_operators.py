"""Known-answer fixtures for the operators."""

from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from keyscape.functions import ip as ipf
from keyscape.functions import text
from keyscape.operators import drift, edges as edge_ops, graph, reconcile, temporal
from keyscape.sources import assets, configs

EDGE = ("src string, dst string, port int, proto string, service string, evidence string, "
        "conn_count bigint, first_seen timestamp, last_seen timestamp, sensors array<string>")


def edge(src, dst, port=443, evidence="responder-confirmed", n=10, proto="tcp"):
    return (src, dst, port, proto, "", evidence, n, None, None, ["s1"])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_addresses(spark):
    cases = {
        "10.0.0.1": ("40a000001", "10.0.0.0/24", True),
        "01.2.3.4": (None, "01.2.3.4", False),
        "2001:db8::1": ("620010db8" + "0" * 23 + "1", "2001:db8::/64", True),
        "::": ("6" + "0" * 32, "::/64", False),
        "1::2::3": (None, "1::2::3", False),
        "12345::": (None, "12345::", False),
        "224.0.0.251": ("4e00000fb", "224.0.0.0/24", False),
        "255.255.255.255": ("4ffffffff", "255.255.255.0/24", False),
        "::ffff:127.0.0.1": ("6" + "0" * 20 + "ffff7f000001", "::/64", False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    got = {r[0]: tuple(r)[1:] for r in df.select(
        "ip", ipf.ip_key("ip"), ipf.subnet("ip"), ipf.terrain_addr("ip")).collect()}
    assert got == cases


def test_few_sensors_are_a_mask(spark):
    """One shuffle for a log of few sensors; the same edges as by collected sets, with any number
    of them, a row without a sensor and an edge without any."""
    names = [f"s{i:02}" for i in range(63)] + ["s63", "\u00e9t\u00e9"]
    def log(count):
        made = [("a", "b", 443, None if i % 2 else "tcp", n, "SF", "x", 5, None if i % 3 else i) for i, n in enumerate(names[:count])]
        made += made[:1] + [("a", "b", 443, "tcp", None, "S0", "", None, None), ("a", "c", 22, "tcp", None, "S0", "", None, None), ("a", None, 22, "tcp", "s00", "S0", "", 1, 1)]
        return spark.createDataFrame(made, "src string, dst string, port int, proto string, sensor string, state string, service string, "
                                     "bytes_out bigint, bytes_in bigint").withColumn("ts", F.timestamp_seconds(F.coalesce("bytes_in", F.lit(7))))
    for count in (0, 1, 2, 63, 64, 65):
        got, want = edge_ops.aggregate_edges(log(count)), edge_ops.aggregate_edges(log(count), masked=-1)
        assert got.dtypes == want.dtypes and rows(got) == rows(want)
        assert {len(r["sensors"]) for r in got.collect() if r["dst"] == "c"} == {0}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == (1 if count < 64 else 2)


def test_glob_and_roles(spark):
    df = spark.createDataFrame(
        [("*.example.com", "a.b.example.com", True), ("*.example.com", "example.com", False),
         ("a*/b", "ax/b", True), ("a*b", "a/b", False)], "p string, n string, want boolean")
    assert all(r[0] == r[1] for r in df.select(text.glob_match("p", "n"), "want").collect())
    df = spark.createDataFrame([("datacenter",), ("Primary DC",), ("web-01",)], "t string")
    assert [r[0] for r in df.select(text.normalize_role("t")).collect()] == ["", "DomainController", "WebServer"]


def test_temporal_truth_table(spark):
    def hist(**at):
        h = [0] * 24
        for k, v in at.items():
            h[int(k[1:])] = v
        return h

    week, weekdays = [10] * 7, [0, 20, 20, 20, 20, 20, 0]
    cases = [
        (hist(h9=5), week, "Sparse"), ([10] * 24, week, "Constant"),
        (hist(**{f"h{i}": 10 for i in range(8, 18)}), weekdays, "BusinessHours"),
        (hist(h2=50, h3=50), week, "Nightly"), (hist(h14=100), week, "Burst"),
    ]
    df = spark.createDataFrame(cases, "hours array<bigint>, dow array<bigint>, want string")
    assert all(r[0] == r[1] for r in df.select(temporal.classify(), "want").collect())


def brandes(pairs, sources):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    score = defaultdict(float)
    for s in sources:
        dist, sigma, preds, order, q = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


PAIRS = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "f"), ("f", "a"), ("c", "g"), ("g", "b")]


@pytest.mark.parametrize("salt", [200_000, 1])
def test_betweenness_matches_brute_force(spark, salt):
    """Exact, sampled with all pivots, and with every hub split, all agree."""
    want = brandes(PAIRS, "abcdefg")
    v = spark.createDataFrame([(x,) for x in "abcdefg"], "ip string")
    w = spark.createDataFrame([(a, b, 1.0) for a, b in PAIRS], "src string, dst string, weight double")
    exact = graph.betweenness(v, w, "exact", salt_rows=salt)
    assert {r[0]: pytest.approx(r[1]) for r in exact.collect()} == {x: want[x] for x in "abcdefg"}
    if salt > 1:
        every = graph.betweenness(v, w, "pivots", 100)
        assert {r[0]: pytest.approx(r[1]) for r in every.collect()} == {x: want[x] for x in "abcdefg"}


def test_backward_pass_reads_only_edges_of_reached_vertices(spark):
    """A vertex below a source with very many callers that the source does not reach: the backward
    pass sends nothing to those."""
    pairs = [("s", "m"), ("m", "t")] + [(f"c{i}", "t") for i in range(500)]
    w = spark.createDataFrame(pairs, "src string, dst string")
    asked, across = [], graph._across

    def counted(level, carried, *rest):
        out = across(level, carried, *rest)
        asked.append(out)
        return out

    graph._across = counted
    try:
        one = graph.path_dependencies(spark.createDataFrame([("s",)], "ip string"), w)
        assert [tuple(r) for r in one.collect()] == [("m", 1.0)]
        assert max(x.count() for x in asked) == 1
    finally:
        graph._across = across


#: Callers that nobody calls, over servers to hubs that call each other; a chain, a self call and a pair apart.
LAYERS = (
    [(f"c{i}", f"s{(i * 3 + j) % 7}") for i in range(40) for j in range(3)]
    + [(f"s{i}", f"h{(i + j) % 4}") for i in range(7) for j in range(2)]
    + [("h0", "h1"), ("h1", "s2"), ("h3", "c1"), ("h2", "x1"), ("x1", "x2"), ("x2", "x2"), ("y1", "y2")])


@pytest.mark.parametrize("held,rows,most", [(2_000_000, 1_000_000, 2_000), (0, 1, 2)])
def test_betweenness_of_edges_held_and_dealt(spark, monkeypatch, held, rows, most):
    """Edges that go to every task, levels joined by hash; edges dealt to several, joined by sort."""
    monkeypatch.setattr(graph, "BUCKET_ROWS", rows)
    monkeypatch.setattr(graph, "MAX_BUCKETS", most)
    names = sorted({x for pair in LAYERS for x in pair} | {"alone"})
    want = brandes(LAYERS, names)
    v = spark.createDataFrame([(x,) for x in names] * 2 + [(None,)], "ip string")
    w = spark.createDataFrame([*LAYERS, *LAYERS[:5], (None, "s1"), ("s1", None)], "src string, dst string")
    got = {r.ip: r.betweenness for r in graph.betweenness(v, w, "exact", 1, 3, held).collect()}
    assert got == {**{x: pytest.approx(want[x]) for x in names}, None: 0.0}
    none = graph.betweenness(v, w.limit(0), "exact", held=held).collect()
    assert {r.betweenness for r in none} == {0.0} and len(none) == len(names) + 1


def test_what_a_level_meets_over_its_edges_does_not_move(spark, monkeypatch):
    """Every path of a search is a row there: only the sums of these are dealt, also when the
    tables are too large to go to every task."""
    moved = []
    for name in ("materialize", "materialize_dealt"):
        def watched(df, label, *rest, real=getattr(graph, name)):
            if label in ("dependency", "betweenness"):
                plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
                moved.extend(below for line, below in zip(plan, plan[1:]) if " Exchange hashpartitioning" in line)
            return real(df, label, *rest)
        monkeypatch.setattr(graph, name, watched)
    v = spark.createDataFrame([(x,) for x in sorted({x for pair in LAYERS for x in pair})], "ip string")
    w = spark.createDataFrame(LAYERS, "src string, dst string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph.betweenness(v, w, "exact").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and all("HashAggregate" in below for below in moved)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "true"


@pytest.mark.parametrize("salt", [200_000, 1])
def test_pagerank_fixed_point(spark, salt):
    pairs = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0)]
    names = ["a", "b", "c", "lone"]
    x = {k: 0.25 for k in names}
    for _ in range(200):
        lost = x["c"] + x["lone"]
        base = 0.15 / 4 + 0.85 * lost / 4
        x = {"a": base, "lone": base, "b": base + 0.85 * x["a"] * 2 / 3, "c": base + 0.85 * (x["a"] / 3 + x["b"])}
    v = spark.createDataFrame([(k,) for k in names], "ip string")
    w = spark.createDataFrame(pairs, "src string, dst string, weight double")
    got = {r[0]: r[1] for r in graph.pagerank(v, w, salt_rows=salt).collect()}
    assert got == {k: pytest.approx(x[k], abs=1e-6) for k in names}


def test_mission_depths(spark):
    e = spark.createDataFrame([edge("2", "1"), edge("3", "2"), edge("4", "4"), edge("5", "1", evidence="port-only")], EDGE)
    n = spark.createDataFrame([(x,) for x in "12345"], "ip string")
    scope = spark.createDataFrame([("1",), ("unknown",)], "ip string")
    out = graph.mission_proximity(n, e, scope)
    assert rows(out.select("ip", "depth")) == [("1", 0), ("2", 1), ("3", 2)]


def test_displacement_first_previous_provider(spark):
    old = spark.createDataFrame([edge("10.1.0.1", "10.0.0.9", 53), edge("10.1.0.1", "10.0.0.10", 53)], EDGE)
    new = spark.createDataFrame([edge("10.1.0.1", "10.0.0.7", 53), edge("10.1.0.2", "10.0.0.7", 53)], EDGE)
    n = spark.createDataFrame([("10.0.0.7", 3)], "ip string, rank int")
    r = drift.displacement(old, new, n).first()
    assert (r.clients_added, [tuple(m) for m in r.migrated_from], r.rank) == (1, [("10.0.0.9", 53, 1)], 3)


def test_asset_list_without_header(spark):
    cells = spark.createDataFrame([(1, "x", "10.0.0.1"), (2, "y", "10.0.0.2"), (3, "z", "bad")], "row bigint, c0 string, c1 string")
    good, bad = assets.parse(cells)
    assert rows(good.select("ip")) == [("10.0.0.1",), ("10.0.0.2",)] and bad.count() == 1
    assert assets.header_columns(["Description", "MAC Address", "IP"]) == {"ip": 2, "role": 0}


ROUTER = """hostname r1
username admin secret 5 topsecret
interface Vlan10
 ip address 10.0.1.1 255.255.255.0
 ip access-group IN in
ip access-list extended IN
 deny tcp any host 10.9.9.9 eq 445
 permit tcp 10.0.1.0 0.0.0.255 any range 90 80
 permit tcp any eq 53 any
 permit tcp any 10.0.0.0 0.255.0.255
 permit gre any any
 permit tcp any any neq 5
 permit tcp any any eq www
access-list 10 permit 10.2.0.0 0.0.255.255
"""


def test_router_rules(spark):
    t = configs.ios_tables(spark.createDataFrame([("r1.cfg", ROUTER)], "source string, content string"))
    got = {(r.ruleset, r.idx): (r.action, r.r_src, r.r_dst, r.port_lo, r.port_hi, r.caveat) for r in t["rules"].collect()}
    assert got[("IN", 0)] == ("deny", "0.0.0.0/0", "10.9.9.9/32", 445, 445, "")
    assert got[("IN", 1)] == ("permit", "10.0.1.0/24", "0.0.0.0/0", 80, 90, "")
    assert got[("IN", 2)][5] == configs.SOURCE_PORT
    assert got[("IN", 3)][5] == "discontiguous wildcard"
    assert got[("IN", 4)][5] == "unsupported protocol"
    assert got[("IN", 5)][5] == "neq unsupported"
    assert got[("IN", 6)][5] == "named port unresolved"
    assert got[("10", 0)][:3] == ("permit", "10.2.0.0/16", "0.0.0.0/0")
    assert not any("topsecret" in str(v) for df in t.values() for r in df.collect() for v in r)


def test_zone_policy_rules(spark):
    doc = """{"data":[{"id":"n1","name":"lan","vlanId":1,"management":"GATEWAY","enabled":true,
      "ipv4Configuration":{"hostIpAddress":"10.0.1.1","prefixLength":24}},
     {"id":"z1","name":"Inside","networkIds":["n1"]},{"id":"z2","name":"Outside","networkIds":["gone"]},
     {"id":"p1","name":"web","enabled":true,"index":7,"action":{"type":"BLOCK"},"source":{"zoneId":"z1"},
      "destination":{"zoneId":"z1","trafficFilter":{"type":"IP_ADDRESS","ipAddressFilter":{"type":"IP_ADDRESSES",
       "items":[{"type":"IP_ADDRESS","value":"10.9.0.1"}]},"portFilter":{"type":"PORTS","items":[
       {"type":"PORT_NUMBER","value":80},{"type":"PORT_NUMBER_RANGE","start":90,"stop":95}]}}},
      "ipProtocolScope":{"protocolFilter":{"type":"PRESET","preset":{"name":"TCP_UDP"}}}},
     {"id":"p2","name":"odd","enabled":true,"action":{"type":"ALLOW"},"source":{"zoneId":"z2"},"destination":{"zoneId":"z1"}}]}"""
    t = configs.controller_tables(spark.createDataFrame([("ctl", "f", doc)], "source string, file string, content string"))
    got = t["rules"].collect()
    blocked = sorted((r.r_proto, r.r_src, r.r_dst, r.port_lo, r.port_hi) for r in got if r.action == "deny")
    assert blocked == [(p, "10.0.1.1/24", "10.9.0.1/32", lo, hi) for p in ("tcp", "udp") for lo, hi in ((80, 80), (90, 95))]
    assert [r.caveat for r in got if r.action == "permit"] == ["firewall zone includes an unresolved network"]


def test_unknown_is_not_contradicted(spark):
    docs = spark.createDataFrame([("1", "h", "DNS"), ("2", "h", "DNS")], "ip string, hostname string, role string")
    n = spark.createDataFrame([("1", [("Unknown",)]), ("2", [("Camera",)])], "ip string, roles array<struct<role:string>>")
    assert rows(reconcile.contradicted(docs, n).select("ip")) == [("2",)]
    assert rows(reconcile.contradicted(docs, n, True).select("ip")) == [("1",), ("2",)]
