"""Investigation leads on small networks with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyscape.operators import leads
from keyscape.plans.hunt import hunt

NODE = ("ip string, hostnames array<string>, subnet string, "
        "roles array<struct<role:string,confidence:double,evidence:array<string>>>, rank int")
EDGE = ("src string, dst string, port int, proto string, service string, evidence string, conn_count bigint, "
        "first_seen timestamp, last_seen timestamp, sensors array<string>")
VIOLATION = ("device string, source string, ruleset string, line int, raw string, src string, dst string, port int, proto string, "
             "confidence string, service string, evidence string, conn_count bigint, first_seen timestamp, last_seen timestamp")
T0 = datetime(2026, 7, 1, 8)
SURE, ANSWERED, TRIED = "protocol-confirmed", "responder-confirmed", "port-only"


class Net:
    def __init__(self, spark, ranks, flows):
        """``ranks``: {ip: rank}; ``flows``: (src, dst, port, evidence)."""
        self.spark = spark
        self.nodes = spark.createDataFrame(
            [(ip, [], ip.rsplit(".", 1)[0] + ".0/24", [], r) for ip, r in ranks.items()], NODE)
        self.edges = spark.createDataFrame(
            [(s, d, p, "tcp", "", e, 1, T0, T0, ["s1"]) for s, d, p, e in flows], EDGE)

    def leads(self, new=(), undocumented=None, contradicted=None, denied=None, approved=None):
        table = lambda rows, ddl: None if rows is None else self.spark.createDataFrame(rows, ddl)
        out = hunt(
            self.nodes, self.edges, table(list(new), "ip string, port int, new_host boolean"),
            table(None if undocumented is None else [(x,) for x in undocumented], "ip string"),
            table(None if contradicted is None else [(x,) for x in contradicted], "ip string"),
            table(denied, VIOLATION), table(None if approved is None else [(x,) for x in approved], "provider string"))
        return leads.ordered(out).collect()


@pytest.fixture
def two_resolvers(spark):
    """Two name servers without a common client."""
    return Net(spark, {"10.0.1.11": 3, "10.0.1.99": 40, "10.0.3.30": 0, "10.0.3.31": 0, "10.0.4.40": 0}, [
        ("10.0.3.30", "10.0.1.11", 53, SURE), ("10.0.3.31", "10.0.1.11", 53, SURE), ("10.0.4.40", "10.0.1.99", 53, SURE)])


def test_the_only_provider_of_a_service(spark):
    net = Net(spark, {"10.0.1.11": 3, "10.0.3.30": 0, "10.0.9.90": 0}, [
        ("10.0.3.30", "10.0.1.11", 53, SURE), ("10.0.9.90", "10.0.1.11", 53, TRIED)])
    (lead,) = net.leads()
    assert (lead.reason, lead.priority, lead.ip, lead.port, lead.service) == ("sole-provider", 3, "10.0.1.11", 53, "dns")
    # an attempt that nothing answered is no client
    assert (lead.subnets, lead.sample_clients, lead.clients) == (["10.0.3.0/24"], ["10.0.3.30"], 1)
    assert lead["query"] == 'destination.ip:"10.0.1.11" AND destination.port:53'
    assert net.leads(approved=["10.0.1.11:53"]) == []
    assert len(net.leads(approved=["10.0.1.11:88", "10.0.1.1:53"])) == 1


def test_two_providers_are_no_lead_by_themselves(two_resolvers):
    assert two_resolvers.leads() == []
    found = two_resolvers.leads(undocumented=["10.0.1.11", "10.0.1.99"])
    assert [(x.ip, x.alternate_providers) for x in found] == [("10.0.1.11", []), ("10.0.1.99", [])]


def test_alternates_of_providers_with_a_common_client(spark):
    net = Net(spark, {"10.0.1.11": 0, "10.0.1.12": 0, "10.0.3.30": 0, "10.0.3.31": 0}, [
        ("10.0.3.30", "10.0.1.11", 53, SURE), ("10.0.3.31", "10.0.1.11", 53, SURE), ("10.0.3.30", "10.0.1.12", 53, SURE)])
    found = {x.ip: x.alternate_providers for x in net.leads(undocumented=["10.0.1.11", "10.0.1.12"])}
    assert found == {"10.0.1.11": ["10.0.1.12:53"], "10.0.1.12": ["10.0.1.11:53"]}


def test_new_hosts_and_new_services(two_resolvers):
    found = two_resolvers.leads(new=[("10.0.1.99", 53, True), ("10.0.1.11", 53, False), ("10.0.1.55", 53, True)])
    assert {x.ip: x.reason for x in found} == {"10.0.1.99": "new-provider", "10.0.1.11": "new-service"}


def test_the_best_reason_and_the_inventory(two_resolvers):
    found = two_resolvers.leads(undocumented=["10.0.1.99"], contradicted=["10.0.1.11"])
    assert [(x.ip, x.reason, x.inventory_status) for x in found] == [
        ("10.0.1.11", "contradicted", "contradicted"), ("10.0.1.99", "undocumented", "undocumented")]
    found = two_resolvers.leads(new=[("10.0.1.11", 53, False)], undocumented=["10.0.1.11"], contradicted=["10.0.1.11"])
    assert [(x.ip, x.reason, x.inventory_status) for x in found] == [("10.0.1.11", "contradicted", "contradicted")]
    found = two_resolvers.leads(new=[("10.0.1.11", 53, False)], undocumented=["10.0.1.11"])
    assert [(x.reason, x.inventory_status) for x in found] == [("undocumented", "undocumented")]


def violation(src, evidence, seen, confidence="full", dst="10.0.1.99", port=445, service="smb"):
    return ("edge-rtr", "/etc/configs/edge.cfg", "EDGE_IN", 10, "deny tcp any host 10.0.1.99 eq 445", src, dst, port, "tcp",
            confidence, service, evidence, 1, seen, seen)


def test_denied_flows_are_one_lead_of_their_responder(spark):
    net = Net(spark, {"10.0.1.99": 0, "10.0.3.30": 0, "10.0.3.31": 0}, [])
    later = T0 + timedelta(hours=1)
    denied = [violation("10.0.3.30", ANSWERED, T0), violation("10.0.3.31", SURE, later), violation("10.0.3.31", TRIED, T0)]
    (lead,) = net.leads(denied=denied)
    assert (lead.reason, lead.priority, lead.ip, lead.port, lead.clients, lead.service) == (
        "policy-denied", 0, "10.0.1.99", 445, 2, "smb")
    assert lead.rule_evidence == "edge-rtr edge.cfg:10 — deny tcp any host 10.0.1.99 eq 445"
    assert (lead.first_seen, lead.last_seen, lead.evidence) == (T0, later, SURE)
    assert lead.sample_clients == ["10.0.3.30", "10.0.3.31"] and lead.subnets == [] and lead.hostname == ""
    assert net.leads(denied=denied, approved=["10.0.1.99:445"]) == [] and net.leads() == []
    (part,) = net.leads(denied=[violation("10.0.3.30", ANSWERED, T0, "partial", service="")])
    assert part.rule_evidence.endswith(" (confidence: partial)") and part.service == "smb"


def test_rule_evidence_stays_with_a_reason_of_the_same_priority(spark):
    net = Net(spark, {"10.0.1.99": 0, "10.0.3.30": 0}, [("10.0.3.30", "10.0.1.99", 445, SURE)])
    (lead,) = net.leads(denied=[violation("10.0.3.30", SURE, T0)])
    assert (lead.reason, lead.clients) == ("policy-denied", 1) and lead.rule_evidence
    (lead,) = net.leads(contradicted=["10.0.1.99"], denied=[violation("10.0.3.30", SURE, T0)])
    assert lead.reason == "contradicted" and lead.rule_evidence and lead.inventory_status == "contradicted"


def test_order(spark):
    """Reason, then evidence, clients, subnets, rank (unranked last), address, port."""
    clients = [f"10.0.{k}.{h}" for k in (3, 4) for h in (1, 2)]
    flows = [(c, "10.0.1.20", 445, ANSWERED) for c in clients[:3]] + [(clients[0], "10.0.1.11", 53, SURE)]
    net = Net(spark, {**{c: 0 for c in clients}, "10.0.1.11": 0, "10.0.1.20": 0}, flows)
    assert [(x.ip, x.reason) for x in net.leads(contradicted=["10.0.1.11"])] == [
        ("10.0.1.11", "contradicted"), ("10.0.1.20", "sole-provider")]
    flows = [(clients[0], f"10.0.1.{k}", 53, SURE if k != 3 else ANSWERED) for k in (1, 2, 3, 4, 5, 6)]
    flows += [(clients[1], "10.0.1.4", 53, SURE), (clients[1], "10.0.1.5", 53, SURE), (clients[2], "10.0.1.6", 53, SURE)]
    net = Net(spark, {**{c: 0 for c in clients}, **{f"10.0.1.{k}": r for k, r in ((1, 0), (2, 9), (3, 1), (4, 5), (5, 4), (6, 99))}}, flows)
    found = net.leads(undocumented=[f"10.0.1.{k}" for k in range(1, 7)])
    assert [x.ip[-1] for x in found] == ["6", "5", "4", "2", "1", "3"]


def test_many_clients_are_sampled_in_order(spark):
    net = Net(spark, {"10.0.1.11": 1}, [(f"10.0.3.{k}", "10.0.1.11", 53, SURE) for k in range(9, 0, -1)])
    (lead,) = net.leads()
    assert lead.clients == 9 and lead.sample_clients == [f"10.0.3.{k}" for k in range(1, 6)]
    assert net.edges.select(F.countDistinct("src")).first()[0] == 9
