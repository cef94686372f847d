"""Derived inputs of the checked queries: snapshots, assets, overlays, configs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyscape.operators import edges as E
from keyscape.plans.scan import ScanOptions, Telemetry, scan
from keyscape.session import materialize
from keyscape.sources import configs
from keyscape.testbed import projection as P


def conn(spark: SparkSession, sf_dir: str, snapshot: int | None = None) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    log = P.conn(spark, sf_dir)
    return log if snapshot is None else log.filter(F.col("snapshot") == snapshot)


def edges(spark: SparkSession, sf_dir: str, snapshot: int | None = None) -> DataFrame:
    return E.aggregate_edges(conn(spark, sf_dir, snapshot))


def stored_edges(spark: SparkSession, sf_dir: str, snapshot: int | None = None) -> DataFrame:
    return materialize(edges(spark, sf_dir, snapshot), "edges")


def telemetry(spark: SparkSession, sf_dir: str, snapshot: int | None = None) -> Telemetry:
    """All logs of one scan. They come from one table that is written first: a scan reads it
    some ten times, and each would join the retail tables anew."""
    log = materialize(conn(spark, sf_dir, snapshot), "log")
    return Telemetry(
        conn=log, logs=P.protocol_logs(log), leases=P.leases(log), ssl=P.server_names(log),
        certs=P.certificates(spark, sf_dir), ssh=P.host_keys(log))


def snapshot(spark: SparkSession, sf_dir: str, number: int | None = None, **options) -> dict[str, DataFrame]:
    """Snapshot without centrality, so that plain SQL can state its ranks."""
    chosen = {"centrality": False, "temporal_top": 0, "metadata": False,
              "created_at": f"200{number or 9}-01-01 00:00:00", "cluster": "grid",
              "window": f"{(number or 0) + 1}h0m0s", **options}
    tables = scan(telemetry(spark, sf_dir, number), ScanOptions(**chosen))
    return {**tables, "nodes": materialize(tables["nodes"], "snapshot-nodes")}


def scope(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in P.SCOPE], "cidr string")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset list rows: most suppliers, and as many silent hosts as every
    tenth supplier."""
    s = F.col("s_suppkey")
    role = F.element_at(F.array(*[F.lit(x) for x in (
        "Domain Controller", "Primary DNS", "SQL DB", "printer", "")]), (s % 5 + 1).cast("int"))
    sup = P.table(spark, sf_dir, "supplier")
    silent = s % 10 == 9
    return sup.select(
        F.when(silent, F.concat_ws(".", F.lit("10.9.0"), F.floor(s / F.lit(10)) % 250)).otherwise(P.server_ip(s)).alias("ip"),
        F.col("s_name").alias("hostname"), role.alias("role"),
        F.when(s % 25 == 0, F.concat(F.lit("seg-"), F.floor(s / F.lit(25)).cast("string"))).otherwise("").alias("segment"),
        s.alias("row"),
    ).withColumn("_n", F.lit(1)).groupBy("ip").agg(
        F.min_by("hostname", "row").alias("hostname"), F.min_by("role", "row").alias("role"),
        F.min_by("segment", "row").alias("segment"), F.min("row").alias("row"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator devices: pairs of neighbouring suppliers' addresses."""
    s = F.col("s_suppkey")
    pair = F.floor(s / F.lit(2))
    return P.table(spark, sf_dir, "supplier").filter(s % 10 < 4).select(
        pair.alias("device_id"), F.concat(F.lit("dev-"), pair.cast("string")).alias("device"),
        F.lit("server").alias("device_type"), P.server_ip(s).alias("ip"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return P.table(spark, sf_dir, "supplier").filter(s % 10 == 5).select(
        P.server_ip(s).alias("ip"),
        F.when(s % 20 == 5, "Printer").otherwise(F.concat(F.lit("box-"), (s % 3).cast("string"))).alias("role_override"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return P.table(spark, sf_dir, "supplier").select(
        P.server_ip(s).alias("ip"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("label"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two /25 halves and one /16 around every server subnet."""
    n = F.floor(F.col("s_suppkey") / F.lit(25)) % 250
    halves = F.array(
        F.struct(F.concat(F.lit("10.0."), n.cast("string"), F.lit(".0/27")).alias("cidr"),
                 F.concat(F.lit("low-"), n.cast("string")).alias("name")),
        F.struct(F.concat(F.lit("10.0."), n.cast("string"), F.lit(".32/27")).alias("cidr"), F.lit("").alias("name")),
        F.struct(F.lit("10.1.0.0/16").alias("cidr"), F.lit("clients").alias("name")))
    return P.table(spark, sf_dir, "supplier").select(F.explode(halves).alias("h")).select("h.*").distinct()


def router_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One router config text per client subnet."""
    c = F.col("c_custkey")
    r, b = 1 + c % 3, F.floor(c / F.lit(200)) % 250
    nets = P.table(spark, sf_dir, "customer").select(r.alias("r"), b.alias("b")).distinct()
    r, b = F.col("r").cast("string"), F.col("b").cast("string")
    vague = F.when(F.col("b") % 2 == 0, F.lit(" permit tcp any any established\n")).otherwise("")
    text = F.concat(
        F.lit("! edge router\nhostname edge-"), r, F.lit("-"), b,
        F.lit("\nenable secret 5 hidden\ninterface Gi0\n description uplink\n ip address 10."), r, F.lit("."), b,
        F.lit(".1 255.255.255.0\n ip access-group EDGE in\ninterface Gi1\n ip address 172.16."), b,
        F.lit(".1 255.255.255.0\n shutdown\n!\nip access-list extended EDGE\n deny tcp any any eq 445\n"
              " permit tcp any 10.0.0.0 0.0.255.255 range 443 80\n permit udp any host 8.8.8.8 gt 100\n"),
        vague, F.lit(" permit tcp any 10.0."), b, F.lit(".0 0.0.0.255 eq 22\n permit icmp any any\n"
                                                        "ip route 10.9.0.0 255.255.255.0 10."), r, F.lit("."), b,
        F.lit(".254\n"))
    return nets.select(F.concat(F.lit("edge-"), r, F.lit("-"), b, F.lit(".cfg")).alias("source"), text.alias("content"))


def controller_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One controller export per server subnet: network, rules, switch."""
    n = F.floor(F.col("s_suppkey") / F.lit(25)) % 250
    nets = P.table(spark, sf_dir, "supplier").select(n.alias("n")).distinct()
    t, guest = F.col("n").cast("string"), F.col("n") % 3 == 2
    text = F.concat(
        F.lit('{"data":[{"_id":"net-'), t, F.lit('","purpose":"'), F.when(guest, "guest").otherwise("corporate"),
        F.lit('","ip_subnet":"10.0.'), t, F.lit('.1/24","name":"lan-'), t, F.lit('","vlan":'), t,
        F.lit('},{"ruleset":"LAN_IN","action":"drop","enabled":true,"src_networkconf_id":"net-'), t,
        F.lit('","dst_address":"10.0.0.0/24","protocol":"tcp_udp","dst_port":"90-22","rule_index":'), t,
        F.lit('},{"ruleset":"GUEST_IN","action":"reject","enabled":true,"protocol":"udp","dst_port":"53","rule_index":'), t,
        F.lit('},{"ruleset":"LAN_IN","action":"accept","enabled":true,"src_networkconf_id":"gone","rule_index":'), t,
        F.lit('},{"ruleset":"LAN_IN","action":"accept","enabled":false,"rule_index":1},'
              '{"mac":"24:5A:4C:00:00:0'), (F.col("n") % 10).cast("string"),
        F.lit('","type":"usw","model":"USW","name":"sw-'), t, F.lit('","ip":"10.0.'), t,
        F.lit('.10","x_authkey":"hidden"},{"odd":1}]}'))
    return nets.select(F.concat(F.lit("net-"), F.lpad(t, 3, "0"), F.lit(".json")).alias("source"), text.alias("content"))


INVENTORY = ("devices", "interfaces", "prefixes", "vlans")
POLICY = (*INVENTORY, "bindings", "rulesets", "rules")


def declared(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    files = router_files(spark, sf_dir).unionByName(controller_files(spark, sf_dir))
    return configs.ingest(files, controller="ctl", tables=tables)
