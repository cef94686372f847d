"""Telemetry projected from the retail tables, used by the checked queries.

One client-to-server connection per line item joined to its order, plus one
server-to-server connection for each line item of an urgent order. Protocol
logs, certificates, leases, asset lists and device configs are derived from the
same rows, so all inputs grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = [88, 389, 53, 445, 5432, 443, 22, 9100, 554, 25, 5246, 67, 123, 3389, 1433,
         51515]
#: Servers 41, 42, ... alone provide these.
SOLE_PORTS = [1521, 3306, 6379, 9200, 9092, 2049]
#: Servers 51 to 56 provide this from the second snapshot on.
LATE_PORT = 636
GATEWAY_MAC = "00:00:0c:00:00:01"
SNAPSHOT_STARTS = ["1997-07-01", "2000-01-01"]
SCOPE = ["10.0.0.0/16", "10.1.0.0/16", "10.9.0.0/24"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b))


def host_of(key: Column) -> Column:
    """Address of server ``key``, with a few non-hosts mixed in."""
    tail = key % 100
    return (
        F.when(tail == 97, "224.0.0.251")
        .when(tail == 98, "255.255.255.255")
        .when(tail == 99, "8.8.8.8")
        .otherwise(server_ip(key))
    )


def server_ip(key: Column) -> Column:
    return F.concat_ws(".", F.lit("10.0"), _div(key, 25) % 250, 10 + key % 25)


def client_ip(c: Column) -> Column:
    return F.concat_ws(
        ".", F.lit("10"), 1 + c % 3, _div(c, 200) % 250, 10 + c % 200
    )


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection log. One scan of each table, both kinds from one row."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    c, s, p, k = (F.col(x) for x in ("o_custkey", "l_suppkey", "l_partkey", "l_orderkey"))
    client = F.struct(client_ip(c).alias("src"), s.alias("dk"))
    server = F.struct(
        server_ip(s).alias("src"),
        F.when(s % 25 == 0, 6 + 16 * (p % 6)).otherwise(p % 40).alias("dk"),
    )
    kinds = F.when(F.col("urgent"), F.array(client, server)).otherwise(F.array(client))
    rows = (
        items.join(orders, k == F.col("o_orderkey"))
        .select("*", F.explode(kinds).alias("e"))
        .select("*", F.col("e.src").alias("src"), F.col("e.dk").alias("dk"))
    )
    dk, d = F.col("dk"), F.col("l_shipdate").cast("timestamp")
    weekend = F.dayofweek(d).isin(1, 7)
    base = F.when((dk % 5 == 0) & weekend, d - F.expr("INTERVAL 2 DAYS")).otherwise(d)
    hour = (
        F.when(dk % 5 == 0, 9 + k % 8)
        .when(dk % 5 == 1, 22 + k % 2)
        .when(dk % 5 == 2, F.lit(14))
        .when(dk % 5 == 3, k % 24)
        .otherwise(k % 12)
    )
    listed = lambda values, at: F.element_at(
        F.array(*[F.lit(x) for x in values]), at.cast("int"))
    late = dk.between(51, 56) & (d >= F.lit(SNAPSHOT_STARTS[0]).cast("timestamp"))
    port = (
        F.when(dk.between(41, 46), listed(SOLE_PORTS, F.least(F.greatest(dk - 40, F.lit(1)), F.lit(6))))
        .when(late, F.lit(LATE_PORT)).otherwise(listed(PORTS, dk % 16 + 1))
    )
    flag = F.col("l_returnflag")
    return rows.select(
        (base + F.make_dt_interval(hours=hour.cast("int"))).alias("ts"),
        F.lit("conn").alias("dataset"),
        "src",
        host_of(dk).alias("dst"),
        port.alias("port"),
        F.when(dk % 7 == 6, F.lit(None))
        .when((dk % 16).isin(2, 11, 12), "udp")
        .otherwise("tcp")
        .alias("proto"),
        F.when(flag == "A", "SF").when(flag == "N", "S0").otherwise("REJ").alias("state"),
        F.when((flag == "A") & (F.col("l_linestatus") == "F"), "app")
        .when(flag == "R", "-")
        .otherwise("")
        .alias("service"),
        F.floor("l_extendedprice").alias("bytes_out"),
        F.when(flag == "A", F.col("l_quantity").cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("bytes_in"),
        F.concat(F.lit("sensor-"), (k % 4).cast("string")).alias("sensor"),
        F.when(dk % 3 == 0, GATEWAY_MAC)
        .otherwise(
            F.concat(F.lit("24:5a:4c:00:00:"), F.lpad((dk % 100).cast("string"), 2, "0"))
        )
        .alias("dst_mac"),
        c.alias("c"),
        k.alias("k"),
        dk.alias("dk"),
        F.when(d < F.lit(SNAPSHOT_STARTS[0]).cast("timestamp"), 1)
        .when(d < F.lit(SNAPSHOT_STARTS[1]).cast("timestamp"), 2)
        .otherwise(3)
        .alias("snapshot"),
    )


_KINDS = {
    "kerberos": lambda port, k: port == 88,
    "ldap": lambda port, k: port.isin(88, 389),
    "dns": lambda port, k: port == 53,
    "smb": lambda port, k: port == 445,
    "ssl": lambda port, k: port == 443,
    "http": lambda port, k: (port == 443) & (k % 2 == 0),
    "dhcp": lambda port, k: port == 67,
}


def protocol_logs(log: DataFrame) -> DataFrame:
    """Responder and client of every protocol log, one pass over ``conn``."""
    port, k = F.col("port"), F.col("k")
    kinds = F.array(*[F.when(test(port, k), name) for name, test in _KINDS.items()])
    return log.select(
        F.explode(kinds).alias("kind"),
        F.col("dst").alias("responder"),
        F.col("src").alias("client"),
        "ts",
        "snapshot",
    ).filter(F.col("kind").isNotNull())


def leases(log: DataFrame) -> DataFrame:
    """Lease log: client address, hostname and hardware address."""
    return log.filter(F.col("port") == 67).select(
        F.col("dst").alias("dhcp_server"),
        F.col("src").alias("assigned_ip"),
        F.concat(F.lit("h"), (F.col("k") % 50).cast("string")).alias("lease_hostname"),
        F.concat(F.lit("b8:27:eb:00:00:"), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
        .alias("lease_mac"),
        "snapshot",
    )


def server_names(log: DataFrame) -> DataFrame:
    return log.filter(F.col("port") == 443).select(
        "dst",
        F.concat(F.lit("host"), F.col("dk").cast("string"), F.lit(".corp.example"))
        .alias("server_name"),
        "snapshot",
    )


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate document per supplier; key 1 holds a wildcard."""
    s = F.col("s_suppkey").cast("string")
    san = F.when(F.col("s_suppkey") == 1, F.lit("*.corp.example")).otherwise(
        F.concat(F.lit("Host"), s, F.lit(".corp.example"))
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit('{"fingerprint":"fp-'), s, F.lit('"}')).alias("message"),
        F.array(san).alias("san_dns"),
        F.concat(F.lit("O=Corp, CN=Web"), s, F.lit(".corp.example")).alias("subject"),
    )


def host_keys(log: DataFrame) -> DataFrame:
    dk = F.col("dk")
    version = F.when(dk % 32 == 6, F.col("snapshot")).otherwise(F.lit(0))
    return log.filter(F.col("port") == 22).select(
        "dst",
        F.concat_ws("-", F.lit("key"), dk.cast("string"), version.cast("string")).alias(
            "host_key"
        ),
        "snapshot",
    )
