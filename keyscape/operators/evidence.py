"""Per-responder evidence and identity taken from the protocol logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import text
from keyscape.session import materialize


def top_values(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values per group, ties by value. Counting comes
    first and the rank limit also applies before the shuffle."""
    return _first_by_count(df.groupBy(*group, value).agg(F.count("*").alias("n")), group, value, k)


def _first_by_count(counts: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def responder_clients(logs: DataFrame) -> DataFrame:
    """Distinct clients per (kind, responder), without samples: one pass, nothing written."""
    keys = ["kind", "responder"]
    pairs = logs.filter(F.col("responder").isNotNull()).select(*keys, "client").distinct()
    return pairs.groupBy(*keys).agg(F.count("client").alias("clients"))


def responder_cardinality(
    logs: DataFrame, samples: int = config.SAMPLE_HOSTS, approximate: bool = False
) -> DataFrame:
    """Distinct clients and a few sample clients per (kind, responder)."""
    logs = logs.filter(F.col("responder").isNotNull())
    keys = ["kind", "responder"]
    if approximate:
        clients = logs.groupBy(*keys).agg(
            F.approx_count_distinct("client").alias("clients")
        )
    else:
        # read for the number of clients and again for the most frequent ones
        counts = materialize(logs.groupBy(*keys, "client").agg(F.count("*").alias("n")), "clients")
        clients = counts.groupBy(*keys).agg(F.count("client").alias("clients"))
    known = F.col("client").isNotNull()
    best = (
        (top_values(logs.filter(known), keys, "client", samples) if approximate
         else _first_by_count(counts.filter(known), keys, "client", samples))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "client"))).alias("s"))
        .select(*keys, F.transform("s", lambda e: e["client"]).alias("sample_hosts"))
    )
    return clients.join(best, keys, "left")


def address_counts(conn: DataFrame) -> DataFrame:
    """Rows of the log per (sensor, hardware address, responder): what gateways and hardware
    addresses of nodes are made of."""
    return conn.filter(F.col("dst_mac").isNotNull() & F.col("dst").isNotNull()).groupBy(
        "sensor", "dst", "dst_mac").agg(F.count("*").alias("n"))


def gateway_candidates(conn: DataFrame, min_ips: int = config.GATEWAY_MIN_IPS) -> DataFrame:
    """Hardware addresses that answered for many addresses on one sensor."""
    pairs = (
        conn.filter(F.col("dst_mac").isNotNull() & F.col("dst").isNotNull())
        .select(
            F.coalesce("sensor", F.lit("")).alias("sensor"),
            F.col("dst_mac").alias("mac"),
            "dst",
        )
        .distinct()
    )
    return (
        pairs.groupBy("sensor", "mac")
        .agg(F.count("*").alias("ip_count"))
        .filter(F.col("ip_count") >= min_ips)
    )


def _most_seen(counts: DataFrame, key: str, value: str) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(value))


def node_macs(conn: DataFrame, min_ips: int = config.GATEWAY_MIN_IPS) -> DataFrame:
    """Most seen hardware address per responder. A responder whose best address
    serves many others has none: it sits behind a gateway."""
    return macs_of(address_counts(conn).groupBy("dst", "dst_mac").agg(F.sum("n").alias("n")), min_ips)


def macs_of(counts: DataFrame, min_ips: int = config.GATEWAY_MIN_IPS) -> DataFrame:
    """The same from counts (dst, dst_mac, n)."""
    shared = (
        counts.groupBy("dst_mac").agg(F.count("*").alias("ips")).filter(F.col("ips") >= min_ips)
    )
    best = _most_seen(counts, "dst", "dst_mac")
    return best.join(shared, "dst_mac", "left_anti").select(
        F.col("dst").alias("ip"), F.col("dst_mac").alias("mac")
    )


def dhcp_leases(leases: DataFrame) -> DataFrame:
    """Most seen hostname and, independently, hardware address per lease."""
    entry = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.col(column).alias("v"))
    counts = (
        leases.filter(F.col("assigned_ip").isNotNull())
        .select("assigned_ip", F.inline(F.array(entry("host", "lease_hostname"), entry("mac", "lease_mac"))))
        .filter(F.coalesce("v", F.lit("")) != "")
        .groupBy("assigned_ip", "kind", "v")
        .agg(F.count("*").alias("n"))
    )

    def best(kind: str) -> Column:
        seen = F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("n"), "v"))
        return F.coalesce(F.min(seen)["v"], F.lit(""))

    return counts.groupBy(F.col("assigned_ip").alias("ip")).agg(
        best("host").alias("hostname"), best("mac").alias("mac"))


def tls_names(ssl: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (responder, server name), restricted to known nodes."""
    pairs = ssl.filter(
        (F.coalesce(F.col("dst"), F.lit("")) != "")
        & (F.coalesce(F.col("server_name"), F.lit("")) != "")
    ).select("dst", "server_name").distinct()
    if nodes is not None:
        pairs = pairs.join(nodes.select(F.col("ip").alias("dst")), "dst", "left_semi")
    return pairs


def certificates(docs: DataFrame) -> DataFrame:
    """One row per fingerprint with its sorted lower-cased names."""
    parsed = docs.select(
        text.x509_fingerprint("message").alias("fingerprint"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        text.certificate_names("san_dns", "subject").alias("names"),
    ).filter(F.col("fingerprint") != "")
    best = F.min(F.struct("subject", "names"))
    return parsed.groupBy("fingerprint").agg(best.alias("b")).select("fingerprint", "b.*")


#: Globs without any literal text are tried on every name, dealt to so many tasks.
WILD_SHARDS = 64


def matched_patterns(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (name, pattern) where the pattern is the name or a glob that matches it.

    A glob is looked up by text that it demands of a name: its dotted ending, or the start
    of its longest literal piece; names have all keys of both kinds. So it only meets names
    with that text. A glob that demands nothing has to meet every name: names are then dealt
    to ``WILD_SHARDS`` groups, each with all such globs. Malformed globs match nothing.
    """
    known = names.select("name").distinct()
    listed = patterns.select("pattern").distinct()
    exact = known.join(listed, F.col("pattern") == F.col("name")).select("name", "pattern")
    globs = listed.filter(F.col("pattern").contains("*") & text.glob_is_valid("pattern")).withColumn(
        "_key", text.glob_key("pattern"))
    keyed = known.select("name", F.explode(text.glob_keys_of("name")).alias("_key")).join(
        globs.filter("_key IS NOT NULL"), "_key")
    shards = F.sequence(F.lit(0), F.lit(WILD_SHARDS - 1))
    wild = known.withColumn("_shard", F.pmod(F.xxhash64("name"), F.lit(WILD_SHARDS)).cast("int")).join(
        globs.filter("_key IS NULL").select("pattern", F.explode(shards).alias("_shard")), "_shard")
    found = keyed.select("name", "pattern").unionByName(wild.select("name", "pattern"))
    return exact.unionByName(found.filter(text.glob_match("pattern", "name"))).distinct()


def tls_fingerprints(names: DataFrame, certs: DataFrame) -> DataFrame:
    """Certificates per responder: a certificate name equals the server name, or
    is a glob that matches it.

    Distinct names are matched with distinct patterns; responders then have patterns, and a
    pattern its certificates, so neither many names under one pattern nor many
    certificates with one are multiplied with each other.
    """
    pairs = names.withColumn("name", F.lower(F.trim("server_name"))).select("dst", "name").distinct()
    entries = certs.select("fingerprint", F.explode("names").alias("pattern")).distinct()
    held = pairs.join(matched_patterns(pairs, entries), "name").select("dst", "pattern").distinct()
    return (
        held.join(entries, "pattern")
        .groupBy(F.col("dst").alias("ip"))
        .agg(F.array_sort(F.collect_set("fingerprint")).alias("tls_fingerprints"))
    )


def ssh_host_keys(ssh: DataFrame) -> DataFrame:
    rows = ssh.filter(
        (F.coalesce(F.col("dst"), F.lit("")) != "")
        & (F.coalesce(F.col("host_key"), F.lit("")) != "")
    ).select("dst", "host_key").distinct()
    return rows.groupBy(F.col("dst").alias("ip")).agg(
        F.array_sort(F.collect_list("host_key")).alias("ssh_host_keys")
    )


def enrich_nodes(
    nodes: DataFrame,
    macs: DataFrame,
    leases: DataFrame,
    tls: DataFrame,
    ssh: DataFrame,
) -> DataFrame:
    """Identity onto nodes; a lease only fills a MAC that is missing."""
    none = F.array().cast("array<string>")
    leased = leases.select(
        "ip", F.col("hostname").alias("_host"), F.col("mac").alias("_mac")
    )
    base = nodes
    if "hostnames" not in nodes.columns:
        base = base.withColumn("hostnames", none)
    joined = (
        base.join(macs, "ip", "left")
        .join(leased, "ip", "left")
        .join(tls, "ip", "left")
        .join(ssh, "ip", "left")
    )
    extra = F.when(F.coalesce("_host", F.lit("")) != "", F.array("_host")).otherwise(none)
    return (
        joined.withColumn("hostnames", F.array_union("hostnames", extra))
        .withColumn("mac", F.coalesce("mac", F.nullif("_mac", F.lit("")), F.lit("")))
        .withColumn("tls_fingerprints", F.coalesce("tls_fingerprints", none))
        .withColumn("ssh_host_keys", F.coalesce("ssh_host_keys", none))
        .drop("_host", "_mac")
    )
