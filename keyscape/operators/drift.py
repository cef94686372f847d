"""Drift between two snapshots, one DataFrame per signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import ip as ipf
from keyscape.functions import ports, text
from keyscape.operators.edges import confirmed
from keyscape.operators.positions import with_position
from keyscape.operators.roles import role_names


def appeared(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("ip"), "ip", "left_anti")


def disappeared(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("ip"), "ip", "left_anti")


def _both(old: DataFrame, new: DataFrame, *columns: str) -> DataFrame:
    o = old.select("ip", *[F.col(c).alias(f"old_{c}") for c in columns])
    n = new.select("ip", *[F.col(c).alias(f"new_{c}") for c in columns])
    return o.join(n, "ip")


def rank_changes(
    old: DataFrame, new: DataFrame, delta: int = config.DRIFT_RANK_DELTA
) -> DataFrame:
    """Positive delta means the host moved toward rank 1."""
    moved = F.col("old_rank") - F.col("new_rank")
    return _both(old, new, "rank").filter(
        (F.col("old_rank") > 0) & (F.col("new_rank") > 0) & (F.abs(moved) >= delta)
    ).select(
        "ip", F.col("old_rank").alias("from_rank"), F.col("new_rank").alias("to_rank"),
        moved.alias("delta"),
    )


def role_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    return (
        _both(old, new, "roles")
        .select("ip", role_names("old_roles").alias("from_roles"),
                role_names("new_roles").alias("to_roles"))
        .filter(F.col("from_roles") != F.col("to_roles"))
    )


def identity_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    both = _both(old, new, "tls_fingerprints", "ssh_host_keys")
    def entry(protocol: str, c: str):
        return F.struct(
            F.lit(protocol).alias("protocol"),
            text.set_added(f"old_{c}", f"new_{c}").alias("added"),
            text.set_removed(f"old_{c}", f"new_{c}").alias("removed"),
        )

    rows = both.select(
        "ip", F.inline(F.array(entry("tls", "tls_fingerprints"), entry("ssh", "ssh_host_keys")))
    )
    return rows.filter((F.size("added") > 0) | (F.size("removed") > 0))


def _edge_keys(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, port); the last transport represents the key."""
    return edges.groupBy("src", "dst", "port").agg(
        F.max_by("conn_count", "proto").alias("conn_count"),
        F.max_by("evidence", "proto").alias("evidence"),
    )


def _top(nodes: DataFrame, top_n: int) -> DataFrame:
    return nodes.filter((F.col("rank") > 0) & (F.col("rank") <= top_n)).select(
        F.col("ip").alias("dst")
    )


def edges_gained(
    a: DataFrame, b: DataFrame, nodes: DataFrame, top_n: int = config.DRIFT_TOP_N
) -> DataFrame:
    """Edges of ``b`` missing in ``a`` whose responder is a top host of ``b``.

    The top filter comes first: at most ``top_n`` responders, so it is a small
    semi join that shrinks the edges before the anti join."""
    top = _top(nodes, top_n)
    candidates = b.join(top, "dst", "left_semi")
    known = a.join(top, "dst", "left_semi").select("src", "dst", "port")
    return _edge_keys(candidates.join(known, ["src", "dst", "port"], "left_anti"))


def new_edges_to_top(old_edges, new_edges, new_nodes, top_n=config.DRIFT_TOP_N) -> DataFrame:
    return edges_gained(old_edges, new_edges, new_nodes, top_n)


def vanished_critical_edges(old_edges, new_edges, old_nodes, top_n=config.DRIFT_TOP_N) -> DataFrame:
    return edges_gained(new_edges, old_edges, old_nodes, top_n)


def sensitive_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (provider, client) of sensitive services on real hosts."""
    return (
        confirmed(edges)
        .filter(ports.is_sensitive("port") & ipf.terrain_addr("dst"))
        .select("dst", "port", "src")
        .distinct()
    )


def new_providers(
    old_edges: DataFrame, new_edges: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame
) -> DataFrame:
    before = confirmed(old_edges).filter(ports.is_sensitive("port")).select("dst", "port")
    gained = (
        sensitive_pairs(new_edges)
        .groupBy("dst", "port").agg(F.count("*").alias("clients"))
        .join(before.distinct(), ["dst", "port"], "left_anti")
    )
    ranks = new_nodes.select(F.col("ip").alias("dst"), "rank")
    known = old_nodes.select(F.col("ip").alias("dst"), F.lit(False).alias("_new"))
    return (
        gained.join(ranks, "dst", "left").join(known, "dst", "left")
        .select(
            F.col("dst").alias("ip"), "port", ports.service_name("port").alias("service"),
            "clients", F.coalesce("_new", F.lit(True)).alias("new_host"),
            F.coalesce("rank", F.lit(0)).alias("rank"),
        )
    )


def client_moves(old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(provider, previous provider, clients) of every client a provider gained.

    A gained client was by definition not the provider's before, so its first
    previous provider of the service is simply its smallest one: one row per
    (service, client) to join, never provider pairs."""
    service = ports.service_name("port")
    now, before = sensitive_pairs(new_edges), sensitive_pairs(old_edges)
    gained = now.join(before, ["dst", "port", "src"], "left_anti").withColumn("service", service)
    first = F.min(F.struct(
        ipf.ip_key("dst").alias("key"), F.col("port").alias("from_port"),
        F.col("dst").alias("from_ip"),
    ))
    previous = before.withColumn("service", service).groupBy("service", "src").agg(first.alias("p"))
    return (
        gained.join(previous, ["service", "src"], "left")
        .groupBy("dst", "port", "service", F.col("p.from_ip").alias("from_ip"),
                 F.col("p.from_port").alias("from_port"))
        .agg(F.count("*").alias("clients"))
    )


def displacement(
    old_edges: DataFrame, new_edges: DataFrame, new_nodes: DataFrame
) -> DataFrame:
    """Clients every provider gained, split by where they came from."""
    moves = client_moves(old_edges, new_edges)
    source = F.when(F.col("from_ip").isNotNull(), F.struct(
        (-F.col("clients")).alias("o"), F.col("from_ip").alias("ip"),
        F.col("from_port").alias("port"), F.col("clients").alias("clients"),
    ))
    ranks = new_nodes.select(F.col("ip").alias("dst"), "rank")
    grouped = moves.groupBy("dst", "port", "service").agg(
        F.sum(F.when(F.col("from_ip").isNull(), F.col("clients")).otherwise(0)).alias("clients_added"),
        F.array_sort(F.collect_list(source)).alias("m"),
    )
    return grouped.join(ranks, "dst", "left").select(
        F.col("dst").alias("ip"), "port", "service", "clients_added",
        F.transform("m", lambda s: F.struct(s["ip"].alias("ip"), s["port"].alias("port"),
                                            s["clients"].alias("clients"))).alias("migrated_from"),
        F.coalesce("rank", F.lit(0)).alias("rank"),
    )


def compatibility_warnings(old_meta: DataFrame, new_meta: DataFrame) -> DataFrame:
    """One line per difference that makes two snapshots hard to compare. Each
    side is one metadata row."""
    a = old_meta.select(F.lit(1).alias("one"), F.struct("*").alias("a"))
    b = new_meta.select(F.lit(1).alias("one"), F.struct("*").alias("b"))
    both = a.join(b, "one")
    lists = {}
    for side in ("a", "b"):
        for c in ("scope", "sensors"):
            values = F.array_sort(F.coalesce(F.col(f"{side}.{c}"), F.array().cast("array<string>")))
            lists[side, c] = F.when(F.size(values) == 0, "(none)").otherwise(F.array_join(values, ", "))

    def scalar(column: str, label: str):
        x, y = (F.coalesce(F.col(f"{s}.{column}"), F.lit("")) for s in ("a", "b"))
        line = F.concat(F.lit(f'{label} differs: "'), x, F.lit('" vs "'), y, F.lit('"'))
        return F.when((x != "") & (y != "") & (x != y), line)

    def listing(column: str, label: str):
        x, y = lists["a", column], lists["b", column]
        return F.when(x != y, F.concat(F.lit(f"{label}: "), x, F.lit(" vs "), y))

    warnings = F.array_compact(F.array(
        scalar("cluster_name", "cluster"), scalar("window", "window"),
        listing("scope", "scope differs"), listing("sensors", "sensors differ"),
    ))
    return both.select(F.posexplode(warnings).alias("pos", "warning"))


def findings(
    warnings, baseline, appeared_nodes, disappeared_nodes, ranks, gained, vanished, identity,
    providers, moves,
) -> DataFrame:
    """(pos, kind, finding) lines of a comparison: its warnings, the counts against the
    ``baseline`` metadata, then a line for each identity change, provider and migration."""
    # The wording of the lines.
    counts = [
        (appeared_nodes, " appeared, "), (disappeared_nodes, " vanished, "), (ranks, " rank changes, "),
        (gained, " new edges to top terrain, "), (vanished, " vanished critical edges, "),
        (identity, " identity changes, "), (providers, " new sensitive-service providers, "),
        (moves, " provider displacements"),
    ]
    text_of = lambda c: F.col(c).cast("string")
    rows = baseline.select(F.lit(-1).alias("o"), F.concat(
        F.lit("drift vs "), F.date_format("created_at", "yyyyMMdd'T'HHmmss'Z'"), F.lit(": ")).alias("t"))
    for order, (df, label) in enumerate(counts):
        rows = rows.unionByName(df.agg(F.count("*").alias("n")).select(
            F.lit(order).alias("o"), F.concat(text_of("n"), F.lit(label)).alias("t")))
    line = lambda pos, kind, text: (
        F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), text.alias("finding"))
    summary = rows.agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("s")).select(*line(
        1, "summary", F.array_join(F.transform("s", lambda e: e["t"]), "")))
    warned = warnings.select(*line(0, "warning", F.concat(F.lit("comparison warning: "), "warning")))
    changed = identity.select(*line(2, "identity", F.concat(
        F.upper("protocol"), F.lit(" identity changed on "), "ip", F.lit(": added ["),
        F.array_join("added", " "), F.lit("] removed ["), F.array_join("removed", " "), F.lit("]"))))
    started = providers.select(*line(3, "provider", F.concat(
        F.lit("new provider: "), "ip", F.lit(" began serving "), "service", F.lit(" (port "),
        text_of("port"), F.lit(") to "), text_of("clients"), F.lit(" client(s)"),
        F.when(F.col("new_host"), ", host first seen this window").otherwise(""),
        F.lit(" — investigate if unexpected"))))
    moved = moves.select("ip", "port", "service", F.explode("migrated_from").alias("m"))
    migrated = moved.select(*line(4, "migration", F.concat(
        text_of("m.clients"), F.lit(" client(s) moved from "), F.col("m.ip"), F.lit(":"),
        text_of("m.port"), F.lit(" to "), "ip", F.lit(":"), text_of("port"), F.lit(" for "), "service")))
    out = warned
    for part in (summary, changed, started, migrated):
        out = out.unionByName(part)
    return out


#: Columns that each signal is read in; a minus sign for descending.
ORDERS = {
    "appeared": ["ip"], "disappeared": ["ip"], "ranks": ["ip"], "roles": ["ip"], "identity": ["ip", "protocol"],
    "gained": ["dst", "src", "port"], "vanished": ["dst", "src", "port"], "providers": ["-clients", "ip", "port"],
    "displacement": ["-total", "ip", "port"],
}


def in_order(signal: str, rows: DataFrame, name: str = "pos") -> DataFrame:
    """``rows`` of a signal with their place from 1 in its order, whatever task they are in:
    a range sort with offsets, so that long lists are no single task. Displacements go by all
    the clients that a provider gained, new ones and moved ones."""
    wanted = [c.lstrip("-") for c in ORDERS[signal]]
    extra = {}
    if "total" in wanted:
        extra["total"] = F.col("clients_added") + F.aggregate(
            "migrated_from", F.lit(0).cast("bigint"), lambda n, m: n + m["clients"])
    order = [-F.col(c.lstrip("-")) if c.startswith("-") else F.col(c) for c in ORDERS[signal]]
    return with_position(rows.withColumns(extra) if extra else rows, order, name).drop(*extra)
