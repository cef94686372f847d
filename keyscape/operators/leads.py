"""Investigation leads: one reason per provider, in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyscape.functions import ports, text
from keyscape.operators.authority import SAMPLE_CLIENTS, sole_providers
from keyscape.operators.edges import evidence_level

# Lower is more actionable; the source number breaks ties.
PRIORITY = {
    "sole-provider": (3, 1), "new-provider": (2, 2), "new-service": (2, 2),
    "undocumented": (1, 3), "contradicted": (0, 4), "policy-denied": (0, 5),
}


def _candidate(df: DataFrame, reason) -> DataFrame:
    name = F.lit(reason) if isinstance(reason, str) else reason
    prio = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v[0])])
    src = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v[1])])
    return df.select("ip", "port", name.alias("reason")).select(
        "ip", "port", F.element_at(prio, F.col("reason")).alias("priority"),
        F.element_at(src, F.col("reason")).alias("source_no"), "reason",
    )


def candidates(authority, new_providers=None, undocumented=None, contradicted=None) -> DataFrame:
    """Every reason a current provider surfaced for."""
    keys = authority.select("ip", "port")
    rows = _candidate(sole_providers(authority), "sole-provider")
    if new_providers is not None:
        reason = F.when(F.col("new_host"), "new-provider").otherwise("new-service")
        gained = new_providers.join(keys, ["ip", "port"], "left_semi")
        rows = rows.unionByName(_candidate(gained, reason))
    for df, reason in ((undocumented, "undocumented"), (contradicted, "contradicted")):
        if df is not None:
            hit = keys.join(df.select("ip").distinct(), "ip", "left_semi")
            rows = rows.unionByName(_candidate(hit, reason))
    return rows


def best_reasons(rows: DataFrame) -> DataFrame:
    """One reason per provider and the inventory status it carries. At most six
    rows per provider exist, so the group is bounded."""
    best = F.min(F.struct("priority", "source_no", "reason"))
    status = (
        F.when(F.max(F.col("reason") == "contradicted"), "contradicted")
        .when(F.max(F.col("reason") == "undocumented"), "undocumented").otherwise("")
    )
    return rows.groupBy("ip", "port").agg(best.alias("b"), status.alias("inventory_status")).select(
        "ip", "port", F.col("b.priority").alias("priority"), F.col("b.reason").alias("reason"),
        "inventory_status",
    )


def denied_flows(violations: DataFrame) -> DataFrame:
    """Policy violations per (responder, port)."""
    rows = violations.select(
        F.col("dst").alias("ip"), "port", "src", "service", "evidence", "first_seen", "last_seen",
        F.struct("device", "ruleset", "line", "src", "dst", "proto",
                 text.rule_evidence("device", "source", "line", "raw", "confidence").alias("t")
                 ).alias("r"),
    )
    pairs = rows.groupBy("ip", "port", "src").agg(
        F.max(text.evidence_strength("evidence")).alias("g"), F.min("first_seen").alias("f"),
        F.max("last_seen").alias("l"), F.min("r").alias("r"), F.max("service").alias("s"))
    order = Window.partitionBy("ip", "port").orderBy("src")
    sample = (
        pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_CLIENTS)
        .groupBy("ip", "port").agg(F.array_sort(F.collect_list("src")).alias("p_sample"))
    )
    grouped = pairs.groupBy("ip", "port").agg(
        F.count("*").alias("p_clients"), F.max("g").alias("g"), F.min("f").alias("p_first"),
        F.max("l").alias("p_last"), F.min("r").alias("r"), F.max("s").alias("s"))
    return grouped.join(sample, ["ip", "port"]).select(
        "ip", "port", "p_clients", "p_first", "p_last", "p_sample",
        F.when(F.col("g") > 0, evidence_level(F.col("g"))).otherwise("").alias("p_evidence"),
        F.when(F.coalesce("s", F.lit("")) != "", F.col("s")).otherwise(ports.service_name("port"))
        .alias("p_service"),
        F.col("r.t").alias("rule_evidence"),
    )


def build(
    authority: DataFrame, enrichment: DataFrame, alternates: DataFrame, reasons: DataFrame,
    denied: DataFrame | None = None, approved: DataFrame | None = None,
) -> DataFrame:
    keys = ["ip", "port"]
    none = F.array().cast("array<string>")
    base = (
        reasons.join(authority, keys).join(enrichment, keys, "left").join(alternates, keys, "left")
    )
    if denied is None:
        rows = base.withColumn("rule_evidence", F.lit(""))
    else:
        listed = base.withColumn("listed", F.lit(True))
        rows = listed.join(denied, keys, "full").withColumns({
            "reason": F.when(F.col("listed").isNull() | (F.col("rule_evidence").isNotNull()
                             & (F.col("priority") > 0)), "policy-denied").otherwise(F.col("reason")),
            "priority": F.when(F.col("rule_evidence").isNotNull(), 0).otherwise(F.col("priority")),
            "service": F.coalesce("service", "p_service"),
            "evidence": F.coalesce("evidence", "p_evidence"),
            "clients": F.coalesce("clients", "p_clients"),
            "first_seen": F.coalesce("first_seen", "p_first"),
            "last_seen": F.coalesce("last_seen", "p_last"),
            "sample_clients": F.coalesce("sample_clients", "p_sample"),
            "rule_evidence": F.coalesce("rule_evidence", F.lit("")),
        })
    if approved is not None:
        keyed = approved.select(F.col("provider").alias("_key")).distinct()
        rows = rows.withColumn("_key", text.provider_key("ip", "port")).join(
            keyed, "_key", "left_anti")
    query = F.concat(F.lit('destination.ip:"'), F.col("ip"), F.lit('" AND destination.port:'),
                     F.col("port").cast("string"))
    return rows.select(
        "priority", "reason", "ip", F.coalesce("hostname", F.lit("")).alias("hostname"), "service",
        "port", "evidence", "clients", F.coalesce("sample_clients", none).alias("sample_clients"),
        F.coalesce("subnets", none).alias("subnets"), F.coalesce("sensors", none).alias("sensors"),
        "first_seen", "last_seen", F.coalesce("rank", F.lit(0)).alias("rank"),
        F.coalesce("inventory_status", F.lit("")).alias("inventory_status"),
        query.alias("query"), "rule_evidence",
        F.coalesce("alternate_providers", none).alias("alternate_providers"),
    )


def ordered(leads: DataFrame) -> DataFrame:
    unranked = F.when(F.col("rank") == 0, 2**30).otherwise(F.col("rank"))
    return leads.orderBy(
        F.asc("priority"), F.desc(text.evidence_strength("evidence")), F.desc("clients"),
        F.desc(F.size("subnets")), unranked.asc(), F.asc("ip"), F.asc("port"),
    )
