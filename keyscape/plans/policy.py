"""Declared configs against one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keyscape.operators import declared as d
from keyscape.session import materialize


def policy(tables: dict[str, DataFrame], edges: DataFrame) -> dict[str, DataFrame]:
    """Denied flows, permits nothing used, and how many rules were not judged."""
    edges = edges.select("src", "dst", "port", "proto", "service", "evidence", "conn_count",
                         "first_seen", "last_seen")
    rules = materialize(tables["rules"], "rules")
    apps = materialize(d.applications(
        tables["devices"], tables["interfaces"], tables["prefixes"], tables["bindings"],
        tables["vlans"], tables["rulesets"]), "applications")
    decided = materialize(d.decisions(edges, apps, rules, tables["rulesets"]), "decisions")
    return {
        "violations": d.violations(decided, rules),
        "unused_permits": d.unused_permits(decided, rules, apps),
        "skipped_rules": d.skipped_rules(rules),
    }


def inventory(tables: dict[str, DataFrame], nodes: DataFrame, zero_coverage: DataFrame) -> dict[str, DataFrame]:
    parts = tables["devices"], tables["interfaces"], tables["prefixes"]
    owned = d.owned_prefixes(tables["interfaces"], tables["prefixes"], tables["vlans"])
    return {
        "matches": d.device_matches(*parts, nodes),
        "adopted": d.adopted_devices(*parts, nodes),
        "gateways": d.declared_gateways(*parts, nodes),
        "silent_subnets": d.silent_subnets(owned, nodes, zero_coverage),
        "undeclared_cidrs": d.undeclared_cidrs(owned, nodes),
    }
