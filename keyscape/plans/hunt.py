"""Hunt leads from a snapshot, its drift, reconciliation and declared policy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keyscape.operators import authority, leads


def hunt(
    nodes: DataFrame, edges: DataFrame, new_providers: DataFrame | None = None,
    undocumented: DataFrame | None = None, contradicted: DataFrame | None = None,
    violations: DataFrame | None = None, approved: DataFrame | None = None,
) -> DataFrame:
    """Every source but the snapshot is optional."""
    providers = authority.service_authority(edges, nodes)
    reasons = leads.best_reasons(leads.candidates(providers, new_providers, undocumented, contradicted))
    denied = leads.denied_flows(violations) if violations is not None else None
    return leads.build(
        providers, authority.provider_enrichment(edges, nodes), authority.alternate_providers(edges),
        reasons, denied, approved)
