"""Normalised composite score, rank and score-driver evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import ip as ipf
from keyscape.operators.edges import host_measures
from keyscape.operators.positions import with_position
from keyscape.session import materialize

_WEIGHTS = {
    "dependents": config.WEIGHT_DEPENDENTS,
    "pagerank": config.WEIGHT_PAGERANK,
    "betweenness": config.WEIGHT_BETWEENNESS,
    "spread": config.WEIGHT_SPREAD,
}


def components(
    nodes: DataFrame,
    edges: DataFrame,
    pagerank: DataFrame | None = None,
    betweenness: DataFrame | None = None,
    measures: DataFrame | None = None,
) -> DataFrame:
    """The four raw measures on every node, zero where unobserved. A centrality
    that was not computed counts as zero everywhere. ``measures``: ``host_measures`` of
    the edges, if they are at hand."""
    measures = host_measures(edges) if measures is None else measures
    joined = nodes
    for part in (measures.select("ip", "dependents", "spread"), pagerank, betweenness):
        if part is not None:
            joined = joined.join(part, "ip", "left")
    for name in ("pagerank", "betweenness"):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(0.0))
    return joined.fillna(
        {"dependents": 0, "spread": 0, "pagerank": 0.0, "betweenness": 0.0}
    )


def min_max(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Scale columns to [0, 1] over terrain hosts. The bounds are one row, read
    once; a constant column scales to 0."""
    stored = materialize(df.withColumn("terrain", ipf.terrain_addr("ip")), "components")
    bounds = stored.filter("terrain").agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in names],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in names],
    ).first()
    scaled = {}
    for c in names:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is None or hi - lo <= 0:
            scaled[c] = F.lit(0.0)
        else:
            scaled[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return stored, scaled


def composite(df: DataFrame) -> DataFrame:
    """Add ``terrain``, the weighted contribution of every measure and their
    sum; addresses that cannot be hosts score 0."""
    stored, scaled = min_max(df, list(_WEIGHTS))
    parts = {c: F.lit(w) * scaled[c] for c, w in _WEIGHTS.items()}
    total = parts["dependents"] + parts["pagerank"] + parts["betweenness"] + parts["spread"]
    return stored.select(
        "*",
        *[p.alias(f"part_{c}") for c, p in parts.items()],
        F.when(F.col("terrain"), F.round(total, 12)).otherwise(0.0).alias("composite"),
    )


def rank(df: DataFrame) -> DataFrame:
    """Rank 1 is the highest composite; ties order by address text."""
    ranked = with_position(df, [F.col("composite").desc(), F.col("ip")], "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def score_drivers(ranked: DataFrame, top_n: int = config.TERRAIN_EVIDENCE_TOP_N) -> DataFrame:
    """Sentences behind the score of the top hosts, largest share first."""
    def driver(order: int, name: str, sentence: Column) -> Column:
        entry = F.struct(
            (-F.col(f"part_{name}")).alias("share"),
            F.lit(order).alias("order"),
            sentence.alias("text"),
        )
        return F.when(F.col(name) > 0, entry)

    # The wording of the sentences.
    entries = F.array_sort(F.array_compact(F.array(
        driver(1, "dependents", F.concat(
            F.col("dependents").cast("string"),
            F.lit(" distinct hosts depend on it for critical services"))),
        driver(2, "betweenness", F.concat(
            F.lit("chokepoint: betweenness "), F.format_string("%.2f", F.col("betweenness")),
            F.lit(" — observed dependency paths pass through it"))),
        driver(3, "spread", F.concat(
            F.lit("blast radius: dependencies reach it from "),
            F.col("spread").cast("string"), F.lit(" subnets"))),
        driver(4, "pagerank", F.concat(
            F.lit("dependency centrality: PageRank "),
            F.format_string("%.4f", F.col("pagerank")),
            F.lit(" from weighted incoming traffic"))),
    )))
    keep = (F.col("rank") <= top_n) & F.col("terrain")
    return ranked.withColumn(
        "terrain_evidence",
        F.when(keep, F.transform(entries, lambda e: e["text"])).otherwise(
            F.array().cast("array<string>")
        ),
    )


def top_ranked(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.filter(F.col("rank") > 0).orderBy("rank").limit(n)
