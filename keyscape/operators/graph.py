"""Graph measures: PageRank, betweenness, mission proximity.

All three run on a weighted edge list. Edges stay hash-partitioned by (source,
salt) for the whole run, so a host with very many peers is spread over several
partitions and a round only moves per-vertex values. Searches for betweenness
are dealt by the vertex they start from while their edges fit in a task.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import ports
from keyscape.operators.edges import confirmed
from keyscape.operators.positions import with_position
from keyscape.session import joins_as_dealt, materialize, materialize_dealt

#: Edges of a vertex times blocks of sources in one task of a search, about.
SALT_ROWS = 200_000
#: Vertices in a row of what a search has reached: the bits of a mask.
BLOCK = 63
#: Edges of a search that go to every task, in arrays of integers.
HELD_EDGES = 2_000_000
#: Rows of a level in one bucket, at most unless there are more than so many buckets of them.
BUCKET_ROWS, MAX_BUCKETS = 1_000_000, 2_000


def weighted_edges(edges: DataFrame) -> DataFrame:
    """Confirmed, non-self pairs; log-scaled volume, tripled on auth and name
    ports, summed over parallel edges."""
    factor = F.when(ports.is_auth_edge("port"), config.AUTH_WEIGHT).otherwise(1.0)
    return (
        confirmed(edges)
        .filter(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.sum(F.log1p(F.col("conn_count").cast("double")) * factor).alias("weight"))
    )


def _splits(degree: Column, rows: int) -> Column:
    return F.ceil(degree / F.lit(rows)).cast("int")


def _salted(edges: DataFrame, key: str, other: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Edges with a salt on ``key`` and the number of salts per key. Only keys
    with more than ``rows`` edges get more than one."""
    splits = edges.groupBy(key).agg(_splits(F.count("*"), rows).alias("splits"))
    splits = materialize(splits, "splits")
    salted = edges.join(splits, key).withColumn(
        "salt", F.pmod(F.xxhash64(other), F.col("splits").cast("bigint")).cast("int")
    )
    return salted, splits


def pagerank(
    vertices: DataFrame,
    wedges: DataFrame,
    damping: float = config.PAGERANK_DAMPING,
    tolerance: float = config.PAGERANK_TOLERANCE,
    rounds: int | None = None,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Weighted PageRank over all vertices, isolated ones included.

    Dangling mass that is spread evenly only rescales the vector, so rounds run
    without it and the result is normalised to sum to one: no global value has
    to be known inside a round. Stops when the 2-norm of the change is below
    ``tolerance``, or after ``rounds`` when given.
    """
    spark = wedges.sparkSession
    vertices = materialize(vertices.select("ip").distinct(), "vertices")
    n = vertices.count()
    if n == 0:
        return vertices.withColumn("pagerank", F.lit(0.0))
    wedges = materialize(wedges, "wedges")
    salted, splits = _salted(wedges, "src", "dst", salt_rows)
    totals = wedges.groupBy("src").agg(F.sum("weight").alias("total"))
    out = (
        salted.join(totals, "src")
        .select(
            "src", "salt", "dst", (F.col("weight") / F.col("total")).alias("share")
        )
        .repartition("src", "salt")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    hubs = splits.withColumnRenamed("src", "ip")
    base = materialize(
        vertices.join(hubs, "ip", "left").fillna({"splits": 0}), "bases"
    )
    teleport = (1.0 - damping) / n
    state = base.withColumn("x", F.lit(1.0 / n)).withColumn("prev", F.lit(1.0 / n))
    done = 0
    while True:
        sent = state.filter("splits > 0").select(
            F.col("ip").alias("src"),
            F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"),
            "x",
        )
        gained = (
            out.join(sent, ["src", "salt"])
            .groupBy(F.col("dst").alias("ip"))
            .agg(F.sum(F.col("share") * F.col("x")).alias("g"))
        )
        # a written table each round: the plan of a round never holds the one before
        state = materialize(
            state.join(gained, "ip", "left").select(
                "ip",
                "splits",
                (F.lit(teleport) + F.lit(damping) * F.coalesce("g", F.lit(0.0))).alias("x"),
                F.col("x").alias("prev"),
            ),
            "pagerank",
        )
        done += 1
        x, p = F.col("x"), F.col("prev")
        m = state.agg(
            F.sum(x).alias("s"), F.sum(p).alias("sp"), F.sum(x * x).alias("xx"),
            F.sum(x * p).alias("xp"), F.sum(p * p).alias("pp"),
        ).first()
        change = m["xx"] / m["s"] ** 2 - 2 * m["xp"] / (m["s"] * m["sp"])
        change = math.sqrt(max(0.0, change + m["pp"] / m["sp"] ** 2))
        if (rounds and done >= rounds) or (not rounds and change < tolerance):
            break
    out.unpersist()
    return state.select("ip", (F.col("x") / F.lit(m["s"])).alias("pagerank"))


def pivots(vertices: DataFrame, count: int) -> tuple[DataFrame, int, int]:
    """Evenly strided vertices in address order: (pivots, used, vertices)."""
    ordered = with_position(vertices.select("ip").distinct(), ["ip"], "pos")
    n = ordered.count()
    used = min(count, n)
    stride = n // used if used else 1
    at = F.col("pos") - 1
    picked = ordered.filter((at % stride == 0) & (at / stride < used)).select("ip")
    return picked, used, n


def betweenness(
    vertices: DataFrame,
    wedges: DataFrame,
    mode: str,
    pivot_count: int = config.BETWEENNESS_PIVOTS,
    salt_rows: int = SALT_ROWS,
    held: int = HELD_EDGES,
) -> DataFrame:
    """Directed unweighted betweenness. ``mode`` is the caller's choice at any size:
    "exact" searches from every vertex, "pivots" from ``pivot_count`` of them and scales
    by n / pivots."""
    if mode not in ("exact", "pivots"):
        raise ValueError(f"betweenness mode {mode!r}: exact or pivots")
    vertices = materialize(vertices.select("ip").distinct(), "vertices")
    sources, scale = vertices, 1.0
    if mode == "pivots":
        sources, used, n = pivots(vertices, pivot_count)
        scale = n / used if used else 1.0
    raw = path_dependencies(sources, wedges, salt_rows, held)
    return vertices.join(raw, "ip", "left").select(
        "ip",
        (F.coalesce("dependency", F.lit(0.0)) * F.lit(scale)).alias("betweenness"),
    )


def path_dependencies(
    sources: DataFrame, wedges: DataFrame, salt_rows: int = SALT_ROWS, held: int = HELD_EDGES
) -> DataFrame:
    """Sum over ``sources`` of the shortest-path dependency on every vertex.

    Level-synchronous: a forward pass counts shortest paths per (source, vertex), a
    backward pass accumulates dependencies level by level. Every level is a written table,
    so a lost executor never replays the search.

    Vertices are numbers. The first step of a search is the source's own edges; those that
    it can take later start at a vertex that has a caller. Up to ``held`` of these go to
    every task: then the tables of the search are dealt by source, and a level meets the
    edges, what was reached before and the level below it without moving. More of them are
    dealt by (vertex, salt), a vertex's edges split by their number times that of the
    sources, and the tables of the search by source and range of vertices.
    """
    with joins_as_dealt(wedges.sparkSession):
        return _search(sources, wedges, salt_rows, held)


def _search(sources: DataFrame, wedges: DataFrame, salt_rows: int, held: int) -> DataFrame:
    pairs = materialize(wedges.select("src", "dst").filter("src <> dst").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("ip")).distinct()
    ids = materialize(with_position(ends, ["ip"], "pos").select("ip", (F.col("pos") - 1).cast("int").alias("id")), "ids")
    links = pairs.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst")
    links = materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    chosen = materialize(ids.join(sources.select("ip"), "ip", "left_semi").select(F.col("id").alias("source")), "sources")
    entered = materialize(links.select(F.col("dst").alias("src")).distinct(), "entered")
    inner = materialize(links.join(entered, "src", "left_semi"), "inner")
    again = materialize(inner.select(F.col("dst").alias("v")).distinct(), "again")
    searches = chosen.count()
    rows = max(min(links.count(), searches * entered.count()), searches * again.count())  # of a level, at most
    buckets = min(MAX_BUCKETS, max(-(-rows // BUCKET_ROWS), int(
        links.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if inner.count() <= held:
        keys = ["source"]
        edges, splits = materialize(inner.groupBy("src").agg(F.collect_list("dst").alias("dst")), "edges"), None
    else:
        keys = ["source", "part"]
        edges, splits = _dealt(inner, "src", "dst", max(1, salt_rows // max(1, -(-searches // BLOCK))), buckets)
    first = links.withColumnsRenamed({"src": "source", "dst": "v"}).join(chosen, "source", "left_semi")
    level = first.join(inner.select(F.col("src").alias("v")).distinct(), "v", "left_semi").select(
        "source", _part().alias("part"), "v", F.lit(1.0).alias("sigma"))
    level = _stored(level.select(*keys, "v", "sigma"), "level", keys, buckets)
    met = first.unionByName(chosen.withColumn("v", F.col("source"))).join(again, "v", "left_semi")
    levels, masks = [], _masks(met)
    while not level.isEmpty():
        levels.append(level)
        seen = _stored(masks, "seen", keys, buckets)
        reached = _across(level, "sigma", edges, splits).groupBy("source", "v").agg(F.sum("sigma").alias("sigma"))
        new = reached.withColumn("part", _part()).join(seen, ["source", "part"], "left").filter(
            F.coalesce("mask", F.lit(0).cast("bigint")).bitwiseAND(_bit()) == 0)
        level = _stored(new.select(*keys, "v", "sigma"), "level", keys, buckets)
        masks = seen.unionByName(_masks(level)).groupBy("source", "part").agg(F.bit_or("mask").alias("mask"))
    return _accumulate(levels, edges, splits, keys, buckets).join(
        ids, F.col("v") == F.col("id")).select("ip", "dependency")


def _part() -> Column:
    return F.floor(F.col("v") / F.lit(BLOCK)).cast("int")


def _bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("v") % BLOCK)


def _masks(rows: DataFrame) -> DataFrame:
    """The vertices of every source as bits, one row for each ``BLOCK`` of numbers."""
    return rows.groupBy("source", _part().alias("part")).agg(F.bit_or(_bit()).alias("mask"))


def _stored(df: DataFrame, label: str, keys: list[str], buckets: int) -> DataFrame:
    return materialize_dealt(df.repartition(buckets, *keys), label, keys, buckets)


def _dealt(pairs: DataFrame, key: str, other: str, rows: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Edges as a table dealt by (key, salt), and the number of salts of each key."""
    salted, splits = _salted(pairs, key, other, rows)
    salted = salted.select(key, "salt", other).repartition(buckets, key, "salt")
    return materialize_dealt(salted, "edges", [key, "salt"], buckets), splits


def _across(level: DataFrame, carried: str, edges: DataFrame, splits: DataFrame | None, *kept: str) -> DataFrame:
    """(v, source, carried) at the other end of every edge of a level's vertices, and ``kept`` of
    the edge's own columns. Without ``splits`` the edges are a row for each vertex, with an
    array of the other ends, and go to the level."""
    key, *_, other = edges.columns
    if splits is None:
        return level.withColumnRenamed("v", key).join(F.broadcast(edges), key).select(
            F.explode(other).alias("v"), "source", carried, *kept)
    spread = level.join(splits.withColumnRenamed(key, "v"), "v").select(
        F.col("v").alias(key), "source", carried, F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"))
    return spread.join(edges, [key, "salt"]).select(F.col(other).alias("v"), "source", carried, *kept)


def _accumulate(
    levels: list[DataFrame], edges: DataFrame, splits: DataFrame | None, keys: list[str], buckets: int
) -> DataFrame:
    """Backwards over the levels. A level goes out over the edges as it did forwards, and takes
    from the level below what every vertex there has for a path: (1 + delta) / sigma. So a level
    costs what it did forwards, and edges from vertices that no source reached are not read.
    In the first level a vertex has one path, and only its sum over the sources is needed."""
    below, largest, parts = None, 0, []
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))
    for depth in range(len(levels) - 1, -1, -1):
        scored = levels[depth].withColumn("delta", F.lit(0.0))
        if below is not None:
            if largest <= 2 * BUCKET_ROWS:  # a task can hold its bucket: no sort of what meets it
                below = below.hint("shuffle_hash")
            pulled = _across(levels[depth], "sigma", edges, splits, "src").withColumn("part", _part()).join(
                below, [*keys, "v"])
            if depth == 0:
                parts.append(pulled.groupBy(F.col("src").alias("v")).agg(F.sum("share").alias("delta")))
                break
            pulls = pulled.groupBy("source", F.col("src").alias("v")).agg(F.sum("share").alias("pull"))
            scored = _stored(levels[depth].join(pulls.withColumn("part", _part()), [*keys, "v"], "left").select(
                *keys, "v", "sigma", (F.col("sigma") * F.coalesce("pull", F.lit(0.0))).alias("delta")),
                "dependency", keys, buckets)
            parts.append(scored.groupBy("v").agg(F.sum("delta").alias("delta")))
        largest = levels[depth].groupBy(bucket).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        below = scored.select(*keys, "v", ((1.0 + F.col("delta")) / F.col("sigma")).alias("share"))
    if not parts:
        return edges.select(F.col("src").alias("v"), F.lit(0.0).alias("dependency")).limit(0)
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return materialize(
        total.filter("delta > 0").groupBy("v").agg(F.sum("delta").alias("dependency")), "betweenness")


def mission_proximity(
    nodes: DataFrame,
    edges: DataFrame,
    scope: DataFrame,
    max_depth: int = config.MISSION_MAX_DEPTH,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Hosts within ``max_depth`` undirected hops of the chosen hosts.

    One search from all of them at once, with the same edges dealt by (host, salt): the
    frontier of a step goes out to them, and a host that is reached twice is dropped by a
    table of all that were, which is one row for each host and read once in a step.
    """
    ends = confirmed(edges).filter(F.col("src") != F.col("dst")).select(F.explode(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.*").distinct()
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links, splits = _dealt(materialize(ends, "links"), "a", "b", salt_rows, buckets)
    chosen = scope.select("ip").distinct().join(nodes, "ip", "left_semi").select(
        F.col("ip").alias("v"), F.lit(0).alias("depth"))
    reached = materialize(chosen, "reached")
    for depth in range(1, max_depth + 1):
        frontier = reached.filter(F.col("depth") == depth - 1).select("v", F.lit(0).alias("source"), "depth")
        met = _across(frontier, "depth", links, splits).select("v", F.lit(depth).alias("depth"))
        reached = materialize(reached.unionByName(met).groupBy("v").agg(F.min("depth").alias("depth")), "reached")
    return reached.select(
        F.col("v").alias("ip"),
        (F.col("depth") == 0).alias("in_scope"),
        "depth",
        (F.lit(1.0) / (F.col("depth") + 1)).alias("mission_score"),
    )
