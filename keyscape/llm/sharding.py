"""Operator 6: shards from a consistent-hash ring with bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape.llm.ranks import rank_within

VIRTUAL_NODES = 100


def _point(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (point, shard) of the virtual nodes; points are 60-bit."""
    return sorted(
        (_point(f"shard-{s}/{v}"), s) for s in range(shards) for v in range(virtual_nodes))


def capacities(total: int, shards: int) -> list[int]:
    """Most rows of each shard: all shards are full at the end, so row counts
    differ by one at most."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def flows(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple]:
    """(arc, low, high, shard, base): rows low to high - 1 of an arc go to ``shard``,
    whose rows before them are ``base``.

    Keys on an arc belong to the shard of the virtual node at its end. First every
    shard takes its own keys, arc by arc, up to its capacity; keys over that then
    continue clockwise to the next virtual node whose shard has room. The work is
    by arcs, never by rows.
    """
    room, used, out, over = list(room), Counter(), [], []

    def put(arc: int, low: int, n: int, shard: int) -> None:
        out.append((arc, low, low + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        take = min(n, room[shard])
        if take:
            put(arc, 0, take, shard)
        if n > take:
            over.append((arc, take, n - take))
    for arc, low, n in over:
        at = arc
        while n:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            take = min(n, room[shard])
            if take:
                put(arc, low, take, shard)
                low, n = low + take, n - take
    return out


def arc_of(key: Column, nodes: list[tuple[int, int]]) -> Column:
    """Index of the first virtual node at or after the key's point, clockwise."""
    points = np.array([p for p, _ in nodes], np.int64)

    @F.pandas_udf("int")
    def find(point: pd.Series) -> pd.Series:
        return pd.Series(
            (np.searchsorted(points, point.to_numpy(np.int64)) % len(points)).astype(np.int32))

    text = F.coalesce(key.cast("string"), F.lit("null"))
    return find(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))


def shard_rows(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, home) of every row of ``docs``.

    Rows are keys by their id on a ring of ``shards`` times ``virtual_nodes`` points;
    ``home`` is the shard of the next point. A shard holds a share of all rows, a row
    more or less, and what it can't hold goes on clockwise; row counts are at most
    one apart. Within an arc, rows go by (id, hash of the text, input position), and
    ``slot`` numbers the rows of a shard from 0 without gaps.

    size is the UTF-8 bytes of the text plus 16, text_crc32 its unsigned CRC; a null
    text counts as empty. Null ids are one key, repeated rows are one key each: if
    they are more than a shard holds, they go on to the next. An empty table gives
    an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    nodes = ring(shards, virtual_nodes)
    rows = docs.select(
        F.col(id_col).alias("i"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = rows.withColumn("arc", arc_of(F.col("i"), nodes))
    ranked = rank_within(rows, ["arc"], ["i", "h"], "rank")
    # one count for each of the virtual nodes
    counts = {r.arc: r.n for r in ranked.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    moves = flows(counts, nodes, capacities(sum(counts.values()), shards))
    table = F.broadcast(docs.sparkSession.createDataFrame(
        [(*m, nodes[m[0]][1]) for m in moves],
        "a int, low long, high long, shard int, base long, home int"))
    return ranked.join(
        table,
        (F.col("arc") == F.col("a")) & (F.col("rank") >= F.col("low"))
        & (F.col("rank") < F.col("high")),
    ).select(
        F.col("i").alias(id_col), "size", "text_crc32", "shard",
        (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), "home")


def shard_of_key(key, nodes: list[tuple[int, int]]) -> int:
    """The home shard of one id, for lookups and tests."""
    point = _point("null" if key is None else str(key))
    return nodes[bisect.bisect_left([p for p, _ in nodes], point) % len(nodes)][1]
