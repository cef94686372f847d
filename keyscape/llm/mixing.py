"""Operator 5: mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.llm.ranks import rank_within
from keyscape.session import materialize

BLOCK_ROWS = 64
HORIZON = 1000
LAST_SLOT = 1 << 62


def quotas(weights: dict, horizon: int = HORIZON) -> dict:
    """Whole blocks of each source in one period of ``horizon`` slots, for a caller that
    repeats a period (``mix_sources`` does not): its share by largest remainder, one at least. Weights of zero or less have no quota. With more
    sources than slots the period is as long as there are sources."""
    weights = {s: w for s, w in weights.items() if w > 0}
    horizon = max(horizon, len(weights))
    total = sum(weights.values())
    share = {s: w / total * horizon for s, w in weights.items()}
    held = {s: max(1, math.floor(x)) for s, x in share.items()}
    by_rest = sorted(share, key=lambda s: (held[s] - share[s], str(s)))
    for s in by_rest[: max(0, horizon - sum(held.values()))]:
        held[s] += 1
    while sum(held.values()) > horizon:
        s = max((s for s in held if held[s] > 1), key=lambda s: (held[s] - share[s], str(s)))
        held[s] -= 1
    return held


def schedule(weights: dict, blocks: dict) -> Iterator[tuple]:
    """(source, block, slot) of ``blocks[source]`` blocks of each source, in order.

    Block j of a source with a share w of all weights is released at floor(j / w) and due
    at ceil((j + 1) / w), worked out from the exact weight. In each slot the released
    block due first runs. Shares sum to one, so every block runs within its window: at
    each slot a source that has blocks left is less than one block from its exact
    share, however long the schedule is. A source that has ended leaves its slots
    empty, or to blocks that are released then. Weights of zero or less have no slots.

    It holds two numbers of each source, whatever the number of blocks.
    """
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    share = {s: int(w * scale) for s, w in exact.items()}
    total = sum(share.values())
    names = sorted((s for s in share if blocks.get(s, 0) > 0), key=lambda s: (str(s), s is None))
    own, ends = [share[s] for s in names], [blocks[s] for s in names]
    waiting, ready, slot = [(0, k, 0) for k in range(len(names))], [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // own[k]), k, j))
        _, k, j = heapq.heappop(ready)
        yield names[k], j, slot
        slot += 1
        if j + 1 < ends[k]:
            heapq.heappush(waiting, ((j + 1) * total // own[k], k, j + 1))


def pattern(held: dict) -> list[tuple]:
    """(source, block in period, slot) of one period in which each source has ``held``
    blocks, its weight."""
    return list(schedule(held, held))


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict:
    """Weight of each source: its rows to ``power``. One number per source reaches
    the driver; sources are a category, not ids."""
    rows = docs.groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n")).collect()
    return {r.s: r.n**power for r in rows}


def _schedule_table(blocks: DataFrame, weights: dict, horizon: int) -> DataFrame:
    """(ps, turn, at): the slot of every block of a source with a weight."""
    spark = blocks.sparkSession
    counts = {r.s: r.n for r in blocks.groupBy("s").agg((F.max("block") + 1).alias("n")).collect()}
    names = list(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {s: k for k, s in enumerate(names)}
        for batch in batches:
            for _ in range(batch.num_rows):
                turns = schedule(weights, counts)
                while part := list(itertools.islice(turns, horizon)):
                    source, block, slot = zip(*part, strict=True)
                    if slot[-1] >= LAST_SLOT >> 1:
                        raise ValueError("a weight is too small for the blocks of its source")
                    yield pa.RecordBatch.from_arrays([
                        pa.array([place[s] for s in source], pa.int32()),
                        pa.array(block, pa.int64()), pa.array(slot, pa.int64()),
                    ], names=["k", "turn", "at"])

    slots = materialize(
        spark.range(0, 1, 1, 1).mapInArrow(run, "k int, turn long, at long"), "mix-schedule")
    kind = blocks.schema["s"].dataType.simpleString()
    named = spark.createDataFrame(list(enumerate(names)), f"nk int, ps {kind}")
    return slots.join(F.broadcast(named), F.col("k") == F.col("nk")).select("ps", "turn", "at")


def mix_sources(
    docs: DataFrame,
    weights: dict,
    block_rows: int = BLOCK_ROWS,
    horizon: int = HORIZON,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, h, block, place, slot) of every row: the place of its block in
    the mix. ``slot`` orders the blocks of all sources, ``place`` (from 0) the rows
    of a block of ``block_rows``; ``h`` is a hash of the id.

    Up to the slot where the first source ends, each source is less than one block from
    its exact weight, on any length and for any number of sources; from there its
    slots stay empty and the others keep their proportions. Every row is placed once.
    Sources with no weight follow after all others, block by block.

    One task works out the schedule from a number of blocks for each source, ``horizon``
    slots at a time, and writes a row for each block, not for each row of ``docs``. A
    schedule of 2**61 slots or more, from a weight that is nearly nothing, is an error.

    A source's rows are in a fixed pseudo-random order by hash of the id, then the
    id; repeated rows take neighbouring places. A null source is a source of its
    own, whose weight is at the key None. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.xxhash64(id_col).alias("h"))
    ranked = rank_within(rows, ["s"], ["h", "i"], "rank")
    blocks = ranked.select(
        "i", "s", "h", F.expr(f"rank div {block_rows}").alias("block"),
        (F.col("rank") % block_rows).cast("int").alias("place"))
    table = _schedule_table(blocks, weights, horizon)
    joined = blocks.join(
        table, F.col("s").eqNullSafe(F.col("ps")) & (F.col("block") == F.col("turn")), "left")
    last = F.lit(LAST_SLOT)
    slot = F.when(F.col("at").isNotNull(), F.col("at")).otherwise(last + F.col("block"))
    return joined.select(
        F.col("i").alias(id_col), F.col("s").alias(source_col), "h", "block", "place",
        slot.cast("bigint").alias("slot"))


def mixed(
    docs: DataFrame,
    weights: dict,
    block_rows: int = BLOCK_ROWS,
    horizon: int = HORIZON,
    id_col: str = "doc_id",
    source_col: str = "source",
    part_rows: int = 20_000,
) -> DataFrame:
    """``docs``, all rows and columns, dealt by range and sorted in the order of the
    mix: written files, read one after another, follow the schedule. Repeated rows
    (same id and source) share the places of their id in any order. Texts are shuffled
    twice, by id and by place, at every size."""
    placed = materialize(
        mix_sources(docs, weights, block_rows, horizon, id_col, source_col)
        .groupBy(F.col(id_col).alias("__mix_i"), F.col(source_col).alias("__mix_s"))
        .agg(F.min(F.struct("slot", "place")).alias("__mix_at")), "mix-places")
    same = docs[id_col].eqNullSafe(F.col("__mix_i")) & docs[source_col].eqNullSafe(F.col("__mix_s"))
    order = [F.col("__mix_at.slot"), F.col("__mix_s"), F.col("__mix_at.place")]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-placed.count() // part_rows))
    return (
        docs.join(placed.hint("merge"), same).repartitionByRange(parts, *order)
        .sortWithinPartitions(*order).select(*[docs[c] for c in docs.columns])
    )
