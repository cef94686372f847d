from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyscape.llm import mixing


def check(order, weights, ends):
    """Each source is less than one block from its weight up to the first end."""
    total, done = sum(weights.values()), Counter()
    for slot, s in sorted(order):
        done[s] += 1
        if done[s] > ends[s] - 1:
            return slot
        if slot % 97 == 0 or slot < 300:
            assert all(abs(done[x] - w * (slot + 1) / total) < 1 for x, w in weights.items()), slot
    return None


@pytest.mark.parametrize("weights", [
    {"a": 2, "b": 1}, {"a": 1, "b": 2**0.5, "c": 3**0.5}, {"a": 1e-5, "b": 1},
    {"hot": 26.9} | {f"s{k}": 1 for k in range(1500)}])
def test_schedule_over_many_periods(weights):
    total = sum(weights.values())
    blocks = {s: int(20_000 * w / total) + 2 for s, w in weights.items()}
    turns = list(mixing.schedule(weights, blocks))
    assert Counter(s for s, _, _ in turns) == blocks
    assert len({slot for _, _, slot in turns}) == len(turns)
    seen = Counter()
    for s, j, _ in turns:
        assert j == seen[s]
        seen[s] += 1
    assert check([(slot, s) for s, _, slot in turns], weights, blocks) > 18_000


@pytest.mark.parametrize("weights", [
    {"a": 2, "b": 1}, {"hot": 27} | {f"s{k}": 1 + k % 2 for k in range(1200)}])
def test_mix_is_at_its_weights(spark, weights):
    total, slots = sum(weights.values()), 9_000
    rows = {s: int(slots * w / total) + 1 for s, w in weights.items()}
    table = spark.createDataFrame(list(rows.items()), "source string, n int")
    docs = table.select("source", F.explode(F.sequence(F.lit(1), "n")).alias("k")).select(
        F.xxhash64("source", "k").alias("doc_id"), "source")
    got = mixing.mix_sources(docs, weights, block_rows=1).select("slot", "source").collect()
    assert len(got) == sum(rows.values())
    assert check([(r.slot, r.source) for r in got], weights, rows) > 5_000
