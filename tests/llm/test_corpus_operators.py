import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyscape.llm import components, mixing, ngram_join, ranks, sharding, suffix_tree
from keyscape.llm.packing import unpack
from tests.llm import brute


def near_copies(seed, sizes=(3, 6, 12, 30, 42, 50, 60, 90, 200), copies=(1, 2, 3, 8, 60)):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    shared = " ".join(r.choice(vocabulary) for _ in range(25))
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice(sizes))]
        for _ in range(r.choice(copies)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.2:
                words += [r.choice(vocabulary) for _ in range(r.randint(1, 4))]
            texts.append(" ".join(words) + (f"\n{shared}" if r.random() < 0.3 else ""))
    texts += [None, "", "  \n", "a", "a", "A", "a b", "b a"]
    return list(enumerate(texts))


@pytest.mark.parametrize("rare", [0, 32])
def test_near_groups(documents, monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rows = near_copies(4)
    want = brute.near_groups(rows)
    got = ngram_join.near_groups(documents([*rows, rows[0], rows[-8]])).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_chain_of_links_and_one_of_each(documents):
    chain = [f"c{k}" for k in range(140)]
    rows = [(k + 1, " ".join(chain[3 * k : 3 * k + 60])) for k in range(25)]
    rows += [(None, " ".join(chain[:60]) + "  "), (50, "x y"), (51, None), (52, None)]
    want = brute.near_groups(rows[:25])
    groups = {r.doc_id: r.component_id for r in ngram_join.near_groups(documents(rows)).collect()}
    assert {i: groups[i] for i, _ in rows[:25]} == {i: c for i, (_, c) in want.items()}
    assert len({c for _, c in want.values()}) == 1
    assert groups[None] == 1 and groups[51] == 51 and groups[52] == 52
    docs = documents(rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 50, 51, 52]
    assert ngram_join.near_groups(documents([])).count() == 0


def test_signatures_meet_the_theorem():
    """Any two sets that link share a signature, also when all their tokens are frequent."""
    r = np.random.default_rng(1)
    for _ in range(3000):
        n = int(r.integers(1, 140))
        tokens = r.choice(1 << 40, n + 60, replace=False).astype(np.uint64)
        level = r.choice([1, 4, 20, 21, 30, 60], n + 60).astype(np.uint8)
        miss = int(r.integers(0, n - -(-80 * n // 100) + 1))
        a = np.arange(n)
        b = np.concatenate((r.choice(n, n - miss, replace=False), n + np.arange(int(r.integers(0, 3)))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * len(np.union1d(a, b)):
            x = ngram_join.signatures(tokens[a], level[a], len(a), 80)
            y = ngram_join.signatures(tokens[b], level[b], len(b), 80)
            assert len(np.intersect1d(x, y)), (n, miss)


def test_a_block_holds_little_more_than_its_tokens():
    """Peak for 8 MB of text. Without slices and early release it was over 100 MB."""
    rng = np.random.default_rng(3)
    names = np.array([f"w{k}" for k in range(50_000)])
    texts = [" ".join(names[rng.integers(0, len(names), 500)]) for _ in range(2600)]
    texts += ["", "one two", texts[0]]
    uids = [*range(len(texts) - 1), 0]
    batch = pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(texts)], names=["u", "t"])
    list(ngram_join._block(batch.slice(0, 10), 5, 40, 4, 5))
    tracemalloc.start()
    try:
        rows = next(iter(ngram_join._block(batch, 5, 40, 4, 5))).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 90 << 20
    got, counts, _ = unpack(next(r["payload"] for r in rows if r["first"] < 0))
    assert got.tolist() == list(range(len(texts) - 1))
    assert counts[:2].tolist() == [496, 496] and counts[-2:].tolist() == [0, 1]


def test_a_block_of_texts_without_words():
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, 9], pa.int64()), pa.array([" ", None], pa.string())], names=["u", "t"])
    rows = next(iter(ngram_join._block(batch, 5, 40, 4, 5))).to_pylist()
    assert [r["first"] for r in rows] == [-1]
    assert [x.tolist() for x in unpack(rows[0]["payload"])] == [[7, 9], [0, 0], []]


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    groups = brute.Sets(range(161))
    for a, b in edges:
        groups.join(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == {
        i: groups.find(i) for i in {x for e in edges if e[0] != e[1] for x in e}}


def test_rank_within(spark):
    rows = [(("a", "b", None)[min(k % 9, 2)], k % 5) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    got = ranks.rank_within(df, ["g"], ["k"], "rank").collect()
    assert len(got) == 500
    for g in ("a", "b", None):
        own = sorted((r["rank"], r.k) for r in got if r.g == g)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == sorted(x[1] for x in own)


@pytest.mark.parametrize("weights", [
    {"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1.7}, {k: 1 / (k + 1) for k in range(40)},
    {"a": 1e-9, "b": 1}, {"a": 2, "b": 0, "c": 1}])
def test_pattern_keeps_every_source_within_a_block(weights):
    held = mixing.quotas(weights, 100)
    period = sum(held.values())
    assert period == max(100, len(held)) and min(held.values()) >= 1
    assert set(held) == {s for s, w in weights.items() if w > 0}
    done = Counter()
    for slot, (source, turn, at) in enumerate(mixing.pattern(held)):
        assert at == slot and turn == done[source]
        done[source] += 1
        for s, c in held.items():
            assert abs(done[s] - c * (slot + 1) / period) < 1
    assert done == held


def test_mix_sources(spark, documents):
    r = random.Random(1)
    rows = [(k, None, r.choice(["a"] * 6 + ["b", "b", "c", None])) for k in range(700)]
    rows += [(900, None, "late"), (None, None, "a"), (5, None, rows[5][2])]
    docs = documents(rows, "doc_id long, text string, source string")
    weights = {"a": 2, "b": 1, "c": 1, None: 1}
    got = mixing.mix_sources(docs, weights, block_rows=5, horizon=50).collect()
    assert sorted(str((x.doc_id, x.source)) for x in got) == sorted(str((x[0], x[2])) for x in rows)
    blocks = {}
    for x in got:
        blocks.setdefault((str(x.source), x.block), []).append((x.place, x.slot))
    for own in blocks.values():
        assert sorted(p for p, _ in own) == list(range(len(own)))
        assert len({s for _, s in own}) == 1
    order = sorted((own[0][1], key) for key, own in blocks.items())
    assert order[-1][1][0] == "late"
    assert len({slot for slot, _ in order}) == len(order)
    ends = {s: max(b for t, b in blocks if t == s) for s in ("a", "b", "c", "None")}
    share, done = {"a": 0.4, "b": 0.2, "c": 0.2, "None": 0.2}, Counter()
    for slot, (s, b) in order:
        done[s] += 1
        assert all(abs(done[x] - share[x] * (slot + 1)) < 1 for x in share)
        if b == ends[s]:
            break
    whole = mixing.mixed(docs, weights, 5, 50, part_rows=100)
    assert whole.columns == docs.columns and whole.count() == len(rows)
    place = {(x.doc_id, x.source): (x.slot, x.place) for x in got if x.doc_id != 5}
    parts = whole.select("doc_id", "source", F.monotonically_increasing_id().alias("at")).collect()
    at = [place[x.doc_id, x.source] for x in sorted(parts, key=lambda x: x["at"]) if x.doc_id != 5]
    assert at == sorted(at)
    none = documents([], "doc_id long, text string, source string")
    assert mixing.mix_sources(none, mixing.tempered_weights(none)).count() == 0


def test_shards(spark, documents):
    rows = [(k, "x" * (k % 7)) for k in range(1003)] + [(None, None)] * 60 + [(7, "same")] * 3
    got = sharding.shard_rows(documents(rows), 8).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    by = {}
    for x in got:
        by.setdefault(x.shard, []).append(x.slot)
    assert set(by) == set(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    nodes = sharding.ring(8)
    assert all(x.home == sharding.shard_of_key(x.doc_id, nodes) for x in got)
    stays = sum(x.home == x.shard for x in got) / len(got)
    assert stays > 0.8
    grown = {x.doc_id: x.shard for x in sharding.shard_rows(documents(rows[:1003]), 9).collect()}
    before = {x.doc_id: x.shard for x in sharding.shard_rows(documents(rows[:1003]), 8).collect()}
    assert sum(grown[i] != before[i] for i in grown) < 0.4 * len(grown)
    assert sharding.shard_rows(documents([]), 8).count() == 0
    one = sharding.shard_rows(documents(rows[:5]), 8).collect()
    assert sorted(x.slot for x in one) == [0] * 5
    assert {x.doc_id: x.size for x in one} == {k: 16 + k % 7 for k in range(5)}


def plain_tree(rows, trains, depth, least):
    """{doc_id: (tokens, known, base, score)} and a function P(symbol | history)."""
    texts = {i: [*brute.words(t), None] for i, t in rows}
    learnt = [texts[i] for i, _ in rows if trains(i)]
    counts = Counter(w for t in learnt for w in t)
    total, kinds = sum(counts.values()), len(counts)
    runs = [Counter() for _ in range(depth + 1)]
    for t in learnt:
        history = [None]
        for w in t:
            for n in range(1, min(depth, len(history)) + 1):
                runs[n][(*history[-n:], w)] += 1
            history.append(w)
    root = lambda w: (counts[w] + 1) / (total + kinds + 1)
    entries, seen = {}, {(w,): c for w, c in counts.items()}
    for n in range(1, depth + 1):
        for run, c in runs[n].items():
            if c >= least and all(counts[w] >= least for w in run):
                entries.setdefault(run[:-1], {})[run[-1]] = c
                seen[run] = c

    def full(context, w):
        if not context:
            return root(w)
        own, n = entries.get(context, {}), seen[context]
        share = {x: max(c - 0.75, 0) / n for x, c in own.items()}
        return share.get(w, 0) + (1 - sum(share.values())) * full(context[1:], w)

    kept = set()
    for context, own in entries.items():
        n = seen[context]
        lower = {w: full(context[1:], w) for w in own}
        gain = sum(c * math.log(c / n / lower[w]) for w, c in own.items())
        other = n - sum(own.values())
        if other > 0:
            gain += other * math.log(other / n / max(1 - sum(lower.values()), 1e-12))
        if gain > 0.5 * len(own) * math.log(max(n, 2)):
            kept |= {context[k:] for k in range(len(context))}

    def p(history, w):
        out = root(w)
        for n in range(1, min(depth, len(history)) + 1):
            context = tuple(history[-n:])
            if context in kept:
                share = {x: max(c - 0.75, 0) / seen[context] for x, c in entries[context].items()}
                out = share.get(w, 0) + (1 - sum(share.values())) * out
        return out

    found = {}
    for i, t in texts.items():
        score, history = 0.0, [None]
        for w in t:
            score += math.log10(p(history, w))
            history.append(w)
        found[i] = (len(t), sum(counts[w] > 0 for w in t), sum(math.log10(root(w)) for w in t), score)
    return found, p, counts, total, kept


def test_suffix_tree(documents):
    r = random.Random(7)
    phrases = ["the cat sat on the mat", "A dog ate the cat", "rain falls", "the the the", "on the mat"]
    rows = [(k, " ".join(r.choice(phrases) for _ in range(r.randint(0, 8))) + f"\n x{k % 9}")
            for k in range(80)]
    rows += [(80, None), (81, ""), (82, "never seen words"), (83, "É é cat")]
    trains = lambda i: i % 7 != 2
    want, p, counts, total, kept = plain_tree(rows, trains, 2, 2)
    assert any(len(k) == 2 for k in kept) and any(len(k) == 1 for k in kept)
    for history in ([None], ["the"], ["on", "the"], ["unseen"], [None, "rain"]):
        assert abs(sum(p(history, w) for w in counts) + p(history, "no such") - 1) < 1e-9
    got = suffix_tree.suffix_tree_scores(
        documents([*rows[:-1], (83, "É é cat"), (None, "the")]), F.col("doc_id") % 7 != 2).collect()
    assert len(got) == len(rows) + 1
    for x in got:
        assert x.train_tokens == total
        if x.doc_id is None:
            assert x.held_out and x.n_tokens == 2
            continue
        tokens, known, base, score = want[x.doc_id]
        assert (x.n_tokens, x.n_known, x.held_out) == (tokens, known, not trains(x.doc_id))
        assert x.base_score == pytest.approx(base) and x.score == pytest.approx(score)
    assert suffix_tree.suffix_tree_scores(documents([]), F.lit(True)).count() == 0
    none = suffix_tree.suffix_tree_scores(documents(rows[:5]), F.lit(False)).collect()
    assert {(x.train_tokens, x.n_known) for x in none} == {(0, 0)}
