"""The queries themselves, over a whole small table, against plain versions."""

import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyscape.llm import queries, sharding
from tests.llm.test_corpus_operators import plain_tree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rest(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_token_counts(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = queries.op1_token_counts(spark, SF)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    got = {tuple(r)[:4] for r in out.collect()}
    counts = {i: len(tok.encode(t, add_special_tokens=False)) for i, t in texts.items()}
    assert got == {(i, len(t.encode()), counts[i], counts[i] > 512) for i, t in texts.items()}
    assert {x[3] for x in got} == {True, False}


def test_quality(spark, texts):
    out = queries.op2_quality(spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (rest(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [r for r in rows if r.held_out and r.doc_id in truth]
    good = [r.score for r in known if truth[r.doc_id] == 1]
    bad = [r.score for r in known if truth[r.doc_id] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_suffix_tree(spark, texts):
    want, _, _, total, _ = plain_tree(list(texts.items()), lambda i: rest(i, 7) != 2, 2, 2)
    rows = queries.op3_suffix_tree(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens, known, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(r.doc_id, 7) == 2, tokens, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_mixed_sources(spark, texts):
    rows = queries.op5_mix_sources(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert len({(r.slot, r.source, r.place) for r in rows}) == len(rows)
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(sources[r.doc_id] == r.source for r in rows)


def walked(keys, nodes, room):
    """Shards of keys, placed one by one: those on an arc with its own shard while that has
    room, then what is left goes on clockwise, node by node."""
    points = [p for p, _ in nodes]
    arc = {k: int(np.searchsorted(points, sharding._point(str(k))) % len(nodes)) for k in keys}
    order = sorted(keys, key=lambda k: (arc[k], k))
    out, late = {}, []
    for k in order:
        shard = nodes[arc[k]][1]
        if room[shard]:
            out[k] = shard
            room[shard] -= 1
        else:
            late.append(k)
    for k in late:
        at = arc[k]
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        out[k] = nodes[at][1]
        room[nodes[at][1]] -= 1
    return out


def test_shards_are_those_of_a_walk_key_by_key(spark, texts):
    rows = queries.op6_shards(spark, SF).collect()
    want = walked(sorted(texts), sharding.ring(40), sharding.capacities(len(texts), 40))
    assert {r.doc_id: r.shard for r in rows} == want
    sizes = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1


def test_one_more_shard_moves_little(spark):
    """Of 10,000 rows some five in a hundred; a shard's share is 2.4."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    before, after = ({r.doc_id: r.shard for r in sharding.shard_rows(docs, n).collect()} for n in (40, 41))
    assert sum(after[i] != s for i, s in before.items()) < 0.06 * len(before)


def test_token_files(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(queries.op7_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(texts) and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in pairwise(rows))
    for r in rows:
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
