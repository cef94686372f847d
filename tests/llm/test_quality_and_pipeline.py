import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keyscape.llm import mixing, quality_crf, queries
from keyscape.llm.line_features import NAMES, line_features, with_neighbours
from tests.llm import brute

DATA = "/root/testdata/sf0.01"


def test_lines_and_neighbours():
    texts = ["a B\n\nC. a a", "", None, "x\n", "\n", "é É 12!!\nzz"]
    features, size, off = line_features(pa.array(texts))
    lines = [(t or "").split("\n") for t in texts]
    lines[3], lines[4] = ["x"], [""]
    assert np.diff(off).tolist() == [len(x) for x in lines]
    assert size.tolist() == [len(u.encode()) for x in lines for u in x]
    third = dict(zip(NAMES, features[2], strict=True))
    assert third["ends_sentence"] == 0 and third["same_as_before"] == pytest.approx(1 / 3)
    assert dict(zip(NAMES, features[0], strict=True))["upper"] == pytest.approx(1 / 3)
    both = with_neighbours(features, off)
    n = len(NAMES)
    assert (both[0, n + 1 : 2 * n + 1] == 0).all() and (both[0, 2 * n + 1 :] == features[1]).all()
    assert (both[2, 2 * n + 1 :] == 0).all()


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(3)
    off = np.array([0, 1, 5, 8])
    good, moves = r.normal(size=8) * 3, r.normal(size=(2, 2)) * 2
    p, moved, norm = quality_crf.marginals(good, off, moves)
    want, steps, logs = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(off):
        total, part, count = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(np.dot(y, good[a:b]) + sum(moves[s] for s in itertools.pairwise(y)))
            total += w
            part += w * np.array(y)
            for s in itertools.pairwise(y):
                count[s] += w
        want[a:b], logs = part / total, logs + np.log(total)
        steps += count / total
    assert np.allclose(p, want) and np.allclose(moved, steps) and norm == pytest.approx(logs)


def test_held_out_quality(spark, documents):
    got = queries.op2_quality(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert len(both) > 80 and (both.predicted == both.quality).mean() > 0.97
    assert got.score.between(0, 1).all() and len(got) == 1000
    docs = documents([(1, None), (None, ""), (3, "THE!! END!!" * 4000), (3, "THE!! END!!" * 4000)])
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    model = queries.quality_model(source, spark.read.parquet(f"{DATA}/labels.parquet"))
    scored = docs.select("doc_id", quality_crf.score(F.col("text"), model).alias("s")).collect()
    own = {r.doc_id: r.s for r in scored}
    assert own[1] == pytest.approx(own[None]) and own[3] < 0.5
    kept = quality_crf.good_documents(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 0
    none = quality_crf.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert docs.select(quality_crf.score(F.col("text"), none).alias("s")).first().s == 0.5
    assert quality_crf.good_documents(documents([]), model).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    outs = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], DATA).write.parquet(f"{tmp_path}/{k}")
        outs.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert outs[-1].schema == docs.schema, name
    rows = [dict((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) for out in outs[:5]]
    # 1: clean documents stay, the classifier's rejects go
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    scores = {r.doc_id: r.predicted for r in queries.op2_quality(spark, DATA).collect()}
    assert set(rows[1]) == {i for i, y in scores.items() if y}
    assert sum(i in rows[1] for i, y in labels.items() if y) >= 0.98 * sum(labels.values())
    # 2: one of each group of near-copies
    groups = brute.near_groups(list(rows[1].items()))
    assert set(rows[2]) == {i for i, (n, c) in groups.items() if i == c}
    # 3: what holds benchmark windows goes
    hits = brute.contamination(list(rows[2].items()), items)
    assert set(rows[3]) == {i for i, x in hits.items() if not x[1]} and len(rows[3]) < len(rows[2])
    # 4: all stay, in the order of the schedule
    assert rows[4] == rows[3]
    order = outs[4].select("doc_id", "source", "_metadata.file_path", "_metadata.row_index").collect()
    order = sorted(order, key=lambda r: (r.file_path, r.row_index))
    placed = mixing.mix_sources(outs[3], mixing.tempered_weights(outs[3])).collect()
    at = {r.doc_id: (r.slot, r.source, r.place) for r in placed}
    assert [r.doc_id for r in order] == sorted(at, key=at.get)
    # 5: the tokens of all of them, in that order
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in order:
        ids = [*tok.encode(rows[4][r.doc_id], add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, outs[5].collect()), key=lambda x: x[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()), key=lambda x: x[1]) == want
