import random

import pytest
from pyspark.sql import functions as F

from keyscape.llm import suffix_tree
from tests.llm.test_corpus_operators import plain_tree


@pytest.mark.parametrize("depth", [2, 3])
def test_rare_runs_count_whatever_the_size(documents, monkeypatch, depth):
    """A run seen twice is in the tree of 2.5 million words too, over many blocks."""
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 1 << 20)
    monkeypatch.setattr(suffix_tree, "PART_TOKENS", 1 << 15)
    r = random.Random(depth)
    common = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(r.choices(common, k=200_000))) for k in range(12)]
    rows += [(12 + k, "rare pair of words w1 w2 other rare end") for k in range(2)]
    rows += [(14, "seen rare pair of words w1 once"), (15, "pair of words"), (16, None)]
    trains = lambda i: i != 15
    want, _, _, total, kept = plain_tree(rows, trains, depth, 2)
    assert total > 2_000_000 and ("rare", "pair") in kept
    got = suffix_tree.suffix_tree_scores(documents(rows), F.col("doc_id") != 15, depth=depth).collect()
    assert len(got) == len(rows)
    for x in got:
        tokens, known, base, score = want[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (tokens, known, total)
        assert x.base_score == pytest.approx(base) and x.score == pytest.approx(score)


def test_blocks_of_empty_texts(documents):
    rows = [(k, (None, "", " \n")[k % 3]) for k in range(9)]
    got = suffix_tree.suffix_tree_scores(documents(rows), F.col("doc_id") > 2).collect()
    want, *_ = plain_tree(rows, lambda i: i > 2, 2, 2)
    assert {x.doc_id: (x.n_tokens, x.n_known) for x in got} == {i: w[:2] for i, w in want.items()}
    assert all(x.score == pytest.approx(want[x.doc_id][3]) for x in got)
