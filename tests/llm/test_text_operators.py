import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyscape.llm import decontamination, digest_index, line_dedup, token_counts, token_files, words
from keyscape.llm.memo import Memo, safe_pieces
from tests.llm import brute

ODD = ["a", "B", "é", "É", " ", "\n", "\t", " ", "  ", "字", "\xa0", "1", "!", ",", ".", "'s", "\x1c",
       "<|endoftext|>", "😀", "'", "\x85", "'LL", "ß", "İ", "́"]


def odd_texts(count, seed=1):
    r = random.Random(seed)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(count)]
    return [*texts, None, "", " ", "x" * 5000, "a, b. " * 3000, texts[0], texts[0]]


@pytest.mark.parametrize("step", [7, 64, 1 << 20])
def test_words_do_not_depend_on_pieces(step):
    texts = odd_texts(300)
    data, off = words.flat(pa.array(texts))
    hashes, starts = [], []
    for s, e in words.pieces(data, off, step=step):
        a, b = words.word_spans(data, off, s, e)
        hashes += words.hash_spans(data[s:e], a, b).tolist()
        starts += (a + s).tolist()
    expected = [brute.words(t) for t in texts]
    assert np.diff(np.searchsorted(starts, off)).tolist() == [len(x) for x in expected]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(sum(expected, []), hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("name", "folds"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_tokenize_like_whole_texts(name, folds):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    memo = Memo(lambda t: tok.encode_batch_fast(t, add_special_tokens=False), True, limit=50)
    texts = odd_texts(1500, 2)
    data, off = words.flat(pa.array(texts))
    got = []
    for base, starts, ends, keys in safe_pieces(data, off, folds):
        slots = memo.resolve(data, starts + base, ends - starts, keys)
        got.append(memo.flat[words.ragged(memo.starts[slots], memo.lengths[slots])])
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert np.concatenate(got).tolist() == sum(want, [])


def test_token_counts(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(k if k % 50 else None, t) for k, t in enumerate(odd_texts(200))]
    got = token_counts.token_counts(documents(rows), path).collect()
    want = [
        (i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(documents([]), path).count() == 0


def test_token_files_round_trip(spark, documents, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(k * 3, t) for k, t in enumerate(odd_texts(200))] + [(None, "a b"), (9, "twice"), (9, "twice")]
    out = f"{tmp_path}/files"
    token_files.write_token_files(documents(rows), out, path, 1, folds=True, part_bytes=4000)
    got = sorted(
        token_files.read_token_files(spark, out, ids=True).collect(), key=lambda r: r.start)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    at, ids = 0, []
    for r in got:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(bytes(r.ids)))
        want[r.doc_id].remove(own)
        at += len(own)
        ids.append(r.doc_id)
    assert not any(want.values())
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert token_files.read_document(spark, out, 9)[0][-1] == 1
    assert len(token_files.read_document(spark, out, 9)) == 3
    assert token_files.read_document(spark, out, 10**9) == []
    token_files.write_token_files(documents([]), f"{tmp_path}/none", path, 1, folds=True)
    assert token_files.read_token_files(spark, f"{tmp_path}/none").count() == 0


LINES = ["one two three four five six", "ONE  two three four five six ", "short line", "", "x",
         "é É ß a b c d", "a line that is nowhere else in these rows", "one two three four five",
         "Two short. Words here! A third sentence with many more words. And what? is this...  a b c d e f"]
PASSAGE = (
    "This passage stands in several texts. It has a few sentences, of which some are long enough and one is\n"
    "wrapped. Short one. Another sentence follows here with words é ß 漢字 so that all of it is over fifty words. ")


@pytest.mark.parametrize("run", [1, 12, 30])
def test_repeated_passages(documents, run):
    r = random.Random(3)
    rows = [(k, "\n".join(r.choice(LINES) for _ in range(r.randint(1, 9)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "\n".join([LINES[0]] * 3000)), (64, " "), (65, "no end. ")]
    rows += [(70 + k, f"Text number {k} starts with words of its own. {PASSAGE}It ends so {k}.") for k in range(5)]
    want = brute.repeated_passages(rows, run=run)
    got = line_dedup.remove_repeated(documents([*rows, rows[5]]), min_run=run).collect()
    assert len(got) == len(rows) + 1
    texts = dict(rows)
    for row in got:
        count, spans = want[row.doc_id]
        assert ([tuple(x) for x in row.removed], row.n_units) == (spans, count)
        rest, text = [], texts[row.doc_id]
        for s, e, _ in brute.passages(text):
            rest += [] if any(x[1] == s for x in spans) else [text[s:e]]
        assert row.text == (None if text is None else "".join(rest))
    assert line_dedup.remove_repeated(documents([])).count() == 0


def test_a_passage_goes_and_a_shared_sentence_stays(documents):
    rows = [(0, f"Own words of the first text are these here. {PASSAGE}"), (1, f"Another start.\n{PASSAGE}The end."),
            (2, "This passage stands in several texts. Nothing else of it does.")]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated(documents(rows)).collect()}
    assert got[0] == rows[0][1] and got[2] == rows[2][1]
    assert got[1] == "Another start.\nThe end."


def _digest(t):
    s = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    return hashlib.sha256(s.encode()).hexdigest()


def _first(member):
    i, n = member
    return -n, i is None, i or 0


def _digests(rows, known):
    """Rows of a batch; ``known``: {digest: all (id, code points) so far}."""
    groups, out = {}, []
    for i, t in rows:
        groups.setdefault(_digest(t), []).append((i, len(t or "")))
    for d, members in groups.items():
        before = known.get(d, [])
        best = min(before or members, key=_first)
        for i, n in members:
            kept = not before and (i, n) == best
            out.append((i, best[0], len(before) + len(members), kept, d))
    for d, members in groups.items():
        known.setdefault(d, []).extend(members)
    return sorted(map(str, out))


def test_exact_dedup_against_the_index(spark, documents):
    first = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, " \n"), (7, "é"), (8, "e"),
             (9, "x" * 9000), (10, "x" * 9000), (None, "ab  "), (None, "lone")]
    second = [(20, "ab"), (21, "new"), (22, "new"), (23, None), (24, " a  b  ")]
    third = [(30, "ab"), (11, "a b"), (31, "n e w"), (32, "e")]
    index, known = digest_index.DigestIndex(spark, buckets=4), {}
    for rows in (first, second, third, []):
        got = index.add(index.entries(documents(rows))).collect()
        assert sorted(str(tuple(r)) for r in got) == _digests(rows, known)
    labels = {bytes(r.digest).hex(): (r.keep_id, r.keep_n, r.group_size) for r in index.labels().collect()}
    assert labels == {d: (*min(m, key=_first), len(m)) for d, m in known.items()}
    assert index.labels().count() == spark.table(index.table).where("first").count() == len(known)
    again = digest_index.DigestIndex(spark, index.table, 4)
    row = again.add(again.entries(documents([(40, "l o n e")]))).first()
    assert (row.keep_id, row.kept, row.group_size) == (None, False, 2)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup_does_not_depend_on_batches(spark, documents, batches):
    rows = [(k, "x " * (k % 7) + "x" * (7 - k % 7)) for k in range(40)] + [(k + 100, f"t {k % 9}") for k in range(30)]
    rows += [(3, "x " * 3 + "x" * 4), (None, "t 1"), (None, None), (200, ""), (201, None)]
    index = digest_index.DigestIndex(spark, buckets=4)
    got = digest_index.deduplicate(documents(rows), index, batches).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(_digest(t), []).append((i, len(t or "")))
    want = []
    for i, t in rows:
        best = min(groups[_digest(t)], key=_first)
        want.append((i, best[0], len(groups[_digest(t)]), (i, len(t or "")) == best, _digest(t)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_the_index_is_met_by_a_merge_anti_join(spark, documents):
    index = digest_index.DigestIndex(spark, buckets=4)
    index.add(index.entries(documents([(1, "a")])))
    known = index.labels().hint("merge")
    plan = index.entries(documents([(2, "b")])).join(known, "digest", "left_anti")._jdf.queryExecution().toString()
    side = plan[plan.index("SortMergeJoin") :]
    assert "LeftAnti" in side and side.count("Exchange") == 1


def test_decontamination(spark, documents):
    r = random.Random(5)
    vocabulary = ["the", "of", "é", "3d", "Alpha", "beta-gamma", "delta", "epsilon", "zeta", "theta"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([3, 9, 10, 11, 25]))) for k in range(12)]
    items += [(12, None), (13, " .. "), (14, items[0][1]), (15, "unique"), (16, None)]
    rows = [(k, text(r.randint(0, 40))) for k in range(60)]
    rows += [(k + 60, f"({text(5)}) {items[k][1]}! {text(4)}".upper()) for k in range(12)]
    rows += [(72, None), (73, ""), (74, "...,"), (75, "Unique."), (76, "unique " * 5000), (77, "clean")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, items)
    docs = documents([*rows, rows[3]])
    got = decontamination.contamination(docs, benchmark).collect()
    assert len(got) == len(rows) + 1
    for row in got:
        n, hit, found = want[row.doc_id]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n, len(hit), len(found), bool(hit))
        listed = ",".join(sorted(map(str, found)))
        assert row.items_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set().union(*[range(s.first, s.last) for s in row.spans]) == hit
    left = decontamination.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert {x.doc_id for x in left.collect()} == {i for i, x in want.items() if not x[1]}
    cut = {x.doc_id: x.text for x in decontamination.remove_spans(docs, benchmark).collect()}
    for i, t in rows:
        hit, own = want[i][1], brute.benchmark_words(t)
        left = [w for k, w in enumerate(own) if k not in hit]
        assert brute.benchmark_words(cut[i]) == left
        assert hit or cut[i] == t
    empty = benchmark.limit(0)
    assert decontamination.contamination(docs, empty).where("contaminated").count() == 0
    assert decontamination.contamination(documents([]), benchmark).count() == 0
    plan = decontamination.contamination(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_anchors_in_blocks(spark, documents, monkeypatch):
    items = [(k, f"word{k} other{k % 7} thing") for k in range(40)]
    rows = [(k, f"x word{k} other{k % 7} thing y") for k in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = decontamination.contamination(documents(rows), benchmark).drop("spans")
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(decontamination, "BLOCK_ANCHORS", 7)
    got = decontamination.contamination(documents(rows), benchmark).drop("spans")
    assert sorted(map(tuple, got.collect())) == want
    assert got.where(F.col("contaminated")).count() == 40
