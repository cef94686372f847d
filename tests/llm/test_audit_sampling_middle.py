"""Filter audit, weighted sampling and fill-in-the-middle against plain Python."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyscape.llm import fill_middle, filter_audit, queries, weighted_sampling

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle ----------------------------------------------------

def middle(i, text, unit=r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"):
    text = text or ""
    u = list(text) if unit == "chars" else re.findall(unit, text)
    digest = sha(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "\n\t ", "one", " one two ", "ünï cödé 漢字 😀 mix x", "a<P>b c", "<", "<<S <P x> y",
    "x\x0by\x1cz\x85w", "漢字 " * 4000 + "end ", "word " * 3000, "a\r\n\r\nb", "  　ß"]


@pytest.mark.parametrize("unit", ["tokens", "chars"])
def test_fill_in_middle_equals_brute_force(spark, documents, unit):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(90)] + [(3, "again twice"), (3, "again twice"), (None, "no id é x")]
    out = fill_middle.fill_in_middle(documents(rows), unit=unit)
    out = out.withColumn("back", fill_middle.restored("output", "form"))
    kind = "chars" if unit == "chars" else r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    want = []
    for i, t in rows:
        n, form, p, m, o = middle(i, t, kind)
        want.append((i, n, form, p, m, o, t or ""))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
    assert {"plain", "psm", "spm"} == {x[2] for x in want}


def test_fill_in_middle_query_on_its_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13_fill_middle(spark, SF).collect():
        n, form, p, m, o = middle(r.doc_id, rows[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, sha(o), sha(rows[r.doc_id] or ""))


@given(st.text())
def test_exceptions_convert_both_ways(text):
    index = fill_middle.Exceptions(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    cuts = np.array([len(text[:k].encode()) for k in chars])
    assert index.bytes(chars).tolist() == cuts.tolist()
    assert index.chars(cuts).tolist() == chars.tolist()


# --- filter audit ----------------------------------------------------------

def mask(text):
    w = re.findall(WORD, text)
    return (
        (len(w) < 100) | (100 * len(set(w)) < 80 * len(w)) << 1
        | (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) << 2
        | bool(re.search(r"[#$%&*|]", text)) << 3)


def masks(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    return [
        (i, part or "", mask(text or "") | (i is not None and i > least[text or ""]) << 4)
        for i, text, part in rows]


def audit(rows, good, toxic):
    out = {}
    found = defaultdict(list)
    for i, part, m in masks(rows):
        found[part].append((i, m))
    for part, docs in found.items():
        gone = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                removed = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                gone[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(bool(m & bit) for _, m in docs) - len(removed),
                    sum(m == bit for _, m in docs), sum(i in good for i, _ in removed),
                    sum(i in toxic for i, _ in removed), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = gone[row[-1]]
    return out


def audit_rows():
    long = " ".join(f"w{k}" for k in range(120))
    rows = [
        (0, long, "en"), (1, long, "en"), (2, long + " $", "en"), (3, "Ab", None), (4, None, "de"), (5, "", "de"),
        (6, "x " * 150, "en"), (7, "SHOUT " * 150, "fr"), (8, "SHOUT " * 150, "fr"), (9, "é" * 9 + "A", ""),
        (None, long, "en"), (None, "Ab", None), (9, long, "en"), (1, long, "en"), (0, long, "en")]
    head = "the same beginning of many texts, longer than one key of the ranges "
    rows += [(20 + k, head * 3 + f"number {k % 30} " + long, "en") for k in range(90)]
    return rows + [(300 + k, long + " copy", "es") for k in range(60)]


@pytest.mark.parametrize("small", [False, True])
def test_masks_and_audit_equal_brute_force(spark, documents, monkeypatch, small):
    if small:
        monkeypatch.setattr(filter_audit, "TRIE_BYTES", 2000)
    rows = audit_rows()
    docs = documents(rows, "doc_id long, text string, lang string").drop("part").withColumnRenamed("i", "mask")
    size = 4000 if small else filter_audit.PART_BYTES
    got = filter_audit.document_masks(docs, part_bytes=size)
    flat = [(r.i, r.part, r["mask"]) for r in got.collect() for _ in range(r.n)]
    assert sorted(flat, key=repr) == sorted(masks(rows), key=repr)
    labels = spark.createDataFrame(
        [(0, 1, 0), (1, 0, 1), (1, 1, None), (7, None, 1), (8, 1, 1), (None, 1, 1), (25, 1, 0)],
        "doc_id long, quality int, toxic int")
    report = filter_audit.filter_audit(docs, labels, part_bytes=size)
    got = {(r.part, r.filter_order, r.step): [
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in report.collect()}
    assert got == audit(rows, {0, 1, 8, 25}, {1, 7, 8})


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, labels).count() == 0
    nulls = spark.createDataFrame([(None, None, None)], empty.schema)
    got = filter_audit.filter_audit(nulls, labels)  # no words: A removes it once in each order
    assert (got.count(), got.where("removed = 1").count(), got.where("shapley = 120").count()) == (600, 120, 120)


@given(st.lists(st.tuples(st.text("abé", max_size=9), st.integers(0, 99))))
def test_trie_holds_the_least_value_of_every_string(rows):
    trie, want = filter_audit.Trie(), {}
    for text, i in rows:
        trie.insert(text.encode(), (i, 0))
        want[text.encode()] = min(i, want.get(text.encode(), i))
    assert {t: v[0] for t, v in trie.texts()} == want
    assert sorted(v[0] for v in trie.values()) == sorted(want.values())


# --- weighted sampling -----------------------------------------------------

def edited(rows):
    """[(id, text, next text, edited text)] in order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        follows, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out.append((i, t, follows, t[: len(t) - half] + follows[:half]))
    return out


def jaccard(a, b):
    a, b = Counter(re.findall(WORD, a)), Counter(re.findall(WORD, b))
    both = a.keys() | b.keys()
    return sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both) if both else 1.0


@pytest.mark.parametrize("bucket", [40, 1 << 20])
def test_next_texts_and_edges(spark, documents, bucket):
    rows = [(k * 7 % 50, f"text number {k} " + "é漢" * (k % 5)) for k in range(50)]
    rows += [(100, None), (101, ""), (101, ""), (3, "tie b"), (3, "tie a"), (None, "no id"), (None, None), (102, "w")]
    out = weighted_sampling.fingerprints(documents(rows), bucket_bytes=bucket)
    want = edited(rows)
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(i, len(t), sha(e)) for i, t, _, e in want], key=repr)
    by_text = defaultdict(set)
    for r, in out.select(F.struct("fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_sha256")).collect():
        by_text[r.edited_sha256].add(r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())


@pytest.mark.parametrize("rows", [[], [(None, None)], [(5, "a b a b")], [(None, "x y"), (None, "x z")]])
def test_sampling_of_tiny_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = weighted_sampling.fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.edited_sha256) for r in out), key=repr) == sorted(
        ((i, sha(e)) for i, _, _, e in edited(rows)), key=repr)
    if len(rows) == 1:
        assert out[0].near_next == 1.0 and len(out[0].fingerprint) == (256 if rows[0][1] else 0)


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    """Over a whole table the mean difference is small, and single ones are within what
    64 samples allow."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {i: (jaccard(t, e), jaccard(t, n)) for i, t, n, e in edited((r.doc_id, r.text) for r in docs.collect())}
    errors = []
    for r in queries.op12_weighted_sampling(spark, SF).collect():
        for got, want in zip((r.near_edited, r.near_next), rows[r.doc_id], strict=True):
            errors.append(got - want)
            assert abs(got - want) < 5 * (want * (1 - want) / 64) ** 0.5 + 0.02
    assert abs(np.mean(errors)) < 0.01


def test_weights_count(spark):
    """One text with a word ten times and one with it once are alike as 1 : 10 in it."""
    rows = [(0, "a " * 10 + "b c d"), (1, "a b c d")]
    texts = spark.createDataFrame(rows, "k long, t string")
    f = {r.k: r.fingerprint for r in weighted_sampling.signatures(texts, ["k"], "t", 512).collect()}
    same = sum(f[0][4 * k : 4 * k + 4] == f[1][4 * k : 4 * k + 4] for k in range(512)) / 512
    assert abs(same - 4 / 13) < 0.08


def test_no_python_in_the_plan(spark):
    plan = weighted_sampling.fingerprints(
        spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
