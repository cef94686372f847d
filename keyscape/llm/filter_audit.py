"""Operator 11: how document filters interact, over all orders in which they can be applied.

Every document gets a mask with a bit for each filter that it fails. Four filters look at
the text alone. The fifth, duplicates, is found with compressed tries of whole texts: each
task reduces its own rows to a trie, then the texts that differ are dealt by ranges of
their beginnings, as long as it takes to split them evenly, and merged in one trie for
each range. A trie holds the smallest id at the node where a text ends. Masks are then
counted, and every order is read off the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.llm.words import IDENTITY, flat, row_slices, word_hashes
from keyscape.session import materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 100, 80, 10, b"#$%&*|"
SLICE_BYTES = 2 << 20
#: A task's trie is written out when it holds so many bytes of texts.
TRIE_BYTES = 24 << 20
#: Texts of one range, about; beginnings that have more are made longer.
PART_BYTES = 16 << 20
FIRST_CHARS, LONGER = 8, 4


class Trie:
    """A compressed trie of byte strings, with the least value at each string's end.

    A node is [label, least value or None, children by first byte or None].
    """

    def __init__(self):
        self.root = [b"", None, None]
        self.held = 0

    def insert(self, text: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while at < len(text):
            children = node[2]
            if children is None:
                children = node[2] = {}
            child = children.get(text[at])
            if child is None:
                child = children[text[at]] = [text[at:], None, None]
                self.held += len(child[0])
            label = child[0]
            if not text.startswith(label, at):
                k = _shared(label, text, at)
                children[text[at]] = [label[:k], None, {label[k]: child}]
                child[0], child = label[k:], children[text[at]]
                label = child[0]
            node, at = child, at + len(label)
        if node[1] is None or value < node[1]:
            node[1] = value

    def texts(self) -> Iterator[tuple[bytes, tuple]]:
        """(text, least value) of every string."""
        todo = [(self.root, b"")]
        while todo:
            node, before = todo.pop()
            text = before + node[0]
            if node[1] is not None:
                yield text, node[1]
            todo.extend((child, text) for child in (node[2] or {}).values())

    def values(self) -> Iterator[tuple]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[1] is not None:
                yield node[1]
            todo.extend((node[2] or {}).values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Bytes that ``label`` and ``text[at:]`` share from the start; they differ later."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


_MARKED = np.zeros(256, bool)
_MARKED[list(MARKS)] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[off])


def text_masks(column: pa.Array) -> np.ndarray:
    """The bits of A to D of every text; words are compared by 64-bit hashes."""
    data, off = flat(column)
    words, at = word_hashes(column, IDENTITY)
    counts = np.diff(at)
    distinct = np.array([
        len(np.unique(words[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
    chars = _sums((data & 0xC0) != 0x80, off)
    fails = [
        counts < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * counts,
        100 * _sums((data >= 0x41) & (data <= 0x5A), off) > UPPER_PERCENT * chars,
        _sums(_MARKED[data], off) > 0]
    return sum(np.asarray(f, np.int64) << k for k, f in enumerate(fails))


_ROW = pa.schema([
    ("text_row", pa.bool_()), ("i", pa.int64()), ("h", pa.int64()), ("part", pa.string()),
    ("mask", pa.int32()), ("t", pa.string())])
_DDL = "text_row boolean, i long, h long, part string, mask int, t string"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows (i, h, part, t) to a row without text and with the mask for each, and to
    its distinct texts, each with its smallest id."""

    def written(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for text, (i, h) in trie.texts():
            rows.append((i, h, text))
            held += len(text)
            if held > SLICE_BYTES:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        i, h, texts = zip(*rows, strict=True)
        n = len(rows)
        return pa.RecordBatch.from_arrays([
            pa.array([True] * n), pa.array(i, pa.int64()), pa.array(h, pa.int64()), pa.nulls(n, pa.string()),
            pa.nulls(n, pa.int32()), pa.array(texts, pa.string())], schema=_ROW)

    trie = Trie()
    for batch in batches:
        for start, end in row_slices(batch.column(3), SLICE_BYTES):
            part = batch.slice(start, end - start)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array([False] * n), part.column(0), part.column(1), part.column(2),
                pa.array(text_masks(part.column(3)), pa.int32()), pa.nulls(n, pa.string())], schema=_ROW)
            texts = part.column(3).cast(pa.binary()).to_pylist()
            for i, h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                if i is not None:
                    trie.insert(t, (i, h))
            if trie.held > TRIE_BYTES:
                yield from written(trie)
                trie = Trie()
    yield from written(trie)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the texts of one range in one trie; (i, h) of the first row of every text."""
    trie = Trie()
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            trie.insert(t, (i, h))
    found = list(trie.values())
    for k in range(0, len(found), 65536):
        i, h = zip(*found[k : k + 65536], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(h, pa.int64())], names=["i", "h"])


def _by_beginning(texts: DataFrame, part_bytes: int) -> DataFrame:
    """``texts`` (i, h, t) dealt by ranges of ``key``, the beginning of a text: as many
    characters as it takes until the texts that share it have ``part_bytes`` at most, or
    until they are at their end. Longer beginnings are known by hashes; there are no more
    of one length than ranges, so that the join with them can be broadcast."""
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))
    keyed, chars = texts.withColumn("n", F.lit(FIRST_CHARS)), FIRST_CHARS
    while True:
        beginning = F.xxhash64(F.substring("t", 1, chars))
        heavy = materialize(
            keyed.where((F.col("n") == chars) & (F.char_length("t") > chars)).groupBy(beginning.alias("heavy"))
            .agg(F.sum(F.octet_length("t")).alias("size")).where(F.col("size") > part_bytes).select("heavy"),
            "audit-beginnings")
        if heavy.isEmpty():
            break
        longer = chars * LONGER
        keyed = keyed.join(
            F.broadcast(heavy), (F.col("n") == chars) & (beginning == F.col("heavy")), "left"
        ).withColumn("n", F.when(F.col("heavy").isNotNull(), longer).otherwise(F.col("n"))).drop("heavy")
        chars = longer
    key = F.expr("substring(t, 1, n)")
    return keyed.withColumn("key", key).repartitionByRange(parts, "key").select("i", "h", "t")


def document_masks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(i, part, mask, n): ids with the mask of the filters that they fail (bit k for the
    k-th of ``FILTERS``), ``n`` rows of each.

    A: under 100 words. B: fewer than 80 distinct words in a hundred. C: more than 10
    letters A-Z in a hundred code points. D: one of ``#$%&*|``. E: a text identical to
    that of a row with a smaller id, whether any other filter removes that row or not.

    A null text is empty, a null part the empty string. Rows of the smallest id pass E,
    also when that id is repeated; a null id is neither smaller nor larger than another
    and passes E. Other columns are not read. Copies are reduced to one text in each task
    before they are shuffled, so a large group sends one text from a task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("i"), F.xxhash64(text).alias("h"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    found = materialize(rows.mapInArrow(_local, _DDL), "audit-rows")
    texts = found.where("text_row").select("i", "h", "t")
    firsts = _by_beginning(texts, part_bytes).mapInArrow(_merged, "i long, h long")
    firsts = firsts.select(F.col("i").alias("fi"), F.col("h").alias("fh"))
    masks = found.where(~F.col("text_row")).groupBy("i", "h", "part", "mask").agg(F.count("*").alias("n"))
    masks = materialize(masks, "audit-masks")
    known = masks.where("i is not null").join(
        firsts, (F.col("i") == F.col("fi")) & (F.col("h") == F.col("fh")), "left")
    again = F.when(F.col("fi").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return known.select("i", "part", F.col("mask").bitwiseOR(again).alias("mask"), "n").unionByName(
        masks.where("i is null").select("i", "part", "mask", "n"))


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, the step's bit, the bits before it) of every order of the filters."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    return [
        ("".join(o), s + 1, bit[f], sum(bit[x] for x in o[:s]))
        for o in permutations(filters) for s, f in enumerate(o)]


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, filter order and step of ``masks`` (part, mask, good, toxic,
    n): ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter but are
    gone before), ``unique_fails`` (fail its filter only), ``good_lost`` and ``toxic_lost``
    of those removed, and ``shapley``, what its filter removes over all orders.

    Masks are counted first: a part has at most 4 x 2^k counts for k filters, whatever its
    number of documents. k! x k rows for each part; k is five here. Of the documents that
    fail j filters each one is first in k!/j of the orders.
    """
    counts = masks.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    listed = F.array(*[
        F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"),
                 F.lit(e).alias("earlier")) for o, s, b, e in orders(filters)])
    rows = counts.select("*", F.inline(listed))
    mask, bit, earlier = (F.col(c) for c in ("mask", "bit", "earlier"))
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) != 0
    share = reduce(
        lambda x, j: F.when(F.bit_count(mask) == j, factorial(len(filters)) // j).otherwise(x),
        range(1, len(filters) + 1), F.lit(0))
    total = lambda where, name: F.sum(F.when(where, F.col("n")).otherwise(0)).alias(name)
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, "kept"), total(fails & ~gone, "removed"), total(fails & gone, "redundant"),
        total(mask == bit, "unique_fails"), total(fails & ~gone & F.col("good"), "good_lost"),
        total(fails & ~gone & F.col("toxic"), "toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share).otherwise(0)).alias("shapley"))


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``interactions`` of the filters over ``docs``; good and toxic are ids that ``labels``
    (id, quality, toxic) marks with 1 in any row. Ids without a label, and null ids, are
    neither. An empty table has no parts and no rows."""
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("li")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    masks = document_masks(docs, id_col, text_col, part_col, part_bytes)
    none = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    pick = lambda df: df.select("part", "mask", "n", none("good"), none("toxic"))
    known = pick(masks.where("i is not null").join(marked, F.col("i") == F.col("li"), "left"))
    other = masks.where("i is null").select("part", "mask", "n", *[F.lit(False).alias(c) for c in ("good", "toxic")])
    return interactions(known.unionByName(other))
