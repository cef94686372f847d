"""Operator 3: language-model scores from a probabilistic suffix tree.

Symbols are words and the end of a text. The tree's contexts are runs of up to
``DEPTH`` symbols. A run of symbols enters the tree if it occurs ``LEAST`` times or more
in the training texts, whatever the size of the corpus, so the tree grows with it.
A context stays if its next-symbol counts diverge from what its suffix predicts: if the
log-likelihood that it gains is over half its number of entries times the logarithm of
its count. Suffixes of contexts that stay do so too.

The next symbol's probability in a state is its discounted relative frequency there,
and the mass left over times its probability in the longest suffix state; at the root it
is (count + 1) / (N + V + 1), with exact counts of all words of the corpus. It sums to
one over the words seen and one unseen. A text's score adds up the probabilities in the
longest states that its words reach.

Neither the driver nor any task holds the tree. Blocks of texts ask for the counts of
their own distinct runs, then for their contexts' sums over all entries, in packed
arrays dealt by hash range; each block's part of a context's sums comes from the places
where the context stands in it, so that a context with many entries is in no one task.
Blocks stay where they are: they are a table dealt by block, and only what a step needs of
the answers so far is brought to them. A run is asked for only if its first and its last
symbols, all but one, occur often enough; a longer run can't occur more often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.llm.packing import differences, pack, unpack
from keyscape.llm.words import mix, row_slices, word_hashes
from keyscape.session import materialize, materialize_dealt

DEPTH = 2
LEAST = 2
DISCOUNT = 0.75
BLOCK_BYTES = 6 << 20
PART_TOKENS = 2 << 20
END = np.uint64(0x0E0D_0E0D_0E0D_0E0D)
#: Steps of rows: texts, counts of runs of L + 1 symbols at _COUNTS + L, sums of contexts of
#: L symbols at L, marks of suffixes at _MARKS + L.
_TEXTS, _COUNTS, _MARKS = -1, 2000, 1000
_FACTORS = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)

_ROW = "block long, step int, part int, v long, payload binary"
_ROW_ARROW = pa.schema([
    ("block", pa.int64()), ("step", pa.int32()), ("part", pa.int32()), ("v", pa.int64()),
    ("payload", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ROW_ARROW)
    return pa.Table.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, _ROW_ARROW.types, strict=True)],
        schema=_ROW_ARROW)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts (id, trains, text) to blocks: their documents (id, is null, trains,
    words), distinct symbols and the places of their symbols in them; ``v`` counts the
    symbols of training texts."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for start, end in row_slices(batch.column(2), BLOCK_BYTES):
            part = batch.slice(start, end - start)
            ids, trains = part.column(0), part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            words, off = word_hashes(part.column(2))
            counts = np.diff(off)
            distinct, places = np.unique(np.insert(words, off[1:], END), return_inverse=True)
            payload = pack(
                ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64),
                ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64),
                trains.astype(np.uint64), counts.astype(np.uint64), differences(distinct),
                places.astype(np.uint64))
            yield from _rows(
                [(number, _TEXTS, -1, int((counts + 1)[trains].sum()), payload)]).to_batches()
            number += 1


def _pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], zero where ``at`` is -1."""
    return np.append(values, np.zeros(1, values.dtype))[at]


class _Block:
    """The runs of one block. ``keys[L]``: sorted hashes of its distinct runs of L + 1
    symbols, ``at[L]``: for every symbol the place there of the run that it ends, -1 if
    that would go across the start of its text. A text starts with the end before it."""

    def __init__(self, payload: bytes, depth: int):
        ids, nulls, trains, counts, steps, places = unpack(payload)
        self.ids, self.nulls, self.trains = ids.view(np.int64), nulls.astype(bool), trains.astype(bool)
        self.lengths = counts.astype(np.int64) + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.of_train = np.repeat(self.trains, self.lengths)
        self.offset = np.arange(len(places)) - np.repeat(self.starts, self.lengths)
        self.keys, self.at = [np.cumsum(steps, dtype=np.uint64)], [places.astype(np.int64)]
        stream = np.concatenate(([END], self.keys[0][self.at[0]]))
        for level in range(1, depth + 1):
            n = max(len(places) - level + 1, 0)
            h = np.full(n, level, np.uint64)
            for m in range(level + 1):
                h += stream[m : m + n] * _FACTORS[m]
            inside = np.flatnonzero(self.offset >= level - 1)
            found, back = np.unique(mix(h)[inside - (level - 1)], return_inverse=True)
            at = np.full(len(places), -1, np.int64)
            at[inside] = back
            self.keys.append(found)
            self.at.append(at)

    def held(self, level: int) -> np.ndarray:
        """Training counts of the runs in this block."""
        at = self.at[level][self.of_train]
        return np.bincount(at[at >= 0], minlength=len(self.keys[level])).astype(np.uint64)

    def context(self, level: int) -> np.ndarray:
        """For every symbol the place in ``keys[level - 1]`` of the ``level`` symbols before
        it, or -1."""
        first = np.searchsorted(self.keys[0], END) if level == 1 else -1
        before = np.concatenate(([first], self.at[level - 1][:-1])).astype(np.int64)
        return np.where(self.offset >= level - 1, before, -1)


class _Answered(_Block):
    """A block with its answers: ``counts[L]`` of all runs, and of contexts of ``level``
    symbols ``rest``, the mass they leave to their suffix, and ``kept``."""

    def __init__(self, table: pa.Table, depth: int, total: int, kinds: int):
        payload, answers = None, {}
        for row in table.select(["step", "part", "payload"]).to_pylist():
            if row["step"] == _TEXTS:
                payload = row["payload"]
            else:
                answers.setdefault(row["step"], []).append((row["part"], unpack(row["payload"])))
        joined = {
            step: [np.concatenate(x) for x in zip(*(
                a for _, a in sorted(own, key=lambda y: y[0])), strict=True)]
            for step, own in answers.items()}
        super().__init__(payload, depth)
        self.counts: list[np.ndarray] = []
        for level in range(depth + 1):
            counts = np.zeros(len(self.keys[level]), np.int64)
            if _COUNTS + level in joined:
                counts[self.likely(level)] = joined[_COUNTS + level][0].astype(np.int64)
            self.counts.append(counts)
        self.base = (self.counts[0] + 1.0)[self.at[0]] / (total + kinds + 1.0)
        self.rest, self.kept = {}, {}
        for level in range(1, depth + 1):
            many, often = len(self.keys[level - 1]), self.asked(level)
            if level in joined:
                entries, inside, kept = joined[level]
                self.rest[level], self.kept[level] = np.ones(many), np.zeros(many, bool)
                self.rest[level][often] -= (
                    inside - DISCOUNT * entries) / self.counts[level - 1][often]
                self.kept[level][often] = kept > 0
            elif not often.any():
                self.rest[level], self.kept[level] = np.ones(many), np.zeros(many, bool)
            if _MARKS + level in joined:
                self.kept[level][often] |= joined[_MARKS + level][0] > 0

    def likely(self, level: int) -> np.ndarray:
        """Runs of ``level`` + 1 symbols whose first and last ``level`` symbols are in the
        training texts often enough; words all are."""
        if not level:
            return np.ones(len(self.keys[0]), bool)
        often, out = self.counts[level - 1] >= LEAST, np.zeros(len(self.keys[level]), bool)
        run = self.at[level]
        held = (run >= 0) & _pick(often, self.context(level)) & _pick(often, self.at[level - 1])
        out[run[held]] = True
        return out

    def asked(self, level: int) -> np.ndarray:
        """Contexts of ``level`` symbols that are in the training texts often enough."""
        return self.counts[level - 1] >= LEAST

    def share(self, level: int, context: np.ndarray) -> np.ndarray:
        """Every symbol's own part in its probability after ``level`` symbols."""
        c = _pick(self.counts[level], self.at[level])
        n = np.maximum(_pick(self.counts[level - 1], context), 1)
        return np.where(c >= LEAST, (c - DISCOUNT) / n, 0.0)

    def probability(self, levels: int, all_contexts: bool) -> np.ndarray:
        """Of every symbol after contexts of up to ``levels``, those kept or all."""
        p = self.base
        for level in range(1, levels + 1):
            context = self.context(level)
            inside = context >= 0
            if not all_contexts:
                inside &= _pick(self.kept[level], context)
            own = self.share(level, context) + _pick(self.rest[level], context) * p
            p = np.where(inside, own, p)
        return p


def _deal(
    block: int, step: int, bits: int, keys: np.ndarray, *values: np.ndarray, some: tuple = ()
) -> pa.Table:
    """Rows of (differences of keys, values) for each hash range; with ``some``, a mask and
    further values, also the mask and those values where it is true."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(of)], strict=False):
        own = [differences(keys[a:b]), *[v[a:b] for v in values]]
        if some:
            mask = some[0][a:b]
            own += [mask.astype(np.uint64), *[v[a:b][mask] for v in some[1:]]]
        rows.append((block, step, int(of[a]), 0, pack(*own)))
    return _rows(rows)


def _ask_counts(level: int, bits: int):
    """Group of one block: its likely runs of ``level`` + 1 symbols and their training
    counts, by hash range."""

    def run(table: pa.Table) -> pa.Table:
        b = _Answered(table, level, 1, 1)
        likely = b.likely(level)
        number = table.column("block")[0].as_py()
        return _deal(number, _COUNTS + level, bits, b.keys[level][likely], b.held(level)[likely])

    return run


def _asked(table: pa.Table) -> tuple[list, list]:
    """(block, part) and arrays of the rows of one hash range, in the order of blocks."""
    rows = sorted(table.select(["block", "part", "payload"]).to_pylist(), key=lambda r: r["block"])
    return [(r["block"], r["part"]) for r in rows], [unpack(r["payload"]) for r in rows]


def _back(names: list, step: int, sizes: list, answers: list[np.ndarray]) -> list[tuple]:
    """Rows of each block's own stretch of the answers."""
    ends = np.cumsum(sizes).tolist()
    return [
        (block, step, part, 0, pack(*[a[e - n : e] for a in answers]))
        for (block, part), n, e in zip(names, sizes, ends, strict=True)]


def _sum_counts(level: int):
    """Group of one hash range: for each block the corpus counts of its runs, and in a
    row without block the number of runs seen in training."""

    def run(table: pa.Table) -> pa.Table:
        names, asked = _asked(table)
        keys = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, back, np.concatenate([a[1] for a in asked]))
        rows = _back(names, _COUNTS + level, [len(k) for k in keys], [total[back]])
        return _rows([*rows, (None, _COUNTS + level, names[0][1], int((total > 0).sum()), b"")])

    return run


def _ask_contexts(level: int, bits: int, depth: int, total: int, kinds: int):
    """Group of one block: for each of its contexts of ``level`` symbols, its count and
    this block's part of the sums over its entries, if it has any: of the places, of 1, of
    the probability in the suffix and of the log-likelihood gained. An entry with a count of
    c adds 1 / c in each place of a training text, so the blocks' parts add up."""

    def run(table: pa.Table) -> pa.Table:
        b = _Answered(table, depth, total, kinds)
        context, often = b.context(level), b.asked(level)
        run, many = b.at[level], len(b.keys[level - 1])
        use = np.flatnonzero(b.of_train & (_pick(b.counts[level], run) >= LEAST))
        own, c = context[use], b.counts[level][run[use]].astype(float)
        lower = b.probability(level - 1, True)[use]
        n = b.counts[level - 1]
        sums = [1 / c, lower / c, np.log(c / n[own] / lower)]
        sums = [np.bincount(own, x, many).astype(float)[often].view(np.uint64) for x in sums]
        places = np.bincount(own, minlength=many).astype(np.uint64)[often]
        number = table.column("block")[0].as_py()
        return _deal(
            number, level, bits, b.keys[level - 1][often], n[often].astype(np.uint64), some=(places > 0, places, *sums))

    return run


def _sum_contexts(level: int):
    """Group of one hash range: for each block its contexts' number of entries, the sum
    of their counts and whether the context stays by itself."""

    def run(table: pa.Table) -> pa.Table:
        names, asked = _asked(table)
        keys = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(distinct), np.int64)
        n[back] = np.concatenate([a[1] for a in asked]).astype(np.int64)
        some = back[np.concatenate([a[2] for a in asked]) > 0]
        inside = np.bincount(some, np.concatenate([a[3] for a in asked]).astype(float), len(n))
        entries, lower, gain = (
            np.bincount(some, np.concatenate([a[k].view(float) for a in asked]), len(n)) for k in range(4, 7))
        entries = np.rint(entries)
        other = np.maximum(n - inside, 0)
        rate = np.maximum(other, 1) / np.maximum(n, 1) / np.maximum(1 - lower, 1e-12)
        gain = gain + np.where(other > 0, other * np.log(rate), 0.0)
        kept = (entries > 0) & (gain > 0.5 * entries * np.log(np.maximum(n, 2)))
        return _rows(_back(names, level, [len(k) for k in keys], [
            x.astype(np.uint64)[back] for x in (entries, inside, kept)]))

    return run


def _ask_marks(level: int, bits: int, depth: int, total: int, kinds: int):
    """Group of one block: its contexts of ``level`` symbols, marked if they are the
    suffix of one that stays."""

    def run(table: pa.Table) -> pa.Table:
        b = _Answered(table, depth, total, kinds)
        longer, often = b.context(level + 1), b.asked(level)
        stays = _pick(b.kept[level + 1], longer)
        marks = np.zeros(len(b.keys[level - 1]), np.uint64)
        marks[b.context(level)[stays]] = 1
        number = table.column("block")[0].as_py()
        return _deal(
            number, _MARKS + level, bits, b.keys[level - 1][often], marks[often])

    return run


def _join_marks(level: int):
    """Group of one hash range: for each block whether its contexts are marked in any."""

    def run(table: pa.Table) -> pa.Table:
        names, asked = _asked(table)
        keys = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        marks = np.zeros(len(distinct), np.uint64)
        np.maximum.at(marks, back, np.concatenate([a[1] for a in asked]))
        return _rows(_back(names, _MARKS + level, [len(k) for k in keys], [marks[back]]))

    return run


def _score(depth: int, total: int, kinds: int):
    """Group of one block: a row for each of its texts."""

    def run(table: pa.Table) -> pa.Table:
        b = _Answered(table, depth, total, kinds)
        p, known = b.probability(depth, False), (b.counts[0] > 0)[b.at[0]]
        return pa.table({
            "i": pa.array(b.ids, mask=b.nulls),
            "held_out": ~b.trains,
            "n_tokens": b.lengths,
            "n_known": np.add.reduceat(known.astype(np.int64), b.starts),
            "base_score": np.add.reduceat(np.log10(b.base), b.starts),
            "score": np.add.reduceat(np.log10(p), b.starts),
        })

    return run


def suffix_tree_scores(
    docs: DataFrame,
    trains,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row
    of ``docs``; texts for which the column ``trains`` is true are learnt from, the
    others are held out. Contexts have up to ``depth`` symbols, 31 at most; each level
    costs an exchange of the blocks' distinct runs and two of the blocks.

    Words are runs of non-white-space, A-Z lower-cased, known by a 64-bit hash, as are runs
    of words; every text has one end more. base_score and score are log10 probabilities
    of the text under the smoothed word counts alone and under the tree.

    A null or empty text is its end only. A null id, which ``trains`` may be null for, is
    held out. Repeated rows count, and are returned, each. An empty table gives an
    empty result; with no training text all symbols are unknown. Other columns are
    not read.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(trains, F.lit(False)).alias("trains"),
        F.col(text_col).cast("string").alias("t"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(2, min(16, int(size // (6 * PART_TOKENS)).bit_length()))
    spark = docs.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, int(size // (4 * BLOCK_BYTES)) + 1)
    blocks = rows.mapInArrow(_encode, _ROW).repartition(buckets, "block")
    blocks = materialize_dealt(blocks, "tree-blocks", ["block"], buckets)
    total = blocks.agg(F.sum("v")).first()[0] or 0
    answers: dict[int, DataFrame] = {}

    def asking(ask, steps: list[int], schema: str) -> DataFrame:
        """``ask`` of every block with what was answered to it in the steps."""
        known = spark.createDataFrame([], _ROW)
        for step in steps:
            known = known.unionByName(answers[step])
        both = lambda block, found: ask(pa.concat_tables(
            [x.cast(_ROW_ARROW) for x in (block, found) if x.num_rows]))
        return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(both, schema)

    def exchange(step: int, ask, answer, steps: list[int], name: str) -> DataFrame:
        found = materialize(asking(ask, steps, _ROW).groupBy("part").applyInArrow(answer, _ROW), name)
        answers[step] = found.where("block is not null")
        return found

    counts = [_COUNTS + level for level in range(depth + 1)]
    kinds = 0
    for level in range(depth + 1):
        found = exchange(counts[level], _ask_counts(level, bits), _sum_counts(level), counts[:level], "tree-counts")
        if not level:
            kinds = found.agg(F.sum("v")).first()[0] or 0
    for level in range(1, depth + 1):
        exchange(level, _ask_contexts(level, bits, level, total, kinds), _sum_contexts(level),
                 counts[: level + 1] + list(range(1, level)), "tree-contexts")
    for level in range(depth - 1, 0, -1):
        exchange(_MARKS + level, _ask_marks(level, bits, level + 1, total, kinds), _join_marks(level),
                 counts[: level + 2] + [level + 1, *([_MARKS + level + 1] if level + 1 < depth else [])], "tree-marks")
    scored = asking(
        _score(depth, total, kinds), list(answers),
        "i long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("i").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
