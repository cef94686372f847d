"""Operator 4: Jaccard self-join on word shingles with token-combination prefixes.

Tokens are the shingles of a text. With sizes n, a partner at similarity t shares at
least ceil(t n) of them, so a text may miss tau = n - ceil(t n) of its own. All texts
sort their tokens alike, by how many texts have them; tokens that only one text has
come first and need no index.

A prefix is extended until its weight is tau + 1, where a rare token weighs 1 and
frequent tokens, dealt by hash to ``GROUPS`` groups, weigh their number less one in
each group. Losing tau tokens leaves a weight of one or more: a rare token, or two
frequent ones of a group. So two texts that link share, in the shorter prefix, a rare
token or a pair of frequent tokens of one group, and these are what is indexed. Texts
too short to reach that weight, and all their possible partners, index the single
tokens of a plain prefix.

Counting works on blocks of texts. A block sends each of its distinct tokens once,
in packed arrays dealt by hash range, and gets back those that other texts have too.
Its texts are hashed ``HASH_BYTES`` at a time, which bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.llm import lean
from keyscape.llm.components import components
from keyscape.llm.joins import BROADCAST_KEYS, compact, join_large, without
from keyscape.llm.packing import differences, pack, unpack
from keyscape.llm.words import mix, row_slices, shingle_sets
from keyscape.session import materialize

SHINGLE = 5
THRESHOLD = 80
GROUPS = 32
RARE = 32
BLOCK_BYTES = 12 << 20
HASH_BYTES = 2 << 20
PART_TOKENS = 1 << 20
SALT_PAIRS = 256
PARITIES = 32


_PACKED = "part int, block long, first long, payload binary"
_PACKED_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("payload", pa.binary())])


def _blocks(bits: int, part_bits: int, size: int):
    """Task: texts to packed blocks. A row with first = -1 holds the texts of a block
    (hash, number of tokens, places of their tokens in the block's sorted distinct
    tokens); the others hold the tokens of one range, from place ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for start, end in row_slices(batch.column(1), BLOCK_BYTES):
                yield from _block(batch.slice(start, end - start), number, bits, part_bits, size)
                number += 1

    return run


def _block(batch, number: int, bits: int, part_bits: int, size: int):
    uids, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
    texts = batch.column(1).take(pa.array(first))
    keys, counts = [], []
    for a, b in row_slices(texts, HASH_BYTES):
        tokens, off = shingle_sets(texts.slice(a, b - a), size)
        tokens >>= np.uint64(64 - bits)
        keys.append(tokens)
        counts.append(np.diff(off))
    del texts, tokens
    counts = np.concatenate(counts)
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.diff(keys, prepend=~keys[:1]) != 0
    places = np.empty(len(keys), np.int32)
    places[order] = np.cumsum(fresh, dtype=np.int32) - 1
    distinct = keys[fresh]
    del order, keys, fresh
    starts = (np.cumsum(counts) - counts)[counts > 0]
    steps = np.diff(places, prepend=np.int32(0))
    steps[starts] = places[starts]
    parts = 1 << part_bits
    held = np.bincount(places, minlength=len(distinct)).astype(np.uint64)
    payload = pack(
        uids.astype(np.int64).view(np.uint64), counts.astype(np.uint64), steps.astype(np.uint64))
    del places, steps
    out = [(number % parts, number, -1, payload)]
    of = (distinct >> np.uint64(bits - part_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts.tolist(), len(of)][1:], strict=True):
        out.append((int(of[a]), number, a, pack(differences(distinct[a:b]), held[a:b])))
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PACKED_ARROW.types, strict=True)],
        schema=_PACKED_ARROW)


def _shared(table: pa.Table) -> pa.Table:
    """Group of one range: for each block its tokens that more than one text has, with
    their places and how many have them, as 4 times the binary logarithm."""
    out, keys, held, lengths, names = [], [], [], [], []
    for row in table.to_pylist():
        if row["first"] < 0:
            out.append((row["part"], row["block"], -1, row["payload"]))
            continue
        steps, counts = unpack(row["payload"])
        keys.append(np.cumsum(steps, dtype=np.uint64))
        held.append(counts)
        lengths.append(len(steps))
        names.append((row["part"], row["block"], row["first"]))
    if keys:
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, back, np.concatenate(held))
        level = np.ceil(4 * np.log2(np.maximum(total, 1))).astype(np.uint64)[back]
        at = 0
        for (part, block, first), own, n in zip(names, keys, lengths, strict=True):
            mine = level[at : at + n]
            kept = np.flatnonzero(mine)
            at += n
            if len(kept):
                out.append((part, block, first, pack(
                    differences(kept.astype(np.uint64)), differences(own[kept]), mine[kept])))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.Table.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, _PACKED_ARROW.types, strict=True)],
        schema=_PACKED_ARROW)


def _miss(n: int, threshold: int) -> int:
    """Tokens that a text may lack in any partner."""
    return n - -(-threshold * n // 100)


def _miss_as_shorter(n: int, threshold: int) -> int:
    """Tokens that it may lack in a partner of its size or more."""
    return n - -(-2 * threshold * n // (100 + threshold))


def short_sizes(threshold: int, groups: int) -> tuple[int, int]:
    """(largest size whose combinations may not reach the weight, largest size of
    its partners)."""
    n = 1
    while n - groups < _miss(n, threshold) + 1 or n <= groups:
        n += 1
    short = n - 1
    return short, short * 100 // threshold


def signatures(
    keys: np.ndarray, level: np.ndarray, n: int, threshold: int
) -> tuple[np.ndarray, np.ndarray]:
    """What to index of a text of ``n`` tokens, of which ``keys`` are not its own alone,
    and which of it is for the text as the shorter of a pair, too."""
    alone = n - len(keys)
    need = _miss(n, threshold) + 1 - alone
    if need <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    few = max(0, _miss_as_shorter(n, threshold) + 1 - alone)
    order = np.lexsort((keys, level))
    keys, level = keys[order], level[order]
    short, partner = short_sizes(threshold, GROUPS)
    out, brief = [], []
    if n <= partner:
        out.append(mix(keys[:need]))
        brief.append(np.arange(len(out[0])) < few)
    if n > short:
        frequent = level > 4 * np.log2(max(RARE, 1))
        group = (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(GROUPS)).astype(np.int64)
        group[~frequent] = -1
        seen = np.zeros(len(keys), bool)
        _, firsts = np.unique(group, return_index=True)
        seen[firsts] = True
        weight = np.cumsum(~(seen & frequent))
        end = int(np.searchsorted(weight, need)) + 1
        early = np.arange(len(keys)) < (int(np.searchsorted(weight, few)) + 1 if few else 0)
        keys, group, frequent, early = keys[:end], group[:end], frequent[:end], early[:end]
        out.append(mix(keys[~frequent]))
        brief.append(early[~frequent])
        by = np.lexsort((keys[frequent], group[frequent]))
        k, g, e = keys[frequent][by], group[frequent][by], early[frequent][by]
        for lag in range(1, len(k)):
            same = g[lag:] == g[:-lag]
            if not same.any():
                break
            a, b = k[:-lag][same], k[lag:][same]
            out.append(mix(mix(a) * np.uint64(0x9E3779B97F4A7C15) + b))
            brief.append((e[:-lag] & e[lag:])[same])
    found, where = np.unique(np.concatenate(out), return_inverse=True)
    as_short = np.zeros(len(found), bool)
    as_short[where[np.concatenate(brief)]] = True
    return found, as_short


def _index(threshold: int):
    """Group of one block: (sig, brief, uid, n, own): ``own`` tokens are in no other text,
    ``brief`` says that the signature is for the text as the shorter one too. A row
    without sig for every text."""

    def run(table: pa.Table) -> pa.Table:
        texts, marks = None, []
        for row in table.to_pylist():
            if row["first"] < 0:
                texts = unpack(row["payload"])
            else:
                marks.append((row["first"], unpack(row["payload"])))
        uids, counts, steps = texts
        counts = counts.astype(np.int64)
        off = np.concatenate(([0], np.cumsum(counts)))
        places = [
            np.cumsum(steps[a:b]).astype(np.int64)
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        width = max((int(p[-1]) + 1 for p in places if len(p)), default=0)
        level, keys = np.zeros(width, np.uint8), np.zeros(width, np.uint64)
        for first, (at, own, mine) in marks:
            at = np.cumsum(at).astype(np.int64) + first
            level[at], keys[at] = mine, np.cumsum(own, dtype=np.uint64)
        sigs, brief, whose, own = [], [], [], counts.copy()
        for k, p in enumerate(places):
            p = p[level[p] > 0]
            own[k] -= len(p)
            found, as_short = signatures(keys[p], level[p], int(counts[k]), threshold)
            sigs.append(found)
            brief.append(as_short)
            whose.append(np.full(len(found), k))
        sigs = np.concatenate([*sigs, np.zeros(0, np.uint64)]).view(np.int64)
        whose = np.concatenate([*whose, np.zeros(0, np.int64)]).astype(np.int64)
        uids = uids.view(np.int64)
        return pa.table({
            "sig": pa.concat_arrays([pa.array(sigs), pa.nulls(len(uids), pa.int64())]),
            "brief": np.concatenate([*brief, np.zeros(len(uids), bool)]),
            "uid": np.concatenate((uids[whose], uids)),
            "n": np.concatenate((counts[whose], counts)),
            "own": np.concatenate((own[whose], own)),
        })

    return run


def postings(texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """(sig, brief, uid, n, own) of the index, stored; sig is null in one row of each text."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    tokens = max(1, total // 4)
    bits = min(62, max(24, tokens.bit_length() + 10))
    part_bits = min(16, max(3, (tokens // PART_TOKENS).bit_length()))
    packed = texts.select("uid", "text").mapInArrow(lean.batches(_blocks(bits, part_bits, size)), _PACKED)
    shared = packed.groupBy("part").applyInArrow(lean.table(_shared), _PACKED)
    return materialize(
        shared.groupBy("block").applyInArrow(
            lean.table(_index(threshold)), "sig long, brief boolean, uid long, n long, own long"),
        "jaccard-index")


def verify(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Of stored pairs (a, b) those that link, stored. The texts of ``b`` are compared in turn with
    that of ``a``, which is sent once for each ``SALT_PAIRS`` of its pairs."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"),
        F.lit(1).alias("role"), F.col("b").alias("uid"))
    heads = salts.select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("role"), F.col("a").alias("uid"))
    rows = members.unionByName(heads).join(texts, "uid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            a, role, uid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            links = []
            for start, end in row_slices(batch.column(3), HASH_BYTES):
                tokens, off = shingle_sets(batch.column(3).slice(start, end - start), size)
                for k in range(start, end):
                    own = tokens[off[k - start] : off[k - start + 1]]
                    if role[k] == 0:
                        head = own
                        continue
                    n = len(head) + len(own)
                    both = n - len(np.unique(np.concatenate((head, own))))
                    if both and 100 * both >= threshold * (n - both):
                        links.append((a[k], uid[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], names=["a", "b"])

    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return materialize(
        ordered.select("a", "role", "uid", "text").mapInArrow(lean.batches(compare), "a long, b long"),
        "jaccard-links")


def _merge(state: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """(uid, root, size) of ``rows`` texts after ``links`` between texts. Components become nodes first."""
    left = state.select(F.col("uid").alias("a"), F.col("root").alias("ra"))
    right = state.select(F.col("uid").alias("b"), F.col("root").alias("rb"))
    roots = components(links.join(left, "a").join(right, "b").select(
        F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = state.drop("size").join(roots.select(
        F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "uid", F.coalesce("top", "root").alias("root"))
    sizes = moved.groupBy("root").agg(F.count("*").alias("size"))
    return materialize(
        compact(moved.join(sizes, "root").select("uid", "root", "size"), rows), "jaccard-state")


def _parities(texts: DataFrame, size: int) -> DataFrame:
    """(uid, p0, p1, ...): for each of 64 ``PARITIES`` slots whether an odd number of the
    text's tokens is dealt to it. Slots that differ between two texts are no more than the
    tokens that only one of them has."""
    names = [f"p{k}" for k in range(PARITIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in row_slices(batch.column(1), HASH_BYTES):
                part = batch.slice(start, end - start)
                tokens, off = shingle_sets(part.column(1), size)
                slot = (mix(tokens) >> np.uint64(20)).astype(np.int64) % (64 * PARITIES)
                odd = np.zeros((len(part), 64 * PARITIES), np.uint8)
                row = np.repeat(np.arange(len(part)), np.diff(off))
                np.bitwise_xor.at(odd, (row, slot), 1)
                words = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(words[:, k].copy()) for k in range(PARITIES)]],
                    names=["uid", *names])

    return texts.select("uid", "text").mapInArrow(
        lean.batches(run), "uid long, " + ", ".join(f"{c} long" for c in names))


def _may_link(threshold: int):
    """Whether a row of the live index and a chosen one (a, na, own_a, brief_a) of its group
    can be a pair by this signature: the shorter has it as the shorter, the sizes are near
    enough, and enough tokens are in other texts."""
    need = (F.col("n") + F.col("na")) * threshold
    return (
        ((F.col("brief") & (F.col("n") <= F.col("na")))
         | (F.col("brief_a") & (F.col("na") <= F.col("n"))))
        & (F.least("n", "na") * 100 >= F.greatest("n", "na") * threshold)
        & (F.least(F.col("n") - F.col("own"), F.col("na") - F.col("own_a"))
           * (100 + threshold) >= need)
    )


def _near_parities(threshold: int):
    """Whether slots differ in no more places than tokens may between texts that link."""
    apart = sum(
        (F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(PARITIES)), F.lit(0))
    return apart * (100 + threshold) <= (F.col("n") + F.col("na")) * (100 - threshold)


def _linked(index: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """(uid, root) of all texts that share something in the index.

    First every text is compared with the head of the signature groups that it shares most
    with: the text with the fewest tokens of its own, which a group of copies comes from.
    Then, while a group holds texts of several components, some of its texts are
    compared with all others of the group that are in other components, and leave
    the group: first more heads, then texts of small components. Texts in one component
    are never compared again, so copies cost one comparison each; all others of a
    group that may link, by their sizes, tokens of their own and parities, are, whatever
    its size.
    """
    names = "sig brief uid n own".split()
    head = F.struct("own", "uid", "n", "brief")
    groups = index.where("sig is not null").groupBy("sig").agg(
        F.min(head).alias("head"), F.min("uid").alias("low"), F.max("uid").alias("high"),
        F.max("brief").alias("any")).where("low <> high and any")
    live = materialize(
        index.join(groups.select("sig", F.col("head.uid").alias("a"), F.col("head.n").alias("na"),
                                 F.col("head.own").alias("own_a"),
                                 F.col("head.brief").alias("brief_a")), "sig")
        .groupBy("sig", "uid").agg(*[
            F.max(c).alias(c) for c in ("brief", "n", "own", "a", "na", "own_a", "brief_a")]),
        "jaccard-live")
    wanted = materialize(live.select("uid").distinct(), "jaccard-wanted")
    n_texts, n_live = wanted.count(), live.count()
    few = F.broadcast(wanted) if n_texts <= BROADCAST_KEYS else wanted
    texts = materialize(
        docs.join(few, "uid", "left_semi").groupBy("uid").agg(F.first("text").alias("text")),
        "jaccard-texts")
    state = materialize(wanted.select(
        "uid", F.col("uid").alias("root"), F.lit(1).cast("long").alias("size")), "jaccard-state")
    best = live.where((F.col("uid") != F.col("a")) & _may_link(threshold)).groupBy(
        "uid", "a").agg(F.count("*").alias("k")).groupBy(
        "uid").agg(F.max(F.struct("k", "a")).alias("best"))
    pairs = materialize(
        best.select(F.col("best.a").alias("a"), F.col("uid").alias("b")), "jaccard-candidates")
    done = parities = None
    live = live.select(*names)
    for picks, by in _turns():
        if not pairs.isEmpty():
            links = verify(pairs, texts, size, threshold)
            state = _merge(state, links, n_texts)
        known = live.join(state, "uid")
        open_groups = known.groupBy("sig").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.max("brief").alias("any")
        ).where("low <> high and any")
        live = materialize(
            compact(known.join(open_groups.select("sig"), "sig"), n_live), "jaccard-live")
        n_live = live.count()
        if not n_live:
            break
        if parities is None:
            open_texts = materialize(live.select("uid").distinct(), "jaccard-open")
            parities = materialize(
                _parities(texts.join(open_texts, "uid", "left_semi"), size), "jaccard-parities")
        chosen = materialize(
            compact(live.groupBy("sig", F.pmod(F.xxhash64("uid"), F.lit(picks)).alias("k"))
            .agg(F.min(F.struct(F.col(by).alias("by"), "uid", "root", "n", "own", "brief")).alias("p"))
            .select("sig", F.col("p.uid").alias("a"), F.col("p.root").alias("ra"),
                    F.col("p.n").alias("na"), F.col("p.own").alias("own_a"),
                    F.col("p.brief").alias("brief_a")), n_live),
            "jaccard-chosen")
        other = parities.select(
            F.col("uid").alias("a"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(PARITIES)])
        pairs = live.join(parities, "uid").join(chosen.join(other, "a"), "sig").where(
            (F.col("root") != F.col("ra")) & _may_link(threshold) & _near_parities(threshold)
        ).select("a", F.col("uid").alias("b"))
        pairs = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
            F.first("a").alias("a"), F.first("b").alias("b"))
        if done is not None:
            pairs = pairs.join(done, ["x", "y"], "left_anti")
        pairs = materialize(pairs, "jaccard-candidates")
        new = pairs.select("x", "y")
        done = new if done is None else done.unionByName(new)
        pairs = pairs.select("a", "b")
        live = live.join(
            chosen.select("sig", F.col("a").alias("uid")), ["sig", "uid"], "left_anti"
        ).select(*names)
    return state.select("uid", "root")


def _turns() -> Iterator[tuple[int, str]]:
    """How many texts of a group to compare in each turn, and which first."""
    yield 1, "own"
    picks = 16
    while True:
        yield picks, "size"
        picks *= 32


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    A text's set is its distinct shingles of ``size`` words (runs of non-white-space,
    A-Z lower-cased); with fewer words its whole sequence is the only one. Texts link
    when 100 * intersection >= threshold * union; component_id is the smallest id that
    links reach. No link is lost: candidates are complete (see the head of this
    module) and are compared by their whole sets, shingles by 64-bit hashes.

    Equal texts are one node; repeated rows share all results. Null, empty and
    blank texts have no shingles and link with nothing: each row's component is its own
    id. A null id takes part, but is never the smallest unless all are null. An
    empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("uid"), text.alias("text"))
    index = postings(rows, size, threshold)
    state = _linked(index, rows.select("uid", "text"), size, threshold)
    ids = materialize(rows.select("i", "uid"), "jaccard-ids")
    sizes = index.where("sig is null").select("uid", "n").distinct()
    nodes = (
        ids.groupBy("uid").agg(F.min("i").alias("low"), F.count("*").alias("rows"))
        .join(sizes, "uid").join(state, "uid", "left")
        .withColumn("root", F.coalesce("root", "uid"))
    )
    nodes = materialize(nodes, "jaccard-nodes")
    lows = nodes.groupBy("root").agg(
        F.min("low").alias("component"), F.count("*").alias("k"))
    labels = materialize(
        join_large(nodes.drop("low"), lows, "root", "k", nodes.count()).select(
            "uid", "n", "rows", "component"), "jaccard-labels")
    out = join_large(ids, labels, "uid", "rows", ids.count())
    return out.select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("i")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """Rows of ``docs``, all columns, of the smallest id of each group of ``near_groups``.
    Texts without words are groups of their own. Rows that repeat the id and the text
    of a row that stays are the same document, and stay."""
    groups = near_groups(docs, id_col, text_col, size, threshold)
    gone = materialize(
        groups.where(~F.col(id_col).eqNullSafe(F.col("component_id")))
        .select(F.col(id_col).alias("__near_gone")).distinct(), "jaccard-gone")
    return without(docs, gone, docs[id_col].eqNullSafe(F.col("__near_gone")))
