"""Operator 10: benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape.llm.joins import without
from keyscape.session import materialize

WINDOW = 10
BLOCK_ANCHORS = 20_000
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pieces(text: Column) -> Column:
    """Words in their own case; an empty string may stand first and last."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), _GAP)


def _fold(word: Column) -> Column:
    """Lower-cased A-Z only. Most words are lower case already, which is cheap
    to see; only the others are translated."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def benchmark_windows(
    benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(item_id, anchor, at, words) of every window of every item: ``window``
    consecutive words, or all words of a shorter item. ``anchor`` is the longest
    word of the window and ``at`` its place in it, from 0. No words: no window."""
    words = F.filter(F.transform(_pieces(F.col(text_col)), _fold), lambda w: w != "")
    items = benchmark.select(F.col(id_col).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return (
        items.select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("words")).distinct()
        .withColumn("best", F.array_max(F.transform("words", lambda w, k: F.struct(
            F.char_length(w).alias("n"), w.alias("w"), (-k).alias("k")))))
        .select("item_id", F.col("best.w").alias("anchor"), (-F.col("best.k")).alias("at"), "words")
    )


def find_hits(docs: DataFrame, windows: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """(keys, item_id, from, length) of every place in ``docs`` where a window
    occurs; ``from`` counts the words of the text from 0.

    Every word of a text is looked up in a set of the anchors' hashes that goes
    to the tasks with the plan; the places found meet the windows of their anchor,
    and all words are then compared. ``windows`` is of the size of the benchmark;
    more than ``BLOCK_ANCHORS`` anchors are taken in blocks, each a pass over
    ``docs``, so the set and the broadcast windows stay bounded.
    """
    anchors = sorted({r.anchor for r in windows.select("anchor").distinct().collect()})
    found = []
    for k in range(0, max(len(anchors), 1), BLOCK_ANCHORS):
        block = anchors[k : k + BLOCK_ANCHORS]
        part = windows
        if len(anchors) > BLOCK_ANCHORS:
            part = windows.where((F.col("anchor") >= block[0]) & (F.col("anchor") <= block[-1]))
        found.append(_hits(docs, part, key_cols, text_col))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _hits(docs: DataFrame, windows: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    hashes = windows.select(F.xxhash64("anchor").alias("a")).distinct().collect()
    known = ", ".join(f"{r.a}L" for r in hashes) or "null"
    pieces = docs.select(*key_cols, _pieces(F.col(text_col)).alias("w"))
    found = F.expr(
        "filter(transform(w, (x, k) -> case when xxhash64(case when lower(x) = x then x else "
        f"translate(x, '{_UPPER}', '{_LOWER}') end) in ({known}) then k end), "
        "k -> k is not null)")
    # outer: else the search would run once more, as a filter before the explode
    places = pieces.select(*key_cols, "w", F.explode_outer(found).alias("pos")).select(
        *key_cols, "w", "pos", _fold(F.get("w", F.col("pos"))).alias("anchor"))
    start = F.col("pos") - F.col("at")
    got = F.when(start >= 0, F.slice("w", start + 1, F.size("words")))
    lead = F.when(F.element_at("w", 1) == "", 1).otherwise(0)
    return (
        places.join(F.broadcast(windows), "anchor")
        .where(F.transform(got, _fold) == F.col("words"))
        .select(*key_cols, "item_id", (start - lead).alias("from"), F.size("words").alias("length"))
    )


def _n_words(text: Column) -> Column:
    w = _pieces(text)
    ends = F.element_at(w, 1) == "", F.element_at(w, -1) == ""
    return (
        F.size(w) - ends[0].cast("int")
        - F.when(F.size(w) > 1, ends[1].cast("int")).otherwise(0)
    ).cast("bigint")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every
    row of ``docs``.

    n_hit counts the words inside any occurrence of a window of ``benchmark``;
    n_items the items with such a window; items_sha256 is over their sorted ids.
    ``spans`` is the sorted array of (first word, one past the last) of the hits.
    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased. Null and empty texts have no words and no hits; so has every text
    if the benchmark is empty. Rows are told apart by id and text, so repeated rows
    get the same result; a null id is a value of its own. Other columns are not read.
    """
    windows = materialize(
        benchmark_windows(benchmark, window, item_col), "benchmark-windows")
    rows = docs.select(
        F.col(id_col).alias("i"), F.xxhash64(F.col(text_col).cast("string")).alias("h"),
        F.col(text_col).cast("string").alias("t"))
    hits = find_hits(rows, windows, ["i", "h"], "t").distinct()
    places = F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["first"], s["last"] - 1)))
    found = materialize(
        hits.groupBy("i", "h").agg(
            F.array_sort(F.collect_set(F.struct(
                F.col("from").alias("first"), (F.col("from") + F.col("length")).alias("last")
            ))).alias("spans"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        ).select(
            "i", "h", "spans", F.size(F.array_distinct(places)).cast("bigint").alias("n_hit"),
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ), "benchmark-hits")
    narrow = rows.select("i", "h", _n_words(F.col("t")).alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    both = narrow.join(
        found.select(F.col("i").alias("fi"), F.col("h").alias("fh"), "spans", "n_hit", "n_items",
                     "items_sha256"),
        F.col("i").eqNullSafe(F.col("fi")) & (F.col("h") == F.col("fh")), "left")
    zero = F.lit(0).cast("bigint")
    return both.select(
        F.col("i").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no window of ``benchmark``.
    Null and empty texts stay."""
    windows = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    rows = docs.select(
        F.col(id_col).alias("i"), F.xxhash64(F.col(text_col).cast("string")).alias("h"),
        F.col(text_col).cast("string").alias("t"))
    found = materialize(
        find_hits(rows, windows, ["i", "h"], "t").select(
            F.col("i").alias("__hit_i"), F.col("h").alias("__hit_h")).distinct(),
        "benchmark-hits")
    same = docs[id_col].eqNullSafe(F.col("__hit_i")) & (
        F.xxhash64(docs[text_col].cast("string")) == F.col("__hit_h"))
    return without(docs, found, same)


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs``, all columns, with the hit words cut out of their texts: the words
    that stay keep their case and are joined by single spaces. Texts without a hit
    are not touched."""
    windows = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    rows = docs.select(
        F.col(id_col).alias("i"), F.xxhash64(F.col(text_col).cast("string")).alias("h"),
        F.col(text_col).cast("string").alias("t"))
    found = materialize(
        find_hits(rows, windows, ["i", "h"], "t").groupBy(
            F.col("i").alias("__hit_i"), F.col("h").alias("__hit_h")
        ).agg(F.collect_set(F.struct("from", "length")).alias("__hit_spans")), "benchmark-hits")
    same = docs[id_col].eqNullSafe(F.col("__hit_i")) & (
        F.xxhash64(docs[text_col].cast("string")) == F.col("__hit_h"))
    words = F.filter(_pieces(docs[text_col]), lambda w: w != "")
    hit = F.array_distinct(F.flatten(F.transform("__hit_spans", lambda s: F.sequence(
        s["from"], s["from"] + s["length"] - 1))))
    marked = F.transform(words, lambda w, k: F.when(~F.array_contains(F.col("__hit_places"), k), w))
    cut = F.when(F.col("__hit_places").isNull(), docs[text_col]).otherwise(
        F.concat_ws(" ", marked))
    joined = docs.join(found.withColumn("__hit_places", hit), same, "left")
    return joined.select(*[
        cut.alias(c) if c == text_col else docs[c] for c in docs.columns])
