"""Operator 12: document fingerprints by consistent weighted sampling.

For each of ``SAMPLES`` samples every word x of a text draws, from hashes of itself and
the sample's number, r and c of Gamma(2, 1) and b of Uniform(0, 1). With the word's count
as its weight S,

    t = floor(ln S / r + b),    ln a = ln c - r (t - b + 1)

and the sample is (x, t) of the word with the smallest a. Two texts draw the same one with
the probability of their generalised Jaccard similarity, sum of min over sum of max of the
counts. As ln a depends on x, t and the sample only, its bits name the pair (x, t).

Most words need no logarithm. With c = -ln q and r = -ln p, a is never under (1 - q) p / S,
and the smallest a of a text is exponential with its number of words as the rate: it is
over ``SURE`` divided by that number once in exp(SURE) samples, so a word whose bound is over
that is left out.

DataFrame functions only, no Python in any task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyscape.functions.columns import let

SAMPLES = 64
SURE = 40.0
#: Samples drawn from one row; more expressions at once are compiled to slower code.
GROUP = 16
#: Hex digits of a sample in a fingerprint: two different ones look alike once in 65,536.
DIGITS = 4
BUCKET_BYTES = 4 << 20
SPLIT = r"[\x20\x09-\x0D]+"


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """``bits`` bits of a hash as a number inside (0, 1)."""
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part + F.lit(0.5)) * F.lit(2.0**-bits)


def log_a(term, count, share, sample: int) -> Column:
    """ln a of a term (a 64-bit hash) for one sample; ``share`` is its count over that of all
    words of the text. Null for a term that can't have the smallest a."""
    term, count, share = (F.col(c) if isinstance(c, str) else c for c in (term, count, share))
    one, two = (F.xxhash64(term, F.lit(2 * sample + k)) for k in range(2))
    q = _uniform(one, 0, 32) * _uniform(one, 32, 32)
    p = _uniform(two, 0, 21) * _uniform(two, 21, 21)
    b, r = _uniform(two, 42, 22), -F.log(p)
    t = F.when(count == 1, F.lit(0.0)).otherwise(F.floor(F.log(count) / r + b))
    return F.when((F.lit(1.0) - q) * p <= share * SURE, F.log(-F.log(q)) - r * (t - b + F.lit(1.0)))


def word_counts(text) -> Column:
    """[(_x, _n, _m)]: the hash of every word of a text, how often it stands there and the
    number of all words; null without words. Equal hashes are neighbours after a sort; each run
    of them is one word."""

    def runs(x: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), first)
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(x, i).alias("_x"), (F.coalesce(F.get(s, k + 1), F.size(x)) - i).alias("_n"),
            F.size(x).alias("_m"))))

    words = F.array_remove(F.split(text, SPLIT, -1), "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    return let(hashes, lambda x: F.when(F.size(x) > 0, runs(x)))


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint) of every row of ``texts``; ``keys`` name a row. ``samples`` is a
    multiple of ``GROUP``.

    Words are counted in their row; then each sample is a minimum over them, in
    aggregations on the keys that move nothing if ``texts`` is already dealt by some of them.
    A fingerprint is ``DIGITS`` hex digits for each sample; that of a text without words is
    empty.
    """
    groups = samples // GROUP
    counted = texts.select(*keys, F.inline_outer(word_counts(text))).select(
        *keys, "_x", F.col("_n").cast("double").alias("_n"), (F.col("_n") / F.col("_m")).alias("_share"))
    many = counted.select("*", F.explode(F.lit(list(range(groups)))).alias("_g")).withColumn(
        "_x", F.when(F.col("_x").isNotNull(), F.xxhash64("_x", "_g")))
    drawn = many.groupBy(*keys, "_g").agg(F.count("_x").alias("_words"), *[
        F.min(log_a("_x", "_n", "_share", j)).alias(f"_a{j}") for j in range(GROUP)])
    digits = F.concat(*[
        F.lpad(F.hex(F.xxhash64(f"_a{j}").bitwiseAND(F.lit(16**DIGITS - 1))), DIGITS, "0")
        for j in range(GROUP)])
    named = drawn.select(*keys, "_g", F.when(F.col("_words") == 0, F.lit("")).otherwise(digits).alias("_d"))
    whole = [F.max(F.when(F.col("_g") == g, F.col("_d"))) for g in range(groups)]
    return named.groupBy(*keys).agg(F.concat(*whole).alias("fingerprint"))


def likeness(one, two, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints; two empty ones are alike, an empty
    one and another are not."""
    one, two = (F.col(c) if isinstance(c, str) else c for c in (one, two))
    place = [1 + DIGITS * j for j in range(samples)]
    same = reduce(lambda x, y: x + y, [
        (F.substring(one, p, DIGITS) == F.substring(two, p, DIGITS)).cast("int") for p in place])
    return F.when((one == "") | (two == ""), (one == two).cast("double")).otherwise(same / samples)


def _cuts(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> list[int]:
    """The smallest id of every bucket, in ascending order: every so manieth id of a range
    sort, so that a bucket has about ``bucket_bytes`` of text. The driver holds a number for
    each bucket."""
    rows, size = docs.where(F.col(id_col).isNotNull()).agg(
        F.count("*"), F.sum(F.octet_length(text_col))).first()
    every = max(1, int(bucket_bytes * rows // max(size or 0, 1)))
    ids = docs.select(F.col(id_col).cast("bigint").alias("i")).where("i is not null")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    found = ids.repartitionByRange("i").sortWithinPartitions("i").select("i", place.alias("p")).where(
        F.col("p") % every == 0)
    return sorted({r.i for r in found.select("i").collect()})


def _bucket(i: Column, cuts: list[int]) -> Column:
    """Place of the last cut that is not above ``i`` (a binary search); nulls are in the last
    bucket."""
    last = max(len(cuts) - 1, 0)
    if not last:
        return F.lit(0)
    all_cuts = F.lit(cuts)
    steps = F.lit([1 << k for k in range(last.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= last) & (F.get(all_cuts, at + s) <= i), at + s).otherwise(at))
    return F.when(i.isNull(), last).otherwise(found)


def with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(bucket, place, copy, i, t, next): every row of ``docs`` with the text of the next one
    in ascending order of the id, after the last that of the first. Null texts are empty;
    ties stand in the order of their texts, null ids after all others.

    Rows are dealt to ranges of ids, once. The first row of a range also goes to the range
    before it, as the next of its last row; such rows are marked ``copy`` and are no rows of
    the result. Dealt by ``bucket``.
    """
    cuts = _cuts(docs, id_col, text_col, bucket_bytes)
    last = max(len(cuts) - 1, 0)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("b", _bucket(F.col("i"), cuts))
    spot = lambda b, copy, wrap: F.struct(
        b.alias("bucket"), F.lit(copy).alias("copy"), F.lit(wrap).alias("wrap"))
    first = F.lit(False) if not cuts else F.col("i") == F.get(F.lit(cuts), F.col("b"))
    spots = F.array_compact(F.array(
        spot(F.col("b"), False, False),
        F.when(first & (F.col("b") > 0), spot(F.col("b") - 1, True, False)),
        F.when(first & (F.col("b") == 0), spot(F.lit(last), True, True))))
    if not cuts:  # no ids: the smallest text is the first of all
        least = docs.agg(F.min(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t"))
        rows = rows.select("*", spot(F.lit(0), False, False).alias("s")).unionByName(
            least.where("t is not null").select(F.lit(None).cast("bigint").alias("i"), "t",
                         F.lit(0).alias("b"), spot(F.lit(0), True, True).alias("s")))
    else:
        rows = rows.select("*", F.explode(spots).alias("s"))
    rows = rows.select("s.*", "i", "t")
    order = Window.partitionBy("bucket").orderBy("wrap", F.asc_nulls_last("i"), "t", "copy")
    return rows.select(
        "bucket", F.row_number().over(order).alias("place"), "copy", "i", "t",
        F.lead("t").over(order).alias("next"))


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    samples: int = SAMPLES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    of every row of ``docs``.

    The edited text has its last half (of ``n_chars`` code points, rounded down) replaced
    by as much of the start of the next text. Words are what stands between white space,
    as they are. ``near_edited`` and ``near_next`` are the shares of equal samples.

    Null and empty texts have no words and an empty fingerprint, like only each other's.
    Ties and null ids: see ``with_next``; null ids are in one range. Repeated rows are rows
    of their own. An empty table gives an empty result. Other columns are not read. Texts are
    shuffled once; words and samples are counted where they are.
    """
    rows = with_next(docs, id_col, text_col, bucket_bytes)
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("t").alias("text")),
        F.when(~F.col("copy"), F.struct(F.lit(1).alias("kind"), edited.alias("text"))))
    texts = rows.select("bucket", "place", F.inline(F.array_compact(kinds)))
    kind = lambda k: F.max(F.when(F.col("kind") == k, F.col("fingerprint")))
    signed = signatures(texts, ["bucket", "place", "kind"], "text", samples).groupBy("bucket", "place").agg(
        kind(0).alias("fingerprint"), kind(1).alias("edited_fingerprint"))
    after = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    near = signed.select(
        "bucket", "place", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
        likeness(F.col("fingerprint"), after, samples).alias("near_next"))
    base = rows.where(~F.col("copy")).select(
        "bucket", "place", F.col("i").alias(id_col), n.cast("bigint").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"))
    return base.join(near, ["bucket", "place"]).drop("bucket", "place")
