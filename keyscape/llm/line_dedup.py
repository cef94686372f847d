"""Operator 8: removal of passages that stand earlier in the corpus, by hashes of their
lines and of the sentences in these.

A text is cut into pieces after each line feed and after each sentence end (``.``, ``!`` or
``?`` and a space). A unit is as many neighbouring pieces of one line as it takes until one
has ``min_words`` words, so its end depends on its own text only and a passage has the same
units wherever it stands. Units of at least that many words in all are normalised (A-Z
lower-cased, one space for each run of white space) and known by a 128-bit digest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyscape.llm.words import row_slices
from keyscape.session import materialize

MIN_WORDS, MIN_RUN = 5, 30
SLICE_BYTES = 2 << 20
_PIECES = re.compile(rb"(?<=\n)|(?<=[.!?] )")
_REMOVED = "array<struct<unit:int,start:int,end:int,keep_id:bigint,keep_unit:int>>"
_SPANS = pa.list_(pa.struct([
    ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("keep_id", pa.int64()), ("keep_unit", pa.int32()),
]))


def units(text: bytes, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, lower-cased words) of every unit, one after the other, in bytes."""
    start = end = 0
    words: list[bytes] = []
    for piece in _PIECES.split(text):
        own = piece.lower().split()
        words += own
        end += len(piece)
        if len(own) >= min_words or piece.endswith(b"\n"):
            yield start, end, words
            start, words = end, []
    if end > start:
        yield start, end, words


def repeated_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """(i, h, unit, keep_id, keep_unit) of every unit that stands earlier in the corpus; ``i``
    is the id of the document and ``h`` the hash of its text.

    Units of ``min_words`` words or more with one digest are a group over all documents; its
    earliest by (id, unit number) stays. Rows are told apart by id and text: repeated rows
    count as one document. Null and empty texts have no units. A null id ranks after all
    others. Each task reduces a digest to its earliest unit before the shuffle, and Spark
    can split the join that lists the rest.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("i"), F.xxhash64(text).alias("h"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        half = 1 << 63
        for batch in batches:
            for s, e in row_slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(s, e - s)
                at, number, a, b = [], [], [], []
                for k, t in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                    for n, (_, _, words) in enumerate(units(t or b"", min_words)):
                        if len(words) >= min_words:
                            digest = xxh3_128_intdigest(b" ".join(words))
                            at.append(k)
                            number.append(n)
                            a.append((digest >> 64) - half)
                            b.append((digest & 0xFFFFFFFFFFFFFFFF) - half)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(at), part.column(1).take(at), pa.array(number, pa.int32()),
                    pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["i", "h", "unit", "a", "b"])

    found = materialize(
        rows.mapInArrow(run, "i long, h long, unit int, a long, b long"), "line-units")
    rank = F.struct(F.col("i").isNull().alias("none"), "i", "unit", "h")
    firsts = materialize(
        found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(rank).alias("keep"))
        .where("n > 1").select("a", "b", "keep"), "line-firsts")
    return (
        found.join(firsts, ["a", "b"]).where(rank != F.col("keep"))
        .select("i", "h", "unit", F.col("keep.i").alias("keep_id"),
                F.col("keep.unit").alias("keep_unit"))
        .distinct()
    )


def _removed(text: bytes, marks: dict, min_words: int, min_run: int) -> tuple[bytes, int, list]:
    """The text without its runs of repeated units, its number of units, and the spans."""
    kept, spans, run, count, words, chars = [], [], [], 0, 0, 0

    def close() -> None:
        nonlocal run, words
        if words >= min_run:
            spans.extend(run)
        run, words = [], 0

    listed = []
    for n, (s, e, own) in enumerate(units(text, min_words)):
        first, chars = chars, chars + len(text[s:e].decode("utf-8", "replace"))
        listed.append((s, e))
        count += 1
        if n in marks:
            run.append({"start": first, "end": chars, **marks[n]})
            words += len(own)
        elif len(own) >= min_words:
            close()
    close()
    gone = {x["unit"] for x in spans}
    kept = [text[s:e] for n, (s, e) in enumerate(listed) if n not in gone]
    return b"".join(kept), count, spans


def remove_repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_run: int = MIN_RUN,
) -> DataFrame:
    """(id, text, n_units, removed) of every row of ``docs``: the text without the passages
    that stand earlier in the corpus, and the array of the units removed: (unit, start, end,
    keep_id, keep_unit), offsets in code points of the original text.

    A unit that stands earlier (see ``repeated_units``, also for ties, repeated rows and null
    ids) goes if it is in a run of such units of ``min_run`` words or more together. Units
    under ``min_words`` words neither end a run nor go with it. So a sentence that many texts
    share stays in each of them, and a passage goes; 1 removes every repeated unit.
    The rest of the text stays as it is. A null text stays null, with no units; an empty one
    has none either. Other columns are not read.
    """
    gone = materialize(
        repeated_units(docs, id_col, text_col, min_words).groupBy("i", "h").agg(
            F.array_sort(F.collect_list(F.struct("unit", "keep_id", "keep_unit"))).alias("gone")
        ).withColumnsRenamed({"i": "gi", "h": "gh"}), "line-removals")
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("i"), text.alias("t"), F.xxhash64(text).alias("h"))
    both = rows.join(
        gone, F.col("i").eqNullSafe(F.col("gi")) & (F.col("h") == F.col("gh")), "left"
    ).select("i", "t", "gone")
    schema = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField(text_col, T.StringType()),
        T.StructField("n_units", T.IntegerType()),
        T.StructField("removed", T._parse_datatype_string(_REMOVED)),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in row_slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(s, e - s)
                texts, counts, removed = [], [], []
                for t, gone in zip(
                        part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if gone is None:
                        texts.append(t)
                        counts.append(sum(1 for _ in units(t or b"", min_words)))
                        removed.append([])
                        continue
                    rest, count, spans = _removed(t, {g["unit"]: g for g in gone}, min_words, min_run)
                    texts.append(rest)
                    counts.append(count)
                    removed.append(spans)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()),
                    pa.array(removed, _SPANS),
                ], names=[id_col, text_col, "n_units", "removed"])

    return both.mapInArrow(cut, schema)
