"""Operator 13: fill-in-the-middle transformation with an index of the exceptions.

Cuts are found in bytes and reported in code points (or the other way round). Most
characters are one byte, so only the others are recorded: where they start and how many
bytes they have more than one. Between two of them both counts differ by a constant, and
``searchsorted`` finds which constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape.llm.words import SPACE, flat, pieces, row_slices, word_spans

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 4 << 20


class Exceptions:
    """The multibyte characters of a UTF-8 buffer: ``at``, the byte where each starts,
    and ``upto``, the bytes beyond one of all before it (one entry more than ``at``)."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.upto = np.concatenate(([0], np.cumsum(excess)))

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before each byte position, which must be a character's start."""
        return cut - self.upto[np.searchsorted(self.at, cut)]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before each code point position."""
        return cut + self.upto[np.searchsorted(self.at - self.upto[:-1], cut)]


class _Tokens:
    """Units of rows: white space with the word after it, or white space at the end."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        found = [s + word_spans(data, off, s, e)[1] for s, e in pieces(data, off)]
        self.ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.off = off
        self.first = np.searchsorted(self.ends, off[:-1], "right")
        self.words = np.searchsorted(self.ends, off[1:], "right") - self.first
        filled = np.flatnonzero(np.diff(off))
        trailing = np.zeros(len(off) - 1, np.int64)
        trailing[filled] = SPACE[data[off[1:][filled] - 1]]
        self.counts = self.words + trailing

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Byte position after ``k`` units of every row."""
        inside = np.append(self.ends, 0)[np.minimum(self.first + k - 1, len(self.ends))]
        return np.where(k == 0, self.off[:-1], np.where(k <= self.words, inside, self.off[1:]))


class _Chars:
    """Units of rows: code points."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.index = Exceptions(data)
        self.start = self.index.chars(off)
        self.counts = np.diff(self.start)

    def cut(self, k: np.ndarray) -> np.ndarray:
        return self.index.bytes(self.start[:-1] + k)


_UNITS = {"tokens": _Tokens, "chars": _Chars}
_OUT = pa.schema([
    ("i", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
    ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(part: pa.RecordBatch, unit: str, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    data, off = flat(part.column(1))
    h1, h2, h3, h4 = (part.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
    units = _UNITS[unit](data, off)
    n = units.counts
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))
    index = Exceptions(data)
    start, one, two = index.chars(off[:-1]), index.chars(first), index.chars(second)
    raw, marks = data.tobytes(), [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    forms, outputs = [], []
    for k, (x, y, z, e) in enumerate(zip(
            off[:-1].tolist(), first.tolist(), second.tolist(), off[1:].tolist(), strict=True)):
        text = raw[x:e]
        if not text or h3[k] % 100 >= fim_percent or any(mark in text for mark in marks):
            forms.append("plain")
            outputs.append(text)
        elif h4[k] % 100 < spm_percent:
            forms.append("spm")
            outputs.append(b"".join((s, raw[z:e], p, raw[x:y], m, raw[y:z])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, raw[x:y], s, raw[z:e], m, raw[y:z])))
    plain = np.array([f == "plain" for f in forms], bool)
    return pa.RecordBatch.from_arrays([
        part.column(0), pa.array(n.astype(np.int64)), pa.array(forms, pa.string()),
        pa.array(one - start, mask=plain), pa.array(two - one, mask=plain),
        pa.array(outputs, pa.string())], schema=_OUT)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    unit: str = "tokens",
    fim_percent: int = 50,
    spm_percent: int = 80,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    A text of n units (white space with the word after it; white space at the end is one
    more; or code points with ``unit`` "chars") is cut at two places that the SHA-256 of
    ``seed:id`` draws; it also draws the form: ``plain``, the text itself, or prefix,
    suffix and middle behind their marks in the order ``psm`` or ``spm``. The lengths
    are in code points, null for ``plain``.

    A null or empty text is plain, with an empty output, and so is a text that holds a mark
    itself: everything else can be restored from output and form. A null id draws as an
    empty one. Rows are independent: ties, repeated rows and other columns, which are
    not read, change nothing. No shuffle; a task holds one slice of rows or one text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"),
        *[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}")
          for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in row_slices(batch.column(1), SLICE_BYTES):
                yield _transform(batch.slice(start, end - start), unit, fim_percent, spm_percent)

    return rows.mapInArrow(
        run, "i long, n long, form string, prefix_chars long, middle_chars long, output string"
    ).withColumnRenamed("i", id_col)


def restored(output, form) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. No other place of an output
    that isn't plain can hold a mark, so cutting at the marks gives the three parts."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1])))
