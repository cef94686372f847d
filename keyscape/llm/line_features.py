"""Features of lines, vectorised over the bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from keyscape.llm.words import LOWER, SPACE, flat, hash_spans, pieces, word_spans

NAMES = (
    "log_bytes", "upper", "digits", "marks", "odd", "space", "non_ascii", "word_bytes",
    "repeats", "same_as_before", "ends_sentence", "short",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_UPPER = _class(bytes(range(0x41, 0x5B)))
_DIGIT = _class(b"0123456789")
_MARK = _class(b".,;:!?'\"()-")
_ODD = _class(bytes(
    b for b in range(0x21, 0x7F)
    if not chr(b).isalnum() and b not in b".,;:?'\"()-"))
_HIGH = _class(bytes(range(0x80, 0x100)))
_STOP = _class(b".!?")


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes of each line, row offsets into the lines).

    Lines are split at line feeds; an empty or null text is one empty line. Everything
    is a sum over bytes or words of the line, so texts of any length take little
    memory: a few arrays over a piece of a few MB at a time.
    """
    data, off = flat(column)
    feeds = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate((off[:-1], feeds + 1, [len(data)])))[:-1]
    starts = starts[starts < len(data)]
    # a feed that ends a text starts no line of the next one; empty texts have one line
    empty = np.flatnonzero(np.diff(off) == 0)
    count = len(starts)
    edges = np.append(starts, len(data))
    sums = np.zeros((count, 9))
    for s, e in pieces(data, off):
        first = int(np.searchsorted(edges, s, "right")) - 1
        last = int(np.searchsorted(edges, e, "left"))
        cuts = np.clip(edges[first : last + 1] - s, 0, e - s)
        b = data[s:e]
        kinds = (_UPPER, _DIGIT, _MARK, _ODD, SPACE, _HIGH)
        for k, kind in enumerate(kinds):
            run = np.concatenate(([0], np.cumsum(kind[b])))
            sums[first:last, k] += np.diff(run[cuts])
        st, en = word_spans(data, off, s, e)
        words = hash_spans(b, st, en, LOWER)
        at = np.searchsorted(st, cuts)
        sums[first:last, 6] += np.diff(at)
        line = np.searchsorted(edges, st + s, "right") - 1
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
        run = np.concatenate(([0], np.cumsum(again)))
        sums[first:last, 7] += np.diff(run[at])
        # words of the line that were in it before, in this piece
        order = np.lexsort((words, line))
        old = np.zeros(len(words), bool)
        old[1:] = (words[order][1:] == words[order][:-1]) & (line[order][1:] == line[order][:-1])
        sums[first:last, 8] += np.bincount(line[order][old] - first, minlength=last - first)
    size = np.diff(edges)
    size = size - (data[np.maximum(edges[1:] - 1, 0)] == 0x0A) if count else size
    closing = np.maximum(edges[:-1] + size - 1, 0) if count else np.zeros(0, np.int64)
    n, w = np.maximum(size, 1)[:, None], np.maximum(sums[:, 6], 1)
    features = np.column_stack((
        np.log1p(size), sums[:, :6] / n, np.minimum((size - sums[:, 4]) / w, 40) / 10,
        sums[:, 7] / w, sums[:, 8] / w,
        _STOP[data[closing]] if count else np.zeros(0), size < 40,
    )).astype(float)
    rows = np.searchsorted(off, starts, "right") - 1
    if len(empty):
        features = np.concatenate((features, np.zeros((len(empty), len(NAMES)))))
        size = np.concatenate((size, np.zeros(len(empty), size.dtype)))
        rows = np.concatenate((rows, empty))
        order = np.argsort(rows, kind="stable")
        features, size, rows = features[order], size[order], rows[order]
    return features, size, np.searchsorted(rows, np.arange(len(off)))


def with_neighbours(features: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A constant, the line's features, and those of the lines before and after it in
    the same text (zeros at its ends)."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[off[:-1]] = 0
    after[off[1:] - 1] = 0
    return np.column_stack((np.ones(len(features)), features, before, after))
