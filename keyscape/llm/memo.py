"""Batch tokenization of distinct pieces of text, remembered by worker process."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from keyscape.llm.words import IDENTITY, LOWER, SPACE, hash_spans, pieces

BATCH_BYTES = 1 << 18
MEMO_PIECES = 3_000_000
#: Bytes of text whose pieces are found at a time; the arrays for them are some fifty times that.
STEP_BYTES = 1 << 17


def by_bytes(sizes: Iterable[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items with about ``limit`` bytes, one item at least."""
    start = total = i = -1
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if i >= start and i >= 0:
        yield start, i + 1


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b".,!?;:*$%#&", np.uint8)] = True


def safe_cut(data: np.ndarray, i: int, j: int) -> np.ndarray:
    """True where white space follows a character that surely isn't white space,
    or a punctuation mark follows an ASCII letter.

    Cutting there keeps every pre-token of a byte-level or word BPE whole: no
    pre-token holds white space after another character, or a letter and such a
    mark. Only ASCII characters and two-byte ones of lead byte C3 to DF count as
    surely not white space.
    """
    a = max(i - 2, 0)
    window = data[a:j]
    two = np.concatenate((np.zeros(2 - (i - a), np.uint8), window))
    here, one, lead = two[2:], two[1:-1], two[:-2]
    sure = (one > 0x20) & (one < 0x7F) | (one >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
    return SPACE[here] & sure | _MARK[here] & _LETTER[one]


def safe_pieces(
    data: np.ndarray, off: np.ndarray, folds: bool = False, added: tuple[bytes, ...] = (b"<|",)
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(base, starts, ends, hash) of the pieces between all safe cuts.

    ``folds`` is for a tokenizer that lower-cases and drops white space: pieces
    then leave out white space in front and are hashed with A-Z lower-cased. Added
    tokens are matched before that, by their case: a piece that holds one of the strings
    ``added``, compared without case, is hashed by its own bytes.
    """
    marked = re.compile(b"|".join(re.escape(x.lower()) for x in added)) if folds and added else None
    for s, e in pieces(data, off, safe_cut, STEP_BYTES):
        cut = safe_cut(data, s, e)
        cut[0] = True
        cut[off[np.searchsorted(off, s) : np.searchsorted(off, e)] - s] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], e - s)
        if folds:
            solid = np.append(np.flatnonzero(~SPACE[data[s:e]]), e - s)
            starts = np.minimum(solid[np.searchsorted(solid, starts)], ends)
        keys = hash_spans(data[s:e], starts, ends, LOWER if folds else IDENTITY)
        if marked:
            at = [m.start() for m in marked.finditer(LOWER[data[s:e]].tobytes())]
            if at:
                own = np.unique(np.searchsorted(starts, at, "right") - 1)
                keys[own] = hash_spans(data[s:e], starts[own], ends[own], IDENTITY)
        yield s, starts, ends, keys


class _Growing:
    """An array that is appended to; ``data`` may be longer than the ``n`` values in it."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            grown = np.zeros(max(need, len(self.data) * 5 // 4), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : need] = values
        self.n = need


class Memo:
    """Token ids of pieces by 64-bit hash, for one tokenizer and worker.

    At most ``limit`` pieces and those of one batch are held; beyond that it
    starts anew. That only costs time. ``ids`` False keeps lengths only. ``added``
    are the tokenizer's added tokens. ``lengths``, ``starts`` and ``flat`` are indexed by
    slots and by starts; keys are sorted, the latest ``FRESH`` of them apart.
    """

    FRESH = 1 << 15

    def __init__(self, encode: Callable[[list[str]], list], ids: bool, limit: int = MEMO_PIECES,
                 added: tuple[bytes, ...] = ()):
        self.encode, self.ids, self.limit, self.added = encode, ids, limit, added
        self._clear()

    def _clear(self) -> None:
        self._sorted = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self._lengths, self._starts = _Growing(np.int32), _Growing(np.int64)
        self._flat = _Growing(np.uint16)

    @property
    def lengths(self) -> np.ndarray:
        return self._lengths.data

    @property
    def starts(self) -> np.ndarray:
        return self._starts.data

    @property
    def flat(self) -> np.ndarray:
        return self._flat.data

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that aren't held."""
        out = np.full(len(keys), -1, np.int32)
        for known, slots in self._sorted:
            at = np.searchsorted(known, keys)
            held = at < len(known)
            held[held] = known[at[held]] == keys[held]
            out[held] = slots[at[held]]
        return out

    def resolve(self, data: np.ndarray, base: np.ndarray, size: np.ndarray, keys: np.ndarray):
        """Slots of the pieces data[base:base+size] whose hashes are ``keys``."""
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        found = self._find(distinct)
        new = np.flatnonzero(found < 0)
        if len(new) and self._lengths.n > self.limit:
            self._clear()
            new = np.arange(len(distinct))
        if len(new):
            order = new[np.argsort(size[first[new]], kind="stable")]
            found[order] = self._add(data, base[first[order]], size[first[order]], distinct[order])
        return found[back]

    def _add(self, data, base, size, keys) -> np.ndarray:
        lengths, flat = [], []
        for i, j in by_bytes(size.tolist()):
            texts = [
                data[b : b + n].tobytes().decode("utf-8", "replace")
                for b, n in zip(base[i:j].tolist(), size[i:j].tolist(), strict=True)
            ]
            for found in self.encode(texts):
                lengths.append(len(found))
                if self.ids:
                    flat.extend(found.ids)
        slots = np.arange(self._lengths.n, self._lengths.n + len(lengths), dtype=np.int32)
        lengths = np.array(lengths, np.int32)
        ends = self._flat.n + np.cumsum(lengths, dtype=np.int64)
        self._starts.extend(ends - lengths)
        self._lengths.extend(lengths)
        if flat:
            joined = np.array(flat, np.uint32)
            if self._flat.data.dtype == np.uint16 and joined.max() > 0xFFFF:
                self._flat.data = self._flat.data.astype(np.uint32)
            self._flat.extend(joined)
        order = np.argsort(keys)
        self._insert(1, keys[order], slots[order])
        if len(self._sorted[1][0]) > self.FRESH:
            self._insert(0, *self._sorted[1])
            self._sorted[1] = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return slots

    def _insert(self, which: int, keys: np.ndarray, slots: np.ndarray) -> None:
        known, own = self._sorted[which]
        at = np.searchsorted(known, keys)
        self._sorted[which] = np.insert(known, at, keys), np.insert(own, at, slots)


_memos: dict = {}


def forget() -> None:
    """Drop the memos of this worker; the next tokenizing task starts anew."""
    _memos.clear()


def tokenizer_memo(path: str, ids: bool) -> Memo:
    """This worker's memo of a tokenizers .json or sentencepiece .model file."""
    if (path, ids) not in _memos:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)

        def encode(texts: list[str]) -> list:
            return tok.encode_batch_fast(texts, add_special_tokens=False)

        added = tuple(t.content.encode() for t in tok.get_added_tokens_decoder().values())
        _memos[path, ids] = Memo(encode, ids, added=added)
    return _memos[path, ids]
