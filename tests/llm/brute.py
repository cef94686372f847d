"""Plain Python versions of what the operators compute."""

import re
from collections import defaultdict


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_groups(rows, threshold=80):
    """{doc_id: (n_shingles, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    ids, groups = list(sets), Sets(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def contamination(rows, items, window=10):
    """{doc_id: (n_words, hit places, items)}"""
    windows = defaultdict(set)
    for item, text in items:
        w = benchmark_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(item)
    out = {}
    for i, text in rows:
        w, hit, found = benchmark_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        out[i] = (len(w), hit, found)
    return out


def passages(text, least=5):
    """[(start, end, words)] of the units of a text."""
    out, first, at, total = [], 0, 0, []
    for piece in re.findall(r"[^\n]*?[.!?] |[^\n]*?\n|[^\n]+", text or ""):
        own, at = words(piece), at + len(piece)
        total += own
        if len(own) >= least or piece.endswith("\n"):
            out.append((first, at, total))
            first, total = at, []
    return out + [(first, at, total)] * (at > first)


def repeated_passages(rows, least=5, run=30):
    """{doc_id: (number of units, [(unit, start, end, keep_id, keep_unit)])}"""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        units, runs = passages(text, least), [[]]
        for k, (s, e, own) in enumerate(units):
            if len(own) >= least:
                keep = first.setdefault(tuple(own), (i, k))
                if keep == (i, k):
                    runs.append([])
                else:
                    runs[-1].append((k, s, e, *keep))
        sizes = lambda r: sum(len(units[x[0]][2]) for x in r)
        out[i] = (len(units), [x for r in runs if sizes(r) >= run for x in r])
    return out
