"""DartMinHash signatures of weighted sets, for whole batches of texts at once.

Each element throws darts into unit cells of (weight, time): a cell holds a Poisson(1) number of darts,
fixed by a hash of (element, cell), each with a place in the cell and a coordinate of the signature.
Darts above the element's weight miss. Each coordinate keeps its earliest dart, so two sets agree in a
coordinate with probability their weighted Jaccard similarity. Time is thrown as far as k ln k + 2k darts
for the whole weight need; coordinates still empty go on to later cells.
"""

from __future__ import annotations

from math import exp, factorial, log

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_CDF = np.cumsum([exp(-1) / factorial(n) for n in range(16)])
_SHIFT = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if _POWERS.size < n:
        p = np.full(max(n, 1 << 16), _B, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


_WORDBYTE = np.array([(48 <= b <= 57) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text (A-Z lower-cased)."""
    a = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = np.concatenate(([False], _WORDBYTE[a], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    if not edge.size:
        return np.empty(0, np.uint64)
    start, end = edge[::2], edge[1::2]
    # a word's value is its polynomial in B; Horner over all words at once, letter by letter
    value, length = np.zeros(start.size, dtype=np.uint64), end - start
    longest = int(length.max())
    if longest > 64:
        sums = np.concatenate(([np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(a.size))))
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(a.size, inverse, dtype=np.uint64))))
        value = (sums[end] - sums[start]) * back[start]
    else:
        order = np.argsort(-length, kind="stable")
        s, n = start[order], length[order]
        got = np.zeros(s.size, dtype=np.uint64)
        p = np.uint64(1)
        counts = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")
        with np.errstate(over="ignore"):
            for j in range(longest):
                m = counts[j]
                got[:m] += (a[s[:m] + j].astype(np.uint64) + np.uint64(1)) * p
                p = p * _B
        value[order] = got
    return mix(value ^ (length.astype(np.uint64) << np.uint64(48)))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of n consecutive words; a shorter text, if not wordless, is one shingle."""
    if not words.size:
        return words
    n = min(n, words.size)
    h = np.zeros(words.size - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : words.size - n + 1 + j]
    return mix(h + np.uint64(n))


def elements(text: str, n: int = 5, weighted: bool = True) -> np.ndarray:
    """Sorted hashes of the elements of a text. Weighted: the j-th occurrence of a shingle is an element of its own,
    so that the Jaccard similarity of such sets is the weighted one (least counts over greatest counts)."""
    h = np.sort(shingles(word_hashes(text), n))
    if not weighted or h.size < 2:
        return np.unique(h)
    new = np.concatenate(([True], h[1:] != h[:-1]))
    if new.all():
        return h
    at = np.arange(h.size)
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    again = nth > 0
    with np.errstate(over="ignore"):
        h[again] = mix(h[again] + nth[again].astype(np.uint64) * _B)
    return np.unique(h)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """sets x k array: the earliest dart of each coordinate. Rows of sets without elements stay full."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(sets * k, full, dtype=np.uint64)
    if not elements.size:
        return out.reshape(sets, k)
    mass = np.bincount(owner, weights, sets)
    until = np.ceil((k * log(k) + 2 * k) / np.maximum(mass, 1e-9)).astype(np.int64)
    until = np.maximum(until, 1)
    begin = np.zeros(sets, dtype=np.int64)
    todo = mass > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        high = np.ceil(weights[mine]).astype(np.int64)
        span = (until - begin)[owner[mine]]
        # all (element, weight cell, time cell), in pieces of bounded size
        cells = high * span
        stop = np.concatenate(([0], np.cumsum(cells)))
        at = 0
        while at < mine.size:
            to = max(at + 1, int(np.searchsorted(stop, stop[at] + 400_000, side="right")) - 1)
            _throw(out, k, elements, weights, owner, mine[at:to], cells[at:to], span[at:to], begin)
            at = to
        empty = (out.reshape(sets, k) == full).any(1)
        todo &= empty
        begin = np.where(todo, until, begin)
        until = np.where(todo, until * 2, until)
    return out.reshape(sets, k)


def _throw(out, k, elements, weights, owner, mine, cells, span, begin) -> None:
    e = np.repeat(mine, cells)
    local = np.arange(e.size) - np.repeat(np.cumsum(cells) - cells, cells)
    width = np.repeat(span, cells)
    y, t = local // width, local % width + begin[owner[e]]
    with np.errstate(over="ignore"):
        seed = mix(elements[e] + mix((y.astype(np.uint64) << _SHIFT) + t.astype(np.uint64) + np.uint64(1)))
    n = np.searchsorted(_CDF, (seed >> np.uint64(11)).astype(np.float64) / 2.0**53)
    d = np.repeat(np.arange(e.size), n)
    if not d.size:
        return
    nth = np.arange(d.size) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        h = mix(seed[d] + (nth.astype(np.uint64) + np.uint64(1)) * _B)
        g = mix(h + np.uint64(0x51ED270B9F6A1D))
    e, y, t = e[d], y[d], t[d]
    hit = y + (g >> _SHIFT).astype(np.float64) / 2.0**32 < weights[e]
    coordinate = (h % np.uint64(k)).astype(np.int64)
    # time in the high 44 bits (cell below 2^16 and 28 bits within), identity below
    time = (np.minimum(t, 0xFFFF).astype(np.uint64) << np.uint64(48)) | ((g & np.uint64(0xFFFFFFF)) << np.uint64(20)) | (h >> np.uint64(44))
    np.minimum.at(out, (owner[e] * k + coordinate)[hit], time[hit])


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """sets x bands keys; equal keys: the band's coordinates agree."""
    s = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.zeros(s.shape[:2], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * _B + s[:, :, r])
        key += np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(key).view(np.int64)

