"""Hashes of byte strings in numpy, over whole Arrow buffers at once.

``Poly`` is a polynomial hash modulo 2**64 whose prefix sums give the hash of
any stretch of a buffer.  ``word_hashes`` gives the hash of every word of a
batch of texts.  Buffers are taken in pieces of about ``PIECE`` bytes, cut
where no word (or window) is cut, so memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class Poly:
    """Hash of ``b[i:j]``: the sum of ``value[b[k]] * base**(k - i)`` modulo 2**64."""

    def __init__(self, seed: int, fold_case: bool = False):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold_case:
            self.value[65:91] = self.value[97:123]
        base = (int(rng.integers(1 << 40, 1 << 62)) << 3 | 3) & ((1 << 64) - 1)
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 4096)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(size, self.base, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(size, self.inverse, np.uint64))])
        return self.up, self.down

    def sums(self, b: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than ``b``."""
        up, _ = self.powers(len(b) + 1)
        out = np.empty(len(b) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.value[b] * up[:len(b)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORDS = Poly(0x5EED, fold_case=True)
_EXACT = Poly(0x5EED5, fold_case=False)


#: As gaps also every ASCII character that is neither letter nor digit.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def pieces(buf: np.ndarray, lo: int, hi: int, bounds: np.ndarray, gaps: np.ndarray = _SPACE,
           size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cut ``[lo, hi)`` at document bounds or white space into stretches of about ``size`` bytes."""
    while lo < hi:
        step = size
        while True:
            end = min(hi, lo + step)
            if end == hi:
                break
            i = np.searchsorted(bounds, end, "right") - 1
            at_bound = int(bounds[i]) if i >= 0 else lo
            gap = np.flatnonzero(gaps[buf[max(lo, end - 4096):end]])
            at_gap = max(lo, end - 4096) + int(gap[-1]) if len(gap) else lo
            cut = max(at_bound, at_gap)
            if cut > lo:
                end = cut
                break
            step *= 2
        yield lo, end
        lo = end


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True,
                places: bool = False, gaps: np.ndarray = _SPACE) -> Iterator[tuple[np.ndarray, ...]]:
    """Per piece: (hash of each word, its text's row); with ``places`` also its first and end byte.

    ``starts`` and ``ends``: each text's stretch of ``buf``, as an Arrow string
    column holds them (adjacent, in order).  A-Z count as a-z with ``fold_case``;
    ``gaps`` tells which bytes end a word.
    """
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return
    s, e = starts[full], ends[full]
    poly = _WORDS if fold_case else _EXACT
    for lo, hi in pieces(buf, int(s[0]), int(e[-1]), s, gaps):
        part = buf[lo:hi]
        solid = ~gaps[part]
        edge = np.zeros(hi - lo + 1, bool)
        cuts = s[np.searchsorted(s, lo):np.searchsorted(s, hi)] - lo
        edge[cuts] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = poly.sums(part)
        h = mix(poly.of(sums, a, z))
        row = full[np.searchsorted(s, a + lo, "right") - 1]
        yield (h, row, a + lo, z + lo) if places else (h, row)


def all_words(buf, starts, ends, fold_case: bool = True, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all words of a batch."""
    got = list(word_hashes(buf, starts, ends, fold_case, gaps=gaps))
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def shingles(h: np.ndarray, row: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word's index of every run of ``n`` words of one text.

    With ``short`` a text of fewer (but some) words gives its whole sequence as one run.
    """
    m = len(h)
    if m == 0:
        return h, row, row
    _, first, count = np.unique(row, return_index=True, return_counts=True)
    acc = np.full(max(0, m - n + 1), n, np.uint64)
    for k in range(n):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k:m - n + 1 + k]) if m >= n else acc
    ok = row[:m - n + 1] == row[n - 1:] if m >= n else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    out_h, out_row = acc[at], row[at]
    few = np.flatnonzero(count < n)
    if short and len(few):
        extra = np.empty(len(few), np.uint64)
        for k in range(1, n):
            pick = few[count[few] == k]
            v = np.full(len(pick), k, np.uint64)
            for j in range(k):
                v = mix(v * np.uint64(0x9E3779B97F4A7C15) + h[first[pick] + j])
            extra[count[few] == k] = v
        out_h = np.concatenate([out_h, extra])
        out_row = np.concatenate([out_row, row[first[few]]])
        at = np.concatenate([at, first[few]])
    return out_h, out_row, at
