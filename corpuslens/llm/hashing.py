"""Vectorised hashes of byte spans, words and word shingles over many texts at a time.

A span's hash is a polynomial modulo 2**64 taken from prefix sums, so any span costs O(1) after one
pass; ``mix`` (the splitmix64 finaliser) spreads it over all bits.
"""

from __future__ import annotations

import numpy as np

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PIECE = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _tables.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 1024)
        base = int(BASES[which])
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if size <= PIECE + 1024:
            _tables[which] = have
    return have


class SpanHash:
    """Hashes of arbitrary spans of one sequence of bytes or of other unsigned numbers."""

    def __init__(self, data: np.ndarray, which: int = 0):
        power, self.inverse = _powers(len(data) + 1, which)
        self.prefix = np.empty(len(data) + 1, U)
        self.prefix[0] = 0
        np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U) * U(0x632BE59BD9B4E019))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    word = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, spans: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word. Works in pieces of bounded size, cut between words. spans: those of
    ``word_spans``, where they are known."""
    start, end, row = spans or word_spans(data, offsets)
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + PIECE, side="right"))
        j = max(j, i + 1)
        lo, hi = start[i], end[j - 1]
        piece = data[lo:hi]
        out[i:j] = SpanHash(_LOWER[piece] if lower else piece).of(start[i:j] - lo, end[i:j] - lo)
        i = j
    return out, row


def shingles(words: np.ndarray, row: np.ndarray, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each k-word window inside one row.

    A row with words but fewer than k gives its whole sequence as one, if asked.
    """
    n = len(words)
    value = mix(words)
    for i in range(1, k):
        m = max(n - i, 0)
        value = mix(value[:m] * U(0xD1342543DE82EF95) + words[i : i + m])
    m = max(n - k + 1, 0)
    inside = np.flatnonzero(row[:m] == row[k - 1 : k - 1 + m]) if m else np.empty(0, np.int64)
    sh, rw, at = value[inside], row[inside], inside
    if whole_if_short and n:
        firsts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        counts = np.diff(np.r_[firsts, n])
        short = np.flatnonzero(counts < k)
        if len(short):
            extra = np.empty(len(short), U)
            for x, s in enumerate(short):
                f, c = firsts[s], counts[s]
                v = mix(words[f : f + 1])
                for i in range(1, c):
                    v = mix(v * U(0xD1342543DE82EF95) + words[f + i : f + i + 1])
                extra[x] = mix(v + U(int(c) * 0x51ED27))[0]
            sh, rw, at = np.r_[sh, extra], np.r_[rw, row[firsts[short]]], np.r_[at, firsts[short]]
    return sh, rw, at


def distinct_per_row(sh: np.ndarray, row: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (row, hash), ordered by row, then hash; more: columns that equal hashes share."""
    order = np.lexsort((sh, row))
    sh, row, *more = (x[order] for x in (sh, row, *more))
    if len(sh):
        keep = np.r_[True, (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])]
        sh, row, *more = (x[keep] for x in (sh, row, *more))
    return sh, row, *more
