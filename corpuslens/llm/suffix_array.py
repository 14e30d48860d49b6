"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as larger (L) or smaller (S) than their successor. Leftmost S suffixes (LMS)
are put in order, recursively on their ranks where two are equal, and induce the order of all
others in two linear passes. Where t holds bytes a pass handles one bucket at a time as whole arrays.
The recursion and sequences of words have large alphabets and small buckets: there a pass handles a
stretch of places at a time, up to the first place that the stretch itself fills; short texts walk
plain lists.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S. The last suffix, followed by the empty one, is L."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        less = t[differs] < t[differs + 1]
        at = np.searchsorted(differs, np.arange(n - 1))
        known = at < len(differs)
        s[:-1][known] = less[at[known]]
    return s


def _bounds(t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def _place(sa: np.ndarray, t: np.ndarray, j: np.ndarray, at: np.ndarray, step: int) -> None:
    """Put suffixes j, in order, at their buckets' next places, which move by step."""
    c = t[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    sizes = np.bincount(c, minlength=len(at))
    rank = np.arange(len(j)) - (np.cumsum(sizes) - sizes)[c]
    if step > 0:
        sa[at[c] + rank] = j
        at += sizes
    else:
        sa[at[c] - 1 - rank] = j
        at -= sizes


def _induce(t: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """Suffix order induced from LMS suffixes, given in order within each bucket at least."""
    n = len(t)
    starts, ends = _bounds(t, k)
    sa = np.full(n, -1, np.int64)
    tails = ends.copy()
    _place(sa, t, lms[::-1], tails, -1)
    seeds = tails.copy()
    heads = starts.copy()

    def follow_l(found: np.ndarray) -> None:
        j = found - 1
        j = j[(found > 0)]
        j = j[~small[j]]
        if len(j):
            _place(sa, t, j, heads, 1)

    _place(sa, t, np.array([n - 1]), heads, 1)
    for c in np.flatnonzero(ends > starts):
        done = starts[c]
        while done < heads[c]:
            upto = heads[c]
            follow_l(sa[done:upto])
            done = upto
        if seeds[c] < ends[c]:
            follow_l(sa[seeds[c] : ends[c]])

    tails = ends.copy()
    for c in np.flatnonzero(ends > starts)[::-1]:
        done = ends[c]
        while True:
            upto = tails[c]
            if upto == done:
                break
            found = sa[upto:done][::-1]
            done = upto
            j = found[found > 0] - 1
            j = j[small[j]]
            if len(j):
                _place(sa, t, j, tails, -1)
        found = sa[starts[c] : heads[c]][::-1]
        j = found[found > 0] - 1
        j = j[small[j]]
        if len(j):
            _place(sa, t, j, tails, -1)
    return sa


def _targets(c: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The next places of suffixes of buckets c, taken in order."""
    order = np.argsort(c, kind="stable")
    found = c[order]
    place = np.arange(len(found))
    new = np.empty(len(found), bool)
    new[0] = True
    np.not_equal(found[1:], found[:-1], out=new[1:])
    rank = place - np.maximum.accumulate(np.where(new, place, 0))
    target = np.empty(len(c), np.int64)
    target[order] = at[found] + rank if step > 0 else at[found] - 1 - rank
    return target


STRETCH = 2  # places in a stretch, by the root of the length
SLOW = 8  # places handled at a time below which single steps are faster


def _induce_stretches(t: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    n = len(t)
    starts, ends = _bounds(t, k)
    sa = np.full(n, -1, np.int64)
    tails, heads = ends.copy(), starts.copy()
    _place(sa, t, lms[::-1], tails, -1)
    sa[heads[t[n - 1]]] = n - 1  # the last suffix precedes its bucket's other L suffixes
    heads[t[n - 1]] += 1
    stretch = max(64, int(STRETCH * n**0.5))

    def single(p: int, at: np.ndarray, want: bool, step: int) -> None:
        j = sa[p] - 1
        if j >= 0 and small[j] == want:
            c = t[j]
            at[c] -= step < 0
            sa[at[c]] = j
            at[c] += step > 0

    a = 0
    while a < n:
        b = min(n, a + stretch)
        found = sa[a:b]
        at = np.flatnonzero(found > 0)
        j = found[at] - 1
        large = ~small[j]
        j, at = j[large], at[large] + a
        if len(j):
            target = _targets(t[j], heads, 1)
            first = int(target.min())
            if first < b:
                if first - a < SLOW:
                    b = min(n, a + 64)
                    for p in range(a, b):
                        single(p, heads, False, 1)
                    a = b
                    continue
                b, early = first, at < first
                j, target = j[early], target[early]
            sa[target] = j
            np.add.at(heads, t[j], 1)
        a = b

    tails, b = ends.copy(), n
    while b > 0:
        a = max(0, b - stretch)
        found = sa[a:b][::-1]
        at = np.flatnonzero(found > 0)
        j = found[at] - 1
        less = small[j]
        j, at = j[less], b - 1 - at[less]
        if len(j):
            target = _targets(t[j], tails, -1)
            last = int(target.max())
            if last >= a:
                if b - 1 - last < SLOW:
                    a = max(0, b - 64)
                    for p in range(b - 1, a - 1, -1):
                        single(p, tails, True, -1)
                    b = a
                    continue
                a, late = last + 1, at > last
                j, target = j[late], target[late]
            sa[target] = j
            np.subtract.at(tails, t[j], 1)
        b = a
    return sa


def _induce_lists(t: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    n = len(t)
    starts, ends = _bounds(t, k)
    text, s = t.tolist(), small.tolist()
    sa = [-1] * n
    tails = ends.tolist()
    for j in lms[::-1].tolist():
        c = text[j]
        tails[c] -= 1
        sa[tails[c]] = j
    heads = starts.tolist()
    c = text[n - 1]
    first = heads[c]
    heads[c] += 1
    # the last suffix precedes its bucket's other L suffixes
    sa[first] = n - 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not s[j]:
            c = text[j]
            sa[heads[c]] = j
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and s[j]:
            c = text[j]
            tails[c] -= 1
            sa[tails[c]] = j
    return np.array(sa, np.int64)


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of LMS substrings, by text position; equal substrings share one. order: sorted LMS."""
    n = len(t)
    following = np.full(n, n, np.int64)
    following[lms[:-1]] = lms[1:]
    length = following[order] - order + (following[order] < n)
    same = length[1:] == length[:-1]
    same &= (following[order[1:]] < n) & (following[order[:-1]] < n)
    live, step = np.flatnonzero(same), 0
    while len(live):
        a, b = order[live], order[live + 1]
        equal = t[a + step] == t[b + step]
        same[live[~equal]] = False
        step += 1
        live = live[equal]
        live = live[length[live] > step]
    rank = np.concatenate([[0], np.cumsum(~same)])
    name = np.empty(n, np.int64)
    name[order] = rank
    return name[lms], int(rank[-1]) + 1


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """Order of the suffixes of t, an array of integers from 0 to k - 1."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = np.asarray(t)
    k = int(t.max()) + 1 if k is None else k
    induce = _induce_lists if n < 2000 else _induce if k <= 256 and n > 20_000 else _induce_stretches
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return induce(t, small, k, lms)
    rough = induce(t, small, k, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    name, names = _names(t, lms, order)
    if names < len(lms):
        order = lms[suffix_array(name, names)]
    return induce(t, small, k, order)


def _common_numbers(t: np.ndarray, live: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many numbers from each live position on agree with those from its predecessor on."""
    n, out, step = len(t), np.zeros(len(t), np.int64), 0
    while len(live):
        a, b = live + step, before[live] + step
        inside = np.maximum(a, b) < n
        equal = inside & (t[np.minimum(a, n - 1)] == t[np.minimum(b, n - 1)])
        out[live[~equal]] = step
        live = live[equal]
        step += 1
    return out


def _common_bytes(t: np.ndarray, live: np.ndarray, before: np.ndarray) -> np.ndarray:
    n = len(t)
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    out = np.zeros(n, np.int64)
    step = 0
    while len(live):
        a, b = live + step, before[live] + step
        room = n - np.maximum(a, b)
        equal = (room >= 8) & (words[np.minimum(a, n)] == words[np.minimum(b, n)])
        stop = live[~equal]
        if len(stop):
            x, y = stop + step, before[stop] + step
            got = np.zeros(len(stop), np.int64)
            on = np.ones(len(stop), bool)
            for d in range(8):
                on &= (np.maximum(x, y) + d < n) & (padded[np.minimum(x + d, n)] == padded[np.minimum(y + d, n)])
                got += on
            out[stop] = step + got
        live = live[equal]
        step += 8
    return out


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in suffix order, by text position.

    Where the preceding characters agree the value is its left neighbour's less one; only the other
    positions are compared, eight bytes a step, or one number a step where t holds no bytes.
    """
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = ~((before[1:] > 0) & (t[:-1] == t[np.maximum(before[1:], 1) - 1]))
    live = np.flatnonzero(fresh & (before >= 0))
    out = _common_bytes(t, live, before) if t.dtype == np.uint8 else _common_numbers(t, live, before)
    start = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.where(before >= 0, out[start] - (i - start), 0)
