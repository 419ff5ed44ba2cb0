"""Suffix arrays by the difference cover modulo three, over numpy arrays.

The suffixes at positions 1 and 2 modulo 3 are sorted by their triples; if some triples are equal, the triples' names are
a string of two thirds of the length, which is sorted in the same way. The remaining suffixes are sorted by their first
symbol and the rank of what follows, and merged in: against a suffix at position 1 by one symbol and a rank, against one
at position 2 by two symbols and a rank.
"""

from __future__ import annotations

import numpy as np

_BITS = 21
#: Symbols at most: three names must fit in one integer.
MOST = (1 << _BITS) - 4


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `text` (non-negative integers below MOST) in order."""
    n = len(text)
    if n > MOST:
        raise ValueError(f"{n} symbols; {MOST} at most")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])
    end = n + (n % 3 == 1)  # an empty triple parts the names of positions 1 from those of positions 2
    ones, twos = np.arange(1, end, 3), np.arange(2, n, 3)
    cover = np.concatenate([ones, twos])
    triple = s[cover] << 2 * _BITS | s[cover + 1] << _BITS | s[cover + 2]
    order = np.argsort(triple)
    new = np.concatenate([[1], (np.diff(triple[order]) != 0).astype(np.int64)])
    names = np.empty(len(cover), np.int64)
    names[order] = np.cumsum(new) - 1
    if not new.all():
        order = suffix_array(names)
    sampled = cover[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]

    zeros = np.arange(0, n, 3)
    zero_key = s[zeros] << _BITS | rank[zeros + 1]
    by = np.argsort(zero_key)
    zeros, zero_key = zeros[by], zero_key[by]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(s[first] << _BITS | rank[first + 1], zero_key)
    long = (s[zeros] << 2 * _BITS) | (s[zeros + 1] << _BITS) | rank[zeros + 2]
    before += np.searchsorted((s[second] << 2 * _BITS) | (s[second + 1] << _BITS) | rank[second + 2], long)
    place = before + np.arange(len(zeros))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zeros
    out[~taken] = sampled
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """`starts` (positions with `length` symbols to come) in suffix order, and the number of each one's group: those that
    share their first `length` symbols, found by comparing neighbours."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text)
    order = order[wanted[order]]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    other = np.ones(len(order), np.int64)
    for at in range(1, len(order), 1 << 16):
        here, prior = order[at : at + (1 << 16)], order[at - 1 : at - 1 + (1 << 16)]
        prior = prior[: len(here)]
        other[at : at + len(here)] = (windows[here] != windows[prior]).any(axis=1)
    return order, np.cumsum(other) - 1
