"""Points within spans: how many spans each lies in, and whose is the smallest, without listing them."""

from __future__ import annotations

import numpy as np


def _two(x: np.ndarray, y: np.ndarray, none: int) -> np.ndarray:
    """The two smallest different values of two such pairs, which lie along the first axis."""
    rest = np.minimum(np.minimum(x[1], y[1]), np.where(x[0] == y[0], none, np.maximum(x[0], y[0])))
    return np.stack([np.minimum(x[0], y[0]), rest])


def smallest_two(begin: np.ndarray, end: np.ndarray, who: np.ndarray, places: int, none: int) -> np.ndarray:
    """[2, places]: of each place, the two smallest different `who` of the stretches [begin, end), none of them empty, that it is in; or `none`.

    A stretch is two of a power of two's length, which may overlap; each length hands on to its halves."""
    level = np.frexp(end - begin)[1] - 1
    cell = np.concatenate([level * places + begin, level * places + end - (1 << level.astype(np.int64))])
    both = np.unique(np.stack([cell, np.concatenate([who, who])]), axis=1)
    first = np.flatnonzero(np.append(True, both[0, 1:] != both[0, :-1]))[: both.shape[1]]
    top = int(level.max(initial=0))
    found = np.full((2, (top + 1) * places), none, np.int64)
    found[0, both[0, first]] = both[1, first]
    second = first[(first + 1 < both.shape[1])] + 1
    second = second[both[0, second] == both[0, second - 1]]
    found[1, both[0, second]] = both[1, second]
    found = found.reshape(2, top + 1, places)
    for k in range(top, 0, -1):
        half, n = 1 << (k - 1), places - (1 << k) + 1
        for at in (0, half):
            found[:, k - 1, at : at + n] = _two(found[:, k - 1, at : at + n], found[:, k, :n], none)
    return found[:, 0]


def covers(at: np.ndarray, own: np.ndarray, begin: np.ndarray, end: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, first): the number of spans (begin, end, who), with both ends, that each point (at, own) lies in and that aren't its own, and the smallest `who` of them."""
    order = np.argsort(at, kind="stable")
    points, places = at[order], len(at)
    low, high = np.searchsorted(points, begin, "left"), np.searchsorted(points, end, "right")
    held = low < high
    if not places or not held.any():
        return np.zeros(places, np.int64), np.zeros(places, np.int64)
    low, high, (names, code) = low[held], high[held], np.unique(who[held], return_inverse=True)
    total = np.cumsum(np.bincount(low, minlength=places + 1) - np.bincount(high, minlength=places + 1))[:places]
    own = own[order]
    mine = np.minimum(np.searchsorted(names, own), len(names) - 1)
    known, wide = names[mine] == own, places + 1
    place = mine * wide + np.arange(places)
    starts, ends = np.sort(code * wide + low), np.sort(code * wide + high)
    same = np.searchsorted(starts, place, "right") - np.searchsorted(ends, place, "right")  # all of smaller codes have begun and ended
    n = total - np.where(known, same, 0)
    one, two = smallest_two(low, high, code, places, len(names))
    first = np.where(known & (one == mine), two, one)
    back = np.empty(places, np.int64)
    back[order] = np.arange(places)
    return n[back], names[np.minimum(first, len(names) - 1)][back]
