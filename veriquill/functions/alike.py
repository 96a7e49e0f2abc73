"""Whether two texts are alike by the ratio of difflib's matcher, to the letter but in far less time on long texts.

The matcher's longest block begins with the longest run of characters that stand in both ranges and are not too common in
the second text, the earliest of equals, and is then widened by whatever is equal on both sides. difflib finds the run by
walking all pairs of places of a character. Here runs of 1, 2, 4, ... characters are numbered once for both texts, so that
whether two ranges share a run of some length is a look-up of numbers, and the longest is found by halving.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np

#: Texts shorter than this have no characters that are too common, and are left to difflib.
SHORTEST = 200


class Blocks:
    """The longest matching blocks of ranges of a and b, as `SequenceMatcher(None, a, b).find_longest_match` gives them."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b)]
        (mine, n), (theirs, times) = (np.unique(p, return_counts=True) for p in points)
        _, i, j = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        #: Characters that a and b share, in whatever order.
        self.shared = int(np.minimum(n[i], times[j]).sum())
        # a block may begin with what is not too common in b
        known = theirs[times <= len(b) // 100 + 1] if len(b) >= SHORTEST else theirs
        numbers = []
        for p in points:
            at = np.searchsorted(known, p)
            numbers.append(np.where(known[np.minimum(at, len(known) - 1)] == p, at, -1) if len(known) else np.full(len(p), -1))
        self.levels = [self._level(numbers, len(known))]

    @staticmethod
    def _level(numbers: list[np.ndarray], kinds: int) -> tuple:
        """Numbers of the runs by the place where they begin (-1: none), those places, and when each number was last seen."""
        return numbers, [np.flatnonzero(n >= 0) for n in numbers], np.zeros(kinds, np.int64)

    def _doubled(self) -> None:
        numbers, places, seen = self.levels[-1]
        size = 1 << len(self.levels) - 1
        found = [self._pairs(n, p, size) for n, p in zip(numbers, places)]
        kinds, inverse = np.unique(np.concatenate([codes for _, codes in found]), return_inverse=True)
        out, read = [], 0
        for n, (at, codes) in zip(numbers, found):
            new = np.full(len(n), -1)
            new[at] = inverse[read : read + len(codes)]
            read += len(codes)
            out.append(new)
        self.levels.append(self._level(out, len(kinds)))

    @staticmethod
    def _pairs(numbers: np.ndarray, places: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where a run begins and another so far behind it, and a code of the two."""
        places = places[: np.searchsorted(places, len(numbers) - apart)]
        second = numbers[places + apart]
        fine = second >= 0
        return places[fine], numbers[places[fine]] << 32 | second[fine]

    def _first(self, k: int, alo: int, ahi: int, blo: int, bhi: int, stamp: int) -> tuple[int, int] | None:
        """Where the first run of k characters of the range of a stands that the range of b has too, and its first place there."""
        if k > min(ahi - alo, bhi - blo):
            return None
        level = k.bit_length() - 1
        while len(self.levels) <= level:
            self._doubled()
        numbers, places, seen = self.levels[level]
        here, there = (p[np.searchsorted(p, lo) : np.searchsorted(p, hi - k, "right")] for p, lo, hi in zip(places, (alo, blo), (ahi, bhi)))
        if not len(here) or not len(there):
            return None
        if k == 1 << level:
            mine, theirs = numbers[0][here], numbers[1][there]
            seen[theirs] = stamp
            met = seen[mine] == stamp
        else:
            (here, mine), (there, theirs) = (self._pairs(n, p, k - (1 << level)) for n, p in zip(numbers, (here, there)))
            met = np.isin(mine, theirs)
        if not met.any():
            return None
        i = met.argmax()
        return int(here[i]), int(there[(theirs == mine[i]).argmax()])

    def longest(self, stamp: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(i, j, size); stamp: a number that grows from call to call."""
        a, b, k = self.a, self.b, 0
        best, past = None, 1
        while found := self._first(past, alo, ahi, blo, bhi, stamp):
            best, k, past = found, past, 2 * past
        while past - k > 1:
            if found := self._first(middle := (k + past) // 2, alo, ahi, blo, bhi, stamp):
                best, k = found, middle
            else:
                past = middle
        i, j = best or (alo, blo)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        return i, j, k


def alike(a: str, b: str, least: float) -> bool:
    """SequenceMatcher(None, a, b).ratio() >= least, without the ratio where bounds settle it.

    The ratio is twice the matched characters over the total. What is matched is never more than the pieces still to be
    compared allow: the shorter of each two. The largest go first, which changes the order of the matcher's steps only.
    """
    total = len(a) + len(b)
    ratio = lambda matched: 2.0 * matched / total if total else 1.0
    if ratio(min(len(a), len(b))) < least:
        return False
    if len(b) < SHORTEST:
        m = SequenceMatcher(None, a, b)
        longest, most = lambda step, *piece: m.find_longest_match(*piece), m.quick_ratio()
    else:
        blocks = Blocks(a, b)
        longest, most = blocks.longest, ratio(blocks.shared)
    if most < least:
        return False
    matched, bound, step = 0, min(len(a), len(b)), 0
    pieces = [(-bound, 0, len(a), 0, len(b))]
    while pieces and ratio(matched) < least <= ratio(bound):
        size, alo, ahi, blo, bhi = heappop(pieces)
        step += 1
        i, j, k = longest(step, alo, ahi, blo, bhi)
        bound += size
        if k:
            matched, bound = matched + k, bound + k
            for piece in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if least_of := min(piece[1] - piece[0], piece[3] - piece[2]):
                    heappush(pieces, (-least_of, *piece))
                    bound += least_of
    return ratio(matched) >= least
