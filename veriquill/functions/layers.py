"""Rewritten copies of a text that know where their characters came from.

A layer holds its text and the runs it is made of: a run either copies its parent from some place on, or stands as a whole
for one place of it. Positions are found by searching the runs, layer by layer, so a copy costs memory for its changes
only. `sure` is False for a layer whose text is right but whose places could not be followed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable


class Layer:
    def __init__(self, text: str, parent: Layer | None = None, runs: list[tuple[int, int, bool]] | None = None, sure: bool = True):
        self.text, self.parent = text, parent
        self.sure = sure and (parent is None or parent.sure)
        self.begins = [r[0] for r in runs] if runs else [0]
        self.origins = [r[1] for r in runs] if runs else [0]
        self.copies = [r[2] for r in runs] if runs else [True]

    def source(self, place: int) -> int:
        """The place in the first text of the character at a place of this one."""
        layer = self
        while layer.parent is not None:
            r = bisect_right(layer.begins, place) - 1
            place = layer.origins[r] + (place - layer.begins[r] if layer.copies[r] else 0)
            layer = layer.parent
        return place

    def span(self, start: int, length: int) -> tuple[int | None, int | None]:
        if not self.sure or length <= 0:
            return None, None
        return self.source(start), self.source(start + length - 1) + 1

    def find(self, needle: str, not_before: int | None = None) -> int:
        """First place of needle whose source is at or after not_before; -1 if none, or if places are unknown."""
        if not_before is None:
            return self.text.find(needle)
        if not self.sure:
            return -1
        return self.text.find(needle, bisect_left(range(len(self.text)), not_before, key=self.source))

    def rewritten(self, pieces: list[tuple[int, int, str]]) -> Layer:
        """A layer with the given (start, end, replacement) pieces, in order and apart."""
        if not pieces:
            return self
        out, runs, read, size = [], [], 0, 0
        for start, end, new in pieces:
            if start > read:
                runs.append((size, read, True))
                out.append(self.text[read:start])
                size += start - read
            if new:
                runs.append((size, start, False))
                out.append(new)
                size += len(new)
            read = end
        if read < len(self.text):
            runs.append((size, read, True))
            out.append(self.text[read:])
        return Layer("".join(out), self, runs or [(0, 0, True)])

    def sub(self, pattern: re.Pattern, new: str) -> Layer:
        return self.rewritten([(m.start(), m.end(), new) for m in pattern.finditer(self.text)])

    def each(self, function: Callable[[str], str], whole: str) -> Layer:
        """The text under a function that should act on characters one by one; `whole` is what it makes of all of it."""
        if whole == self.text:
            return self
        changed = [(i, i + 1, new) for i, c in enumerate(self.text) if (new := function(c)) != c]
        layer = self.rewritten(changed)
        return layer if layer.text == whole else Layer(whole, self, sure=False)

    def stripped(self) -> Layer:
        kept = self.text.strip()
        if len(kept) == len(self.text):
            return self
        lead = len(self.text) - len(self.text.lstrip())
        return Layer(kept, self, [(0, lead, True)])
