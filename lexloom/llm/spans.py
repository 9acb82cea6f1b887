"""Digests of (kind, start, end) spans in texts, and which of them overlap; ends are exclusive, in code points."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


class Taken:
    """What spans cover, as ranges in order that don't touch inside."""

    def __init__(self, spans=()):
        self.ranges: list[tuple[int, int]] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ranges and a < self.ranges[-1][1]:
                self.ranges[-1] = (self.ranges[-1][0], max(b, self.ranges[-1][1]))
            else:
                self.ranges.append((a, b))

    def overlaps(self, a: int, b: int) -> bool:
        at = bisect_left(self.ranges, (b,)) - 1
        return at >= 0 and self.ranges[at][1] > a

    def add(self, a: int, b: int) -> None:
        """a to b, which overlap nothing yet."""
        insort(self.ranges, (a, b))
