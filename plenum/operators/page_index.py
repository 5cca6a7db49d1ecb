"""A page made ready for many questions: which part of a quote does it hold?"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def suffix_order(text: str) -> np.ndarray:
    """The places of all suffixes of a text, sorted.

    Suffixes are ranked by their first 1, 2, 4, ... characters until all ranks differ: the rank
    by twice as many characters is that of a pair of known ranks. Memory is a few longs per
    character, whatever the text.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    rank = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    rank, width = np.unique(rank, return_inverse=True)[1], 1
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[:-width] = rank[width:] + 1
        pair = rank * (n + 1) + behind
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        rank[order] = np.concatenate(([0], np.cumsum(pair[1:] != pair[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class PageIndex:
    """The sorted suffixes of one page, searched by all its claims."""

    def __init__(self, page: str):
        self.page, self.order = page, suffix_order(page).tolist()

    def holds(self, block: str) -> bool:
        """Is the block part of the page? By bisection over the suffixes."""
        size = len(block)
        at = bisect_left(self.order, block, key=lambda place: self.page[place : place + size])
        return at < len(self.order) and self.page.startswith(block, self.order[at])

    def longest(self, quote: str) -> tuple[int, int]:
        """Length of the longest common block and its first place in the page; (0, 0) without one.

        From each place of the quote only blocks at least as long as the best so far are asked
        for; a longer one is found by doubling its length and then halving the gap.
        """
        best, blocks = 0, set()
        for start in range(len(quote)):
            rest, low = len(quote) - start, max(best, 1)
            if low > rest:
                break
            if not self.holds(quote[start : start + low]):
                continue
            high = low + 1
            while high <= rest and self.holds(quote[start : start + high]):
                low, high = high, 2 * high
            high = min(high, rest + 1)
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if self.holds(quote[start : start + middle]) else (low, middle)
            if low > best:
                best, blocks = low, set()
            blocks.add(quote[start : start + low])
        return best, min((self.page.find(b) for b in blocks), default=0)
