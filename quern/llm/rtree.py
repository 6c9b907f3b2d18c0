"""An R-tree over count vectors, with joins bounded by summed coordinate minima.

A set is a point: its size, and how many of its members fall in each of a fixed number of groups.  Two sets overlap in
at most the sum over the groups of the smaller count; a node's upper corner bounds every point below it in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FANOUT = 16
#: Node or point pairs whose bounds are taken in one step.
STEP = 1 << 12
#: Searches in a row that tie nothing before the join takes over.
FRUITLESS = 4


class CountRTree:
    """Bulk-loaded (sort, tile, recurse) tree over points (rows of counts) with their set sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = self._tile(counts, sizes)
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            upper, low, high = self.levels[-1]
            cuts = np.arange(0, len(upper), FANOUT)
            self.levels.append((np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    @staticmethod
    def _tile(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Halves along the widest coordinate until a leaf is left."""

        def walk(rows: np.ndarray) -> list[np.ndarray]:
            if len(rows) <= FANOUT:
                return [rows]
            part = counts[rows]
            widest = int((part.max(0) - part.min(0)).argmax())
            rows = rows[np.argsort(part[:, widest], kind="stable")]
            half = FANOUT * ((len(rows) // FANOUT + 1) // 2 or 1)
            return walk(rows[:half]) + walk(rows[half:])

        return np.concatenate(walk(np.argsort(sizes, kind="stable"))) if len(sizes) else np.zeros(0, np.int64)

    def self_join(self, num: int, den: int, differ: np.ndarray | None = None) -> np.ndarray:
        """Pairs of rows (n, 2) that may have a Jaccard similarity of num/den: no such pair is missing.

        differ: labels; only pairs of different labels are returned.
        """
        return np.concatenate([np.zeros((0, 2), np.int64), *self._joined(num, den, differ)])

    def _joined(self, num: int, den: int, differ: np.ndarray | None = None, across: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """self_join's pairs step by step.  Labels may be merged in between: node pairs of one label are left out unseen."""
        top = len(self.levels) - 1
        stack = [(top, np.array([[0, 0]]))] if len(self.levels[0][0]) else []
        while stack:
            level, pairs = stack.pop()
            if len(pairs) > STEP:
                stack += [(level, pairs[i : i + STEP]) for i in range(0, len(pairs), STEP)]
                continue
            if level == 0:
                pairs = pairs[pairs[:, 0] < pairs[:, 1]]
            for labels in (differ, across):
                if labels is not None:
                    least, most = self._extremes(labels, level)
                    pairs = pairs[(least[pairs[:, 0]] != most[pairs[:, 1]]) | (most[pairs[:, 0]] != least[pairs[:, 1]])]
            upper, low, high = self.levels[level]
            a, b = pairs[:, 0], pairs[:, 1]
            pairs = pairs[may_link(upper[a], upper[b], low[a], high[a], low[b], high[b], num, den)]
            if not len(pairs):
                continue
            if level == 0:
                yield self.order[pairs]
                continue
            n = len(self.levels[level - 1][0])
            step = max(1, STEP // (FANOUT * FANOUT))
            for i in range(0, len(pairs), step):
                part = pairs[i : i + step]
                kids = np.arange(FANOUT)
                left = part[:, 0, None, None] * FANOUT + kids[None, :, None]
                right = part[:, 1, None, None] * FANOUT + kids[None, None, :]
                left, right = np.broadcast_arrays(left, right)
                keep = (left < n) & (right < n) & (left <= right)
                stack.append((level - 1, np.stack([left[keep], right[keep]], 1)))

    def _extremes(self, labels: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest label below each node of a level."""
        least = most = labels[self.order]
        for _ in range(level):
            cuts = np.arange(0, len(least), FANOUT)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
        return least, most

    def search(self, row: int, asked: np.ndarray, num: int, den: int) -> np.ndarray:
        """The rows among those asked (a mask) that may have the similarity with one row, in order."""
        at = int(np.flatnonzero(self.order == row)[0])
        point, size = self.levels[0][0][at : at + 1], self.levels[0][1][at]
        masks = [asked[self.order]]
        for _ in self.levels[1:]:
            masks.append(np.logical_or.reduceat(masks[-1], np.arange(0, len(masks[-1]), FANOUT)))
        nodes = np.flatnonzero(masks[-1])
        for level in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[level]
            ok = [may_link(upper[x], point, low[x], high[x], size, size, num, den) for x in np.split(nodes, range(STEP, len(nodes), STEP))]
            nodes = nodes[np.concatenate(ok)]
            if level and len(nodes):
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(masks[level - 1])]
                nodes = nodes[masks[level - 1][nodes]]
        return np.sort(self.order[nodes])

    def tie(self, num: int, den: int, root: np.ndarray, across: np.ndarray | None = None, holds: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
        """Pairs that tie rows of different roots (and of different values of across), one for each root fewer; root, which
        names a row of each tie, is brought up to date.  In the end no pair of different roots is left that may have the similarity
        (and holds, if given).

        Rows not tied yet are searched for first, smallest first, as long as searches tie rows: near copies are tied in a
        few searches, and the join that follows passes over nodes of one root.
        """
        taken: list[tuple[int, int]] = []

        def take(a: int, others: np.ndarray) -> int:
            merged = {int(root[a])}
            for b in others.tolist():
                if int(root[b]) not in merged and (holds is None or holds(a, b)):
                    merged.add(int(root[b]))
                    taken.append((a, b) if a < b else (b, a))
            if len(merged) > 1:
                root[np.isin(root, list(merged))] = min(merged)
            return len(merged) - 1

        fruitless, seen = 0, np.zeros(len(root), bool)
        while fruitless < FRUITLESS and not seen.all():
            a = int(np.argmin(seen))
            asked = root != root[a]
            if across is not None:
                asked &= across != across[a]
            tied = take(a, self.search(a, asked, num, den)) if asked.any() else 0
            fruitless = 0 if tied else fruitless + 1
            seen |= root == root[a]
        for pairs in self._joined(num, den, root, across):
            pairs = np.sort(pairs, axis=1)
            pairs = pairs[np.lexsort([pairs[:, 1], pairs[:, 0]])]
            while len(pairs):
                a = pairs[0, 0]
                own = pairs[:, 0] == a
                take(int(a), pairs[own, 1])
                pairs = pairs[~own]
                pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
        return taken


def may_link(upper_a, upper_b, low_a, high_a, low_b, high_b, num: int, den: int) -> np.ndarray:
    """Whether sets below two corners can reach the similarity: by sizes, and by the sum of coordinate minima.

    From overlap * (den + num) >= num * (|a| + |b|), each side at its most hopeful.
    """
    near = (np.minimum(high_a, high_b) * den >= np.maximum(low_a, low_b) * num)
    bound = np.minimum(upper_a, upper_b).sum(1, dtype=np.int64)
    return near & (bound * (den + num) >= num * (low_a + low_b))
