"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round j inserts, for every string at once, the symbol that stands j places from its right end (Bauer, Cox and Rosone's
construction): the symbol is written where the string's last suffix stands, and the rank of that place among equal
symbols is where the longer suffix belongs.  Each round makes the transform, the common prefixes and the origins of the next
one.  They are held in memory, as arrays in suffix order: a collection's size is bounded by the caller, and Python tasks
reach the shared folder only through Spark, so they keep no files of their own.
"""

from __future__ import annotations

import numpy as np


def collection_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bwt, lcp, string, length) in suffix order, ends of strings first.

    bwt holds byte + 1, or 0 where a string begins; lcp[r] is the common prefix with row r - 1; string and length name the
    suffix of row r.
    """
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    last = np.cumsum(sizes)  # one past the end of each string in the joined bytes
    joined = np.frombuffer(b"".join(strings), np.uint8)
    kind = np.uint8 if joined.max(initial=0) < 255 else np.uint16  # no UTF-8 text holds the byte 255
    bwt, lcp = np.zeros(m, kind), np.zeros(m, np.int32)
    place = np.arange(m)  # row of each string's longest inserted suffix
    active = np.flatnonzero(sizes > 0)
    j = 0
    while len(active):
        j += 1
        at = place[active]
        bwt[at] = joined[last[active] - j].astype(kind) + kind(1)
        order = np.argsort(bwt, kind="stable")
        ends = int((bwt == 0).sum())  # rows whose string is complete
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        spot = rank[at].astype(np.int64) - ends  # rank among the rows that follow the m ends
        # common prefixes of the new rows, and of the rows after them, with the row before: one symbol more than
        # the least prefix between the places they were extended from
        total = len(bwt) - ends
        inserted = np.sort(spot)
        need = np.sort(np.concatenate([inserted, inserted + 1]))
        need = need[np.concatenate([[True], need[1:] != need[:-1]]) & (need < total)]
        here = order[need + ends]
        before = order[np.maximum(need - 1, 0) + ends]
        same = (need > 0) & (bwt[here] == bwt[before])
        value = np.zeros(len(need), np.int32)
        if same.any():
            lo, hi = before[same] + 1, here[same]
            turn = np.argsort(-lo, kind="stable")
            cuts = np.empty(2 * len(turn), np.int64)
            cuts[0::2], cuts[1::2] = lo[turn], np.minimum(hi[turn] + 1, len(lcp))
            least = np.minimum.reduceat(np.append(lcp, np.int32(0)), cuts)[0::2]
            got = np.empty(len(turn), np.int32)
            got[turn] = least
            value[same] = got + 1
        old = np.ones(m + total, bool)
        old[m + inserted] = False
        grown = np.zeros(m + total, kind), np.empty(m + total, np.int32)
        for new, was in zip(grown, (bwt, lcp)):
            new[old] = was
        bwt, lcp = grown
        lcp[m + need] = value
        place += np.searchsorted(m + inserted - np.arange(len(inserted)), place, side="right")
        place[active] = m + spot
        active = active[sizes[active] > j]
    # the origins: from the end of each string, the symbol of a row leads to the row of the suffix that it begins
    owner, length = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    rank += m - int((bwt == 0).sum())
    row, active, j = np.arange(m), np.flatnonzero(sizes > 0), 0
    while len(active):
        j += 1
        row[active] = rank[row[active]]
        owner[row[active]], length[row[active]] = active, j
        active = active[sizes[active] > j]
    return bwt, lcp, owner, length


def repeated(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, string, offset) of every place where a substring of ``length`` bytes stands that stands elsewhere too."""
    _, lcp, owner, suffix = collection_bwt(strings)
    joined = lcp >= length
    member = joined.copy()
    member[:-1] |= joined[1:]
    rows = np.flatnonzero(member)
    group = np.cumsum(~joined)[rows]
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    return group, owner[rows], sizes[owner[rows]] - suffix[rows]
