"""Word shingles of many texts at once, as flat 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1024) - 1, 0x100000001B3 | 1, np.uint64)]), dtype=np.uint64)
    return _powers


#: Bytes of text whose words are hashed in one step; longer texts are cut at blanks.
PIECE = 2 << 20
_CUT = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run of bytes other than 0x20 and 0x09-0x0D), and the number of words of each text."""
    if sum(map(len, raws)) <= PIECE or not raws:
        return _hashed(raws)
    hashes, counts, group, size = [], [], [], 0
    for raw in raws:
        if len(raw) > PIECE:
            hashes.append(_hashed(group))
            group, size, at, pieces = [], 0, 0, []
            while at < len(raw):
                blank = _CUT.search(raw, at + PIECE)
                end = blank.start() if blank else len(raw)
                pieces.append(_hashed([raw[at:end]])[0])
                at = end
            whole = np.concatenate(pieces)
            hashes.append((whole, np.array([len(whole)])))
            continue
        if size + len(raw) > PIECE:
            hashes.append(_hashed(group))
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    hashes.append(_hashed(group))
    hashes, counts = zip(*hashes)
    return np.concatenate(hashes), np.concatenate(counts)


def _hashed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(raws) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    blank = _SPACE[buf]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
    at = np.arange(len(buf))
    inside = at - np.maximum.accumulate(np.where(first, at, 0))
    values = np.where(blank, np.uint64(0), (buf.astype(np.uint64) + np.uint64(1)) * _power_table(int(inside.max()) + 1)[inside])
    hashes = mix(np.add.reduceat(values, starts))
    text = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return hashes, np.bincount(text, minlength=len(raws))


def shingle_sets(raws: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside it, and their number for each text.

    A text of fewer words is one shingle of its whole sequence; one without words has none.
    """
    hashes, counts = word_hashes(raws)
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled[: n - j] += mix(hashes[j:] + np.uint64(j + 1)) * _STEP[j % 5]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(raws), np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            total = sum(int(h) * (2 * k + 3) for k, h in enumerate(mix(hashes[a:b]))) + (b - a)
            own = mix(np.array([total % (1 << 64)], np.uint64))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
