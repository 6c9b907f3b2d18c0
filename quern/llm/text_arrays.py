"""Helpers for Arrow batches of texts as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a flat computation takes; longer texts go alone.
STEP_BYTES = 2 << 20


def steps(batch: pa.RecordBatch, text_col: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch holding about ``limit`` bytes of text at most (one row at least)."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text_col).cast(pa.large_binary())]) if batch.num_rows else np.zeros(0)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def crc32_mod(id_col, modulus: int):
    """crc32 of an id as text, modulo; a null id counts as ''."""
    from pyspark.sql import functions as F

    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % modulus


#: Stretches of a filter; each comes to the driver as one value.
STRETCHES = 64


def hash_filter(hashes, bits: int):
    """Broadcast bit map of the 64-bit hashes in column ``key``: bits / 8 bytes, whatever their number.

    ``bits`` is a power of two, so signed and unsigned remainders agree.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    span = bits // STRETCHES

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps: dict[int, np.ndarray] = {}
        for f in frames:
            place = f["place"].to_numpy()
            for s in np.unique(place // span).tolist():
                own = place[place // span == s] % span
                np.bitwise_or.at(maps.setdefault(s, np.zeros(span // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        if maps:
            yield pd.DataFrame({"stretch": list(maps), "bits": [m.tobytes() for m in maps.values()]})

    placed = hashes.select(F.expr(f"pmod(key, {bits})").alias("place"))
    made = placed.repartition(STRETCHES, F.expr(f"place div {span}")).mapInPandas(fill, "stretch long, bits binary")
    whole = bytearray(bits // 8)
    for r in made.toLocalIterator():
        whole[r["stretch"] * (span // 8) : (r["stretch"] + 1) * (span // 8)] = r["bits"]
    return hashes.sparkSession.sparkContext.broadcast(bytes(whole))


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be among those that made the filter."""
    place = keys % np.uint64(8 * len(bits))
    return ((bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
