"""Embedding near-duplicates: lattice hashing with E8 cells, several tables, neighbouring cells, verified cosine.

1. Equal vectors of a label collapse into one class (a partial aggregation), so copies are never expanded.
2. Each class's unit vector is projected to 8 dimensions by ``tables`` random matrices and decoded to its E8 cell; it is
   filed under that cell and under its ``n_probes`` nearest neighbouring cells.
3. Classes filed together are compared in blocks; cells with more than ``block`` rows are split into pairs of blocks
   that go to different tasks.  Pairs never leave a task: each class sends the number of vectors that it links with and meets
   there first (a pair counts in the first cell that both are filed under), and the links of a spanning forest.
4. The numbers add up to each vector's count; the forests give, by connected components, its component.

Edge cases: vectors that are null, zero or hold null or non-finite components, null labels and null ids link with
nothing (component_id is their own id); vectors of different lengths never meet; rows that share an id are one
node of the components; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.lattice import decode, probes
from quern.plans.shared import discard, materialise, ship_package

BLOCK = 2048


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _cells(unit: np.ndarray, table: int, scale: float, n_probes: int) -> np.ndarray:
    """(rows, 1 + n_probes) 64-bit cell hashes: the own cell first."""
    rng = np.random.default_rng([table, unit.shape[1], 8])
    x = unit @ (rng.normal(size=(unit.shape[1], 8)) / scale) + rng.uniform(0, 2, 8)
    own = decode(x)
    cells = np.concatenate([own[:, None, :], probes(x, own, n_probes)], axis=1)
    mixed = np.full(cells.shape[:2], np.uint64(1469598103934665603 + table), np.uint64)
    for d in range(8):
        mixed = (mixed ^ cells[:, :, d].astype(np.uint64)) * np.uint64(1099511628211)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _keyed(classes: DataFrame, tables: int, scale: float, n_probes: int) -> DataFrame:
    """(id, copies, keys, vector) of each class; keys: the cells that it is filed under, table by table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["vector"].map(len)):
                x = np.stack(part["vector"].to_numpy()).astype(np.float64).reshape(len(part), dim)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                salt = (part["label"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
                keys = np.concatenate([(_cells(unit, t, scale, n_probes) ^ salt).astype(np.int64) for t in range(tables)], axis=1)
                yield pd.DataFrame({"id": part["id"], "copies": part["copies"], "keys": list(keys), "vector": [v.tobytes() for v in x]})

    return classes.select("id", "label", "vector", "copies").mapInPandas(run, "id long, copies long, keys array<long>, vector binary")


def sorted_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of two rows or more from frames that arrive sorted by keys; a group may span frames."""
    rest = None
    for frame in frames:
        frame = frame if rest is None or not len(rest) else pd.concat([rest, frame], ignore_index=True)
        k = frame[keys].to_numpy()
        edges = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if not len(edges):
            rest = frame
            continue
        starts = np.concatenate([[0], edges[:-1]])
        for a, b in zip(starts[edges - starts > 1], edges[edges - starts > 1]):
            yield frame.iloc[a:b]
        rest = frame.iloc[edges[-1] :]
    if rest is not None and len(rest) > 1:
        yield rest


def spanning_links(hit: np.ndarray) -> list[tuple[int, int]]:
    """From a symmetric matrix of links, those of a spanning forest: breadth first, each row looked at once."""
    left, out = hit.any(1), []
    while left.any():
        frontier = np.flatnonzero(left)[:1]
        left[frontier] = False
        while len(frontier):
            met = hit[frontier] & left[None, :]
            fresh = np.flatnonzero(met.any(0))
            out += zip(frontier[met[:, fresh].argmax(0)].tolist(), fresh.tolist())
            left[fresh] = False
            frontier = fresh
    return out


def _compare(threshold: float, n_probes: int):
    """Cells -> for each class the vectors (copies counted) that it first meets and links with here (b null), and links of a
    spanning forest (linked null): two rows a class at most, however many pairs link."""

    def earlier(keys: np.ndarray, a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
        """Whether the pairs share a cell in an earlier table, or one of a smaller name in this one."""
        met = np.zeros(len(a), bool)
        wide = 1 + n_probes
        for t in range(keys.shape[1] // wide):
            x, y = keys[a, t * wide : (t + 1) * wide], keys[b, t * wide : (t + 1) * wide]
            shared = x[:, :, None] == y[:, None, :]
            here = (x == key).any(1) & (y == key).any(1)
            met |= np.where(here, (shared & (x < key)[:, :, None]).any((1, 2)), shared.any((1, 2)) & ~here)
            if here.all():
                break
        return met

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        size = 0
        for group in sorted_groups(frames, ["key", "i", "j"]):
            group = group.drop_duplicates("id")
            ids, own, i, j, key = group["id"].to_numpy(), group["own"].to_numpy(), group["i"].iloc[0], group["j"].iloc[0], group["key"].iloc[0]
            n = len(ids)
            if n < 2:
                continue
            x = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(n, -1)
            norm = np.sqrt((x * x).sum(1))
            hit = np.zeros((n, n), bool)
            for at in range(0, n, 512):
                hit[at : at + 512] = (x[at : at + 512] @ x.T) / (norm[at : at + 512, None] * norm[None, :]) >= threshold
            hit &= hit.T  # alike from both sides, whatever the rounding of blocks
            np.fill_diagonal(hit, False)
            if i != j:
                hit &= own[:, None] != own[None, :]
            if not hit.any():
                continue
            keys, copies, linked = np.stack(group["keys"].to_numpy()), group["copies"].to_numpy(), np.zeros(n, np.int64)
            for at in range(0, n, 256):
                a, b = np.nonzero(hit[at : at + 256])
                fresh = ~earlier(keys, a + at, b, key)
                np.add.at(linked, a[fresh] + at, copies[b[fresh]])
            ends = np.array(spanning_links(hit))
            some = np.flatnonzero(linked)
            none = lambda k: pd.array([None] * k, "Int64")
            out += [pd.DataFrame({"a": ids[some], "b": none(len(some)), "linked": pd.array(linked[some], "Int64")}), pd.DataFrame({"a": ids[ends[:, 0]], "b": pd.array(ids[ends[:, 1]], "Int64"), "linked": none(len(ends))})]
            size += len(some) + len(ends)
            if size > 20_000:
                yield pd.concat(out, ignore_index=True)
                out, size = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int = 10, scale: float = 1.6, n_probes: int = 1, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    ship_package(vectors.sparkSession)
    vector = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.cast("array<double>").alias("vector"))
    able = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    classes = materialise(rows.filter("able").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")

    keyed = materialise(_keyed(classes, tables, scale, n_probes), "vector-keyed")
    # cells of one class hold no pair; the others are counted and cut without the vectors, which follow once they are placed
    thin = keyed.select("id", F.explode("keys").alias("key")).distinct()
    shared = materialise(thin.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "vector-cells")
    placed = thin.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id").join(keyed, "id")
    n = max(12, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = spread.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    met = materialise(dealt.mapInPandas(_compare(threshold, n_probes), "a long, b long, linked long"), "vector-met")
    discard(keyed)
    discard(shared)

    degree = met.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("linked").alias("linked"))
    parts = connected_components(met.filter("b IS NOT NULL").select("a", "b"))
    known = classes.join(degree, "id", "left").join(parts, "id", "left").select("label", "vector", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    found = rows.filter("able").join(known, ["label", "vector"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("NOT able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
