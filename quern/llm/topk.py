"""Exact top-k search by inner product with a pivot-distance index.

Inner products become distances by one more coordinate: x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, where M is the greatest norm of all rows.  Every row is keyed by its nearest pivot
and its distance to it; a pivot's distances are cut into annuli.  A query
1. expands the annuli nearest to it until they hold enough rows, which gives a k-th score;
2. visits every further annulus that the triangle inequality cannot rule out against that score, ties included.
Only the pivots and annulus edges come from a bounded sample (``sample`` rows of lowest hash); every row is indexed and
the result is exact.  The directory of annuli has a fixed number of rows.  Annuli of more than ``block`` rows are
split, so many copies of one vector are searched by many tasks.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do those of another
length than most (ties: the longer), nor rows without an id; a query with fewer than k candidates gets them all; equal
scores go to the smaller id; a repeated query row is answered once, repeated candidates rank one by one; an empty table
gives no rows.  Vectors whose squared norm reaches 2^62 would overflow a long and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.vectors import sorted_groups, usable
from quern.plans.shared import materialise, ship_package

PIVOTS, ANNULI = 16, 4
BLOCK = 16384


def fit_pivots(x: np.ndarray, n: int = PIVOTS, rounds: int = 6) -> np.ndarray:
    """Farthest-first seeds, then a few Lloyd rounds; fewer pivots if the sample has fewer distinct rows."""
    seeds = [0]
    gap = ((x - x[0]) ** 2).sum(1)
    while len(seeds) < n and gap.max() > 0:
        seeds.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[seeds[-1]]) ** 2).sum(1))
    pivots = x[seeds].copy()
    for _ in range(rounds):
        own = distances(x, pivots).argmin(1)
        for p in range(len(pivots)):
            if (own == p).any():
                pivots[p] = x[own == p].mean(0)
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))[:, None]], 1)


class Directory:
    """Pivots and, for each annulus, its pivot, nearest and farthest row, rows and parts."""

    def __init__(self, pivots: np.ndarray, edges: np.ndarray, m2: float):
        self.pivots, self.edges, self.m2 = pivots, edges, m2

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(lifted(x, self.m2), self.pivots)
        p = d.argmin(1)
        r = d[np.arange(len(x)), p]
        return p * ANNULI + (r[:, None] > self.edges[p]).sum(1), r

    def close(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, block: int) -> None:
        self.cell, self.low, self.high, self.rows, self.parts = cell, low, high, rows, -(-rows // block)

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest score that each annulus can hold (queries, cells), and the distance to its pivot."""
        d = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), self.pivots)[:, self.cell // ANNULI]
        least = np.maximum(0, np.maximum(d - self.high, self.low - d))
        both = (q * q).sum(1)[:, None] + self.m2
        return (both - least**2) / 2 + 1e-9 * both + 0.5, d


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _ask(directory: Directory, k: int, first: bool):
    """Query rows -> one row for each part of each annulus that the round visits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                f = frame.iloc[at : at + 256]
                if not len(f):
                    continue
                top, far = directory.reach(_vectors(f["x"]))
                order = np.argsort(-top, axis=1, kind="stable")
                held = np.cumsum(directory.rows[order], axis=1) - directory.rows[order]
                near = np.zeros(top.shape, bool)
                np.put_along_axis(near, order, held < 8 * (k + 1), axis=1)
                visit = near if first else ~near & (top >= f["tau"].to_numpy()[:, None])
                q, c = np.nonzero(visit)
                times = directory.parts[c]
                q, c = np.repeat(q, times), np.repeat(c, times)
                part = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"cell": directory.cell[c], "part": part, "role": 1, "id": f["id"].to_numpy()[q], "r": far[q, c], "tau": f["tau"].to_numpy()[q], "x": f["x"].to_numpy()[q]})

    return run


def _search(k: int, m2: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["cell", "part"]):
            role = group["role"].to_numpy()
            rows, asked = group[role == 0], group[role == 1]
            if not len(rows) or not len(asked):
                continue
            x, r, ids = _vectors(rows["x"]), rows["r"].to_numpy(), rows["id"].to_numpy()
            queries, tau, far = _vectors(asked["x"]), asked["tau"].to_numpy(), asked["r"].to_numpy()
            # rows arrive sorted by distance: the annulus that a query's score still allows is one slice of them
            both = (queries * queries).sum(1) + m2
            radius = np.where(np.isneginf(tau), np.inf, np.sqrt(np.maximum(both - 2 * np.where(np.isneginf(tau), 0, tau) + 1 + 1e-9 * both, 0)))
            a, b = np.searchsorted(r, far - radius - 1e-6), np.searchsorted(r, far + radius + 1e-6, side="right")
            exact = np.abs(queries).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 2.0**52
            for at in range(0, len(queries), 256):
                part = slice(at, at + 256)
                lo, hi = a[part].min(), b[part].max()
                if lo >= hi:
                    continue
                s = queries[part] @ x[lo:hi].T if exact else queries[part].astype(np.int64) @ x[lo:hi].T.astype(np.int64)
                s, own = s.astype(np.int64), ids[lo:hi]
                for q, i in enumerate(asked["id"].to_numpy()[part]):
                    some = np.flatnonzero(own != i)
                    if len(some) > k:
                        score = s[q][some]
                        least = np.partition(score, len(some) - k)[len(some) - k]
                        over, tied = some[score > least], some[score == least]
                        some = np.concatenate([over, tied[np.argsort(own[tied], kind="stable")][: k - len(over)]])
                    if len(some):
                        yield pd.DataFrame({"query_id": i, "vec_id": own[some], "score": s[q][some]})

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, sample: int = 4096, block: int = BLOCK, quantum: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest scores of each query (rows whose id is divisible by ``every``): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * quantum).cast("double"))).withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).filter(F.col("n2") < 2.0**62)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("n2").alias("m2")).orderBy(F.desc("n"), F.desc("dim")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if sizes is None or sizes["dim"] == 0:
        return spark.createDataFrame([], out)
    m2 = float(sizes["m2"])
    rows = rows.filter(F.size("v") == sizes["dim"]).select("id", "v")

    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    lifted_sample = lifted(np.stack(drawn["v"].to_numpy()).astype(np.float64), m2)
    pivots = fit_pivots(lifted_sample)
    d = distances(lifted_sample, pivots)
    own = d.argmin(1)
    shares = np.arange(1, ANNULI) / ANNULI
    edges = np.stack([np.quantile(d[own == p, p], shares) if (own == p).any() else np.zeros(ANNULI - 1) for p in range(len(pivots))])
    directory = Directory(pivots, edges, m2)

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).astype(np.float64)
                cell, r = directory.cells(x)
                yield pd.DataFrame({"cell": cell, "id": f["id"], "r": r, "x": [row.tobytes() for row in x]})

    index = materialise(rows.mapInPandas(key, "cell int, id long, r double, x binary"), "topk-index")
    listed = index.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).orderBy("cell").toPandas()
    directory.close(listed["cell"].to_numpy(np.int64), listed["low"].to_numpy(), listed["high"].to_numpy(), listed["n"].to_numpy(np.int64), block)
    parts = F.lit(1)
    for c, n in zip(directory.cell.tolist(), directory.parts.tolist()):
        parts = F.when(F.col("cell") == c, n).otherwise(parts) if n > 1 else parts
    filed = index.select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(0).alias("role"), "id", "r", F.lit(0.0).alias("tau"), "x")
    n_parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked_schema = "cell int, part int, role int, id long, r double, tau double, x binary"
    found_schema = "query_id long, vec_id long, score long"

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        asked = queries.mapInPandas(_ask(directory, k, first), asked_schema)
        met = filed.union(asked).repartition(n_parts, "cell", "part").sortWithinPartitions("cell", "part", "role", "r", "id")
        return met.mapInPandas(_search(k, m2), found_schema)

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)

    queries = index.filter(F.col("id") % every == 0).select("id", "x").dropDuplicates(["id", "x"])
    near = materialise(best(visit(queries.withColumn("tau", F.lit(float("-inf"))), True)), "topk-near")
    tau = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("tau"))
    further = queries.join(tau.withColumnRenamed("query_id", "id"), "id", "left").withColumn("tau", F.coalesce("tau", F.lit(float("-inf"))))
    rest = visit(further.select("id", "x", "tau"), False)
    done = best(near.select("query_id", "vec_id", "score").union(rest))
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
