"""Chunkers.  A chunk is a token interval of its document: doc_id, chunk_idx, tok_lo, tok_hi (inclusive), n_tokens.

Fixed windows are a closed form, sentence packing a fold over a document's sentence sizes; both stay in the JVM and are narrow
up to the grouping of sentences by document.  Only recursive splitting runs in Python, a batch of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import sentences, token_count
from quern.operators.order_stats import order_statistics
from quern.plans.shared import ship_package


def _check(size: int, overlap: int) -> None:
    if size < 1:
        raise ValueError("size must be >= 1")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")


def window_bounds(n_tokens: Column, size: int | Column, overlap: int = 0, first: Column | int = 0) -> Column:
    """Array of (lo, hi) windows of n_tokens tokens that start at ``first``: the last is the first to reach the end."""
    size = F.lit(size) if isinstance(size, int) else size
    first = F.lit(first) if isinstance(first, int) else first
    stride = size - F.lit(overlap)
    count = F.when(n_tokens <= 0, F.lit(0)).when(n_tokens <= size, F.lit(1)).otherwise(F.ceil((n_tokens - size) / stride).cast("int") + 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.struct((first + k * stride).cast("int").alias("lo"), (first + F.least(k * stride + size, n_tokens) - 1).cast("int").alias("hi")))


def _exploded(rows: DataFrame, bounds: Column, *more: str) -> DataFrame:
    out = rows.select("doc_id", *more, F.posexplode(bounds).alias("chunk_idx", "c"))
    return out.select("doc_id", *more, "chunk_idx", F.col("c.lo").alias("tok_lo"), F.col("c.hi").alias("tok_hi"), (F.col("c.hi") - F.col("c.lo") + 1).alias("n_tokens"))


def fixed_chunks(docs: DataFrame, size: int, overlap: int = 0, text_col: str = "text") -> DataFrame:
    """Windows of ``size`` tokens with a stride of size - overlap."""
    _check(size, overlap)
    counted = docs.select("doc_id", token_count(F.col(text_col)).alias("n"))
    return _exploded(counted, window_bounds(F.col("n"), size, overlap))


def fixed_chunk_grid(counted: DataFrame, sizes: list[int]) -> DataFrame:
    """counted(doc_id, n) -> the chunks of all sizes in one plan, with column ``size``."""
    sized = counted.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return _exploded(sized, window_bounds(F.col("n"), F.col("size")), "size")


def _per_document(rows: DataFrame) -> DataFrame:
    """Sentence sizes of each document in order; an array is bounded by its document."""
    listed = F.array_sort(F.collect_list(F.struct("sent_idx", "n_tokens")))
    return rows.groupBy("doc_id").agg(F.transform(listed, lambda s: s["n_tokens"]).alias("sizes"))


def _pack(sizes: Column, limit: int) -> Column:
    """Greedy packing: a new group where the next sentence would pass the limit; long sentences become windows."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        closed = F.when(acc["held"] > 0, F.concat(acc["out"], F.array(F.struct((acc["at"] - acc["held"]).alias("lo"), (acc["at"] - 1).alias("hi"))))).otherwise(acc["out"])
        fits = acc["held"] + n <= limit
        out = F.when(n > limit, F.concat(closed, window_bounds(n, limit, 0, acc["at"]))).when(fits, acc["out"]).otherwise(closed)
        held = F.when(n > limit, F.lit(0)).when(fits, acc["held"] + n).otherwise(n)
        return F.struct((acc["at"] + n).alias("at"), held.alias("held"), out.alias("out"))

    def close(acc: Column) -> Column:
        return F.when(acc["held"] > 0, F.concat(acc["out"], F.array(F.struct((acc["at"] - acc["held"]).alias("lo"), (acc["at"] - 1).alias("hi"))))).otherwise(acc["out"])

    return F.aggregate(sizes, zero, step, close)


def pack_with_overlap(sizes: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token intervals of greedy packing where each group begins ``overlap`` sentences before the last one ended.

    The rewind has no end-of-document test, so suffixes of the last group are groups as well.
    """
    ends = np.cumsum(sizes)
    begin = ends - sizes
    out, i, n = [], 0, len(sizes)
    while i < n:
        if sizes[i] > limit:
            out += [(int(a), int(min(a + limit, ends[i]) - 1)) for a in range(int(begin[i]), int(ends[i]), limit)]
            i += 1
        else:
            j = int(np.searchsorted(ends, begin[i] + limit, side="right"))
            out.append((int(begin[i]), int(ends[j - 1]) - 1))
            i = max(j - overlap, i + 1)
    return out


def sentence_chunks(docs: DataFrame, limit: int, overlap: int = 0, text_col: str = "text") -> DataFrame:
    """Whole sentences packed greedily up to ``limit`` tokens, ``overlap`` counted in sentences."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    if overlap < 0:
        raise ValueError("overlap must be >= 0")
    rows = _per_document(sentences(docs, text_col))
    if overlap == 0:
        return _exploded(rows.select("doc_id", _pack(F.col("sizes"), limit).alias("bounds")), F.col("bounds"))
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<struct<lo:int,hi:int>>")
    def packed(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: [{"lo": a, "hi": b} for a, b in pack_with_overlap(np.asarray(s, np.int64), limit, overlap)])

    return _exploded(rows.select("doc_id", packed("sizes").alias("bounds")), F.col("bounds"))


def semantic_breaks(rows: DataFrame, percentile: float = 95.0) -> DataFrame:
    """rows(doc_id, sent_idx, embedding, ...) with ``breaks``: whether the distance to the sentence before is strictly above its document's percentile."""
    from pyspark.sql import Window

    if not 0 < percentile < 100:
        raise ValueError("percentile must be strictly between 0 and 100")
    order, whole = Window.partitionBy("doc_id").orderBy("sent_idx"), Window.partitionBy("doc_id")
    dot = F.aggregate(F.zip_with("embedding", "_before", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    far = rows.withColumn("_before", F.lag("embedding").over(order)).withColumn("distance", F.when(F.col("_before").isNotNull(), F.lit(1.0) - dot))
    limit = F.percentile("distance", F.lit(percentile / 100)).over(whole)
    return far.withColumn("limit", limit).withColumn("breaks", F.coalesce(F.col("distance") > F.col("limit"), F.lit(False))).drop("_before")


def semantic_chunks(rows: DataFrame, limit: int, percentile: float = 95.0) -> DataFrame:
    """rows(doc_id, sent_idx, n_tokens, embedding) -> sentences packed up to ``limit`` tokens without crossing a break."""
    broken = semantic_breaks(rows, percentile)
    listed = F.array_sort(F.collect_list(F.struct("sent_idx", "n_tokens", "breaks")))
    docs = broken.groupBy("doc_id").agg(listed.alias("s"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))

    def shut(acc: Column) -> Column:
        return F.when(acc["held"] > 0, F.concat(acc["out"], F.array(F.struct((acc["at"] - acc["held"]).alias("lo"), (acc["at"] - 1).alias("hi"))))).otherwise(acc["out"])

    def step(acc: Column, s: Column) -> Column:
        n = s["n_tokens"]
        fits = (acc["held"] + n <= limit) & ~s["breaks"]
        out = F.when(n > limit, F.concat(shut(acc), window_bounds(n, limit, 0, acc["at"]))).when(fits, acc["out"]).otherwise(shut(acc))
        held = F.when(n > limit, F.lit(0)).when(fits, acc["held"] + n).otherwise(n)
        return F.struct((acc["at"] + n).alias("at"), held.alias("held"), out.alias("out"))

    return _exploded(docs.select("doc_id", F.aggregate("s", zero, step, shut).alias("bounds")), F.col("bounds"))


class _Offsets:
    """A document's token edges and interval counts."""

    def __init__(self, text: str):
        import regex

        found = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]", text)]
        self.starts = np.array([a for a, _ in found], np.int64)
        self.ends = np.array([b for _, b in found], np.int64)

    def between(self, lo: int, hi: int) -> tuple[int, int]:
        """Places of the tokens that lie wholly in [lo, hi)."""
        return int(np.searchsorted(self.starts, lo)), int(np.searchsorted(self.ends, hi, side="right"))


def recursive_bounds(text: str, limit: int, separators: tuple[str, ...] = ("\n\n", "\n", " ")) -> list[tuple[int, int]]:
    """Token intervals of text cut at the coarsest separators that bring pieces down to ``limit`` tokens, then merged greedily."""
    at = _Offsets(text)
    if not len(at.starts):
        return []
    leaves: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        lo, hi, level = todo.pop()
        a, b = at.between(lo, hi)
        if b - a <= limit:
            if b > a:
                leaves.append((a, b))
        elif level == len(separators):
            leaves += [(k, min(k + limit, b)) for k in range(a, b, limit)]
        else:
            cuts, sep, seek = [lo], separators[level], lo
            while (seek := text.find(sep, seek, hi)) >= 0:
                seek += len(sep)
                cuts.append(seek)
            cuts.append(hi)
            parts = [p for p in zip(cuts, cuts[1:]) if p[0] < p[1]]
            if len(parts) > 1:
                todo += [(x, y, level + 1) for x, y in reversed(parts)]
            else:
                todo.append((lo, hi, level + 1))
    merged: list[list[int]] = []
    for a, b in leaves:
        if merged and b - merged[-1][0] <= limit:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [(a, b - 1) for a, b in merged]


def recursive_chunks(docs: DataFrame, limit: int, separators: tuple[str, ...] = ("\n\n", "\n", " "), text_col: str = "text") -> DataFrame:
    """Recursive splitting by separators; offsets are token intervals, so edges are trimmed already."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    if not all(separators):
        raise ValueError("separators must not be empty")
    ship_package(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, k, a, b, b - a + 1) for d, t in zip(f["doc_id"], f["text"]) for k, (a, b) in enumerate(recursive_bounds(t or "", limit, separators))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "tok_lo", "tok_hi", "n_tokens"])

    return docs.select("doc_id", F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, chunk_idx int, tok_lo int, tok_hi int, n_tokens int")


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Count, least, upper median, mean (2 places) and greatest chunk size by ``by``."""
    sizes = chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.min("n_tokens").alias("tokens_min"), F.round(F.avg("n_tokens"), 2).alias("tokens_mean"), F.max("n_tokens").alias("tokens_max"))
    middle = order_statistics(chunks, list(by), "n_tokens", {"tokens_median": "n div 2"})
    both = sizes.join(middle, list(by)) if by else sizes.join(middle)  # without groups, one row each
    return both.select(*by, "n_chunks", "tokens_min", "tokens_median", "tokens_mean", "tokens_max")


def segmentation_stats(broken: DataFrame, limit: int, *by: str) -> DataFrame:
    """Documents, sentences, gaps between sentences of a document, breaks, and sentences over ``limit`` tokens, by ``by``.

    broken: the rows of semantic_breaks() with n_tokens; sums combine before the shuffle.
    """
    documents = broken.groupBy(*by, "doc_id").agg(F.count("*").alias("s"), F.count_if("breaks").alias("b"), F.count_if(F.col("n_tokens") > limit).alias("o"))
    return documents.groupBy(*by).agg(F.count("*").alias("n_documents"), F.sum("s").alias("n_sentences"), F.sum(F.col("s") - 1).alias("n_gaps"), F.sum("b").alias("n_breakpoints"), F.sum("o").alias("n_over_window"))
