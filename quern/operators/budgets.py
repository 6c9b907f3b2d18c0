"""Token budgets over a ranking, and span-level scores of what they take.

ranked: keys, qid, doc_id, chunk_idx, rank, tok_lo, tok_hi; gold: qid, alt_idx, lo, hi (token intervals, inclusive; the
alternatives of a question are choices, the intervals of an alternative are required together).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def take(rows: DataFrame, budgets: Sequence[int], rule: str = "stop", keys: Sequence[str] = ()) -> DataFrame:
    """Chunks that fit each budget in rank order: nothing after the first that does not fit.

    rule "truncate" also takes the tokens of that first one that still fit.  One window by question serves all budgets.
    """
    if rule not in ("stop", "truncate"):
        raise ValueError(f"unknown rule {rule!r}")
    order = Window.partitionBy(*keys, "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.col("tok_hi") - F.col("tok_lo") + 1
    rows = rows.withColumn("upto", F.sum(cost).over(order)).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    if rule == "stop":
        return rows.filter(F.col("upto") <= F.col("budget")).drop("upto")
    left = F.col("budget") - (F.col("upto") - cost)
    return rows.filter(left > 0).withColumn("tok_hi", F.least("tok_hi", (F.col("tok_lo") + left - 1).cast("int"))).drop("upto")


def exposure(rows: DataFrame, budgets: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, qid, budget, taken (ranks that fit), cut (whether the first that does not would be truncated)."""
    order = Window.partitionBy(*keys, "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.col("tok_hi") - F.col("tok_lo") + 1
    rows = rows.withColumn("upto", F.sum(cost).over(order)).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    over = (F.col("upto") > F.col("budget")) & (F.col("upto") - cost < F.col("budget"))
    return rows.groupBy(*keys, "qid", "budget").agg(F.count_if(F.col("upto") <= F.col("budget")).alias("taken"), F.bool_or(over).alias("cut"))


def _disjoint(rows: DataFrame, by: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Intervals cut so that those of one group do not overlap; the union stays the same."""
    before = Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max(hi).over(before)).withColumn(lo, F.greatest(F.col(lo), F.coalesce(F.col("_reach") + 1, F.col(lo)))).filter(F.col(lo) <= F.col(hi)).drop("_reach")


def span_scores(taken: DataFrame, gold: DataFrame, asked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, qid, budget, recall, precision, iou, chunks, tokens; asked(keys, qid, budget) names every row of the result.

    Each metric is the best over a question's alternatives; nothing taken scores 0; rounded to 6 places.
    """
    cell = [*keys, "qid", "budget"]
    size = taken.groupBy(*cell).agg(F.count("*").alias("chunks"), F.sum(F.col("tok_hi") - F.col("tok_lo") + 1).alias("tokens"))
    parts = _disjoint(taken.select(*cell, "tok_lo", "tok_hi"), cell, "tok_lo", "tok_hi")
    spans = _disjoint(gold.select("qid", "alt_idx", "lo", "hi"), ["qid", "alt_idx"], "lo", "hi")
    held = parts.groupBy(*cell).agg(F.sum(F.col("tok_hi") - F.col("tok_lo") + 1).alias("held"))
    wanted = spans.groupBy("qid", "alt_idx").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("wanted"))
    both = parts.join(spans, "qid").filter("tok_lo <= hi AND tok_hi >= lo")
    both = both.groupBy(*cell, "alt_idx").agg(F.sum(F.least("tok_hi", "hi") - F.greatest("tok_lo", "lo") + 1).alias("hit"))
    rows = asked.join(wanted, "qid").join(held, cell, "left").join(both, [*cell, "alt_idx"], "left").fillna(0, ["held", "hit"])
    best = rows.groupBy(*cell).agg(
        F.round(F.max(F.col("hit") / F.col("wanted")), 6).alias("recall"),
        F.round(F.max(F.when(F.col("held") > 0, F.col("hit") / F.col("held")).otherwise(0.0)), 6).alias("precision"),
        F.round(F.max(F.col("hit") / (F.col("held") + F.col("wanted") - F.col("hit"))), 6).alias("iou"),
    )
    return best.join(size, cell, "left").fillna(0, ["chunks", "tokens"])


def hit_at_k(ranked: DataFrame, gold: DataFrame, ks: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, qid, k, hit: whether one of the first k chunks overlaps any interval of any alternative."""
    top = ranked.filter(F.col("rank") <= max(ks))
    first = top.join(gold.select("qid", "lo", "hi"), "qid").filter("tok_lo <= hi AND tok_hi >= lo").groupBy(*keys, "qid").agg(F.min("rank").alias("first"))
    asked = ranked.select(*keys, "qid").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return asked.join(first, [*keys, "qid"], "left").select(*keys, "qid", "k", F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).alias("hit"))
