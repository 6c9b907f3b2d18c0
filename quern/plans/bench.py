"""How the evaluation's relations are bound to the tables at hand.

Every document asks one question: its sentence number (7 * doc_id) modulo its sentences is the gold span, and that
sentence's first eight words are the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import WORD, sentences, token_count
from quern.operators.budgets import hit_at_k, span_scores, take
from quern.operators.chunking import fixed_chunk_grid
from quern.operators.retrieval import bm25

SIZES = [64, 128, 256, 512]
BUDGETS = [200, 400, 800, 1600]
KS = [1, 5, 10]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def questions(docs: DataFrame) -> DataFrame:
    """qid, doc_id, query, alt_idx, lo, hi."""
    rows = sentences(docs).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    chosen = rows.filter(F.col("sent_idx") == (7 * F.col("doc_id")) % F.col("n"))
    words = F.slice(F.regexp_extract_all("sentence", F.lit(WORD), F.lit(0)), 1, 8)
    return chosen.select(F.col("doc_id").alias("qid"), "doc_id", F.array_join(words, " ").alias("query"), F.lit(0).alias("alt_idx"), F.col("tok_lo").alias("lo"), (F.col("tok_lo") + F.col("n_tokens") - 1).alias("hi"))


def grid_chunks(docs: DataFrame, sizes: list[int] = SIZES) -> DataFrame:
    return fixed_chunk_grid(docs.select("doc_id", token_count(F.col("text")).alias("n")), sizes)


def ranked_grid(docs: DataFrame, asked: DataFrame, sizes: list[int] = SIZES) -> DataFrame:
    """BM25 ranking of all sizes, with the chunks' token intervals."""
    chunks = grid_chunks(docs, sizes)
    order = bm25(docs, chunks, asked, ["size"])
    return order.join(chunks.select("size", "doc_id", "chunk_idx", "tok_lo", "tok_hi"), ["size", "doc_id", "chunk_idx"])


def scored_grid(docs: DataFrame, sizes: list[int] = SIZES, budgets: list[int] = BUDGETS, rule: str = "stop", asked: DataFrame | None = None) -> DataFrame:
    """size, qid, budget, recall, precision, iou, chunks, tokens.  asked: the questions, where they are at hand."""
    asked = questions(docs) if asked is None else asked
    order = ranked_grid(docs, asked, sizes)
    cells = asked.select("qid", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    return span_scores(take(order, budgets, rule, ["size"]), asked, cells, ["size"])


def hits_grid(docs: DataFrame, sizes: list[int] = SIZES, ks: list[int] = KS) -> DataFrame:
    asked = questions(docs)
    return hit_at_k(ranked_grid(docs, asked, sizes), asked, ks, ["size"])
