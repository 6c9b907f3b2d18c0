"""Chunkers, tokenizers, retrievers and datasets by name, as a grid of configurations names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.operators import retrieval as R
from quern.operators.encoders import hashed_sentences
from quern.sources import datasets as D

#: name -> (docs, size, overlap) -> chunks.
CHUNKERS: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "fixed": C.fixed_chunks,
    "sentence": C.sentence_chunks,
    "recursive": lambda docs, size, overlap: C.recursive_chunks(docs, size),
    "semantic": lambda docs, size, overlap: C.semantic_chunks(hashed_sentences(T.sentences(docs)), size),
}
#: name -> docs -> doc_id, tok_idx, tok_start, tok_end.
TOKENIZERS: dict[str, Callable[..., DataFrame]] = {"regex": lambda docs, vocabulary=None: T.token_offsets(docs).select("doc_id", "tok_idx", "tok_start", "tok_end")}
#: name -> (docs, chunks, questions, keys) -> ranking.
RETRIEVERS: dict[str, Callable[..., DataFrame]] = {"bm25": R.bm25, "tfidf": R.tfidf, "lsa": lambda docs, chunks, questions, keys=(): R.lsa(docs, chunks, questions)}
DATASETS: dict[str, Callable] = {"squad": D.load_squad, "reference": D.load_reference_corpora, "preference": D.load_preferences}


def _bpe(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    from quern.functions.bpe_spans import subword_offsets

    if not vocabulary:
        raise ValueError("the bpe tokenizer needs the path of a vocabulary")
    return subword_offsets(docs, vocabulary).select("doc_id", "tok_idx", "tok_start", "tok_end")


TOKENIZERS["bpe"] = _bpe


def _named(kind: str, table: dict, name: str):
    if name not in table:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(table))}")
    return table[name]


def make_chunker(name: str, size: int, overlap: int = 0) -> Callable[[DataFrame], DataFrame]:
    """docs(doc_id, text) -> chunks; recursive and semantic chunkers have no overlap."""
    make = _named("chunker", CHUNKERS, name)
    if overlap and name in ("recursive", "semantic"):
        raise ValueError(f"{name} chunks do not overlap")
    return lambda docs: make(docs, size, overlap)


def make_tokenizer(name: str, vocabulary: str | None = None) -> Callable[[DataFrame], DataFrame]:
    make = _named("tokenizer", TOKENIZERS, name)
    return lambda docs: make(docs, vocabulary)


def make_retriever(name: str) -> Callable[..., DataFrame]:
    return _named("retriever", RETRIEVERS, name)


def load_dataset(spark: SparkSession, name: str, path: str, **more):
    return _named("dataset", DATASETS, name)(spark, path, **more)


def grid(docs: DataFrame, questions: DataFrame, chunkers: list[tuple[str, int, int]], retrievers: list[str]) -> DataFrame:
    """chunker, chunk_size, overlap, retriever, qid, doc_id, chunk_idx, rank, tok_lo, tok_hi: a ranking for every configuration.

    Lexical retrievers rank all chunkers' chunks in one plan, keyed by configuration.
    """
    keys, made = ["chunker", "chunk_size", "overlap"], None
    for name, size, overlap in chunkers:
        chunks = make_chunker(name, size, overlap)(docs).select(F.lit(name).alias("chunker"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"), "doc_id", "chunk_idx", "tok_lo", "tok_hi")
        made = chunks if made is None else made.union(chunks)
    out = None
    for name in retrievers:
        if name == "lsa":
            parts = [R.lsa(docs, made.filter((F.col("chunker") == c) & (F.col("chunk_size") == s) & (F.col("overlap") == o)), questions).select(F.lit(c).alias("chunker"), F.lit(s).alias("chunk_size"), F.lit(o).alias("overlap"), "qid", "doc_id", "chunk_idx", "rank") for c, s, o in chunkers]
            order = parts[0]
            for p in parts[1:]:
                order = order.union(p)
        else:
            order = make_retriever(name)(docs, made, questions, keys).select(*keys, "qid", "doc_id", "chunk_idx", "rank")
        order = order.join(made, [*keys, "doc_id", "chunk_idx"]).select(*keys, F.lit(name).alias("retriever"), "qid", "doc_id", "chunk_idx", "rank", "tok_lo", "tok_hi")
        out = order if out is None else out.union(order)
    return out
