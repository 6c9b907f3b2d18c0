"""Ranking of a document's chunks for questions on that document: BM25, TF-IDF, latent semantics, dense vectors.

chunks: doc_id, chunk_idx, tok_lo, tok_hi and any config columns (``keys``); questions: qid, doc_id, query.  Corpus statistics
belong to one document and one config.  Scores are rounded to nine places before ranking, so that the order of a
sum never decides a tie; ties go to the smaller chunk_idx.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import WORD, terms, tokens
from quern.plans.shared import ship_package


#: Tokens of a stretch of a document, in which places and chunks meet.
STRETCH = 128


def query_terms(questions: DataFrame) -> DataFrame:
    """One row for each distinct term of a question: qid, doc_id, term, qtf."""
    return questions.select("qid", "doc_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("qid", "doc_id", "term").agg(F.count("*").alias("qtf"))


def document_terms(docs: DataFrame, text_col: str = "text", *more: str) -> DataFrame:
    """One row a word: doc_id, tok_idx (its place among all tokens), term, and more columns of docs."""
    listed = docs.select("doc_id", *more, F.posexplode(tokens(F.col(text_col))).alias("tok_idx", "token"))
    return listed.filter(F.col("token").rlike(f"^{WORD}$")).select("doc_id", "tok_idx", F.lower("token").alias("term"), *more)


def word_counts(docs: DataFrame, chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """chunks with dl, the words of each: those among its document's tokens from tok_lo to tok_hi."""
    # a character a token, as this meets every chunk
    flags = F.transform(tokens(F.col(text_col)), lambda t: F.when(t.rlike(f"^{WORD}$"), "1").otherwise("0"))
    flagged = docs.select("doc_id", F.array_join(flags, "").alias("_flags"))
    inside = F.substring(F.col("_flags"), F.col("tok_lo").cast("int") + 1, (F.col("tok_hi") - F.col("tok_lo") + 1).cast("int"))
    return chunks.join(flagged, "doc_id").withColumn("dl", F.length(F.replace(inside, F.lit("0"), F.lit("")))).drop("_flags")


def _matches(docs: DataFrame, chunks: DataFrame, asked: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """Term frequencies of asked terms only: keys, qid, doc_id, chunk_idx, term, tf."""
    # the terms go to the texts, so that no other word becomes a row that is shuffled
    wanted = asked.groupBy("doc_id").agg(F.collect_set("term").alias("_wanted"))
    words = document_terms(docs.join(wanted, "doc_id"), text_col, "_wanted").filter(F.array_contains("_wanted", F.col("term"))).drop("_wanted")
    hits = words.join(asked.select("qid", "doc_id", "term"), ["doc_id", "term"])
    # a hit meets only the chunks that reach into its stretch of the document, not all of them
    stretch = lambda c: F.expr(f"{c} div {STRETCH}")
    spans = chunks.select(*keys, "doc_id", "chunk_idx", "tok_lo", "tok_hi", F.explode(F.sequence(stretch("tok_lo"), stretch("tok_hi"))).alias("stretch"))
    met = hits.withColumn("stretch", stretch("tok_idx")).join(spans, ["doc_id", "stretch"]).filter("tok_idx BETWEEN tok_lo AND tok_hi")
    return met.groupBy(*keys, "qid", "doc_id", "chunk_idx", "term").agg(F.count("*").alias("tf"))


def ranked(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """scored(keys, qid, doc_id, chunk_idx, score) with rank from 1."""
    order = Window.partitionBy(*keys, "qid").orderBy(F.desc("score"), "chunk_idx")
    return scored.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order))


def _all_chunks(chunks: DataFrame, questions: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every chunk of a question's document, those without a score at 0."""
    pairs = questions.select("qid", "doc_id").join(chunks.select(*keys, "doc_id", "chunk_idx"), "doc_id")
    return pairs.join(scores, [*keys, "qid", "chunk_idx"], "left").select(*keys, "qid", "doc_id", "chunk_idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25(docs: DataFrame, chunks: DataFrame, questions: DataFrame, keys: Sequence[str] = (), k1: float = 1.5, b: float = 0.75, text_col: str = "text") -> DataFrame:
    """BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a question's repeated terms count once."""
    sized = word_counts(docs, chunks, text_col)
    corpus = sized.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = _matches(docs, chunks, query_terms(questions), keys, text_col)
    df = F.count("*").over(Window.partitionBy(*keys, "qid", "term"))
    rows = tf.withColumn("df", df).join(corpus, [*keys, "doc_id"]).join(sized.select(*keys, "doc_id", "chunk_idx", "dl"), [*keys, "doc_id", "chunk_idx"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    scores = rows.groupBy(*keys, "qid", "chunk_idx").agg(F.sum(part).alias("score"))
    return ranked(_all_chunks(chunks, questions, scores, keys), keys)


def _document_weights(texts: list[list[str]], codes: dict[str, int], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """Chunks, and the cells (row, col, w) of their L2-normalised TF-IDF with idf = ln((1 + N) / (1 + df)) + 1, 0 for other terms.

    spans: chunk, first and last token of each; codes number the words of the texts, other tokens are empty.
    """
    coded = [np.fromiter((codes.get(w, -1) for w in t), np.int64, len(t)) for t in texts]
    chunks, of = np.unique(np.array([c for c, _, _ in spans], np.int64), return_inverse=True)
    parts = [(r, t[lo : hi + 1]) for r, (_, lo, hi) in zip(of.tolist(), spans) for t in coded]
    col = np.concatenate([np.zeros(0, np.int64), *[p for _, p in parts]])
    row = np.repeat(np.array([r for r, _ in parts], np.int64), np.array([len(p) for _, p in parts], np.int64))
    width = max(len(codes), 1)
    cells, tf = np.unique(row[col >= 0] * width + col[col >= 0], return_counts=True)
    row, col = cells // width, cells % width
    df = np.bincount(col, minlength=width)
    idf = np.where(df > 0, np.log((1.0 + len(spans)) / (1.0 + df)) + 1.0, 0.0)
    raw = tf * idf[col]
    return chunks, row, col, raw / np.sqrt(np.bincount(row, raw * raw, len(chunks)))[row], idf


def _latent(row: np.ndarray, col: np.ndarray, w: np.ndarray, q: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have terms, and cosines (queries by rows) in the space of the leading singular vectors; none if degenerate."""
    rows, r = np.unique(row, return_inverse=True)
    cols, c = np.unique(col, return_inverse=True)
    rank = min(rank, len(rows) - 1, len(cols) - 1)
    if rank < 1:
        return rows[:0], np.zeros((len(q), 0))
    x = np.zeros((len(rows), len(cols)))
    x[r, c] = w
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    a, b = x @ vt[:rank].T, q[:, cols] @ vt[:rank].T
    lengths = np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None, :]
    return rows, np.where(lengths > 0, b @ a.T / np.where(lengths > 0, lengths, 1), 0.0)


def _document_scores(texts: list[list[str]], spans: list[tuple[int, int, int]], queries: list[tuple[int, list[str]]], rank: int | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(qid, chunk, score) of one document: the cosine of TF-IDF vectors or, with a rank, of latent semantics."""
    codes: dict[str, int] = {}
    for t in texts:
        for w in t:
            if w and w not in codes:
                codes[w] = len(codes)
    chunks, row, col, w, idf = _document_weights(texts, codes, spans)
    asked: dict[int, np.ndarray] = {}
    for qid, words in queries:
        q = asked.setdefault(qid, np.zeros(len(idf)))
        for word in words:
            if word in codes:
                q[codes[word]] += idf[codes[word]]
    asked = {qid: q / np.sqrt((q * q).sum()) for qid, q in asked.items() if q.any()}
    if not asked:
        return []
    if rank is not None:
        rows, scores = _latent(row, col, w, np.stack(list(asked.values())), rank)
        return [(np.full(len(rows), qid), chunks[rows], s) for qid, s in zip(asked, scores)]
    out = []
    for qid, q in asked.items():
        score = np.bincount(row, q[col] * w, len(chunks))
        some = np.flatnonzero(score)
        out.append((np.full(len(some), qid), chunks[some], score[some]))
    return out


def _vector_scores(docs: DataFrame, chunks: DataFrame, questions: DataFrame, keys: Sequence[str], text_col: str, rank: int | None) -> DataFrame:
    """keys, qid, chunk_idx, score.  A document's text, chunks and questions meet in one shuffle, and its terms never become rows."""
    ship_package(docs.sparkSession)
    keys, types = list(keys), dict(chunks.dtypes)
    lowered = F.transform(tokens(F.col(text_col)), lambda t: F.when(t.rlike(f"^{WORD}$"), F.lower(t)).otherwise(""))
    none = [F.lit(None).cast(types[k]).alias(k) for k in keys]
    nil = lambda kind, name: F.lit(0).cast(kind).alias(name)  # noqa: E731  (a null would make whole numbers doubles in pandas)
    texts = docs.select("doc_id", F.lit(0).alias("kind"), *none, nil("long", "at"), nil("int", "lo"), nil("int", "hi"), F.array_join(lowered, "\n").alias("words"))
    spans = chunks.select("doc_id", F.lit(1).alias("kind"), *keys, F.col("chunk_idx").cast("long").alias("at"), F.col("tok_lo").cast("int").alias("lo"), F.col("tok_hi").cast("int").alias("hi"), F.lit(None).cast("string").alias("words"))
    asked = questions.select("doc_id", F.lit(2).alias("kind"), *none, F.col("qid").cast("long").alias("at"), nil("int", "lo"), nil("int", "hi"), F.array_join(terms(F.col("query")), "\n").alias("words"))

    def solved(f: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        kind, at, words = f["kind"].to_numpy(), f["at"].to_numpy(), f["words"].to_numpy()
        lo, hi = f["lo"].to_numpy(), f["hi"].to_numpy()
        named = list(zip(*[f[k] for k in keys])) if keys else [()] * len(f)
        out: list[tuple] = []
        for x, y in zip(edges.tolist(), edges[1:].tolist()):
            split, queries, configs = [], [], {}
            for i in range(x, y):
                if kind[i] == 1:
                    configs.setdefault(named[i], []).append((int(at[i]), int(lo[i]), int(hi[i])))
                elif words[i] is not None:
                    if kind[i] == 0:
                        split.append(words[i].split("\n"))
                    else:
                        queries.append((int(at[i]), words[i].split("\n")))
            if split and queries:
                out += [(name, *found) for name, listed in configs.items() for found in _document_scores(split, listed, queries, rank)]
        columns = {k: [name[j] for name, q, _, _ in out for _ in range(len(q))] for j, k in enumerate(keys)}
        empty = np.zeros(0, np.int64)
        return pd.DataFrame({**columns, "qid": np.concatenate([empty, *[q for _, q, _, _ in out]]), "chunk_idx": np.concatenate([empty, *[c for _, _, c, _ in out]]), "score": np.concatenate([np.zeros(0), *[s for *_, s in out]])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            ids = f["doc_id"].to_numpy()
            starts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            if held and ids[0] == held[-1]["doc_id"].iloc[0] and not len(starts):
                held.append(f)  # the document goes on
                continue
            whole = pd.concat([*held, f], ignore_index=True)
            ids = whole["doc_id"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            yield solved(whole, edges)
            held = [whole.iloc[edges[-1] :]]
        if held:
            yield solved(pd.concat(held, ignore_index=True), np.array([0, sum(map(len, held))]))

    rows = texts.union(spans).union(asked).filter("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "kind")
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"qid {dict(questions.dtypes)['qid']}", f"chunk_idx {types['chunk_idx']}", "score double"])
    return rows.mapInPandas(run, schema)


def tfidf(docs: DataFrame, chunks: DataFrame, questions: DataFrame, keys: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """Cosine of TF-IDF vectors; a question's repeats count, terms its document lacks do not."""
    return ranked(_all_chunks(chunks, questions, _vector_scores(docs, chunks, questions, keys, text_col, None), keys), keys)


def lsa(docs: DataFrame, chunks: DataFrame, questions: DataFrame, rank: int = 64, text_col: str = "text") -> DataFrame:
    """Cosine in the space of the leading singular vectors of a document's TF-IDF matrix; 0 for degenerate documents."""
    return ranked(_all_chunks(chunks, questions, _vector_scores(docs, chunks, questions, (), text_col, rank), ()))


def dense(vectors: DataFrame, queries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cosine ranking of vectors(doc_id, chunk_idx, embedding) for queries(qid, doc_id, query_embedding)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = queries.join(vectors, "doc_id")
    lengths = F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("query_embedding", "query_embedding"))
    score = F.when(lengths > 0, dot("embedding", "query_embedding") / lengths).otherwise(0.0)
    return ranked(rows.select(*keys, "qid", "doc_id", "chunk_idx", score.alias("score")), keys)
