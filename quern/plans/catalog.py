"""Registered queries over the engine's evaluation operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import token_count, token_offsets as offsets, sentences
from quern.operators import budgets as B
from quern.operators import chunking as C
from quern.operators import retrieval as R
from quern.plans import bench

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its counterpart if SQL has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_S = r"\s\p{Z}\x0b\x1c-\x1f\x85"
_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_S}]"
_WORD = r"[\p{L}\p{N}_]+"
_END = rf"""([.!?]["'')\]]*[{_S}]+)([A-Z0-9"''(\[])"""

TOKENS = f"tk AS (SELECT doc_id, unnest(range(len(l)))::INT AS tok_idx, unnest(l) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS l FROM documents)), nt AS (SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}')) AS n FROM documents)"
SENTENCES = rf"""sp AS (SELECT doc_id, unnest(range(len(l))) AS pi, unnest(l) AS piece FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{_END}', '\1' || chr(1) || '\2', 'g'), '(\n+)', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)),
s0 AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pi) - length(regexp_replace(piece, '^[{_S}]+', '')) AS sent_start, regexp_replace(piece, '^[{_S}]+|[{_S}]+$', '', 'g') AS sentence FROM sp),
st AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS sent_idx, sent_start::INT AS sent_start, (sent_start + length(sentence))::INT AS sent_end, sentence, n_tokens::INT AS n_tokens, (sum(n_tokens) OVER w - n_tokens)::INT AS tok_lo
       FROM (SELECT *, len(regexp_extract_all(sentence, '{_TOKEN}')) AS n_tokens FROM s0 WHERE sentence <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY pi))"""
QUESTIONS = f"""qs AS (SELECT doc_id AS qid, doc_id, array_to_string(list_slice(regexp_extract_all(sentence, '{_WORD}'), 1, 8), ' ') AS query, tok_lo AS lo, tok_lo + n_tokens - 1 AS hi
       FROM st JOIN (SELECT doc_id, count(*) AS ns FROM st GROUP BY 1) USING (doc_id) WHERE sent_idx = (7 * doc_id) % ns)"""


def chunk_cte(sizes: list[int]) -> str:
    return f"ch AS (SELECT size, doc_id, k::INT AS chunk_idx, (k * size)::INT AS tok_lo, (least(k * size + size, n) - 1)::INT AS tok_hi FROM (SELECT *, unnest(range(((n + size - 1) // size)::BIGINT)) AS k FROM (SELECT doc_id, n, unnest({sizes}) AS size FROM nt)))"


BM25 = f"""wt AS (SELECT doc_id, tok_idx, lower(token) AS term FROM tk WHERE regexp_full_match(token, '{_WORD}')),
dl AS (SELECT size, ch.doc_id, chunk_idx, count(tok_idx) AS dl FROM ch LEFT JOIN wt ON ch.doc_id = wt.doc_id AND tok_idx BETWEEN tok_lo AND tok_hi GROUP BY ALL),
co AS (SELECT size, doc_id, count(*) AS n, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1.0 END AS avgdl FROM dl GROUP BY ALL),
qt AS (SELECT DISTINCT qid, doc_id, unnest(regexp_extract_all(lower(query), '{_WORD}')) AS term FROM qs),
tf AS (SELECT size, qid, qt.doc_id, (tok_idx // size)::INT AS chunk_idx, term, count(*) AS tf FROM qt JOIN wt USING (doc_id, term), (SELECT DISTINCT size FROM ch) GROUP BY ALL),
sc AS (SELECT size, qid, chunk_idx, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
       FROM (SELECT *, count(*) OVER (PARTITION BY size, qid, term) AS df FROM tf) JOIN co USING (size, doc_id) JOIN dl USING (size, doc_id, chunk_idx) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY size, qid ORDER BY score DESC, chunk_idx)::INT AS rank
       FROM (SELECT ch.size, qid, ch.doc_id, ch.chunk_idx, tok_lo, tok_hi, round(coalesce(score, 0), 9) AS score FROM qs JOIN ch USING (doc_id) LEFT JOIN sc USING (size, qid, chunk_idx)))"""


def base(sizes: list[int]) -> str:
    return f"WITH {TOKENS}, {SENTENCES}, {QUESTIONS}, {chunk_cte(sizes)}, {BM25}"


def taken_cte(budgets: list[int], rule: str = "stop") -> str:
    inner = f"SELECT *, unnest({budgets}) AS budget FROM (SELECT *, sum(tok_hi - tok_lo + 1) OVER (PARTITION BY size, qid ORDER BY rank) AS upto FROM rk)"
    if rule == "stop":
        return f"ta AS (SELECT * FROM ({inner}) WHERE upto <= budget)"
    return f"ta AS (SELECT * REPLACE (least(tok_hi, tok_lo + (budget - (upto - (tok_hi - tok_lo + 1))) - 1)::INT AS tok_hi) FROM ({inner}) WHERE budget > upto - (tok_hi - tok_lo + 1))"


def scores_cte(budgets: list[int]) -> str:
    return f"""cells AS (SELECT qid, lo, hi, size, budget FROM qs, (SELECT DISTINCT size FROM ch), (SELECT unnest({budgets}) AS budget)),
se AS (SELECT c.size, c.qid, c.budget, any_value(c.hi - c.lo + 1) AS wanted, count(chunk_idx) AS chunks, coalesce(sum(tok_hi - tok_lo + 1), 0)::BIGINT AS tokens, coalesce(sum(CASE WHEN chunk_idx IS NULL THEN 0 ELSE greatest(0, least(tok_hi, c.hi) - greatest(tok_lo, c.lo) + 1) END), 0) AS hit FROM cells c LEFT JOIN ta USING (size, qid, budget) GROUP BY ALL),
sr AS (SELECT size, qid, budget, round(hit / wanted, 6) AS recall, CASE WHEN tokens > 0 THEN round(hit / tokens, 6) ELSE 0.0 END AS "precision", round(hit / (tokens + wanted - hit), 6) AS iou, chunks, tokens FROM se)"""


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}'))::INT AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.documents(spark, sf_dir).select("doc_id", token_count(F.col("text")).alias("n_tokens"))


@query(rf"""WITH p AS (SELECT doc_id, unnest(range(len(l)))::INT AS tok_idx, unnest(l) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '[{_S}]*(?:{_TOKEN})') AS l FROM documents)),
q AS (SELECT doc_id, tok_idx, regexp_replace(piece, '^[{_S}]+', '') AS token, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY tok_idx)::INT AS tok_end FROM p)
SELECT doc_id, tok_idx, (tok_end - length(token))::INT AS tok_start, tok_end, token FROM q""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets(bench.documents(spark, sf_dir))


@query(f"WITH {SENTENCES} SELECT doc_id, sent_idx, sent_start, sent_end, n_tokens FROM st")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(bench.documents(spark, sf_dir)).select("doc_id", "sent_idx", "sent_start", "sent_end", "n_tokens")


@query(f"WITH {TOKENS}, {chunk_cte([64])} SELECT doc_id, chunk_idx, tok_lo, tok_hi, (tok_hi - tok_lo + 1)::INT AS n_tokens FROM ch")
def chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_chunks(bench.documents(spark, sf_dir), 64)


@query(f"WITH {TOKENS}, w AS (SELECT doc_id, n, unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= 128 THEN 1 ELSE (n - 128 + 95) // 96 + 1 END)) AS k FROM nt) SELECT doc_id, k::INT AS chunk_idx, (k * 96)::INT AS tok_lo, (least(k * 96 + 128, n) - 1)::INT AS tok_hi, (least(k * 96 + 128, n) - k * 96)::INT AS n_tokens FROM w")
def chunks_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_chunks(bench.documents(spark, sf_dir), 128, 32)


PACK = """pk AS (
  SELECT doc_id, sent_idx, n_tokens, tok_lo, 0 AS grp, n_tokens AS held FROM st WHERE sent_idx = 0
  UNION ALL
  SELECT s.doc_id, s.sent_idx, s.n_tokens, s.tok_lo, CASE WHEN p.held + s.n_tokens > {limit} THEN p.grp + 1 ELSE p.grp END, CASE WHEN p.held + s.n_tokens > {limit} THEN s.n_tokens ELSE p.held + s.n_tokens END
  FROM pk p JOIN st s ON s.doc_id = p.doc_id AND s.sent_idx = p.sent_idx + 1),
gr AS (SELECT doc_id, grp, min(tok_lo) AS lo, sum(n_tokens) AS n FROM pk GROUP BY ALL),
wi AS (SELECT doc_id, lo, n, unnest(range(((n + {limit} - 1) // {limit})::BIGINT)) AS k FROM gr)
"""


@query(f"WITH RECURSIVE {SENTENCES}, {PACK.format(limit=64)} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY lo + k * 64) - 1)::INT AS chunk_idx, (lo + k * 64)::INT AS tok_lo, (lo + least(k * 64 + 64, n) - 1)::INT AS tok_hi, (least(k * 64 + 64, n) - k * 64)::INT AS n_tokens FROM wi")
def chunks_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentence_chunks(bench.documents(spark, sf_dir), 64)


@query(f"""WITH RECURSIVE {TOKENS}, {SENTENCES}, se AS (SELECT doc_id, sent_idx, n_tokens, tok_lo AS b, tok_lo + n_tokens AS e FROM st),
nx AS (SELECT s.doc_id, s.sent_idx, s.b, s.e, s.n_tokens > 128 AS wide, count(t.sent_idx) AS j, max(t.e) AS upto FROM se s LEFT JOIN se t ON s.doc_id = t.doc_id AND t.e <= s.b + 128 GROUP BY ALL),
wk AS (SELECT doc_id, 0::BIGINT AS i FROM nx WHERE sent_idx = 0 UNION ALL SELECT wk.doc_id, CASE WHEN wide THEN i + 1 ELSE greatest(j - 2, i + 1) END FROM wk JOIN nx ON wk.doc_id = nx.doc_id AND wk.i = nx.sent_idx),
pc AS (SELECT doc_id, sent_idx, CASE WHEN wide THEN b + k * 128 ELSE b END AS lo, CASE WHEN wide THEN least(b + k * 128 + 128, e) ELSE upto END - 1 AS hi FROM (SELECT nx.*, unnest(range(CASE WHEN wide THEN (e - b + 127) // 128 ELSE 1 END::BIGINT)) AS k FROM wk JOIN nx ON wk.doc_id = nx.doc_id AND wk.i = nx.sent_idx))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, lo) - 1)::INT AS chunk_idx, lo::INT AS tok_lo, hi::INT AS tok_hi, (hi - lo + 1)::INT AS n_tokens FROM pc""")
def chunks_sentence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentence_chunks(bench.documents(spark, sf_dir), 128, overlap=2)


@query()
def chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recursive_chunks(bench.documents(spark, sf_dir), 128)


@query(f"WITH {TOKENS}, {chunk_cte(bench.SIZES)} SELECT size, count(*) AS n_chunks, min(tok_hi - tok_lo + 1)::INT AS tokens_min, list_sort(list(tok_hi - tok_lo + 1))[(count(*) // 2 + 1)::INT]::INT AS tokens_median, round(avg(tok_hi - tok_lo + 1), 2) AS tokens_mean, max(tok_hi - tok_lo + 1)::INT AS tokens_max FROM ch GROUP BY size")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_stats(bench.grid_chunks(bench.documents(spark, sf_dir)), "size")


@query(f"{base([64])} SELECT qid, chunk_idx, rank, round(score, 6) AS score FROM rk WHERE rank <= 10")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bench.documents(spark, sf_dir)
    out = R.bm25(docs, C.fixed_chunks(docs, 64), bench.questions(docs))
    return out.filter("rank <= 10").select("qid", "chunk_idx", "rank", F.round("score", 6).alias("score"))


def tfidf_sql(size: int) -> str:
    """Ranking rk by the cosine of TF-IDF vectors of windows of one size."""
    return f"""WITH {TOKENS}, {SENTENCES}, {QUESTIONS}, {chunk_cte([size])},
wt AS (SELECT doc_id, (tok_idx // {size})::INT AS chunk_idx, lower(token) AS term, count(*) AS tf FROM tk WHERE regexp_full_match(token, '{_WORD}') GROUP BY ALL),
nn AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY 1),
df AS (SELECT doc_id, term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM wt JOIN nn USING (doc_id) GROUP BY ALL),
ww AS (SELECT *, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id, chunk_idx)) AS w FROM wt JOIN df USING (doc_id, term)),
qq AS (SELECT qid, doc_id, unnest(regexp_extract_all(lower(query), '{_WORD}')) AS term FROM qs),
qw AS (SELECT *, q * idf / sqrt(sum((q * idf) * (q * idf)) OVER (PARTITION BY qid)) AS wq FROM (SELECT qid, doc_id, term, count(*) AS q FROM qq GROUP BY ALL) JOIN df USING (doc_id, term)),
sc AS (SELECT qid, chunk_idx, sum(wq * w) AS score FROM qw JOIN ww USING (doc_id, term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY size, qid ORDER BY score DESC, chunk_idx)::INT AS rank FROM (SELECT ch.size, qid, ch.doc_id, ch.chunk_idx, tok_lo, tok_hi, round(coalesce(score, 0), 9) AS score FROM qs JOIN ch USING (doc_id) LEFT JOIN sc USING (qid, chunk_idx)))"""


@query(f"{tfidf_sql(64)} SELECT qid, chunk_idx, rank, round(score, 6) AS score FROM rk WHERE rank <= 10")
def tfidf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bench.documents(spark, sf_dir)
    out = R.tfidf(docs, C.fixed_chunks(docs, 64), bench.questions(docs))
    return out.filter("rank <= 10").select("qid", "chunk_idx", "rank", F.round("score", 6).alias("score"))


@query()
def lsa_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bench.documents(spark, sf_dir)
    out = R.lsa(docs, C.fixed_chunks(docs, 64), bench.questions(docs))
    return out.filter("rank <= 10").select("qid", "chunk_idx", "rank", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS e, label AS doc_id FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT qid, vec_id AS chunk_idx, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS score FROM q JOIN embeddings ON label = doc_id)
SELECT qid, chunk_idx, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx)::INT AS rank FROM d) WHERE rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector against the vectors of its label, which stands for the document here."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = v.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_idx"), "embedding")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("doc_id"), F.col("embedding").alias("query_embedding"))
    return R.dense(vectors, asked).filter("rank <= 10").select("qid", "chunk_idx", "rank", F.round("score", 6).alias("score"))


def _ranked(spark: SparkSession, sf_dir: str, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    docs = bench.documents(spark, sf_dir)
    asked = bench.questions(docs)
    return bench.ranked_grid(docs, asked, sizes), asked


@query(f"{base([64])}, {taken_cte(bench.BUDGETS)} SELECT qid, budget, rank, chunk_idx, tok_lo, tok_hi FROM ta")
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.take(_ranked(spark, sf_dir, [64])[0], bench.BUDGETS, "stop", ["size"]).select("qid", "budget", "rank", "chunk_idx", "tok_lo", "tok_hi")


@query(f"{base([256])}, {taken_cte(bench.BUDGETS, 'truncate')} SELECT qid, budget, rank, chunk_idx, tok_lo, tok_hi FROM ta")
def budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.take(_ranked(spark, sf_dir, [256])[0], bench.BUDGETS, "truncate", ["size"]).select("qid", "budget", "rank", "chunk_idx", "tok_lo", "tok_hi")


@query(f'{base([64, 256])}, {taken_cte(bench.BUDGETS)}, {scores_cte(bench.BUDGETS)} SELECT size, qid, budget, recall, "precision", iou, chunks, tokens FROM sr')
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.scored_grid(bench.documents(spark, sf_dir), [64, 256])


@query(f"{base(bench.SIZES)}, f AS (SELECT size, qid, min(rank) AS first FROM rk JOIN qs USING (qid) WHERE tok_lo <= hi AND tok_hi >= lo GROUP BY ALL) SELECT size, k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM (SELECT DISTINCT size, qid FROM rk) LEFT JOIN f USING (size, qid), (SELECT unnest({bench.KS}) AS k) GROUP BY ALL")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bench.hits_grid(bench.documents(spark, sf_dir))
    return hits.groupBy("size", "k").agg(F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 6).alias("hit_rate"))


@query(f'{base(bench.SIZES)}, {taken_cte(bench.BUDGETS)}, {scores_cte(bench.BUDGETS)} SELECT size, budget, count(*) AS n_questions, round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(iou), 6) AS iou FROM sr GROUP BY ALL')
def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bench.scored_grid(bench.documents(spark, sf_dir))
    return scored.groupBy("size", "budget").agg(F.count("*").alias("n_questions"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall", "precision", "iou")])


@query(f"{base(bench.SIZES)}, {taken_cte(bench.BUDGETS)}, {scores_cte(bench.BUDGETS)} SELECT size, budget, round(avg(tokens) / budget, 6) AS utilization, round(avg(chunks), 6) AS mean_chunks FROM sr GROUP BY size, budget")
def budget_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bench.scored_grid(bench.documents(spark, sf_dir))
    return scored.groupBy("size", "budget").agg(F.round(F.avg("tokens") / F.col("budget"), 6).alias("utilization"), F.round(F.avg("chunks"), 6).alias("mean_chunks"))


from quern.plans import catalog_grid, catalog_judge, catalog_more, catalog_reports  # noqa: E402, F401  (they register theirs)
