"""Report queries over the 64-token run held against the 256-token run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import budgets as B
from quern.operators import chunking as C
from quern.operators import judge as J
from quern.operators import reports as P
from quern.operators import retrieval as R
from quern.operators.order_stats import order_statistics
from quern.plans import bench
from quern.plans.catalog import SENTENCES, TOKENS, base, chunk_cte, query, scores_cte, taken_cte, tfidf_sql
from quern.plans.catalog_judge import rounded
from quern.plans.shared import free_shuffles, materialise


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, budget, a (recall at 64), b (recall at 256), d, corpus, gold (tokens)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    questions = materialise(bench.questions(docs), "questions")  # else their plan runs, and is held, wherever they are used
    scored = bench.scored_grid(docs.select("doc_id", "text"), [64, 256], asked=questions)
    # one pass over the scores: a run is a size, so the join on the question becomes a pivot
    pivot = scored.groupBy("qid", "budget").agg(*[F.max(F.when(F.col("size") == s, F.col("recall"))).alias(n) for n, s in (("a", 64), ("b", 256))])
    asked = questions.select("qid", (F.col("hi") - F.col("lo") + 1).alias("gold"))
    return pivot.withColumn("d", F.col("a") - F.col("b")).join(asked, "qid").join(docs.select(F.col("doc_id").alias("qid"), F.col("source").alias("corpus")), "qid")


RUNS = f"""{base([64, 256])}, {taken_cte(bench.BUDGETS)}, {scores_cte(bench.BUDGETS)},
de AS (SELECT x.qid, x.budget, x.recall AS a, y.recall AS b, x.recall - y.recall AS d, source AS corpus, hi - lo + 1 AS gold FROM sr x JOIN sr y ON x.qid = y.qid AND x.budget = y.budget AND x.size = 64 AND y.size = 256 JOIN qs ON qs.qid = x.qid JOIN documents dd ON dd.doc_id = x.qid)"""
_TERCILES = f"""{RUNS}, cu AS (SELECT list_sort(list(gold)) AS l, count(*) AS n FROM qs2), tc AS (SELECT de.*, CASE WHEN gold <= l[(n // 3 + 1)::INT] THEN 1 WHEN gold <= l[(2 * n // 3 + 1)::INT] THEN 2 ELSE 3 END AS tercile FROM de, cu)""".replace("FROM qs2", "FROM (SELECT hi - lo + 1 AS gold FROM qs)")


@query(f"{RUNS} SELECT budget, count(*) AS n, round(avg(a), 6) AS challenger, round(avg(b), 6) AS baseline, round(avg(d), 6) AS delta, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS wins FROM de GROUP BY budget")
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs(spark, sf_dir).groupBy("budget").agg(F.count("*").alias("n"), F.avg("a").alias("challenger"), F.avg("b").alias("baseline"), F.avg("d").alias("delta"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("wins")))


@query(f"{_TERCILES} SELECT tercile, budget, count(*) AS n, round(avg(d), 6) AS delta FROM tc GROUP BY ALL")
def gold_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.terciles(runs(spark, sf_dir), "gold", ["budget"]).groupBy("tercile", "budget").agg(F.count("*").alias("n"), F.avg("d").alias("delta")))


@query(f"""{RUNS}, g AS (SELECT budget, corpus, count(*) AS n, sum(d) AS s FROM de GROUP BY ALL), w AS (SELECT budget, sum(n) AS wn, sum(s) AS ws FROM g GROUP BY 1)
SELECT budget, 'none' AS dropped, wn::BIGINT AS n, round(ws / wn, 6) AS mean FROM w UNION ALL SELECT g.budget, corpus, (wn - n)::BIGINT, round((ws - s) / (wn - n), 6) FROM g JOIN w ON g.budget = w.budget""")
def corpus_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.jackknife(runs(spark, sf_dir), "corpus"))


@query(f"{RUNS}, x AS (SELECT *, CASE WHEN d <= -0.25 AND a = 0 THEN 'miss' WHEN d <= -0.25 THEN 'partial' WHEN d >= 0.25 THEN 'win' ELSE 'within' END AS stratum FROM de) SELECT budget, stratum, count(*) AS n, round(avg(d), 6) AS delta, round(avg(gold), 6) AS gold FROM x GROUP BY ALL")
def loss_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.loss_strata(runs(spark, sf_dir)).groupBy("budget", "stratum").agg(F.count("*").alias("n"), F.avg("d").alias("delta"), F.avg("gold").alias("gold")))


_STRATA = "CASE WHEN d <= -0.25 AND a = 0 THEN 'miss' WHEN d <= -0.25 THEN 'partial' WHEN d >= 0.25 THEN 'win' ELSE 'within' END AS stratum"


@query(f"""{RUNS}, x AS (SELECT *, {_STRATA} FROM de), by_corpus AS (SELECT budget, stratum, corpus, count(*) AS k FROM x GROUP BY ALL),
listed AS (SELECT budget, stratum, string_agg(corpus || ' ' || k, ', ' ORDER BY k DESC, corpus) AS corpora FROM by_corpus GROUP BY ALL)
SELECT budget, stratum, count(*) AS n, list_sort(list(gold))[(count(*) // 2 + 1)::INT] AS gold_median, 0.0::DOUBLE AS multi, round(avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_a, round(avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_b, corpora FROM x JOIN listed USING (budget, stratum) GROUP BY budget, stratum, corpora""")
def error_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the questions of each loss stratum have in common (each question here has one reference)."""
    hit = lambda c: F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    rows = P.loss_strata(runs(spark, sf_dir)).withColumns({"n_refs": F.lit(1), "hit_a": hit("a"), "hit_b": hit("b")})
    return rounded(P.characteristics(rows))


@query(f"""{base([64])} SELECT source AS corpus, count(*) AS n_questions, min(hi - lo + 1)::INT AS gold_min, list_sort(list(hi - lo + 1))[(count(*) // 2 + 1)::INT]::INT AS gold_median, max(hi - lo + 1)::INT AS gold_max, 1::INT AS refs_max FROM qs JOIN documents ON documents.doc_id = qs.qid GROUP BY source""")
def gold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold tokens and references of the questions of each corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = bench.questions(docs).select("qid", (F.col("hi") - F.col("lo") + 1).cast("int").alias("gold"))
    rows = asked.join(docs.select(F.col("doc_id").alias("qid"), F.col("source").alias("corpus")), "qid")
    whole = rows.groupBy("corpus").agg(F.count("*").alias("n_questions"), F.min("gold").alias("gold_min"), F.max("gold").alias("gold_max"), F.lit(1).alias("refs_max"))
    return whole.join(order_statistics(rows, ["corpus"], "gold", {"gold_median": "n div 2"}), "corpus")


@query(f"""{RUNS} SELECT budget, round(avg(d), 6) AS total, round(avg(CASE WHEN b = 0 THEN d ELSE 0 END), 6) AS missed, round(avg(CASE WHEN b > 0 AND b < 1 THEN d ELSE 0 END), 6) AS in_part, round(avg(CASE WHEN b >= 1 THEN d ELSE 0 END), 6) AS whole,
count(*) FILTER (b = 0) AS n_missed, count(*) FILTER (b > 0 AND b < 1) AS n_in_part, count(*) FILTER (b >= 1) AS n_whole FROM de GROUP BY budget""")
def overlap_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.decomposition(runs(spark, sf_dir)))


@query(f"""{_TERCILES}, z AS (SELECT * FROM tc WHERE budget = 400), c AS (SELECT corpus, tercile, count(*) AS n, sum(d) AS s FROM z GROUP BY ALL), w AS (SELECT tercile, sum(n) AS wn, sum(s) AS ws FROM c GROUP BY 1),
o AS (SELECT corpus, n, s, (ws - s) / nullif(wn - n, 0) AS other FROM c JOIN w USING (tercile))
SELECT corpus, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS observed, CASE WHEN count(*) = count(other) THEN round(sum(n * other) / sum(n), 6) END AS predicted, CASE WHEN count(*) = count(other) THEN round(sum(s) / sum(n) - sum(n * other) / sum(n), 6) END AS residual FROM o GROUP BY corpus""")
def composition_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.terciles(runs(spark, sf_dir).filter("budget = 400"), "gold")
    return rounded(P.composition(rows, "corpus"))


@query()
def composition_residual_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.terciles(runs(spark, sf_dir).filter("budget = 400"), "gold")
    return rounded(P.composition_interval(rows, "corpus"))


@query(f"{RUNS} SELECT qid, round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS d FROM de WHERE budget = 1600 ORDER BY round(d, 9), qid LIMIT 8")
def worst_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest losses: a top-k report."""
    rows = runs(spark, sf_dir).filter("budget = 1600")
    return rounded(rows.orderBy(F.round("d", 9), "qid").limit(8).select("qid", "a", "b", "d"))


@query(f"""{RUNS}, sa AS (SELECT seed, qid FROM (SELECT seed, qid, row_number() OVER (PARTITION BY seed, corpus ORDER BY md5(seed || ':' || corpus || ':' || qid), qid) AS n FROM (SELECT DISTINCT qid, corpus FROM de), (SELECT unnest([0, 1, 2]) AS seed)) WHERE n <= 20),
m AS (SELECT budget, seed, avg(d) AS m FROM de JOIN sa USING (qid) GROUP BY ALL) SELECT budget, round(min(m), 6) AS low, round(max(m), 6) AS high, round(max(m) - min(m), 6) AS range FROM m GROUP BY budget""")
def seeds_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    asked = rows.filter("budget = 200").select("qid", "corpus")
    drawn = [J.sample_per_group(asked, 20, "corpus", "qid", seed).select("qid", F.lit(seed).alias("seed")) for seed in (0, 1, 2)]
    means = rows.join(drawn[0].union(drawn[1]).union(drawn[2]), "qid").groupBy("budget", "seed").agg(F.avg("d").alias("m"))
    return rounded(means.groupBy("budget").agg(F.min("m").alias("low"), F.max("m").alias("high"), (F.max("m") - F.min("m")).alias("range")))


@query(f"""{base([256, 512])}, {taken_cte(bench.BUDGETS, 'truncate')}, {scores_cte(bench.BUDGETS)},
t2 AS (SELECT * FROM ({taken_cte(bench.BUDGETS)[7:-1]})), s2 AS (SELECT c.size, c.qid, c.budget, round(coalesce(sum(CASE WHEN chunk_idx IS NULL THEN 0 ELSE greatest(0, least(tok_hi, c.hi) - greatest(tok_lo, c.lo) + 1) END), 0) / any_value(c.hi - c.lo + 1), 6) AS recall FROM cells c LEFT JOIN t2 USING (size, qid, budget) GROUP BY ALL)
SELECT size, budget, round(avg(sr.recall), 6) AS truncate, round(avg(s2.recall), 6) AS stop, round(avg(sr.recall - s2.recall), 6) AS delta FROM sr JOIN s2 USING (size, qid, budget) GROUP BY ALL""")
def rule_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncating against stopping, one ranking for both."""
    docs = bench.documents(spark, sf_dir)
    asked = bench.questions(docs)
    order = bench.ranked_grid(docs, asked, [256, 512])
    cells = asked.select("qid", F.explode(F.array(F.lit(256), F.lit(512))).alias("size")).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in bench.BUDGETS])))
    by = {rule: B.span_scores(B.take(order, bench.BUDGETS, rule, ["size"]), asked, cells, ["size"]).select("size", "qid", "budget", F.col("recall").alias(rule)) for rule in ("truncate", "stop")}
    both = by["truncate"].join(by["stop"], ["size", "qid", "budget"])
    return rounded(both.groupBy("size", "budget").agg(F.avg("truncate").alias("truncate"), F.avg("stop").alias("stop"), F.avg(F.col("truncate") - F.col("stop")).alias("delta")))


def retriever_recall(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    """budget, the mean recall of BM25 on 128-token chunks, and what each other retriever adds to it."""
    docs = bench.documents(spark, sf_dir)
    # each retriever's recalls are written before the next begins, so its shuffles are gone by then
    asked, chunks = materialise(bench.questions(docs), "questions"), materialise(C.fixed_chunks(docs, 128), "chunks")
    free_shuffles(spark)
    cells = asked.select("qid", F.explode(F.array(*[F.lit(b) for b in bench.BUDGETS])).alias("budget"))
    out = None
    for name in ("bm25", *others):
        order = {"bm25": R.bm25, "tfidf": R.tfidf, "lsa": R.lsa}[name](docs, chunks, asked).join(chunks.select("doc_id", "chunk_idx", "tok_lo", "tok_hi"), ["doc_id", "chunk_idx"])
        scored = materialise(B.span_scores(B.take(order, bench.BUDGETS), asked, cells).select("qid", "budget", F.col("recall").alias(name)), f"recall-{name}")
        free_shuffles(spark)
        out = scored if out is None else out.join(scored, ["qid", "budget"])
    return rounded(out.groupBy("budget").agg(F.avg("bm25").alias("bm25"), *[F.avg(F.col(o) - F.col("bm25")).alias(f"{o}_delta") for o in others]))


@query()
def retriever_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF and latent semantics against BM25."""
    return retriever_recall(spark, sf_dir, "tfidf", "lsa")


_SCORED = f"{taken_cte(bench.BUDGETS)}, {scores_cte(bench.BUDGETS)} SELECT qid, budget, recall FROM sr"


@query(f"WITH x AS ({base([128])}, {_SCORED}), y AS ({tfidf_sql(128)}, {_SCORED}) SELECT budget, round(avg(x.recall), 6) AS bm25, round(avg(y.recall - x.recall), 6) AS tfidf_delta FROM x JOIN y USING (qid, budget) GROUP BY budget")
def tfidf_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF against BM25, the part of retriever_deltas that SQL expresses."""
    return retriever_recall(spark, sf_dir, "tfidf")


_LIMITS = [48, 64, 96, 128]


@query(f"""WITH RECURSIVE {TOKENS}, {SENTENCES}, {chunk_cte([64, 128])}, li AS (SELECT unnest({_LIMITS}) AS lim),
pk AS (SELECT lim, doc_id, sent_idx, n_tokens, 0 AS grp, n_tokens AS held FROM st, li WHERE sent_idx = 0 UNION ALL
  SELECT p.lim, s.doc_id, s.sent_idx, s.n_tokens, CASE WHEN p.held + s.n_tokens > p.lim THEN p.grp + 1 ELSE p.grp END, CASE WHEN p.held + s.n_tokens > p.lim THEN s.n_tokens ELSE p.held + s.n_tokens END FROM pk p JOIN st s ON s.doc_id = p.doc_id AND s.sent_idx = p.sent_idx + 1),
gr AS (SELECT lim, doc_id, grp, sum(n_tokens) AS n FROM pk GROUP BY ALL), ca AS (SELECT lim, round(sum(n) / sum((n + lim - 1) // lim), 2) AS mean FROM gr GROUP BY lim),
ta AS (SELECT size AS nominal, round(avg(tok_hi - tok_lo + 1), 2) AS tokens_mean FROM ch GROUP BY size)
SELECT nominal, tokens_mean, lim AS matched_size, mean AS matched_value, abs(mean - tokens_mean) / tokens_mean > 0.05 AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY nominal ORDER BY abs(mean - tokens_mean), lim) AS k FROM ta, ca) WHERE k = 1""")
def nearest_size_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows against the sentence packing whose realised mean is nearest."""
    docs = bench.documents(spark, sf_dir)
    targets = C.chunk_stats(bench.grid_chunks(docs, [64, 128]), "size").select(F.col("size").alias("nominal"), "tokens_mean")
    packed = [C.sentence_chunks(docs, n).agg(F.lit(n).alias("limit"), F.round(F.avg("n_tokens"), 2).alias("tokens_mean")) for n in _LIMITS]
    candidates = packed[0].union(packed[1]).union(packed[2]).union(packed[3])
    return P.nearest(targets, candidates, "tokens_mean", "limit")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'MISSING' WHEN doc_id % 11 = 5 THEN 'DRIFT' END AS status FROM documents WHERE doc_id % 7 = 3 OR doc_id % 11 = 5
UNION ALL SELECT -1 - doc_id, 'UNEXPECTED' FROM documents WHERE doc_id % 13 = 1""")
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of a table against itself with known changes: rows lost, altered and added by rule."""
    expected = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    found = expected.filter("doc_id % 7 <> 3").withColumn("n_chars", F.when(F.col("doc_id") % 11 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    added = expected.filter("doc_id % 13 = 1").withColumn("doc_id", -1 - F.col("doc_id"))
    return P.audit(expected, found.union(added), "doc_id")


@query()
def chunks_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed up to 128 tokens between breaks of a deterministic hashed encoder (no trained encoder is available offline)."""
    from quern.functions.text import sentences
    from quern.operators.encoders import hashed_sentences

    return C.semantic_chunks(hashed_sentences(sentences(bench.documents(spark, sf_dir))), 128)


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
d AS (SELECT label, vec_id, CASE WHEN p IS NOT NULL THEN 1 - list_dot_product(e, p) END AS d FROM e), l AS (SELECT *, quantile_cont(d, 0.95) OVER (PARTITION BY label) AS lim FROM d)
SELECT label::BIGINT AS doc_id, vec_id AS sent_idx, round(d, 6) AS distance, round(lim, 6) AS "limit", coalesce(d > lim, false) AS breaks FROM l""")
def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break points among the vectors of each label in order of id."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("sent_idx"), "embedding")
    return rounded(C.semantic_breaks(v).select("doc_id", "sent_idx", "distance", "limit", "breaks"))
