"""Rankings, budgets and span scores against hand-worked values."""

import pytest

from quern.operators import budgets as B
from quern.operators import retrieval as R
from quern.operators.chunking import fixed_chunks


@pytest.fixture(scope="module")
def corpus(spark):
    """Three chunks of one document: 'the cat sat', 'the dog', 'cat cat cat'."""
    docs = spark.createDataFrame([(0, "the cat sat the dog cat cat cat")], "doc_id long, text string")
    chunks = spark.createDataFrame([(0, 0, 0, 2), (0, 1, 3, 4), (0, 2, 5, 7)], "doc_id long, chunk_idx int, tok_lo int, tok_hi int")
    return docs, chunks


def asked(spark, *texts):
    return spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "qid long, doc_id long, query string")


def by_chunk(df, qid):
    return [r["score"] for r in df.filter(f"qid = {qid}").orderBy("chunk_idx").collect()]


def test_bm25_values(spark, corpus):
    out = R.bm25(*corpus, asked(spark, "cat", "the dog", "cat sat", "cat CAT cat"))
    want = [[0.4449738501734775, 0, 0.7596018250436132], [0.4449738501734775, 1.634741275783056, 0], [1.3735695926697864, 0, 0.7596018250436132]]
    for q, w in enumerate(want):
        assert by_chunk(out, q) == pytest.approx(w, abs=1e-8)
    assert by_chunk(out, 3) == by_chunk(out, 0)
    assert [r["chunk_idx"] for r in out.filter("qid = 2").orderBy("rank").collect()] == [0, 2, 1]


def test_tfidf_values(spark, corpus):
    out = R.tfidf(*corpus, asked(spark, "cat", "the dog", "cat sat", "unknown words"))
    want = [[0.5178561161676974, 0, 1], [0.31348342733583406, 1, 0], [0.8554677334345859, 0, 0.6053485081062916], [0, 0, 0]]
    for q, w in enumerate(want):
        assert by_chunk(out, q) == pytest.approx(w, abs=1e-8)


def test_lsa_ranks_like_its_parts_and_survives_degenerate_documents(spark, corpus):
    out = R.lsa(*corpus, asked(spark, "cat", "zzz"))
    assert by_chunk(out, 0)[2] > by_chunk(out, 0)[1] and by_chunk(out, 1) == [0, 0, 0]
    docs = spark.createDataFrame([(0, "single")], "doc_id long, text string")
    assert by_chunk(R.lsa(docs, fixed_chunks(docs, 4), asked(spark, "single")), 0) == [0]


def test_dense_ties_go_to_the_smaller_chunk(spark):
    v = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [2.0, 0.0]), (0, 2, [0.0, 0.0])], "doc_id long, chunk_idx int, embedding array<double>")
    q = spark.createDataFrame([(0, 0, [3.0, 0.0])], "qid long, doc_id long, query_embedding array<double>")
    assert [(r["chunk_idx"], r["score"]) for r in R.dense(v, q).orderBy("rank").collect()] == [(0, 1.0), (1, 1.0), (2, 0.0)]


def ranking(spark, *spans):
    return spark.createDataFrame([(0, 0, k, k + 1, a, b) for k, (a, b) in enumerate(spans)], "qid long, doc_id long, chunk_idx int, rank int, tok_lo int, tok_hi int")


@pytest.mark.parametrize("costs,budget,want", [((3, 3, 4), 7, 2), ((5, 5, 1), 6, 1), ((8,), 7, 0)])
def test_stop_rule(spark, costs, budget, want):
    spans = [(10 * k, 10 * k + c - 1) for k, c in enumerate(costs)]
    assert B.take(ranking(spark, *spans), [budget]).count() == want


def test_truncate_rule(spark):
    got = B.take(ranking(spark, (0, 2), (3, 9)), [5], "truncate").orderBy("rank").collect()
    assert [(r["tok_lo"], r["tok_hi"]) for r in got] == [(0, 2), (3, 4)]
    with pytest.raises(ValueError):
        B.take(ranking(spark, (0, 2)), [5], "other")


def scores(spark, taken, gold, budget=100):
    cells = spark.createDataFrame([(0, budget)], "qid long, budget int")
    spans = spark.createDataFrame([(0, *g) for g in gold], "qid long, alt_idx int, lo int, hi int")
    r = B.span_scores(B.take(ranking(spark, *taken), [budget]), spans, cells).first()
    return r["recall"], r["precision"], r["iou"], r["chunks"], r["tokens"]


def test_span_scores_by_hand(spark):
    assert scores(spark, [(0, 4)], [(0, 3, 6)])[:3] == (0.5, 0.4, round(2 / 7, 6))
    # each metric takes its best alternative on its own
    assert scores(spark, [(0, 3)], [(0, 0, 1), (1, 0, 7)])[:3] == (1.0, 1.0, 0.5)
    # spans of one alternative are required together
    assert scores(spark, [(0, 3)], [(0, 0, 1), (0, 8, 9)])[0] == 0.5
    # overlapping chunks count a token once
    assert scores(spark, [(0, 3), (2, 5)], [(0, 0, 5)])[:3] == (1.0, 1.0, 1.0)
    assert scores(spark, [(0, 9)], [(0, 0, 1)], budget=5) == (0.0, 0.0, 0.0, 0, 0)


def test_hit_at_k(spark):
    gold = spark.createDataFrame([(0, 0, 4, 5), (0, 1, 100, 101)], "qid long, alt_idx int, lo int, hi int")
    got = {r["k"]: r["hit"] for r in B.hit_at_k(ranking(spark, (0, 3), (4, 9)), gold, [1, 2]).collect()}
    assert got == {1: False, 2: True}


def test_vectors_of_terms_never_become_rows(spark, corpus):
    big = spark.createDataFrame([((1 << 53) + 1, 0, "cat sat")], "qid long, doc_id long, query string")
    for rank in (R.tfidf, R.lsa):
        plan = rank(*corpus, big)._jdf.queryExecution().executedPlan().toString()
        assert "explode" not in plan
    assert {r["qid"] for r in R.tfidf(*corpus, big).collect()} == {(1 << 53) + 1}
