"""Loaders, stores, reports and the stream."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions.text import token_offsets
from quern.operators import reports as P
from quern.sources import datasets as D
from quern.sources import results as R


def squad(tmp_path, start=4):
    answer = {"answer_start": start, "text": "two"}
    data = {"data": [{"title": "T", "paragraphs": [{"context": "one two three", "qas": [{"id": "q1", "question": " which? ", "answers": [answer, answer, {"answer_start": 0, "text": "one"}]}, {"id": "q2", "question": "which?", "answers": [answer]}, {"id": "q3", "question": "none?", "is_impossible": True, "answers": []}]}, {"context": "four five", "qas": [{"id": "q4", "question": "second?", "answers": [{"answer_start": 5, "text": "five"}]}]}]}]}
    path = tmp_path / "squad.json"
    path.write_text(json.dumps(data))
    return str(path)


def test_squad(spark, tmp_path):
    docs, asked, gold = D.load_squad(spark, squad(tmp_path))
    text = docs.first()["text"]
    assert text == "one two three\n\nfour five"
    assert {r["qid"]: r["query"] for r in asked.collect()} == {"q1": "which?", "q4": "second?"}
    got = sorted((r["qid"], r["alt_idx"], text[r["start"] : r["end"]]) for r in gold.collect())
    assert got == [("q1", 0, "two"), ("q1", 1, "one"), ("q4", 0, "five")]
    spans = {(r["qid"], r["alt_idx"]): (r["lo"], r["hi"]) for r in D.gold_tokens(gold, token_offsets(docs), asked).collect()}
    assert spans == {("q1", 0): (1, 1), ("q1", 1): (0, 0), ("q4", 0): (4, 4)}
    with pytest.raises(PySparkException):
        D.load_squad(spark, squad(tmp_path, start=5))[2].collect()


def test_reference_corpora(spark, tmp_path):
    (tmp_path / "alpha.md").write_text("first line\nsecond, line")
    refs = json.dumps([{"content": "first", "start_index": 0, "end_index": 5}, {"content": "second, line", "start_index": 11, "end_index": 23}])
    quoted = refs.replace('"', '""')
    (tmp_path / "questions_df.csv").write_text(f'question,references,corpus_id\n"What, now?","{quoted}",alpha\nAgain,"{quoted}",alpha\n')
    docs, asked, gold = D.load_reference_corpora(spark, str(tmp_path))
    assert sorted(r["qid"] for r in asked.collect()) == ["alpha:001", "alpha:002"]
    assert sorted((r["alt_idx"], r["span_idx"]) for r in gold.filter("qid = 'alpha:001'").collect()) == [(0, 0), (0, 1)]
    (tmp_path / "questions_df.csv").write_text(f'question,references,corpus_id\nx,"{quoted}",beta\n')
    with pytest.raises(PySparkException):
        D.load_reference_corpora(spark, str(tmp_path))[1].collect()


def test_preferences(spark, tmp_path):
    path = f"{tmp_path}/p"
    spark.createDataFrame([("1", "s", "p", "a", "b", "m", "n"), ("2", "s", "p", "c", "d", "m", "n")], "id string, subset string, prompt string, chosen string, rejected string, chosen_model string, rejected_model string").write.parquet(path)
    rows = D.load_preferences(spark, path, {"s": 2}, {"s": "Chat"})
    assert {r["item_id"] for r in rows.collect()} == {"s/1", "s/2"} and rows.first()["category"] == "Chat"
    for bad in (({"s": 3}, None), ({"s": 2}, {"t": "Chat"})):
        with pytest.raises(ValueError):
            D.load_preferences(spark, path, *bad)


def test_hashes(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert D.file_hashes(spark, str(tmp_path)).first()["sha256"] == digest
    D.verify_hash(spark, f"{tmp_path}/f.bin", digest)
    with pytest.raises(ValueError):
        D.verify_hash(spark, f"{tmp_path}/f.bin", "0")


def test_result_store(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    config = {"dataset": "d", "retriever": "bm25", "chunker": "fixed", "chunk_size": 64}
    scores = spark.createDataFrame([("q", 200, 0.5)], "qid string, budget int, recall double")
    assert R.save_run(scores, path, config) and not R.save_run(scores, path, config) and R.save_run(scores, path, config, force=True)
    assert R.save_run(scores, path, {**config, "tokenizer": "bpe", "chunker": "sentence"})
    assert R.load_runs(spark, path).count() == 1 and R.load_runs(spark, path, tokenizer=None).count() == 2
    assert R.load_runs(spark, path, chunk_size=[128]).count() == 0
    assert R.label({**config, "overlap": 32, "budget_rule": "truncate"}) == "fixed-64/o32/truncate"
    assert [r["chunker"] for r in R.load_runs(spark, path, tokenizer=None).orderBy(*R.presentation_order()).collect()] == ["fixed", "sentence"]
    assert set(R.run_metadata()) == {"commit", "pyspark", "started_utc"}


def test_judgment_store_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    rows = spark.createDataFrame([("m", "r", "o", "i", "A", 1.0, -0.1, -2.0, 1.0, "A", True, 5, 0.1)], R.JUDGMENT)
    R.append_judgments(rows, path)
    R.append_judgments(rows.union(rows.withColumn("item_id", F.lit("j"))), path)
    assert sorted(r["item_id"] for r in R.load_judgments(spark, [path]).collect()) == ["i", "j"]
    R.write_sidecar(spark, f"file://{tmp_path}/meta", {"b": 1, "a": 2})
    assert spark.read.text(f"file://{tmp_path}/meta").first()["value"] == '{"a": 2, "b": 1}'


def test_log_digest(spark):
    log = spark.createDataFrame([("intro\n## 2026-01-01 — Day one\n**First lead** and **second**\n## 2026-01-02\nnothing",)], "value string")
    rows = [(r["day"], r["lead"]) for r in R.log_digest(log).filter("day LIKE '2026%'").collect()]
    assert rows == [("2026-01-01 — Day one", "First lead"), ("2026-01-01 — Day one", "second"), ("2026-01-02", None)]


RUN = "qid long, budget int, recall double"


def test_deltas_need_the_same_questions(spark):
    a = spark.createDataFrame([(1, 200, 1.0), (2, 200, 0.0)], RUN)
    b = spark.createDataFrame([(1, 200, 0.25), (2, 200, 0.5)], RUN)
    assert sorted(r["d"] for r in P.deltas(a, b).collect()) == [-0.5, 0.75]
    with pytest.raises(PySparkException):
        P.deltas(a, b.filter("qid = 1")).collect()


def rows(spark):
    data = [(k, 200, k % 3 / 2, (k * 7) % 4 / 3, "xyz"[k % 3], k + 1) for k in range(30)]
    return spark.createDataFrame(data, "qid long, budget int, a double, b double, corpus string, gold int").withColumn("d", F.col("a") - F.col("b"))


def test_parts_sum_to_the_whole(spark):
    r = P.decomposition(rows(spark)).first()
    assert r["missed"] + r["in_part"] + r["whole"] == pytest.approx(r["total"]) and r["n_missed"] + r["n_in_part"] + r["n_whole"] == 30
    assert {x["stratum"] for x in P.loss_strata(rows(spark)).select("stratum").distinct().collect()} <= {"miss", "partial", "within", "win"}


def test_terciles_are_order_statistics(spark):
    got = P.terciles(rows(spark), "gold").groupBy("tercile").count().orderBy("tercile").collect()
    assert [r["count"] for r in got] == [11, 10, 9]


def test_jackknife(spark):
    data = [(r["corpus"], r["d"]) for r in rows(spark).collect()]
    for r in P.jackknife(rows(spark), "corpus").collect():
        left = [d for c, d in data if c != r["dropped"]]
        assert (r["n"], r["mean"]) == (len(left), pytest.approx(sum(left) / len(left)))


def test_composition(spark):
    same = rows(spark).withColumn("d", F.lit(0.5)).withColumn("tercile", F.lit(1))
    assert all(r["residual"] == pytest.approx(0) for r in P.composition(same, "corpus").collect())
    alone = same.withColumn("tercile", F.when(F.col("corpus") == "x", 2).otherwise(1))
    assert {r["corpus"]: r["predicted"] is None for r in P.composition(alone, "corpus").collect()} == {"x": True, "y": False, "z": False}
    ci = {r["corpus"]: r for r in P.composition_interval(same, "corpus", replicates=50).collect()}
    assert set(ci) == set("xyz") and ci["x"]["lo"] == ci["x"]["hi"] == pytest.approx(0)


def test_nearest_and_audit_and_markdown(spark):
    t = spark.createDataFrame([("s", 50.0)], "name string, mean double")
    c = spark.createDataFrame([(64, 45.0), (48, 55.0), (96, 90.0)], "size int, mean double")
    r = P.nearest(t, c, "mean", "size").first()
    assert (r["matched_size"], r["flagged"]) == (48, True)
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    f = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    assert {r["k"]: r["status"] for r in P.audit(e, f, "k").collect()} == {2: "DRIFT", 3: "MISSING", 4: "UNEXPECTED"}
    assert P.markdown(e.orderBy("k")).splitlines()[2] == "| 1 | a |"
    with pytest.raises(ValueError):
        P.markdown(e, limit=2)


def test_stream_of_pairs(spark, tmp_path):
    from quern.streaming.swap_pairs import stream_swap_pairs

    schema = "model string, rubric string, `order` string, item_id string, z double, mass_ab double, compliant boolean, ts timestamp"
    src = f"{tmp_path}/in"
    batch = [("m", "r", "chosen_first", "i", 3.0, 0.9, True, "2026-01-01 00:00:00"), ("m", "r", "chosen_first", "i", 3.0, 0.9, True, "2026-01-01 00:01:00"), ("m", "r", "rejected_first", "i", 1.0, 0.8, True, "2026-01-01 00:10:00"), ("m", "r", "chosen_first", "j", 1.0, 0.8, True, "2026-01-01 00:10:00")]
    spark.createDataFrame([(*x[:-1], x[-1]) for x in batch], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = stream_swap_pairs(spark.readStream.schema(schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("pairs_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("pairs_out").collect()
    assert [(r["item_id"], r["s"], r["b"], r["mass_min"]) for r in got] == [("i", 1.0, 2.0, 0.8)]


def test_order_statistics_are_those_of_the_sorted_values(spark):
    from quern.operators.order_stats import order_statistics

    rows = [("a", v) for v in (5, 1, 1, 9, 2, 2, 2)] + [("b", 7), ("b", None), ("c", None)]
    got = {r["g"]: (r["low"], r["mid"], r["high"]) for r in order_statistics(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", {"low": "0", "mid": "n div 2", "high": "9 * n div 10"}).collect()}
    assert got == {"a": (1, 2, 9), "b": (7, 7, 7)}


def test_summaries_beside_their_sidecar(spark, tmp_path):
    R.save_summary(spark.createDataFrame([(2, 0.5), (1, 0.25)], "budget int, recall double"), f"file://{tmp_path}/s", {"a": 1})
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/s").collect()] == ['{"budget":1,"recall":0.25}', '{"budget":2,"recall":0.5}']
    assert spark.read.text(f"file://{tmp_path}/s.meta").first()["value"] == '{"a": 1}'
    assert R.repository_state(str(tmp_path)) == "unknown" and R.run_metadata(judge="m")["judge"] == "m"


def test_registry(spark):
    from quern import registry
    from quern.plans import bench

    docs = spark.createDataFrame([(1, "One two three. Four five six seven. Eight nine."), (2, ""), (3, "Alpha beta.")], "doc_id long, text string")
    for name in registry.CHUNKERS:
        chunks = registry.make_chunker(name, 4)(docs).collect()
        assert {c["doc_id"] for c in chunks} == {1, 3} and all(c["n_tokens"] == c["tok_hi"] - c["tok_lo"] + 1 <= 4 for c in chunks), name
    assert registry.make_tokenizer("regex")(docs).count() == 15
    for kind, name in ((registry.make_chunker, "x"), (registry.make_tokenizer, "x"), (registry.make_retriever, "x")):
        with pytest.raises(ValueError, match="unknown"):
            kind(name, 4) if kind is registry.make_chunker else kind(name)
    with pytest.raises(ValueError):
        registry.make_chunker("recursive", 8, 2)
    with pytest.raises(ValueError, match="vocabulary"):
        registry.make_tokenizer("bpe")(docs)
    rows = registry.grid(docs, bench.questions(docs), [("fixed", 4, 0), ("sentence", 6, 0)], list(registry.RETRIEVERS)).collect()
    assert {(r["chunker"], r["retriever"]) for r in rows} == {(c, r) for c in ("fixed", "sentence") for r in registry.RETRIEVERS}
    assert all(r["rank"] >= 1 for r in rows) and {r["qid"] for r in rows} == {1, 3}


def test_characteristics(spark):
    rows = [(400, "win", g, k, float(h), 1.0, c) for g, k, h, c in [(3, 1, 1, "b"), (9, 2, 0, "a"), (5, 1, 1, "b"), (7, 3, 0, "c")]] + [(400, "miss", 4, 1, 0.0, 1.0, "a")]
    found = P.characteristics(spark.createDataFrame(rows, "budget int, stratum string, gold int, n_refs int, hit_a double, hit_b double, corpus string")).toPandas().set_index("stratum")
    assert found.loc["win", ["n", "gold_median", "multi", "hit_a", "hit_b", "corpora"]].to_list() == [4, 7, 0.5, 0.5, 1.0, "b 2, a 1, c 1"]
    assert found.loc["miss", ["n", "gold_median", "multi", "corpora"]].to_list() == [1, 4, 0.0, "a 1"]
