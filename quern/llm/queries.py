"""The registered queries opN_<name> and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The vocabulary that op1 reads, one of the public files; never copied here.
VOCABULARY = "word_bpe_49k.json"


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text per document."""
    from quern.llm.bpe import bpe_encode

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe_encode(docs, vocabulary_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of sources with weights 5, 2, 1 takes from each document."""
    from quern.llm.mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir))


def _op8_oracle() -> str:
    from quern.llm.mixing import oracle

    return oracle()


ORACLES["op8_mix"] = _op8_oracle()


@_query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: candidates, secrets among them, the highest score, and a digest of the text with secrets masked."""
    from quern.llm.secrets import scan_secrets

    found = scan_secrets(_documents(spark, sf_dir).select("doc_id", "text", "source"), path_col="source")
    secret = F.filter("findings", lambda f: f["is_secret"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secret).cast("long").alias("n_secrets"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0)).alias("max_score"),
        F.transform(secret, lambda f: F.sha2(f["value"], 256)).alias("secrets_sha256"),
        F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"),
    )


@_query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and calibrated score per document, learnt from three quarters of the documents."""
    from quern.llm.langid import predict_language, train
    from quern.llm.text_arrays import crc32_mod

    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.filter(crc32_mod("doc_id", 4) != 2))
    out = predict_language(docs.select("doc_id", "text", (crc32_mod("doc_id", 4) == 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@_query
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.93 and their components per vector."""
    from quern.llm.vectors import near_vectors

    return near_vectors(_embeddings(spark, sf_dir).select("vec_id", "embedding", "label"))


@_query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and component of documents linked at a Jaccard similarity of 0.85 on four words."""
    from quern.llm.jaccard import jaccard_components

    return jaccard_components(_documents(spark, sf_dir).select("doc_id", "text"), words=4, num=85, den=100)


@_query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector against all others."""
    from quern.llm.topk import top_k

    return top_k(_embeddings(spark, sf_dir).select("vec_id", "embedding"))


ORACLES["op3_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@_query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeats of 100 bytes and more that each document loses, and a digest of what is left."""
    from quern.llm.repeats import remove_repeats

    cut = remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), length=100)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and Pitman-Yor log10 probabilities of every document, learnt from six sevenths of them."""
    from quern.llm.lm import score_documents
    from quern.llm.text_arrays import crc32_mod

    return score_documents(_documents(spark, sf_dir).select("doc_id", "text"), crc32_mod("doc_id", 7) == 2)


@_query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: paragraphs, those with a confirmed licence or an unknown one, and the families found."""
    from quern.llm.licences import UNKNOWN, scan_licences

    found = scan_licences(_documents(spark, sf_dir).select("doc_id", "text"))
    known = F.filter("licences", lambda p: p["family"] != UNKNOWN)
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size(known).cast("long").alias("n_licences"),
        (F.size("licences") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_sort(F.array_distinct(F.transform(known, lambda p: p["family"]))).alias("families"),
        F.coalesce(F.array_max(F.transform(known, lambda p: p["probability"])), F.lit(0.0)).alias("max_probability"),
    )


#: Brute force: all pairs of a label; reachability by repeated steps.
ORACLES["op5_near_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AS able FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE able),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON id = vec_id
"""

#: Brute force: overlaps counted over shared shingles; reachability by repeated steps.
ORACLES["op6_jaccard"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (na + nb - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN m ON id = doc_id
"""
