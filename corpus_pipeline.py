"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of ``documents``.  Between stages the rows are written as Parquet into the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import bpe_encode
from quern.llm.jaccard import jaccard_groups
from quern.llm.langid import UND, predict_language, train
from quern.llm.mixing import mix_sources
from quern.llm.queries import vocabulary_path
from quern.llm.secrets import scan_secrets
from quern.plans.shared import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose best language is less likely than this is rejected, as is one without letters.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language stay; a missing ``lang`` is filled with the predicted one."""
    model = train(docs)
    seen = predict_language(docs.select(*COLUMNS), model, lang_col="_pred", score_col="_score")
    kept = seen.filter((F.col("_pred") != UND) & (F.col("_score") >= LEAST_SCORE)) if model.languages else seen
    return kept.withColumn("lang", F.coalesce("lang", "_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 on five words stays: the one of the smallest id.

    Rows that share an id are compared by their texts like any others; a row without an id stays only where its group
    has no id; equal rows count as one.  Documents without words link with nothing and all stay.
    """
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("_mark"))
    groups = jaccard_groups(marked, words=5, num=80, den=100, mark_col="_mark")
    # ids with the hash of their text name the rows; without an id, the hash alone
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    first = groups.filter("group IS NOT NULL").groupBy("group").agg(F.min(name).alias("first")).select("first.doc_id", F.col("first.mark").alias("_mark"))
    wordless = groups.filter("group IS NULL").select("doc_id", F.col("mark").alias("_mark")).distinct()
    kept = marked.join(first.distinct(), marked["doc_id"].eqNullSafe(first["doc_id"]) & (marked["_mark"] == first["_mark"]), "left_semi").dropDuplicates(["doc_id", "_mark"])
    rest = marked.join(wordless, marked["doc_id"].eqNullSafe(wordless["doc_id"]) & (marked["_mark"] == wordless["_mark"]), "left_semi")
    return kept.select(*COLUMNS).union(rest.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    found = scan_secrets(docs.select(*COLUMNS), path_col="source")
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.col("redacted").isNull(), F.col("n_chars")).otherwise(F.length("redacted").cast("long")).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes stay, as often as it takes them (rounded, once at least).

    Rows without an id cannot be named by the mix and stay once.
    """
    mix = mix_sources(docs.filter("doc_id IS NOT NULL")).filter("taken > 0")
    times = mix.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).select("doc_id", F.greatest(F.round(F.col("taken") / F.col("size")).cast("int"), F.lit(1)).alias("times"))
    taken = docs.select(*COLUMNS).join(times, "doc_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*COLUMNS).union(docs.filter("doc_id IS NULL").select(*COLUMNS))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    coded = bpe_encode(docs.select("doc_id", "text", "lang", "source"), vocabulary_path(), decoded_col=None)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("bpe", bpe)]

#: Language ID, near-duplicates and BPE have no SQL counterpart; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
