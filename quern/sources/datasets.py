"""Question-answering and preference datasets as DataFrames.

Loaders declare their schemas and fail on drift: a gold span that is not the text it claims to be raises when read.
documents: doc_id, text; questions: qid, doc_id, query; gold: qid, alt_idx, span_idx, start, end (code points, end exclusive).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import SPACE

JOINER = "\n\n"
SQUAD = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<answer_start:int,text:string>>>>>>>>"
REFERENCES = "array<struct<content:string,start_index:int,end_index:int>>"
PAIRS = ("id", "subset", "prompt", "chosen", "rejected", "chosen_model", "rejected_model")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_hash(spark: SparkSession, path: str, sha256: str) -> None:
    """Raises unless the one file at path has the pinned digest."""
    found = [r["sha256"] for r in file_hashes(spark, path).select("sha256").collect()]
    if found != [sha256]:
        raise ValueError(f"checksum mismatch for {path}: expected {sha256}, got {found}")


def _checked(rows: DataFrame, text: str, start: str, end: str, claimed: str) -> DataFrame:
    there = F.expr(f"substring({text}, {start} + 1, {end} - {start})")
    return rows.withColumn(start, F.when(there == F.col(claimed), F.col(start)).otherwise(F.raise_error(F.concat(F.lit("span mismatch: "), F.col(claimed))).cast("int")))


def _stripped(c: str):
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def load_squad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, questions, gold) of a SQuAD v1.1 or v2.0 file.

    An article is its paragraphs joined by a blank line; answers move with their paragraph.  Unanswerable questions go, a
    question asked twice of an article stays once, equal spans are one alternative, each answer an alternative of its own.
    """
    articles = spark.read.schema(SQUAD).option("multiLine", True).json(path).select(F.posexplode("data").alias("article", "a"))
    documents = articles.select(F.col("a.title").alias("doc_id"), F.array_join(F.transform("a.paragraphs", lambda p: p["context"]), JOINER).alias("text"))
    paragraphs = articles.select("article", F.col("a.title").alias("doc_id"), F.posexplode("a.paragraphs").alias("place", "p"))
    before = Window.partitionBy("article").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    paragraphs = paragraphs.withColumn("offset", F.coalesce(F.sum(F.length("p.context") + len(JOINER)).over(before), F.lit(0)))
    asked = paragraphs.select("article", "doc_id", "place", "offset", F.posexplode("p.qas").alias("at", "qa")).filter(~F.coalesce("qa.is_impossible", F.lit(False)) & (F.size("qa.answers") > 0))
    asked = asked.withColumn("query", _stripped("qa.question"))
    first = Window.partitionBy("article", "query").orderBy("place", "at")
    asked = asked.withColumn("n", F.row_number().over(first)).filter("n = 1").select(F.col("qa.id").alias("qid"), "doc_id", "query", "offset", "qa.answers")
    spans = asked.select("qid", "doc_id", "offset", F.posexplode("answers").alias("i", "answer"))
    spans = spans.select("qid", "doc_id", "i", (F.col("offset") + F.col("answer.answer_start")).cast("int").alias("start"), F.col("answer.text").alias("claimed")).withColumn("end", (F.col("start") + F.length("claimed")).cast("int"))
    spans = spans.groupBy("qid", "doc_id", "start", "end", "claimed").agg(F.min("i").alias("i"))
    spans = _checked(spans.join(documents, "doc_id"), "text", "start", "end", "claimed")
    gold = spans.withColumn("alt_idx", F.row_number().over(Window.partitionBy("qid").orderBy("i")) - 1).select("qid", "alt_idx", F.lit(0).alias("span_idx"), "start", "end")
    return documents, asked.select("qid", "doc_id", "query"), gold


def load_reference_corpora(spark: SparkSession, folder: str, questions: str = "questions_df.csv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, questions, gold) of a folder with <corpus>.md files and a CSV of questions with JSON references.

    All references of a question are required together.  qid is <corpus>:<nnn> in row order; an unknown corpus raises.
    """
    texts = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("doc_id"), F.col("value").alias("text"))
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("question string, references string, corpus_id string").csv(f"{folder}/{questions}", enforceSchema=False)
    # the file's row order; a multi-line CSV is one partition by nature
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.join(texts.select(F.col("doc_id").alias("corpus_id"), F.lit(True).alias("_known")), "corpus_id", "left")
    rows = rows.withColumn("corpus_id", F.when(F.col("_known"), F.col("corpus_id")).otherwise(F.raise_error(F.concat(F.lit("unknown corpus "), F.col("corpus_id")))))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("corpus_id").orderBy("_row")))
    rows = rows.select(F.format_string("%s:%03d", "corpus_id", "n").alias("qid"), F.col("corpus_id").alias("doc_id"), _stripped("question").alias("query"), F.from_json("references", REFERENCES).alias("refs"))
    spans = rows.select("qid", "doc_id", F.posexplode("refs").alias("span_idx", "r")).select("qid", "doc_id", "span_idx", F.col("r.start_index").alias("start"), F.col("r.end_index").alias("end"), F.col("r.content").alias("claimed"))
    gold = _checked(spans.join(texts, "doc_id"), "text", "start", "end", "claimed")
    return texts, rows.select("qid", "doc_id", "query"), gold.select("qid", F.lit(0).alias("alt_idx"), "span_idx", "start", "end")


def load_preferences(spark: SparkSession, path: str, expected: dict[str, int] | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """item_id (subset/id), subset, category, prompt, chosen, rejected and model names of a preference table.

    expected: rows of each subset; any difference, an empty field, equal responses or a repeated id raise.
    """
    rows = spark.read.parquet(path)
    missing = [c for c in PAIRS if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    rows = rows.select(F.concat_ws("/", "subset", F.col("id").cast("string")).alias("item_id"), *[F.col(c) for c in PAIRS[1:]])
    stats = rows.groupBy("subset").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("ids"), F.sum(F.when((F.col("prompt") == "") | (F.col("chosen") == "") | (F.col("rejected") == "") | (F.col("chosen") == F.col("rejected")), 1).otherwise(0)).alias("bad")).collect()
    if expected is not None and {r["subset"]: r["n"] for r in stats} != expected:
        raise ValueError("the table's composition is not the expected one")
    if any(r["n"] != r["ids"] or r["bad"] for r in stats):
        raise ValueError("repeated ids, empty fields or equal responses")
    if categories is None:
        return rows.withColumn("category", F.col("subset"))
    unknown = {r["subset"] for r in stats} - set(categories)
    if unknown:
        raise ValueError(f"subsets without a category: {sorted(unknown)}")
    return rows.withColumn("category", F.element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("subset")))


def gold_tokens(gold: DataFrame, offsets: DataFrame, questions: DataFrame) -> DataFrame:
    """gold in code points -> qid, alt_idx, span_idx, lo, hi: the first and last token that a span overlaps."""
    spans = gold.join(questions.select("qid", "doc_id"), "qid")
    met = spans.join(offsets, "doc_id").filter((F.col("tok_end") > F.col("start")) & (F.col("tok_start") < F.col("end")))
    return met.groupBy("qid", "alt_idx", "span_idx").agg(F.min("tok_idx").alias("lo"), F.max("tok_idx").alias("hi"))
