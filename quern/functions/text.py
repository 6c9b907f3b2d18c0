"""Tokens, terms and sentences as column expressions.

Character classes are spelled out, so that the JVM and DuckDB read them alike: letters, digits and the low line make words;
white space is Unicode's, as in Python's str methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
#: A sentence ends at a mark before white space and a capital, digit, quote or bracket.
SENTENCE_END = rf"""([.!?]["')\]]*[{SPACE}]+)([A-Z0-9"'(\[])"""
#: Parts sentences; never a character of text that is kept.
MARK = "\x01"


def tokens(text: Column) -> Column:
    """Words and single marks in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def terms(text: Column) -> Column:
    """Lower-case words: what the lexical retrievers index."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end (all of Unicode's, unlike trim)."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def sentence_pieces(text: Column) -> Column:
    """The text cut after sentence ends and line breaks; the pieces joined are the text again."""
    marked = F.regexp_replace(F.regexp_replace(text, SENTENCE_END, f"$1{MARK}$2"), r"(\n+)", f"$1{MARK}")
    return F.split(marked, MARK)


def token_offsets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a token: doc_id, tok_idx, tok_start, tok_end (code points, end exclusive), token."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"[{SPACE}]*({TOKEN})"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(pieces).alias("tok_idx", "piece"))
    upto = Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tok_end", F.sum(F.length("piece")).over(upto).cast("int"))
    token = F.regexp_replace("piece", rf"^[{SPACE}]+", "")
    return rows.select("doc_id", "tok_idx", (F.col("tok_end") - F.length(token)).alias("tok_start"), "tok_end", token.alias("token"))


def sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a sentence: doc_id, sent_idx, sent_start, sent_end, sentence, n_tokens, tok_lo (its first token's place)."""
    rows = docs.select("doc_id", F.posexplode(sentence_pieces(F.col(text_col))).alias("piece_idx", "piece"))
    upto = Window.partitionBy("doc_id").orderBy("piece_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.length("piece")).over(upto)).withColumn("sentence", strip(F.col("piece")))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", rf"^[{SPACE}]+", ""))
    rows = rows.withColumn("sent_start", (F.col("stop") - F.length("piece") + lead).cast("int")).filter("sentence <> ''")
    order = Window.partitionBy("doc_id").orderBy("piece_idx")
    rows = rows.withColumn("n_tokens", token_count(F.col("sentence"))).withColumn("sent_idx", F.row_number().over(order) - 1)
    rows = rows.withColumn("tok_lo", (F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).cast("int"))
    return rows.select("doc_id", "sent_idx", "sent_start", (F.col("sent_start") + F.length("sentence")).alias("sent_end"), "sentence", "n_tokens", "tok_lo")
