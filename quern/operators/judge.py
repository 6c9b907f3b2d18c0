"""Pairwise judging: prompts, verdict read-outs, swap pairs and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import resampling as S
from quern.plans.shared import ship_package

#: The judge's instructions, the question's layout, and the chat layouts that models were trained on.
RUBRICS = {
    "minimal": {
        "system": "You are an impartial judge comparing two responses to the same user instruction. Decide which response answers the instruction better. Do not let the order in which the responses appear, their length, or their style influence your decision; judge only quality and adherence to the instruction.",
        "closing": "Which response is better? Reply with exactly one letter: A or B.",
    },
    "detailed": {
        "system": "You are an impartial judge comparing two responses to the same user instruction. Evaluate each response for: (1) adherence to the instruction and all of its constraints, (2) factual accuracy, (3) helpfulness and completeness, and (4) safety and appropriateness of the response given the instruction. Do not let the order in which the responses appear, their length, or their style influence your decision.",
        "closing": "Considering adherence, accuracy, helpfulness, and safety: which response is better? Reply with exactly one letter: A or B.",
    },
}
PARTS = ("Instruction:\n", "\n\nResponse A:\n", "\n\nResponse B:\n", "\n\n")
CHAT = {
    "chatml": ("<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "llama3": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"),
}
ORDERS = ("chosen_first", "rejected_first")
#: Edges of the validity bins; the last is open above.
MASS_EDGES = (0.0, 0.25, 0.5, 0.75, 0.9)


def prompts(items: DataFrame, rubric: str = "minimal", chat: str | None = None) -> DataFrame:
    """items(item_id, prompt, chosen, rejected) -> two rows an item: order, expected_verdict, system, user (and rendered).

    The contents are joined, never substituted, so braces in them are plain text.
    """
    if rubric not in RUBRICS:
        raise ValueError(f"unknown rubric {rubric!r}")
    rows = items.withColumn("order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    straight = F.col("order") == ORDERS[0]
    a, b = F.when(straight, F.col("chosen")).otherwise(F.col("rejected")), F.when(straight, F.col("rejected")).otherwise(F.col("chosen"))
    user = F.concat(F.lit(PARTS[0]), F.col("prompt"), F.lit(PARTS[1]), a, F.lit(PARTS[2]), b, F.lit(PARTS[3] + RUBRICS[rubric]["closing"]))
    out = rows.select("item_id", F.lit(rubric).alias("rubric"), "order", F.when(straight, "A").otherwise("B").alias("expected_verdict"), F.lit(RUBRICS[rubric]["system"]).alias("system"), user.alias("user"))
    if chat is None:
        return out
    opening, middle, closing = CHAT[chat]
    return out.withColumn("rendered", F.concat(F.lit(opening), F.col("system"), F.lit(middle), F.col("user"), F.lit(closing)))


def infer(rows: DataFrame, load: Callable[[], Any], limit: int, text_col: str = "rendered") -> DataFrame:
    """rows with n_prompt_tokens, logits and argmax_token from a model that each Python worker loads once.

    load() returns an object with ``tokens(text) -> list[int]`` and ``logits(list[list[int]]) -> list[list[float]]`` (one row of
    the vocabulary a prompt) and ``text(id) -> str``.  A prompt of more than ``limit`` tokens raises: prompts are never cut.
    A, B must be single tokens of the model.  Rows stay in their partitions; a task asks the model once a batch.
    """
    ship_package(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_prompt_tokens", T.IntegerType()), T.StructField("logits", T.ArrayType(T.DoubleType())), T.StructField("argmax_token", T.StringType()), T.StructField("id_a", T.IntegerType()), T.StructField("id_b", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        letters = [model.tokens(v) for v in ("A", "B")]
        if any(len(ids) != 1 for ids in letters):
            raise ValueError("the verdict letters are not single tokens of this model")
        for f in frames:
            ids = [model.tokens(t) for t in f[text_col]]
            for prompt in ids:
                if len(prompt) > limit:
                    raise ValueError(f"a prompt of {len(prompt)} tokens is over the limit of {limit}")
            found = [list(map(float, r)) for r in model.logits(ids)] if len(f) else []
            top = [model.text(max(range(len(r)), key=r.__getitem__)) for r in found]
            yield f.assign(n_prompt_tokens=[len(i) for i in ids], logits=found, argmax_token=top, id_a=letters[0][0], id_b=letters[1][0])

    return rows.mapInPandas(run, schema)


def read_logits(rows: DataFrame, logits: str = "logits", id_a: int = 3, id_b: int = 5, argmax_token: str = "argmax_token") -> DataFrame:
    """rows with z, logp_a, logp_b, mass_ab and compliant, by a stable log of summed exponentials."""
    a, b = F.element_at(logits, id_a + 1), F.element_at(logits, id_b + 1)
    top = F.array_max(logits)
    norm = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    token = F.regexp_replace(argmax_token, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return rows.withColumns({"z": a - b, "logp_a": a - norm, "logp_b": b - norm, "mass_ab": F.exp(a - norm) + F.exp(b - norm), "compliant": token.isin("A", "B")})


def todo(wanted: DataFrame, done: DataFrame, key: Sequence[str] = ("model", "rubric", "order", "item_id")) -> DataFrame:
    """Prompts that no record answers yet; running it again after appending changes nothing else."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def incomplete(records: DataFrame) -> DataFrame:
    """model, rubric, n_incomplete: items that lack one of the two orders and so make no swap pair."""
    seen = records.groupBy("model", "rubric", "item_id").agg(F.countDistinct("order").alias("k"))
    return seen.groupBy("model", "rubric").agg(F.count_if(F.col("k") < 2).alias("n_incomplete"))


def swap_pairs(records: DataFrame) -> DataFrame:
    """One row for each item judged in both orders; items with a repeated order raise, incomplete ones are left out.

    s is what the judge prefers whatever the order, b what it owes to the order.
    """
    key = ["model", "rubric", "item_id"]
    pick = lambda order, c: F.max(F.when(F.col("order") == order, F.col(c)))
    pairs = records.groupBy(*key).agg(pick(ORDERS[0], "z").alias("z_cf"), pick(ORDERS[1], "z").alias("z_rf"), F.bool_and("compliant").alias("compliant_both"), F.min("mass_ab").alias("mass_min"), F.count("*").alias("n"), F.count_distinct("order").alias("orders"))
    pairs = pairs.withColumn("z_cf", F.when(F.col("n") > F.col("orders"), F.raise_error(F.concat(F.lit("repeated order for "), F.col("item_id"))).cast("double")).otherwise(F.col("z_cf")))
    return with_parts(pairs.filter("z_cf IS NOT NULL AND z_rf IS NOT NULL").drop("n", "orders"))


def with_parts(pairs: DataFrame) -> DataFrame:
    """Derived columns: s, b, raw verdicts by order (a tie at 0 reads as A), symmetrised verdict (a tie is a half), flip."""
    pairs = pairs.withColumns({"s": (F.col("z_cf") - F.col("z_rf")) / 2, "b": (F.col("z_cf") + F.col("z_rf")) / 2, "raw_cf": F.when(F.col("z_cf") >= 0, 1.0).otherwise(0.0), "raw_rf": F.when(F.col("z_rf") < 0, 1.0).otherwise(0.0)})
    return pairs.withColumns({"raw_mean": (F.col("raw_cf") + F.col("raw_rf")) / 2, "sym": F.when(F.col("s") > 0, 1.0).when(F.col("s") < 0, 0.0).otherwise(0.5), "flip": (F.col("z_cf") >= 0) == (F.col("z_rf") >= 0)})


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def summary(pairs: DataFrame, *by: str) -> DataFrame:
    """The standard block, one aggregation."""
    q = lambda p: F.percentile("b", F.lit(p))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_items"), _share(F.col("compliant_both")).alias("compliance_rate"), F.percentile("mass_min", F.lit(0.5)).alias("mass_p50"),
        F.avg("raw_mean").alias("raw_acc"), F.avg("raw_cf").alias("raw_cf"), F.avg("raw_rf").alias("raw_rf"), F.avg("sym").alias("sym_acc"), F.avg(F.col("sym") - F.col("raw_mean")).alias("sym_minus_raw"), _share(F.col("flip")).alias("flip_rate"),
        F.avg("b").alias("b_mean"), q(0.5).alias("b_median"), F.stddev_samp("b").alias("b_sd"), q(0.25).alias("b_q25"), q(0.75).alias("b_q75"), _share(F.col("b") > 0).alias("b_positive"),
        F.avg("s").alias("s_mean"), F.percentile(F.abs("s"), F.lit(0.5)).alias("s_median_abs"), F.stddev_samp("s").alias("s_sd"), _share(F.abs("b") > F.abs("s")).alias("bias_dominates"),
    )


def accuracies(pairs: DataFrame, *keep: str) -> DataFrame:
    """keep, raw_acc, sym_acc, sym_minus_raw of each pair: what the summary's intervals resample."""
    return pairs.select(*keep, F.col("raw_mean").alias("raw_acc"), F.col("sym").alias("sym_acc"), (F.col("sym") - F.col("raw_mean")).alias("sym_minus_raw"))


def summary_intervals(pairs: DataFrame, *by: str, replicates: int = 10_000) -> DataFrame:
    """by, metric, n, mean, lo, hi, significant for the three accuracies of the standard block."""
    long = accuracies(pairs, *by, "item_id").unpivot([*by, "item_id"], ["raw_acc", "sym_acc", "sym_minus_raw"], "metric", "value")
    return S.by_group(long, [*by, "metric"], "item_id", lambda f: S.mean_interval(f["value"].to_numpy(), replicates))


def stratum_stats(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_items"), F.avg("sym").alias("sym_acc"), F.avg("raw_mean").alias("raw_acc"), _share(F.col("flip")).alias("flip_rate"), F.percentile("b", F.lit(0.5)).alias("b_median"),
        F.percentile(F.abs("b"), F.lit(0.5)).alias("b_median_abs"), F.percentile(F.abs("s"), F.lit(0.5)).alias("s_median_abs"), _share(F.abs("b") > F.abs("s")).alias("bias_dominates"), F.percentile("mass_min", F.lit(0.5)).alias("mass_p50"),
    )


def compliance_strata(pairs: DataFrame) -> DataFrame:
    """stratum all, compliant_both and non_compliant in one pass over the pairs."""
    names = F.array(F.lit("all"), F.when(F.col("compliant_both"), "compliant_both").otherwise("non_compliant"))
    return stratum_stats(pairs.withColumn("stratum", F.explode(names)), "stratum")


def mass_bins(pairs: DataFrame, edges: Sequence[float] = MASS_EDGES) -> DataFrame:
    """Statistics by bin of mass_min; empty bins are rows too."""
    spark = pairs.sparkSession
    bins = spark.range(len(edges)).select(F.col("id").cast("int").alias("bin"), F.element_at(F.array(*[F.lit(float(e)) for e in edges]), (F.col("id") + 1).cast("int")).alias("lo"))
    place = F.lit(-1)
    for k, e in enumerate(edges):
        place = F.when(F.col("mass_min") >= e, k).otherwise(place)
    return bins.join(stratum_stats(pairs.withColumn("bin", place), "bin"), "bin", "left").fillna(0, ["n_items"])


def floors(items: DataFrame, *by: str) -> DataFrame:
    """What needs no judge: always A, the longer response by characters and by words (a tie is a half), chance."""
    words = lambda c: F.regexp_count(c, F.lit(r"[^\s\p{Z}\x0b\x1c-\x1f\x85]+"))
    longer = lambda x, y: F.avg(F.when(x > y, 1.0).when(x < y, 0.0).otherwise(0.5))
    return items.groupBy(*by).agg(F.count("*").alias("n_items"), F.lit(0.5).alias("always_a"), longer(F.length("chosen"), F.length("rejected")).alias("longer_chars"), longer(words("chosen"), words("rejected")).alias("longer_words"), F.lit(0.5).alias("random"))


def largest_remainder(counts: DataFrame, n: int, name: str, count: str = "count") -> DataFrame:
    """counts(name, count) with ``quota``: shares of n, the rest to the largest fractions, ties by name.

    One row a stratum: the ordering is over the strata, not over the items.
    """
    whole = Window.partitionBy(F.lit(0))
    exact = F.lit(n) * F.col(count) / F.sum(count).over(whole)
    rows = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    rows = rows.withColumn("_short", F.lit(n) - F.sum("_floor").over(whole)).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_floor")), name)))
    return rows.withColumn("quota", (F.col("_floor") + F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0)).cast("int")).drop("_exact", "_floor", "_short", "_rank")


def hashed_order(seed: int, *parts: str) -> Column:
    """A reproducible random order that SQL engines share."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def stratified_sample(items: DataFrame, n: int, stratum: str, key: str, seed: int = 0) -> DataFrame:
    """n items, each stratum by its quota, drawn in hashed order."""
    quotas = largest_remainder(items.groupBy(stratum).count(), n, stratum).select(stratum, "quota")
    order = Window.partitionBy(stratum).orderBy(hashed_order(seed, key), key)
    return items.withColumn("_n", F.row_number().over(order)).join(quotas, stratum).filter("_n <= quota").drop("_n", "quota")


def sample_per_group(rows: DataFrame, cap: int, group: str, key: str, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each group, drawn in hashed order."""
    order = Window.partitionBy(group).orderBy(hashed_order(seed, group, key), key)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")
