"""Stores of run results and judgments.

Runs are Parquet, partitioned by the columns that name a configuration, so a filter prunes files and a repeated run replaces only
its own partition.  Judgments are JSON lines, appended after an anti-join on their key.
"""

from __future__ import annotations

import json
import os
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = ("dataset", "retriever", "tokenizer", "budget_rule", "chunker", "chunk_size", "overlap", "seed")
DEFAULTS = {"budget_rule": "stop", "tokenizer": "regex", "overlap": 0, "seed": 0}
ORDER = ("fixed", "sentence", "recursive", "semantic")
JUDGMENT = "model string, rubric string, `order` string, item_id string, expected_verdict string, z double, logp_a double, logp_b double, mass_ab double, argmax_token string, compliant boolean, n_prompt_tokens int, prefill_seconds double"
KEY = ("model", "rubric", "order", "item_id")


def label(config: dict) -> str:
    """<chunker>-<size>, then what differs from the defaults."""
    out = f"{config['chunker']}-{config['chunk_size']}"
    out += f"/o{config['overlap']}" if config.get("overlap") else ""
    for k in ("budget_rule", "tokenizer"):
        out += f"/{config[k]}" if config.get(k, DEFAULTS[k]) != DEFAULTS[k] else ""
    return out


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_run(scores: DataFrame, path: str, config: dict, force: bool = False) -> bool:
    """Writes one configuration's scores; False, without running the plan, if they are there already."""
    full = {**DEFAULTS, **config}
    spark = scores.sparkSession
    part = "/".join([path, *(f"{c}={full[c]}" for c in CONFIG)])
    if exists(spark, f"{part}/_SUCCESS") and not force:
        return False
    scores.write.mode("overwrite").parquet(part)
    return True


def load_runs(spark: SparkSession, path: str, tokenizer: str | None = "regex", **wanted) -> DataFrame:
    """Scores of the configurations that match; the tokenizer filter is closed unless opened with None.

    Values may be lists.  Columns of CONFIG that a store lacks take their defaults.
    """
    rows = spark.read.option("basePath", path).option("recursiveFileLookup", "false").parquet(path)
    for c, v in DEFAULTS.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    wanted = {**wanted, **({"tokenizer": tokenizer} if tokenizer is not None else {})}
    for c, v in wanted.items():
        if v is not None:
            rows = rows.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return rows.orderBy(*presentation_order(), *[c for c in CONFIG if c in rows.columns and c not in ("chunker", "chunk_size", "overlap")])


def presentation_order():
    """Sort keys: chunkers in their usual order, others after them, then size and overlap."""
    place = F.lit(99)
    for k, name in enumerate(ORDER):
        place = F.when(F.col("chunker") == name, k).otherwise(place)
    return [place, F.col("chunker"), F.col("chunk_size"), F.col("overlap")]


def load_judgments(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(JUDGMENT).json(paths)


def append_judgments(records: DataFrame, path: str) -> None:
    """Adds the records whose key the store lacks; running it twice adds nothing."""
    spark = records.sparkSession
    fresh = records.dropDuplicates(list(KEY))
    if exists(spark, path):
        fresh = fresh.join(load_judgments(spark, [path]).select(*KEY), list(KEY), "left_anti")
    fresh.write.mode("append").json(path)


def repository_state(root: str) -> str:
    """Commit of the repository that holds root, with a mark where tracked files differ from it; ``unknown`` outside of one."""
    try:
        told = subprocess.run(["git", "-C", root, "describe", "--always", "--abbrev=40", "--exclude=*", "--dirty"], capture_output=True, text=True, check=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return "unknown"
    return told.stdout.strip() or "unknown"


def run_metadata(root: str | None = None, **more) -> dict:
    """What a sidecar says of a run: state of this package's repository (or of root), versions, UTC start, and more, such as a judge's."""
    import pyspark

    here = root or os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    now = datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
    return {**more, "commit": repository_state(here), "pyspark": pyspark.__version__, "started_utc": f"{now.isoformat()}Z"}


def save_summary(summary: DataFrame, path: str, meta: dict | None = None) -> None:
    """One JSON line a row of a report, sorted by all its columns, beside a sidecar where meta is given."""
    summary.orderBy(*summary.columns).coalesce(1).write.mode("overwrite").json(path)
    if meta is not None:
        write_sidecar(summary.sparkSession, f"{path.rstrip('/')}.meta", meta)


def write_sidecar(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def log_digest(log: DataFrame, column: str = "value") -> DataFrame:
    """day, lead, anchor of each entry of a Markdown log: sections that begin with '## ', and their bold leads."""
    sections = log.select(F.explode(F.filter(F.split(column, r"(?m)^## "), lambda s: F.trim(s) != "")).alias("section"))
    title = F.regexp_extract("section", r"^([^\n]*)", 1)
    rows = sections.select(title.alias("day"), F.explode_outer(F.regexp_extract_all("section", F.lit(r"\*\*([^*\n]+)\*\*"), F.lit(1))).alias("lead"))
    anchor = F.regexp_replace(F.regexp_replace(F.lower("day"), r"[^\p{L}\p{N} _-]", ""), " ", "-")
    return rows.withColumn("anchor", anchor)
