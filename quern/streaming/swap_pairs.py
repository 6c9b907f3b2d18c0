"""An extension: swap pairs completed over a stream of judgments.

Late repeats of a key are dropped within the watermark, and a pair appears once both orders have come; state is kept by key
and leaves with the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.judge import ORDERS, with_parts


def stream_swap_pairs(records: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """records with an event time -> pairs of items whose two orders come within ``delay`` of each other."""
    seen = records.withWatermark(time, delay).dropDuplicatesWithinWatermark(["model", "rubric", "order", "item_id"])
    side = lambda order, tag: seen.filter(F.col("order") == order).select("model", "rubric", "item_id", F.col(time).alias(f"t_{tag}"), F.col("z").alias(f"z_{tag}"), F.col("compliant").alias(f"c_{tag}"), F.col("mass_ab").alias(f"m_{tag}"))
    a, b = side(ORDERS[0], "cf"), side(ORDERS[1], "rf").select(F.col("model").alias("_m"), F.col("rubric").alias("_r"), F.col("item_id").alias("_i"), "t_rf", "z_rf", "c_rf", "m_rf")
    near = F.expr(f"model = _m AND rubric = _r AND item_id = _i AND t_rf BETWEEN t_cf - INTERVAL {delay} AND t_cf + INTERVAL {delay}")
    both = a.join(b, near).select("model", "rubric", "item_id", "z_cf", "z_rf", (F.col("c_cf") & F.col("c_rf")).alias("compliant_both"), F.least("m_cf", "m_rf").alias("mass_min"))
    return with_parts(both)
