"""Order statistics of whole numbers by group, from counts by value: no array or task ever holds a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, str]) -> DataFrame:
    """by, and for each name the value at a place of the group's sorted values.

    places: name -> SQL of the place, from 0, in terms of ``n`` (the group's rows), e.g. ``{"median": "n div 2"}``.  Null values
    are passed over.  Rows combine to one per distinct value before the shuffle.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("_k").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_k").over(group))

    def at(place: str) -> Column:
        return F.min(F.when(F.col("_upto") > F.expr(place), F.col("_v")))

    return ranked.groupBy(*by).agg(*[at(place).alias(name) for name, place in places.items()])
