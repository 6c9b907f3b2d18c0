"""Connected components of a table of links, by alternating large and small stars (no driver-side graph).

Each round moves every node's links to the smallest node it knows: two minima and two joins on the node, both of
which combine before the shuffle or split where a node has very many links.  Stars settle in two or three rounds.
Each round is written to the shared folder, which cuts the lineage; the round before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.shared import discard, materialise


def _settled(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links(a, b) of whole-number ids -> (id, component), one row per linked id; component is its smallest reachable id.

    Links to itself and links with a null are passed over; repeated links count once.
    """
    now = materialise(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).distinct(), "links")
    before = _settled(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo")))
        after = materialise(small.distinct(), "stars")
        found = _settled(after)
        discard(now)
        now = after
        if found == before:
            break
        before = found
    out = now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
    out._quern_path = now._quern_path  # discard() deletes the table below
    return out
