"""Connected components over DataFrames: alternating large-star and small-star rounds, each written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of the component.

    A round links each node's larger neighbours to its smallest one, then each node and its smaller neighbours to the
    smallest of them; rounds grow with the logarithm of the longest path. No neighbourhood is gathered in one row. Only
    a count and a checksum of the links reach the driver.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select("lo", "lo").distinct())
        seen = mark
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        lower = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = stored(lower.union(lowest.select("hi", "m")).distinct(), "links")
