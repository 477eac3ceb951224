"""Action-cache analytics: hits under a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.plans.ordered import carry


def cache_lookup_ttl(log: DataFrame, ttl_seconds: int, **options) -> DataFrame:
    """Each get with the latest earlier put: hit when at most the time to live old, expired when older, else miss.

    An as-of join without a join: puts and gets share one pass in time order. At equal times a put comes first.
    """
    is_get = (F.col("op") == "get").cast("int")
    us = F.unix_micros("ts")
    rows = log.select("hash", "ts", is_get.alias("_get"), "seq")
    put_at = F.when(F.col("_get") == 0, us)
    out = carry(rows, ["hash"], ["ts", "_get", "seq"], last={"put_us": put_at}, **options)
    age = us - F.col("put_us")
    return out.filter(F.col("_get") == 1).select(
        "seq",
        "hash",
        age.alias("age_us"),
        F.when(F.col("put_us").isNull(), "miss").when(age <= ttl_seconds * 1_000_000, "hit").otherwise("expired").alias("outcome"),
    )
