"""The flagship query: the build list page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buildlens.operators import builds as B
from buildlens.plans import standins as D


def recent_builds_with_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = B.build_summary(D.build_events(spark, sf_dir), targets=False)
    return B.builds_recent(summary.join(B.cache_hit_ratio(summary), "invocation_id"))
