"""Physical plans must hold at scale: no nested loops, no row-at-a-time Python, no unbounded single-task windows."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.fixture(scope="module")
def no_static_broadcast(spark):
    """Plan as for tables too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, sf_dir, no_static_broadcast, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    # a window never runs over one partition that holds everything
    for above, below in zip(text.splitlines(), text.splitlines()[1:]):
        assert not (re.search(r"[-+ ]Window \[", above) and "SinglePartition" in below)


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(QUERIES["queue_class"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in text


def test_filters_reach_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", plan(QUERIES["retention"](spark, sf_dir)))
    assert re.search(r"PushedFilters: \[.*EqualTo\(l_linestatus,F\)", plan(QUERIES["test_rollup"](spark, sf_dir)))


def test_history_is_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["history_cap"](spark, sf_dir))
