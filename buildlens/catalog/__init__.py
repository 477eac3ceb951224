"""Registered queries by area."""

from __future__ import annotations

import importlib

AREAS = ["builds", "benchmarks", "store", "execution", "trees", "sources", "streams"]


def registered():
    queries, sql = {}, {}
    for area in AREAS:
        module = importlib.import_module(f"buildlens.catalog.{area}")
        clash = queries.keys() & module.QUERIES.keys()
        assert not clash, clash
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
