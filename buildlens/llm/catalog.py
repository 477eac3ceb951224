"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["token_orc", "lattice_pieces", "evidence_language", "ngram_join", "interleave", "curve_pack", "superkmer", "line_crf", "topk", "imatch", "toxicity", "lexical_search", "word_runs", "stages"]


def registered():
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"buildlens.llm.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
