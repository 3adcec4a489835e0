"""The queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = ["op01", "op02", "op03", "op04", "op05", "op06", "op07", "op08", "op09", "op10", "op11", "op12", "op13"]


def load():
    """(queries, oracle SQL)."""
    found = [import_module(f"mnemograph.llm.{name}") for name in MODULES]
    queries, twins = {m.NAME: m.query for m in found}, {m.NAME: m.SQL for m in found if m.SQL}
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, twins
