"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "structure_queries", "timeline_queries", "catalog_queries", "notes_queries",
           "progress_queries", "document_queries")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for m in MODULES:
        mod = import_module(f"bookflow.plans.{m}")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql
