"""Registered queries, one module per operator family."""

from importlib import import_module

MODULES = ("text_queries", "dedupe_queries", "geo_queries", "profile_queries", "score_queries", "decide_queries", "spatial_queries", "theme_queries", "fact_queries", "source_queries", "export_queries", "pipeline_queries")


def all_queries() -> dict:
    from registry.core import QUERIES
    for m in MODULES:
        import_module(f"registry.{m}")
    return dict(QUERIES)


def all_sql() -> dict:
    from registry.core import ORACLE
    all_queries()
    return dict(ORACLE)
