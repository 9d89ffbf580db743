"""End-to-end jobs, the query registry and the check queries."""

from __future__ import annotations


def all_queries() -> dict:
    """Every registered check query by name."""
    from importlib import import_module

    from querygauge.plans.registry import QUERIES

    for module in ("text_queries", "corpus_queries", "score_queries", "exec_queries", "shape_queries", "source_queries", "task_queries"):
        import_module(f"querygauge.plans.{module}")
    return QUERIES
