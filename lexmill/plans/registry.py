"""All queries of the reference's own operators and their SQL."""

from importlib import import_module

MODULES: tuple[str, ...] = ("text_queries", "record_queries", "report_queries", "rule_queries", "stream_queries")


def collected() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"lexmill.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
