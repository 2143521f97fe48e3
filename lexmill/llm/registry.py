"""All queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = ("token_counts", "license_scan", "language_id", "decontaminate", "quality", "mixing", "jaccard_join", "suffix_dedup", "passage_dedup", "media", "resampling", "byte_bpe", "conversation_trie")


def collected() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"lexmill.llm.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
