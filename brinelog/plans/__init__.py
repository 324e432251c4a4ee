"""Queries over the given tables, one module per group."""

from importlib import import_module

MODULES = ["feed_queries", "tag_queries", "rule_queries", "ingest_queries", "product_queries", "stream_queries", "image_queries"]


def load():
    """Import every query module once and return the registry."""
    for name in MODULES:
        import_module(f"brinelog.plans.{name}")
    return import_module("brinelog.plans.registry")
