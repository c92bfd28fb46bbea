"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from gleaner.catalog import events, ingest, models, reviews, texts  # noqa: F401  (fill the registry)
from gleaner.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
