"""All named queries."""

from __future__ import annotations

from . import catalog, page_queries, text_queries  # noqa: F401


def all_queries() -> dict:
    return catalog.QUERIES


def all_sql() -> dict[str, str]:
    return catalog.SQL


def flagship(spark, folder: str):
    return catalog.QUERIES["link_counts"](spark, folder)
