"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["keyword_queries", "cleaning_queries", "tree_queries", "request_queries", "summary_queries", "crawl_queries", "search_queries", "curation_queries", "serving_queries"]


def load():
    queries, sql = {}, {}
    for name in MODULES:
        catalog = importlib.import_module(f"canopy.plans.{name}").catalog
        overlap = queries.keys() & catalog.queries.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        queries.update(catalog.queries)
        sql.update(catalog.sql)
    return queries, sql
