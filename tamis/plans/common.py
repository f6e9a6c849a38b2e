"""How a query and its SQL are registered together."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import TABLES, VIEWS, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = with_views(sql, *views)
        return function

    return register


def stated(sql: str):
    """As `query`; the SQL has the relations that it reads in braces."""
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    assert all(n in VIEWS or n in TABLES for n in used), used
    return query(re.sub(r"\{(\w+)\}", r"\1", sql), *(n for n in used if n in VIEWS))
