"""Queries by name, each with the SQL that says the same, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Registers a function of the named tables under its own name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*readers.tables(spark, sf_dir, *tables))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def fold(x: str) -> str:
    """SQL of functions.text.fold."""
    return rf"trim(regexp_replace(replace(strip_accents(lower(coalesce({x}, ''))), 'đ', 'd'), '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    """SQL of functions.text.tokens."""
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"


def content(x: str) -> str:
    """SQL of functions.text.content_tokens, in no certain order."""
    from ..functions.text import STOPWORDS

    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct([w for w in regexp_extract_all({fold(x)}, '[a-z0-9]+') if len(w) >= 3 and not list_contains([{stop}], w)])"
