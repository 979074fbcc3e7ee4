"""Sequence operators: islands, values carried forward, bands, the last of a history, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, by: list[str], order: list[str], levels: list[str]) -> DataFrame:
    """Fills each level with its last value in order, since the last value of a level above it: a new chapter clears the
    article, a new article the clause. One window serves all levels, so rows are sorted once."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # A value of a level or of one above it sets the level: to its own value, or to none.
    last = [F.last(F.when(F.coalesce(*levels[: k + 1]).isNotNull(), F.struct(F.col(level).alias("v"))), True).over(window)["v"] for k, level in enumerate(levels)]
    return rows.withColumns(dict(zip(levels, last, strict=True)))


def islands(rows: DataFrame, by: list[str], order: list[str], begins: Column) -> DataFrame:
    """Numbers the runs of rows that a row with begins starts, from 0 for rows before the first."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.when(begins, 1).otherwise(0)).over(window).cast("long"))


def island_texts(rows: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """One row for each island, with its lines joined in order."""
    parts = rows.groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n_lines"), F.min(order).alias("first"), F.max(order).alias("last"), F.sort_array(F.collect_list(F.struct(order, line))).alias("_parts"))
    return parts.withColumn("text", F.array_join(F.transform("_parts", lambda p: p[line]), "\n")).drop("_parts")


def bands(rows: DataFrame, by: list[str], at: str, gap: float, reach: float) -> DataFrame:
    """For each place the band above it: from a gap below the place before, at most reach back, to a little above."""
    before = F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    return rows.withColumn("band_from", F.greatest(F.coalesce(before + gap, F.col(at) - reach), F.col(at) - reach)).withColumn("band_to", F.col(at) - 5)


def last_of(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("_nth") <= n).drop("_nth")


def last_by_role(rows: DataFrame, by: list[str], order: str, role: str, text: str, roles: list[str]) -> DataFrame:
    """Each group's last text of every role."""
    return rows.groupBy(*by).agg(*[F.max_by(F.when(F.col(role) == r, F.col(text)), F.when(F.col(role) == r, F.col(order))).alias(f"last_{r}") for r in roles])


def within_budget(rows: DataFrame, by: list[str], order: list, length: str, budget: int) -> DataFrame:
    """The first rows in an order whose lengths sum to at most the budget."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(length).over(window)).filter(F.col("used") <= budget)


def first_per_key(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_nth = 1").drop("_nth")


def keep_all_if_none(rows: DataFrame, by: list[str], inside: Column) -> DataFrame:
    """The rows inside a scope, or all of a group that has none inside."""
    some = rows.groupBy(*by).agg(F.max(inside.cast("int")).alias("_some"))
    return rows.join(some, by).filter(inside | (F.col("_some") == 0)).drop("_some")
