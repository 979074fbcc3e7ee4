"""Aggregations: extremes, frequencies with samples, catalogues, gaps in sequences, summaries and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(rows: DataFrame, by: list[str], top: int, sample: str | None = None, samples: int = 4) -> DataFrame:
    """The largest groups with their counts and, if asked, the least few values of a column. Samples are cut before they
    are gathered, so a group of any size costs a few values."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), *by).limit(top)
    if not sample:
        return best
    ranked = rows.join(F.broadcast(best), by, "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(sample))).filter(F.col("_nth") <= samples)
    few = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    return best.join(few, by)


def extremes(rows: DataFrame, amount: str, key: str, top: int, largest: bool = True) -> DataFrame:
    """The rows of the largest, or of the smallest amounts above 0; ties by key."""
    kept = rows.filter(F.col(amount).isNotNull() & (F.lit(largest) | (F.col(amount) > 0)))
    return kept.orderBy(F.desc(amount) if largest else F.asc(amount), key).limit(top)


def missing_numbers(rows: DataFrame, by: list[str], number: str, first: int = 20) -> DataFrame:
    """Each group's greatest number, how many numbers from 1 on are missing, and the first of them.

    Gaps come from neighbours in order, so neither the numbers nor the gaps of a group are gathered whole."""
    distinct = rows.filter(F.col(number) >= 1).select(*by, F.col(number).alias("_n")).distinct()
    before = F.coalesce(F.lag("_n").over(Window.partitionBy(*by).orderBy("_n")), F.lit(0))
    gaps = distinct.withColumn("_from", before + 1).withColumn("_to", F.col("_n") - 1)
    totals = gaps.groupBy(*by).agg(F.max("_n").alias("last"), F.sum(F.greatest(F.col("_to") - F.col("_from") + 1, F.lit(0))).alias("n_missing"))
    early = gaps.filter("_to >= _from").withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_n"))).filter(F.col("_at") <= first)
    some = early.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.expr(f"sequence(_from, least(_to, _from + {first - 1}))")))), 1, first).alias("missing"))
    return totals.join(some, by, "left").withColumn("missing", F.coalesce("missing", F.array().cast(some.schema["missing"].dataType)))


def nearest_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Elements at index round((n - 1) * share) of each group's sorted values, halves to even: by counting equal values and
    adding up the counts in order, so a group's distinct values are put in order, not its rows."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value))
    placed = counted.withColumn("_to", upto).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda s: F.bround((F.col("_all") - 1) * F.lit(s)).cast("long")
    picks = [F.max(F.when((F.col("_to") - F.col("_n") <= at(s)) & (at(s) < F.col("_to")), F.col(value))).alias(name) for name, s in shares.items()]
    return placed.groupBy(*by).agg(*picks)


def profile(rows: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """The number of rows and, of each condition, how many rows meet it."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def summary_with_total(rows: DataFrame, by: str, *measures: Column) -> DataFrame:
    """Measures by group and in total, where the group is null."""
    return rows.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), *measures)


def best_by(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """Each group's first row in an order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_nth = 1").drop("_nth")


def boilerplate_lines(pages: DataFrame, doc: str, page: str, text: str, edge: int = 5, share: float = 0.6, longest: int = 150) -> DataFrame:
    """Lines that stand near the edge of at least a share of a document's pages."""
    lines = pages.select(doc, page, F.split(text, "\n", -1).alias("lines"))
    near = F.array_distinct(F.filter(F.transform(F.concat(F.slice("lines", 1, edge), F.slice("lines", -F.least(F.lit(edge), F.size("lines")), F.lit(edge))), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) < longest)))
    counts = lines.select(doc, page, F.explode(near).alias("line")).groupBy(doc, "line").agg(F.countDistinct(page).alias("n_pages"))
    totals = pages.groupBy(doc).agg(F.countDistinct(page).alias("of_pages"))
    return counts.join(totals, doc).filter(F.col("n_pages") >= share * F.col("of_pages"))


def strip_lines(pages: DataFrame, lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Pages without the lines listed for their document (few: those of boilerplate_lines)."""
    listed = lines.groupBy(doc).agg(F.collect_set("line").alias("_lines"))
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.coalesce("_lines", F.array().cast("array<string>")), F.trim(x)))
    return pages.join(listed, doc, "left").withColumn(text, F.array_join(kept, "\n")).drop("_lines")


def set_coverage(expected: DataFrame, actual: DataFrame, by: list[str], key: str) -> DataFrame:
    """Of each group's expected keys, how many there are, how many are found, and what share (1 of none)."""
    want = expected.select(*by, key).distinct()
    have = actual.select(*by, key).distinct().withColumn("_hit", F.lit(1))
    out = want.join(have, [*by, key], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found"))
    return out.withColumn("coverage", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("found") / F.col("expected")))


def coverage_score(chunk: Column, coord: Column, hierarchy: Column, source_only: Column, garbage: Column) -> Column:
    """Weighted coverage, less a penalty for rows that only quote their source, times the share of clean rows."""
    weighted = 0.60 * chunk + 0.25 * coord + 0.15 * hierarchy - F.least(F.lit(0.20), 0.5 * source_only)
    return F.greatest(F.lit(0.0), weighted) * (1 - garbage)


def coverage_status(score: Column, garbage: Column) -> Column:
    return F.when(garbage > 0.1, "dirty").when(score > 0.95, "ready").otherwise("incomplete")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, size: int, seed: int) -> DataFrame:
    """A sample of a size with each stratum's share by largest remainders; within a stratum by a seeded hash."""
    counts = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))  # one row for each stratum stands here, not the rows
    quota = counts.withColumn("_exact", F.lit(size) * F.col("_n") / total).withColumn("_whole", F.floor("_exact"))
    left = F.lit(size) - F.sum("_whole").over(Window.partitionBy(F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_exact") - F.col("_whole")), *strata))
    quota = quota.withColumn("_quota", F.least(F.col("_n"), F.col("_whole") + F.when(nth <= left, 1).otherwise(0))).select(*strata, "_quota")
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.join(quota, strata).withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= F.col("_quota")).drop("_nth", "_quota")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
