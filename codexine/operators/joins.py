"""Joins: by levels of a reference, by prefix, of intervals, as of a place, in tiers, and the outer and anti kinds.

None of these is a cross join: theta conditions are given an equality on a bucket or a level first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def level_join(probes: DataFrame, rows: DataFrame, levels: list[list[str]], first_only: bool = False) -> DataFrame:
    """Probes meet rows at every level (a list of key columns, the most special first), as one union of equal joins.

    A level takes part for probes that have all of its keys. first_only keeps a probe's first level that finds rows.
    probes have probe_id; the result has probe_id, level and the columns of rows, each row once per probe at its first level."""
    found = []
    for k, keys in enumerate(levels):
        full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in keys])
        found.append(probes.filter(full).select("probe_id", *keys).join(rows, keys).withColumn("level", F.lit(k)).select("probe_id", "level", *rows.columns))
    out = reduce(DataFrame.unionByName, found)
    if first_only:
        return first_tier(out, ["probe_id"], "level")
    return out.groupBy("probe_id", *rows.columns).agg(F.min("level").alias("level"))


def first_tier(rows: DataFrame, by: list[str], tier: str) -> DataFrame:
    """The rows of each group's least tier."""
    least = rows.groupBy(*by).agg(F.min(tier).alias(tier))
    return rows.join(least, [*by, tier], "left_semi")


def prefix_join(probes: DataFrame, rows: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Rows whose leading keys equal the probe's; a probe's blank keys match anything, and only trailing ones may be blank.

    One equal join for each number of keys that probes give."""
    given = reduce(lambda a, b: a + b, [F.when(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "", 1).otherwise(0) for k in keys])
    found = []
    for n in range(1, len(keys) + 1):
        found.append(probes.filter(given == n).select("probe_id", *keys[:n]).join(rows, keys[:n]).select("probe_id", *rows.columns))
    return reduce(DataFrame.unionByName, found).dropDuplicates(["probe_id", id_column])


def interval_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, by: list[str] = (), width: int = 64) -> DataFrame:
    """Points within spans, ends included, by an equal join on buckets of the axis that spans are dealt to.

    A span costs a row for each bucket that it touches, so width should be about a usual span."""
    bucketed = spans.filter(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    rows = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return rows.join(bucketed, [*by, "_bucket"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_bucket")


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """For each row of left the values of the last row of right that isn't after it: both sides are one ordered sequence,
    and the last row of right is carried forward. The work is a sort, whatever the number of rows that could match."""
    own = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(_kind(right, values)).alias("_value"))
    other = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"))
    order = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return own.unionByName(other).withColumn("_value", F.last("_value", True).over(order)).filter("_side = 1").select("_row.*", *[F.col(f"_value.{v}").alias(v) for v in values])


def _kind(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("x")).schema["x"].dataType


def coalesce_join(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], bad) -> DataFrame:
    """Left outer join that puts right's value where left's is bad, and lists the repaired columns."""
    renamed = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = left.join(renamed, on, "left")
    fixed = [F.when(bad(F.col(c)) & F.col(f"_r_{c}").isNotNull(), F.lit(c)) for c in columns]
    out = out.withColumn("repaired", F.array_compact(F.array(*fixed)))
    for c in columns:
        out = out.withColumn(c, F.when(bad(F.col(c)), F.coalesce(F.col(f"_r_{c}"), F.col(c))).otherwise(F.col(c)))
    return out.drop(*[f"_r_{c}" for c in columns])


def parent_join(rows: DataFrame, keys: list[str], own: str, is_parent: Column, values: list[str]) -> DataFrame:
    """Each child with the values of its group's parent row (the least by own, if there are several)."""
    parents = rows.filter(is_parent).groupBy(*keys).agg(F.min_by(F.struct(*values), own).alias("_parent"))
    return rows.filter(~is_parent).join(parents, keys, "left").select(rows.columns + [F.col(f"_parent.{v}").alias(f"parent_{v}") for v in values])


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], left_id: str, at: str, right_at: str, within: int, values: list[str]) -> DataFrame:
    """Each row of left with the nearest row of right within a distance, ties to the lesser place, then the lesser values.

    Both sides are one ordered sequence within buckets of that width: the last place before a row and the first one behind it
    are carried to it, or are the ends of the buckets beside its own. So no row meets all of a bucket."""
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, at]])
    own = left.filter(fine).select(*by, F.col(left_id).alias("_id"), F.col(at).alias("_at"), F.floor(F.col(at) / within).alias("_b"))
    places = right.select(*by, F.col(right_at).alias("_at"), F.struct(*values).alias("_v")).filter(F.col("_at").isNotNull()).groupBy(*by, "_at").agg(F.min("_v").alias("_v"))
    places = places.select(*by, "_at", F.floor(F.col("_at") / within).alias("_b"), F.struct("_at", "_v").alias("_p"))
    kind = places.schema["_p"].dataType
    both = own.withColumns({"_side": F.lit(1), "_p": F.lit(None).cast(kind)}).unionByName(places.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    group = Window.partitionBy(*by, "_b")
    carried = lambda order: F.last("_p", True).over(group.orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"_before": carried(F.asc("_at")), "_behind": carried(F.desc("_at"))}).filter("_side = 1").drop("_side", "_p")
    ends = places.groupBy(*by, "_b").agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))
    met = met.join(ends.select(*by, (F.col("_b") + 1).alias("_b"), "_last"), [*by, "_b"], "left").join(ends.select(*by, (F.col("_b") - 1).alias("_b"), "_first"), [*by, "_b"], "left")
    near = F.transform(F.array_compact(F.array("_before", "_behind", "_last", "_first")), lambda p: F.struct(F.abs(F.col("_at") - p["_at"]).alias("_d"), p["_at"].alias("_at"), p["_v"].alias("_v")))
    best = met.select("_id", F.array_min(F.filter(near, lambda p: p["_d"] <= within)).alias("_best")).filter(F.col("_best").isNotNull())
    best = best.groupBy(F.col("_id").alias(left_id)).agg(F.min("_best").alias("_best"))
    return left.join(best, left_id).select(*left.columns, F.col("_best._d").alias("distance"), *[F.col(f"_best._v.{v}").alias(f"near_{v}") for v in values])


def linked_anti(rows: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no link points at."""
    return rows.join(links.select(*keys).distinct(), keys, "left_anti")


def contained(sets: DataFrame, held: DataFrame, set_id: str, held_id: str, words: str) -> DataFrame:
    """set_id, held_id of the distinct words of sets that stand whole in those of held. They meet by the one word of a set that the
    fewest of held have; what meets is then compared. Empty sets are in none."""
    own = cut(held.select(held_id, F.array_distinct(words).alias("_held")), "held")
    each = own.select(held_id, F.explode("_held").alias("_w"))
    asked = cut(sets.select(set_id, F.array_distinct(words).alias("_asked")).filter(F.size("_asked") > 0), "asked")
    named = asked.select(set_id, F.explode("_asked").alias("_w"))
    often = cut(each.join(named.select("_w").distinct(), "_w", "left_semi").groupBy("_w").agg(F.count(F.lit(1)).alias("_n")), "often")
    # A word that nobody has makes its set one that is in none.
    rarest = named.join(often, "_w", "left").groupBy(set_id).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_w")).alias("_m"))
    key = rarest.filter("_m._n > 0").select(set_id, F.col("_m._w").alias("_w"))
    met = key.join(each, "_w").select(set_id, held_id).join(asked, set_id).join(own, held_id)
    return met.filter(F.size(F.array_except("_asked", "_held")) == 0).select(set_id, held_id)
