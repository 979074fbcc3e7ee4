"""Keyed tables in buckets: a set of changes rewrites the buckets that it touches, and no other.

A table is a folder of commits, each with the buckets that it wrote, and a manifest of versions that names the commit of
every bucket. A row's bucket is a hash of its key, its digest one of all its columns; what is new, changed or gone follows
from digests, which are made where rows of a bucket meet and are neither moved nor kept. Rows are moved once, to their
bucket. A version counts when its manifest is whole, so a job that fails leaves the last one. One writer at a time.

Keys may be null; of rows that share a key the first in an order counts, or by digest where no order is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables

BUCKETS = 64
_MANIFEST = "bucket int, name string, buckets int, n long"
_OWN = ("_bucket",)
#: Where a row comes from.
_OLD, _NEW, _GONE = 0, 1, 2


def _manifest(spark: SparkSession, path: str) -> list:
    """One row for each bucket that holds rows."""
    found = tables.current(spark, f"{path}/manifest", _MANIFEST)
    return found.collect() if found is not None else []


def _read(spark: SparkSession, path: str, manifest: list, schema) -> DataFrame:
    folders = [f"{path}/data/{m['name']}/_part={m['bucket']}" for m in manifest if m["name"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _schema(spark: SparkSession, path: str, manifest: list):
    first = next(m for m in manifest if m["name"])
    return spark.read.parquet(f"{path}/data/{first['name']}/_part={first['bucket']}").schema


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if there is none or it never held a row."""
    manifest = _manifest(spark, path)
    if not any(m["name"] for m in manifest):
        return None
    return _read(spark, path, manifest, _schema(spark, path, manifest)).drop(*_OWN)


def _met(rows: DataFrame, key: list[str], order: list, keep_first: bool, whole: bool) -> DataFrame:
    """One row for each key that stays or goes, with its _bucket and _kind, of rows with _bucket and _from."""
    own = [c for c in rows.columns if c not in ("_bucket", "_from")]
    rows = rows.withColumn("_digest", F.unhex(F.sha2(F.to_json(F.struct(*sorted(own)), {"ignoreNullFields": "false"}), 256)))
    by = Window.partitionBy("_bucket", *key)
    # Old rows stand behind new ones, unless the first of both counts; keys that go stand last.
    rank = F.when(F.col("_from") == _GONE, 2).when((F.col("_from") == _OLD) & F.lit(not keep_first), 1).otherwise(0)
    given = lambda what: F.max(F.col("_from") == what).over(by)
    first = rows.withColumns({
        "_nth": F.row_number().over(by.orderBy(rank, *order, "_digest")),
        "_old": F.max(F.when(F.col("_from") == _OLD, F.col("_digest"))).over(by),
        "_new": given(_NEW),
        "_gone": F.lit(True) if whole else given(_GONE),
    }).filter(F.col("_nth") == 1)
    kind = F.when(~F.col("_new"), F.when(F.col("_old").isNull(), "none").when(F.col("_gone"), "deleted").otherwise("kept"))
    kind = kind.when(F.col("_old").isNull(), "inserted").when(F.col("_old") != F.col("_digest"), "updated").otherwise("same")
    return first.select(*own, "_bucket", kind.alias("_kind")).filter("_kind <> 'none'")


def _change(path: str, rows: DataFrame, key: list[str], order: list, buckets: int, gone: DataFrame | None, whole: bool, keep_first: bool) -> dict[str, int]:
    spark = rows.sparkSession
    manifest = _manifest(spark, path)
    buckets = manifest[0]["buckets"] if manifest else buckets
    dealt = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    given = dealt(rows).withColumn("_from", F.lit(_NEW))
    if gone is not None:
        given = given.unionByName(dealt(gone.select(*key)).withColumn("_from", F.lit(_GONE)), allowMissingColumns=True)
    held = manifest
    if manifest and not whole:  # only the buckets of these rows are read
        given = tables.cut(given, "changes")
        touched = {r["_bucket"] for r in given.select("_bucket").distinct().collect()}  # at most as many as there are buckets
        held = [m for m in manifest if m["bucket"] in touched]
    old = _read(spark, path, held, given.drop("_from").schema).withColumn("_from", F.lit(_OLD))
    met = given.unionByName(old) if held else given
    met = tables.cut(_met(met.repartition(buckets, "_bucket"), key, order, keep_first, whole), "met")
    found = met.groupBy("_bucket", "_kind").agg(F.count(F.lit(1)).alias("n")).collect()  # five rows a bucket at most
    out = {k: sum(r["n"] for r in found if r["_kind"] == k) for k in ("inserted", "updated", "deleted", "same")}
    changed = sorted({r["_bucket"] for r in found if r["_kind"] not in ("same", "kept")})
    out["buckets"] = len(changed)
    if not changed:
        return out
    sizes = {b: sum(r["n"] for r in found if r["_bucket"] == b and r["_kind"] != "deleted") for b in changed}
    name = uuid.uuid4().hex
    if any(sizes.values()):
        # A bucket's rows lie in one file of what met, so they are written as they are read.
        body = met.filter(F.col("_bucket").isin(changed) & (F.col("_kind") != "deleted")).drop("_kind").withColumn("_part", F.col("_bucket"))
        body.sortWithinPartitions("_part").write.partitionBy("_part").parquet(f"{path}/data/{name}")
    entries = [tuple(m) for m in manifest if m["bucket"] not in changed] + [(b, name if n else "", buckets, n) for b, n in sizes.items()]
    tables.replace(spark.createDataFrame(entries, _MANIFEST).coalesce(1), f"{path}/manifest")
    return out


def sync(path: str, rows: DataFrame, key: list[str], gone: DataFrame | None = None, whole: bool = False, order: list = (), buckets: int = BUCKETS) -> dict[str, int]:
    """Brings rows in by key and takes out the keys of gone (or, whole, all keys that rows lack): inserted, updated, deleted, same, and
    the buckets that were rewritten. A key that is in both stays. buckets counts for a new table only."""
    return _change(path, rows, key, list(order), buckets, gone, whole, False)


def upsert(path: str, rows: DataFrame, key: list[str], order: list, buckets: int = BUCKETS) -> dict[str, int]:
    """Keeps of the table's and the new rows the first in an order for each key. To bring the same rows in again changes nothing."""
    return _change(path, rows, key, list(order), buckets, None, False, True)


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes commits that the last version doesn't name, once nobody reads an earlier one; returns how many."""
    used, n = {m["name"] for m in _manifest(spark, path)}, 0
    for name in tables.folders(spark, f"{path}/data"):
        if name not in used:
            tables.remove(spark, f"{path}/data/{name}")
            n += 1
    return n
