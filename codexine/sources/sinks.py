"""Writers: keyed upserts, partitioned tables, reports and line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key of both tables: the first in an order, rows of new before equal ones of old."""
    rows = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), True)
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order, "_age"))).filter("_nth = 1").drop("_nth", "_age")


def with_priority(rows: DataFrame, kind: str = "record_type") -> DataFrame:
    """Enriched rows come before legacy ones, and those before units that only quote their source."""
    return rows.withColumn("priority", F.when(F.col(kind) == "enriched_rule", 3).when(F.col(kind) == "source_legal_unit", 1).otherwise(2))


def without_fallbacks(rows: DataFrame, chunk: str = "source_chunk_id", kind: str = "record_type", status: str = "enrichment_status", keep: str = "source_table_preserved") -> DataFrame:
    """Drops quoting units whose chunk has an enriched row, unless their status says to keep them."""
    enriched = rows.filter(F.col(kind) == "enriched_rule").select(chunk).distinct().withColumn("_has", F.lit(True))
    fallback = (F.col(kind) == "source_legal_unit") & ~F.col(status).eqNullSafe(keep)
    return rows.join(enriched, chunk, "left").filter(~(fallback & F.coalesce("_has", F.lit(False)))).drop("_has")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), files_by: str | None = None) -> None:
    """Overwrites a path that df doesn't read. A job that fails leaves it incomplete; where that matters, tables.replace keeps versions."""
    out = df.repartition(files_by) if files_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str, condition, review_path: str) -> None:
    """All rows to one place, those that meet a condition also to another."""
    df.write.mode("overwrite").json(path)
    df.filter(condition).write.mode("overwrite").json(review_path)


def foreach_partition(df: DataFrame, connect, send, batch: int = 500) -> None:
    """Hands rows to an injected client in batches, one connection a partition; send must be an upsert, as tasks may run again."""

    def run(rows):
        client, held = connect(), []
        for row in rows:
            held.append(row.asDict(True))
            if len(held) >= batch:
                send(client, held)
                held = []
        if held:
            send(client, held)

    df.foreachPartition(run)
