"""Structured Streaming: incremental upserts, resumable work, and the last turns of each conversation as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import buckets, tables


def pending(rows: DataFrame, done: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows that weren't done yet with this content; done rows of a null digest count for any content."""
    finished = done.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    return rows.join(finished, (rows[key] == finished["_k"]) & (finished["_d"].isNull() | (rows[digest] == finished["_d"])), "left_anti")


def upsert_stream(stream: DataFrame, path: str, key: list[str], order: list, checkpoint: str) -> StreamingQuery:
    """Keeps a table in buckets (sources.buckets) with one row for each key; a batch rewrites the buckets of its keys only. A batch that
    runs again gives the same table, so each row counts once; a batch that fails leaves the last version. A table that is missing
    after the first batch is an error."""

    def apply(batch: DataFrame, number: int) -> None:
        if number > 0 and not tables.versions(batch.sparkSession, f"{path}/manifest"):
            raise FileNotFoundError(f"batch {number} finds no table at {path}")
        buckets.upsert(path, batch, key, order)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enrich_stream(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, key: str, digest: str, checkpoint: str) -> StreamingQuery:
    """Enriches rows whose content the table at path lacks, and appends them."""

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates([key, digest])
        try:
            todo = pending(todo, spark.read.parquet(path).select(key, digest), key, digest)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        enrich(todo).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_turns(stream: DataFrame, n: int = 8, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last n turns of each conversation (conv_id, turn, role, text) after every batch. State is n turns a conversation."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += list(zip(f["turn"], f["role"], f["text"], strict=True))
            held = sorted(held, key=lambda t: t[0])[-n:]
        state.update(tuple(list(x) for x in zip(*held, strict=True)))
        yield pd.DataFrame({"conv_id": key[0], "turn": [t[0] for t in held], "role": [t[1] for t in held], "text": [t[2] for t in held]})

    kept = stream.filter(F.col("role").isin(*roles) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    schema = "conv_id long, turn long, role string, text string"
    return kept.groupBy("conv_id").applyInPandasWithState(run, schema, "turn array<long>, role array<string>, text array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"))
