"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast after they were counted.
BROADCAST_ROWS = 10_000
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a session within one process makes a
    temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codexine-")
        sc.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no earlier stage."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a broadcast of small if it was counted and has at most so many rows, by a shuffle otherwise.

    small must be cheap to read twice, such as a cut table."""
    few = len(small.select(F.lit(1)).take(rows + 1)) <= rows
    return big.join(F.broadcast(small) if few else small, on, how)


def blank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str, folds: int, fold: int) -> Column:
    """True if crc32 of the id as text leaves the remainder fold; a null id counts as the empty text."""
    return (F.crc32(blank(column)) % folds) == fold


def arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, with the session's batches of at most BATCH_BYTES: a batch is whole in the executor and in its Python worker.

    The rows of a batch are limited by the session's own setting besides. A row is never split, so the longest text still counts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    most = conf.get(name).rstrip("b")
    if not most.isdigit() or int(most) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't hold, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
