"""Intermediate tables in the folder that driver and executors share, and tables of versions that replace one another."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a session within one process makes one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codexine-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path for an intermediate table, in a folder of the application's own."""
    folder = f"{shared_root(spark)}/codexine-{spark.sparkContext.applicationId}"
    if folder not in _made:
        _made.add(folder)
        atexit.register(_remove_at_exit, spark, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no earlier stage."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    system, where = _system(spark, path)
    system.delete(where, True)


def release(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application. Results that still read them must be written before."""
    for folder in [f for f in _made if f.endswith(spark.sparkContext.applicationId)]:
        remove(spark, folder)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        if spark.sparkContext._jsc is not None:
            remove(spark, folder)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's folders."""
    system, where = _system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()] if system.exists(where) else []


def _rename(spark: SparkSession, made: str, path: str) -> bool:
    """Gives a whole folder its name; False if another has it."""
    system, where = _system(spark, path)
    if system.exists(where):
        if system.exists(_system(spark, f"{path}/_SUCCESS")[1]):
            return False
        system.delete(where, True)
    return system.rename(_system(spark, made)[1], where)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table: those whose job has ended, as its marker says."""
    system, where = _system(spark, path)
    if not system.exists(where):
        return []
    found = []
    for status in system.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and system.exists(_system(spark, f"{path}/{name}/_SUCCESS")[1]):
            found.append(int(name[1:]))
    return sorted(found)


def current(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The last whole version of a table, or None if there is none."""
    known = versions(spark, path)
    if not known:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/v{known[-1]:09d}")


def replace(df: DataFrame, path: str, keep: int = 2) -> None:
    """Writes df, which may read the table itself, as the table's next version. A job that fails leaves the last version as it
    was, as a version counts only when its job has ended; then all but the last few go. A table has one writer at a time; a
    second one that ends first is an error here."""
    spark = df.sparkSession
    known = versions(spark, path)
    new = known[-1] + 1 if known else 0
    made = f"{path}/v{new:09d}.{uuid.uuid4().hex}"
    df.write.parquet(made)
    if not _rename(spark, made, f"{path}/v{new:09d}"):
        remove(spark, made)
        raise RuntimeError(f"another job wrote version {new} of {path}")
    for old in [*known, new][:-keep]:
        remove(spark, f"{path}/v{old:09d}")
