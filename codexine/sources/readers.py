"""Readers: JSON arrays, wrapped case files, line files, graphs, pages and manifests. All go through Spark's readers, so any
store that Spark can open will do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def json_records(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """Files of one JSON array each as rows; files that can't be read are skipped, values of another type become null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None, limit: int | None = None) -> DataFrame:
    """One JSON object a line; blank lines are left out."""
    reader = spark.read.schema(schema) if schema else spark.read
    out = reader.json(path)
    return out.limit(limit) if limit is not None else out


def cases(spark: SparkSession, path: str, schema: str, wrappers: tuple[str, ...] = ("cases", "records", "data", "items")) -> DataFrame:
    """Rows of files that hold a JSON array, or an object with the array under the first of some names."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    plain = F.when(F.col("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>"))
    wrapped = F.from_json("value", ", ".join(f"{w} array<struct<{schema}>>" for w in wrappers))
    rows = F.coalesce(plain, *[wrapped[w] for w in wrappers])
    return whole.select(F.explode(rows).alias("row")).select("row.*")


def many_cases(spark: SparkSession, specs: str, schema: str, limit: int | None = None) -> DataFrame:
    """Files given as one text with commas: line files by their suffix, others as cases()."""
    parts = [json_lines(spark, p, schema) if p.endswith(".jsonl") else cases(spark, p, schema) for p in (x.strip() for x in specs.split(",")) if p]
    out = reduce(DataFrame.unionByName, parts)
    return out.limit(limit) if limit is not None else out


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def graph(spark: SparkSession, path: str, node: str, edge: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files {"nodes": [...], "edges": [...]}; a file of another kind has none."""
    whole = spark.read.schema(f"nodes array<struct<{node}>>, edges array<struct<{edge}>>").option("multiLine", True).json(path)
    return whole.select(F.explode("nodes").alias("n")).select("n.*"), whole.select(F.explode("edges").alias("e")).select("e.*")


def manifest(spark: SparkSession, path: str, version: str) -> DataFrame:
    """path, size, modified and a signature of every file, for caches that must follow their inputs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.withColumn("signature", F.substring(F.sha2(F.concat_ws("|", F.lit(version), "path", "size", F.col("modified").cast("string")), 256), 1, 16))


def html_text(column: str = "html"):
    """The text of a page: without scripts and tags, with the five named entities put back."""
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_items(tag: str, column: str = "html"):
    """The contents of a tag's elements, without inner tags."""
    found = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " ")))


def page_stats(text: str = "text"):
    """text_len, word_count, low_text and a quality label of a page's text."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    return F.struct(size.alias("text_len"), F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(\S+)"), 1)).alias("word_count"), (size < 80).alias("low_text"))
