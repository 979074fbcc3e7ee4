"""A corpus pipeline of five operators: each stage works on all that the stage before it kept.

All stages but the last return the columns of documents, with any further ones that are carried along. Columns that a stage
needs meanwhile have names that its input doesn't hold. Rows that one stage removes don't reach the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexine.llm import line_dedup, ngram_join, packing, quality_rules, secret_scan
from codexine.llm.common import blank, cut, fresh_path, table, unused

#: The stages can't all be expressed in SQL; tests hold run() against the stages' definitions.
ORACLE_SQL = None


def _sized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns named, with n_chars of the text as it is now; of a null text it stays as it was."""
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A row is known by id, language and text, as ids may be null or repeated."""
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    doc_id, lang, text = (unused(docs, f"gone_{x}") for x in ("id", "lang", "text"))
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id), F.col("lang").alias(lang), F.col("text_key").alias(text)).distinct()
    same = docs["doc_id"].eqNullSafe(gone[doc_id]) & docs["lang"].eqNullSafe(gone[lang]) & (F.xxhash64(blank("text")) == gone[text])
    return docs.join(gone, same, "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of lines go, and documents of which nothing is left."""
    n_lines, n_removed = line_dedup.added(docs)
    out = line_dedup.dedup(docs).filter((F.col(n_removed) < F.col(n_lines)) | (F.col(n_lines) == 0))
    return _sized(out, docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the first by id, null ids last, and of equal ids by text.

    Rows that share id and text are one document, of which one row stays; rows that share an id alone are several."""
    doc_id, kept_text, text, nth = (unused(docs, x) for x in ("kept", "kept_text", "text", "nth"))
    kept = ngram_join.join(docs).filter("is_first").select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(kept_text)).distinct()
    rows = docs.withColumn(text, F.xxhash64(blank("text")))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept[doc_id]) & (rows[text] == kept[kept_text]), "left_semi")
    # Spark keeps the first of each before it shuffles, so many equal rows don't meet in a task.
    first = F.row_number().over(Window.partitionBy("doc_id", text).orderBy("lang", "source", "n_chars"))
    return rows.withColumn(nth, first).filter(F.col(nth) == 1).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the names of their kinds."""
    found = secret_scan.scan(docs, fresh_path(spark, "ledger"), begin=True)
    out = secret_scan.redact(docs, cut(found.select("blob", "findings").filter(F.size("findings") > 0).distinct(), "found"))
    return _sized(out, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_copies), ("secret scans", secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
