"""Line dedup by overlapping three-line windows.

Lines that hold a word are compared after trimming and joining their white space. Every run of three such lines of a
document is a window, hashed; a document of one or two lines is one window. A window that also stands earlier, by
document and place, is covered; covered windows are merged, and their lines removed, with the blank lines between them.

Defined cases: a null text stays null and has no lines; a text without words stays; the first of equal windows stays,
by doc_id (null ids come last), then by place, then by text for rows of equal ids; rows that are equal in all of those
are one row here and stay together; an empty table gives no rows; other columns are carried along unread, whatever their
names: columns that are needed meanwhile, and the two that are added, have names that the input doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank, cut, table, unused

LINES = 3


def _words(line):
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def _has_words(line):
    return line.rlike(r"\S")


def windows(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """_ld_id, _ld_text (a hash), at, until, a, b of every window: its lines' places, up to the next line that has a word, and two hashes.

    A document's work is linear in its lines: a window is a struct of numbers before it becomes a row."""
    rows = documents.select(F.col("doc_id").alias("_ld_id"), F.xxhash64(blank("text")).alias("_ld_text"), F.split(blank("text"), "\n", -1).alias("line"))
    rows = rows.withColumn("kept", F.filter(F.transform("line", lambda x, i: F.struct(i.alias("at"), _words(x).alias("line"))), lambda x: x["line"] != "")).filter(F.size("kept") > 0)
    rows = rows.select("_ld_id", "_ld_text", "kept", F.size("line").alias("end"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("kept") - lines, F.lit(0)))
    content = lambda i: F.array_join(F.transform(F.slice("kept", i + 1, F.lit(lines)), lambda x: x["line"]), "\n")

    def window(i):
        text = content(i)
        until = F.coalesce(F.get(F.col("kept"), i + lines)["at"], F.col("end"))
        return F.struct(F.get(F.col("kept"), i)["at"].alias("at"), until.alias("until"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("window"), text).alias("b"))

    return rows.select("_ld_id", "_ld_text", F.explode(F.transform(starts, window)).alias("w")).select("_ld_id", "_ld_text", "w.*")


def repeated(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """_ld_id, _ld_text (a hash) and _ld_gone of documents that lose lines: the places of the lines that go."""
    # Without an id a row comes after those that have one.
    place = F.struct(F.col("_ld_id").isNull().alias("none"), F.col("_ld_id").alias("id"), F.col("_ld_text").alias("text"), "at")
    rows = cut(windows(documents, lines), "windows").withColumn("place", place)
    first = rows.groupBy("a", "b").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # As a table of its own, so that Spark may split the join where one window is very common.
    later = rows.join(cut(first, "first"), ["a", "b"]).filter(~F.col("place").eqNullSafe(F.col("first")))
    spans = later.groupBy("_ld_id", "_ld_text").agg(F.collect_set(F.struct("at", "until")).alias("spans"))
    return spans.select("_ld_id", "_ld_text", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["until"] - 1)))).alias("_ld_gone"))


def added(documents: DataFrame) -> tuple[str, str]:
    """The names of the columns that dedup adds: _ld_lines and _ld_removed, with more underscores if the input has those."""
    return unused(documents, "ld_lines"), unused(documents, "ld_removed")


def dedup(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """documents with text changed, and the columns that added() names: lines with a word, before and of them removed."""
    n_lines, n_removed = added(documents)
    own_id, own_text, gone, key, every = (unused(documents, f"ld_{x}") for x in ("id", "text", "gone", "key", "all"))
    lost = repeated(documents, lines).select(F.col("_ld_id").alias(own_id), F.col("_ld_text").alias(own_text), F.col("_ld_gone").alias(gone))
    rows = documents.withColumn(key, F.xxhash64(blank("text")))
    on = rows["doc_id"].eqNullSafe(lost[own_id]) & (rows[key] == lost[own_text])
    rows = rows.join(lost.hint("shuffle_hash"), on, "left").drop(own_id, own_text, key)
    rows = rows.withColumn(every, F.split(blank("text"), "\n", -1))
    worded = lambda places: F.size(F.filter(places, lambda i: _has_words(F.get(F.col(every), i))))
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone)
    text = F.array_join(F.transform(left, lambda i: F.get(F.col(every), i)), "\n")
    rows = rows.withColumn(n_lines, F.size(F.filter(every, _has_words)).cast("long")).withColumn(n_removed, F.when(F.col(gone).isNull(), F.lit(0)).otherwise(worded(gone)).cast("long"))
    return rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(text)).drop(gone, every)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    n_lines, n_removed = added(documents)
    return dedup(documents).select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.coalesce("text", F.lit("")).alias("text"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS line, unnest(l) AS raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM lines WHERE line <> ''
), windows AS (
  SELECT doc_id, k, n, line || coalesce(chr(10) || lead(line, 1) OVER w, '') || coalesce(chr(10) || lead(line, 2) OVER w, '') AS content
  FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS nth FROM windows WHERE k <= greatest(n - 2, 1)) WHERE nth > 1
), gone AS (
  SELECT DISTINCT kept.doc_id, kept.pos FROM kept JOIN later ON kept.doc_id = later.doc_id AND kept.k BETWEEN later.k AND later.k + 2
), marked AS (
  SELECT lines.*, gone.pos IS NOT NULL AS is_gone,
    coalesce(last_value(CASE WHEN lines.line <> '' THEN gone.pos IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY lines.doc_id ORDER BY lines.pos ROWS UNBOUNDED PRECEDING), false) AS cutting
  FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.pos = lines.pos
)
SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE is_gone) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT cutting), '') AS text
FROM marked GROUP BY doc_id
"""
