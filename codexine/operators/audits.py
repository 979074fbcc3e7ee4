"""Audits of what was extracted: structure, references, questions, pages and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, text
from ..functions.text import col

#: Headings of articles, clauses and points at the start of a line: fixed values.
UNITS = {"article": r"(?imu)^Điều\s+(\d+[a-z]*)", "clause": r"(?m)^\s*(\d+)\.\s+[A-ZÀ-Ỹ]", "point": r"(?m)^\s*([a-zđ])\)\s+[A-ZÀ-Ỹ]"}
INTENTS = ("DEFINITION", "SIGN_MEANING", "PENALTY", "PROCEDURE", "EXCEPTION", "TECHNICAL_SPEC")
DIFFICULTIES = ("easy", "medium", "hard")


def expected_units(rows: DataFrame, by: list[str], body: str = "text") -> DataFrame:
    """by, unit, value: the distinct articles, clauses and points that texts spell out."""
    named = F.array(*[F.struct(F.lit(k).alias("unit"), F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(p), 1).alias("values")) for k, p in UNITS.items()])
    return rows.select(*by, F.explode(named).alias("_u")).select(*by, "_u.unit", F.explode("_u.values").alias("value")).distinct()


def extracted_units(records: DataFrame, by: list[str]) -> DataFrame:
    """The same of records' references, without placeholders; articles in upper case, points in lower."""
    value = {"article": F.upper("article"), "clause": F.col("clause"), "point": F.lower("point")}
    named = F.array(*[F.struct(F.lit(k).alias("unit"), F.when(~cleaning.is_garbage(k), v).alias("value")) for k, v in value.items()])
    return records.select(*by, F.explode(named).alias("_u")).select(*by, "_u.unit", "_u.value").filter("value IS NOT NULL").distinct()


def coordinate(article="article", clause="clause", point="point") -> Column:
    """Darticle|Kclause|Ppoint without placeholders; null if all are missing."""
    part = lambda c: F.when(cleaning.is_garbage(c), "").otherwise(F.trim(F.col(c)))
    a, k, p = part(article), part(clause), part(point)
    return F.when(F.concat(a, k, p) != "", F.concat(F.lit("D"), a, F.lit("|K"), k, F.lit("|P"), p))


def unit_coverage(expected: DataFrame, found: DataFrame, by: list[str], first: int = 20) -> DataFrame:
    """by, unit, expected, found, coverage, and the first missing values."""
    hit = expected.join(found.select(*by, "unit", "value").withColumn("_hit", F.lit(1)), [*by, "unit", "value"], "left")
    missing = hit.filter("_hit IS NULL").withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "unit").orderBy(F.length("value"), "value"))).filter(F.col("_nth") <= first)
    few = missing.groupBy(*by, "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "value"))), lambda x: x["value"]).alias("missing"))
    counts = hit.groupBy(*by, "unit").agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found"))
    out = counts.join(few, [*by, "unit"], "left")
    return out.withColumn("coverage", F.col("found") / F.col("expected")).withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def text_mismatches(records: DataFrame, body: str, digest: str) -> DataFrame:
    """Records whose text no longer has the hash that was kept with it."""
    return records.filter(F.col(body).isNotNull() & F.col(digest).isNotNull() & (F.sha2(body, 256) != F.col(digest)))


def records_by_file(records: DataFrame, by: str = "document") -> DataFrame:
    """Counts of a file's records: all, kinds, bad and garbled references, texts that aren't in their source, and short ones.

    records: record_type, document, chapter, article, clause, point, source, extracted."""
    bad = cleaning.is_garbage("document") | (cleaning.is_garbage("article") & cleaning.is_garbage("clause") & cleaning.is_garbage("point"))
    garbled = F.size(cleaning.garbage_fields("document", "chapter", "article", "clause", "point"))
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    source, own = norm("source"), norm("extracted")
    judged = (F.col("record_type") != "source_legal_unit") & (source != "") & (own != "")
    return records.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("record_type") == "source_legal_unit").alias("source_only"), F.count_if(bad).alias("bad_references"), F.sum(garbled).alias("garbled_values"),
        F.count_if(judged & ~F.contains(source, own)).alias("not_in_source"), F.count_if(judged & (F.length(own) < F.length(source) * 0.5)).alias("very_short"),
    )


def questions_by_file(pairs: DataFrame, chunks: DataFrame, by: str = "document") -> DataFrame:
    """Counts of a file's questions: all, duplicates, bad kinds and difficulties, missing citations, quotes that aren't in their chunk, chunks without questions.

    pairs: document, chunk, question, intent, difficulty, citation, quote, answer. chunks: document, chunk, text."""
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), r"\s+", " ")))
    source = chunks.groupBy(by, "chunk").agg(F.first("text", True).alias("text"))
    full = pairs.withColumn("_q", norm).join(source, [by, "chunk"], "left")
    strict = (F.length(F.trim(F.coalesce("quote", F.lit("")))) >= 8) & (F.length(F.trim(F.coalesce("answer", F.lit("")))) >= 15) & F.coalesce(F.contains(text.canonical_quote("text"), text.canonical_quote("quote")), F.lit(False))
    counts = full.groupBy(by).agg(
        F.count(F.lit(1)).alias("questions"), (F.count(F.lit(1)) - F.count_distinct("_q")).alias("duplicates"), F.count_if(~F.coalesce(F.col("intent").isin(*INTENTS), F.lit(False))).alias("bad_intents"),
        F.count_if(~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False))).alias("bad_difficulties"), F.count_if(F.trim(F.coalesce("citation", F.lit(""))) == "").alias("missing_citations"), F.count_if(~strict).alias("bad_quotes"),
    )
    bare = source.join(pairs.select(by, "chunk").distinct(), [by, "chunk"], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("chunks_without"))
    return counts.join(bare, by, "left").fillna(0, ["chunks_without"])


def pages_by_document(pages: DataFrame, by: str = "document") -> DataFrame:
    """pages, avg_text_len, text_rich_ratio, low_text_ratio, image_heavy_ratio, images_per_page and the engine that reads such a document best.

    pages: text_len, images. A name that says so, with many images, means signs (ocr); good and poor pages mixed mean both (hybrid)."""
    counts = pages.groupBy(by).agg(
        F.count(F.lit(1)).alias("pages"), F.avg("text_len").alias("avg_text_len"), F.avg((F.col("text_len") >= 500).cast("int")).alias("text_rich_ratio"), F.avg((F.col("text_len") < 80).cast("int")).alias("low_text_ratio"),
        F.avg(((F.col("images") > 0) & (F.col("text_len") < 250)).cast("int")).alias("image_heavy_ratio"), F.avg("images").alias("images_per_page"),
    )
    return counts.withColumn("sign_heavy", sign_heavy(F.col(by))).withColumn("mixed", ~F.col("sign_heavy") & mixed()).withColumn("scanned", scanned()).withColumn("engine", F.when(F.col("sign_heavy"), "ocr").when(F.col("mixed"), "hybrid").when(F.col("scanned"), "ocr").otherwise("text"))


def sign_heavy(name: Column) -> Column:
    return text.contains_any(F.lower(name.cast("string")), ("qcvn", "51-bgtvt")) & (F.col("image_heavy_ratio") >= 0.20) & (F.col("images_per_page") >= 5)


def mixed() -> Column:
    return (F.col("text_rich_ratio") >= 0.30) & (F.col("low_text_ratio") >= 0.15)


def scanned() -> Column:
    """Whether a document's pages need to be read from their images."""
    good = (F.col("avg_text_len") >= 500) | (F.col("text_rich_ratio") >= 0.30)
    return F.col("sign_heavy") | (~good & ((F.col("low_text_ratio") > 0.15) | (F.col("image_heavy_ratio") > 0.25)))


def has_header(rows: Column) -> Column:
    """Whether a table's first row is a header: at least half of its cells hold letters, and at most half are numbers."""
    first = F.filter(F.get(rows, F.lit(0)), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    half = F.floor(F.size(first) / 2)
    letters, numbers = F.size(F.filter(first, lambda c: c.rlike("[A-Za-zÀ-ỹ]"))), F.size(F.filter(first, lambda c: c.rlike(r"^[\d\s.,/%-]+$")))
    return F.coalesce((F.size(rows) >= 2) & (F.size(first) > 0) & (letters >= F.greatest(F.lit(1), half)) & (numbers <= half), F.lit(False))


def table_parts(rows) -> Column:
    """headers and rows of a table: the first row as headers if it looks like one."""
    rows = col(rows)
    head = has_header(rows)
    return F.struct(F.when(head, F.get(rows, F.lit(0))).otherwise(F.array().cast("array<string>")).alias("headers"), F.when(head, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows).alias("rows"))


def has_merged_cells(rows) -> Column:
    return F.exists(col(rows), lambda r: F.exists(r, lambda c: c.isNull()))


def tables_of_chunks(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """chunk, table: tables on a chunk's pages whose first cell stands in its text, unless a table is most of the chunk; where the
    chunk has a place (y_from, y_to), also tables that begin within it. chunks: document, chunk, page_start, page_end, text;
    tables: document, table, page, text, and y (null if unknown). They meet on pages, never as a product."""
    pages = chunks.withColumn("page", F.explode(F.sequence("page_start", F.greatest(F.coalesce("page_end", "page_start"), "page_start"))))
    both = pages.join(tables.withColumnRenamed("text", "_t"), ["document", "page"])
    cell = F.substring(F.trim(F.get(F.split(F.lower("_t"), r"\|", 2), F.lit(0))), 1, 30)
    inside = (cell != "") & F.contains(F.lower("text"), cell)
    near = F.coalesce(F.col("y").between(F.col("y_from") - 10, F.col("y_to") + 150), F.lit(False))
    fits = (F.coalesce("_t", F.lit("")) != "") & ((F.length("text") == 0) | (F.length("_t") <= F.length("text") * 0.7))
    return both.filter(fits & (inside | near)).select("chunk", "table").distinct()


def caption_quality(name, mode) -> Column:
    """How good a sign's caption is: its length, more from a band, less for a bare code, an exception or two words."""
    body = F.trim(F.coalesce(col(name), F.lit("")))
    lower = F.lower(body)
    score = F.length(body) + F.when(col(mode) == "appendix_band", 80).otherwise(0) - F.when(lower.rlike(r"(?iuU)\bbiển\s+số\s+(?:dp|ie|p|w|r|i|s|e)\s*\.?\s*\d"), 60).otherwise(0)
    score = score - F.when(text.contains_any(lower, ("chỉ là", "trường hợp", "không áp dụng", "ví dụ")), 50).otherwise(0) - F.when(F.size(F.split(body, r"\s+")) < 3, 25).otherwise(0)
    starts = F.lit(False)
    for prefix in ("làn đường", "hết làn đường", "hướng đi", "biển gộp", "kết thúc", "đường dành"):
        starts = starts | lower.startswith(prefix)
    return F.when(body == "", -100).otherwise(score + F.when(starts, 30).otherwise(0))


def best_captions(assets: DataFrame) -> DataFrame:
    """code, image, name, source of each distinct code and image, with the code's best name, or one made of the code.

    assets: code, image, name, mode."""
    rows = assets.withColumn("code", F.regexp_replace("code", r"\s+", "")).filter("code <> ''").withColumn("_q", caption_quality("name", "mode"))
    best = rows.groupBy("code").agg(F.max_by(F.struct("name", "mode", "_q"), F.struct("_q", "name")).alias("_b"))
    once = rows.groupBy("code", "image").agg(F.max("_q").alias("_q"))
    name = F.trim(F.coalesce("_b.name", F.lit("")))
    return once.join(best, "code").select("code", "image", F.when(name == "", F.concat(F.lit("Biển số "), "code")).otherwise(name).alias("name"), F.when(name == "", "code_fallback").otherwise(F.col("_b.mode")).alias("source"))


def gate(checks: DataFrame) -> DataFrame:
    """n_failed and the names of the checks (name, passed) that failed, in order."""
    return checks.agg(F.count_if(~F.coalesce("passed", F.lit(False))).alias("n_failed"), F.array_sort(F.array_compact(F.collect_set(F.when(~F.coalesce("passed", F.lit(False)), F.col("name"))))).alias("failed"))


def topic_counts(rows: DataFrame, topics: dict[str, tuple[str, ...]], body: str = "text") -> DataFrame:
    """topic, n: rows whose folded text holds one of the topic's terms."""
    found = rows.select(F.explode(F.array_compact(F.array(*[F.when(text.contains_any(text.fold(body), terms), F.lit(name)) for name, terms in topics.items()]))).alias("topic"))
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
