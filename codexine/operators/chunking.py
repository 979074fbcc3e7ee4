"""Structural chunks of statutory text: lines, headings, carried levels, islands and their ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import cut
from . import windows

#: Headings, anchored at a line's start, as references within a line aren't headings. A point's letter is lower case.
CHAPTER = r"(?iu)^\s*(?:#\s*)?(?:chương|chuong)\s+([ivxlcdm\d]+)\b"
ARTICLE = r"(?iu)^\s*(?:#\s*)?(?:điều|dieu)\s+(\d+[a-z]*)\b"
CLAUSE = r"(?u)^\s*(?:Khoản\s+)?(\d+)[.)-]\s+"
POINT = r"^\s*([a-zđ])[).]\s+"
#: Numbered headings of technical regulations, of at most three numbers; parts, chapters and appendixes.
SECTION = r"(?u)^\s*(?:#\s*)?(\d+(?:\.\d+){0,2})\.?\s+\p{Lu}"
APPENDIX = r"(?iu)^\s*(?:#\s*)?phụ\s+lục\s+([a-zđ\d]+)\b"
#: An article may go so far on, or back, from the last one; other numbers are references.
FORWARD, BACK = 5, 2


def lines(pages: DataFrame, doc: str = "doc", page: str = "page", body: str = "text") -> DataFrame:
    """doc, line_no (a sortable place), page, line of every line with text; a heading word alone is joined to the next line."""
    alone = lambda x: F.lower(F.trim(x)).isin("điều", "khoản", "chương")
    full = F.filter(F.split(F.coalesce(F.col(body), F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    # Each line looks at the one before it, so the page is taken apart once and not for every line.
    stitched = text.let(full, lambda split: F.transform(split, lambda x, i: F.when((i > 0) & alone(F.get(split, i - 1)), F.concat_ws(" ", F.trim(F.get(split, i - 1)), F.trim(x))).otherwise(x)))
    kept = F.filter(stitched, lambda x: ~alone(x))
    return pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(kept).alias("_at", "line")).select("doc", F.struct("page", "_at").alias("line_no"), "page", "line")


def _match(pattern: str) -> Column:
    found = F.regexp_extract("line", pattern, 1)
    return F.when(found != "", found)


def plausible_articles(rows: DataFrame) -> DataFrame:
    """rows (doc, page, line_no, number and more) with the number only of the article headings that follow the last accepted one
    closely. Only headings are dealt to documents, not lines, and they are read in order: a task holds the last one, whatever a
    document's size."""

    def run(batches):
        first, doc, last = True, None, None
        for batch in batches:
            numbers = []
            for own, n in zip(batch.column("doc").to_pylist(), batch.column("number").to_pylist(), strict=True):
                if first or own != doc:
                    first, doc, last = False, own, None
                number = int(n) if n.isdigit() else None
                fine = number is None or last is None or last - BACK <= number <= last + FORWARD
                numbers.append(n if fine else None)
                if fine:
                    last = number
            at = batch.schema.get_field_index("number")
            yield batch.set_column(at, batch.schema.field(at), pa.array(numbers, batch.schema.field(at).type))

    heads = rows.filter("number is not null").repartition("doc").sortWithinPartitions("doc", F.asc_nulls_last("page"), "line_no._at")
    return rows.filter("number is null").unionByName(heads.mapInArrow(run, rows.schema))


def decree_chunks(pages: DataFrame, **columns: str) -> DataFrame:
    """One row for each article, clause or point: id, doc, kind, chapter, article, title, clause, point, pages, text, context."""
    rows = lines(pages, **columns).withColumns({"chapter": _match(CHAPTER), "number": F.lower(_match(ARTICLE)), "clause": _match(CLAUSE), "point": _match(POINT)})
    rows = plausible_articles(cut(rows, "lines")).withColumnRenamed("number", "article")
    inside = F.col("chapter").isNull() & F.col("article").isNull()
    rows = rows.withColumns({"clause": F.when(inside, F.col("clause")), "point": F.when(inside & F.col("clause").isNull(), F.col("point"))})
    rows = rows.withColumn("title", F.when(F.col("article").isNotNull(), F.trim(F.regexp_replace("line", ARTICLE + r"[.:]?\s*", ""))))
    begins = F.coalesce("chapter", "article", "clause", "point").isNotNull()
    rows = windows.islands(rows, ["doc"], ["line_no"], begins)
    rows = windows.carry_forward(rows, ["doc"], ["line_no"], ["chapter", "article", "clause", "point"])
    # A title belongs to the island of its heading; children find it by article.
    parts = rows.groupBy("doc", "island").agg(
        *[F.max(c).alias(c) for c in ("chapter", "article", "clause", "point", "title")],
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"),
    )
    # Texts are cleaned once, for the filter, the titles and the chunks.
    parts = cut(parts.withColumn("text", text.clean_text("raw")).drop("raw"), "parts").filter("text <> ''")
    kind = F.when(F.col("point").isNotNull(), "point").when(F.col("clause").isNotNull(), "clause").when(F.col("article").isNotNull(), "article").otherwise("preamble")
    parts = parts.withColumn("kind", kind).withColumn("id", chunk_id("doc", "article", "clause", "point", "text"))
    titles = parts.filter("kind = 'article'").groupBy("doc", "chapter", "article").agg(F.min_by(F.struct("title", F.col("text").alias("preamble")), "island").alias("_t"))
    renamed = titles.withColumnsRenamed({"doc": "_d", "chapter": "_c", "article": "_a"})
    same = (F.col("doc") == F.col("_d")) & F.col("chapter").eqNullSafe(F.col("_c")) & (F.col("article") == F.col("_a"))
    out = parts.drop("title").join(renamed, same, "left")
    context = F.when(F.col("kind").isin("clause", "point"), F.col("_t.preamble"))
    return out.select("id", "doc", "island", "kind", "chapter", "article", F.col("_t.title").alias("title"), "clause", "point", "page_start", "page_end", "text", F.coalesce(context, F.lit("")).alias("context"))


def chunk_id(doc: str, article: str, clause: str, point: str, body: str) -> Column:
    """document_article_clause_point_hash, with 0 for what is missing, in lower case without dots."""
    parts = [F.col(doc), *[F.coalesce(F.col(c), F.lit("0")) for c in (article, clause, point)], F.substring(F.sha2(F.col(body), 256), 1, 6)]
    return F.replace(F.replace(F.lower(F.concat_ws("_", *parts)), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def regulation_chunks(pages: DataFrame, least_words: int = 3, **columns: str) -> DataFrame:
    """Sections of technical regulations by numbered headings and appendixes: doc, section, page_start, page_end, text. Heading
    lines stay in the text, so provisions of one line aren't lost."""
    rows = lines(pages, **columns)
    heading = F.coalesce(F.when(_match(APPENDIX).isNotNull(), F.concat(F.lit("PL "), F.upper(_match(APPENDIX)))), _match(SECTION))
    rows = windows.islands(rows.withColumn("section", heading), ["doc"], ["line_no"], F.col("section").isNotNull())
    parts = rows.groupBy("doc", "island").agg(
        F.max("section").alias("section"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    return parts.filter(F.size(F.split(F.trim("text"), r"\s+")) >= least_words)


def document_kind(name: str) -> Column:
    """Which chunker a document needs, by its folded name."""
    q = text.fold(name)
    return F.when(text.contains_any(q, ("qcvn", "quy chuan")), "regulation").when(text.contains_any(q, ("nghi dinh", "nd-cp")), "decree").when(text.contains_any(q, ("thong tu",)), "circular").otherwise("law")


def overview(chunks: DataFrame, first: int = 20) -> DataFrame:
    """doc, n_articles, n_chapters and the first missing article numbers of each document."""
    from . import aggregates

    articles = chunks.filter("kind = 'article'")
    numbers = articles.select("doc", F.expr("try_cast(article as int)").alias("number"))
    gaps = aggregates.missing_numbers(numbers, ["doc"], "number", first)
    return articles.groupBy("doc").agg(F.countDistinct("article").alias("n_articles"), F.countDistinct("chapter").alias("n_chapters")).join(gaps, "doc", "left")
