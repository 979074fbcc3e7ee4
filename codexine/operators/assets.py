"""Images, tables and figures of records, and the projections of records that callers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, references, text
from ..functions.text import col, let


def image_paths(*sources: Column) -> Column:
    """The distinct paths of several arrays and single paths, in their order, without blank ones."""
    arrays = [F.coalesce(s, F.array().cast("array<string>")) for s in sources]
    return F.array_distinct(F.filter(F.transform(F.concat(*arrays), lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != ""))


def context_images(hits: DataFrame, limit: int = 80) -> DataFrame:
    """query_id, image, rank: the images of each query's hits as served, each once: signs first, then what was searched for its
    image, figures and tables, whole articles, and others. hits: query_id, rank, modality, facet, reasons, images."""
    whole = F.exists(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: F.contains(r, F.lit("legal_detail")) | F.contains(r, F.lit("document_overview")))
    base = F.when(F.col("modality") == "sign", 0).when(F.col("facet") == "source_image", 10).when(F.col("modality").isin("figure", "table"), 20).when(whole, 35).otherwise(50)
    rows = hits.select("query_id", (base + F.col("rank") - 1).alias("_p"), F.posexplode("images").alias("_at", "_path")).withColumn("image", cleaning.asset_path("_path")).filter("image <> ''")
    once = rows.groupBy("query_id", "image").agg(F.min(F.struct("_p", "_at")).alias("_first"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_first", "image"))).filter(F.col("rank") <= limit).drop("_first")


def figures_for_record(figures, codes) -> Column:
    """The figures of the codes that a record names; all if none has one of them."""
    own = F.filter(col(figures), lambda f: F.array_contains(F.transform(col(codes), text.normalize_sign_code), text.normalize_sign_code(f["code"])))
    return F.array_distinct(F.when(F.size(own) > 0, own).otherwise(col(figures)))


def tables_for_record(tables) -> Column:
    """The distinct tables that have an id."""
    return F.array_distinct(F.filter(col(tables), lambda t: F.coalesce(t["id"], F.lit("")) != ""))


def figures_of_pages(figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, figure: figures on a chunk's pages; where the chunk names codes, only figures of these. Each once.

    figures: document, figure, page, code; chunks: document, chunk, page_start, page_end, codes."""
    from . import joins

    both = joins.interval_join(figures, chunks, "page", "page_start", "page_end", ["document"], 8)
    fits = (F.size(F.coalesce("codes", F.array().cast("array<string>"))) == 0) | F.array_contains("codes", text.normalize_sign_code("code"))
    return both.filter(F.coalesce(fits, F.lit(False))).select("chunk", "figure").distinct()


def first_records(hits: DataFrame, limit: int) -> DataFrame:
    """Each query's first hits, one for each chunk, or id, or reference. hits: query_id, rank, chunk, id, reference (a struct)."""
    key = F.coalesce(F.nullif("chunk", F.lit("")), F.nullif("id", F.lit("")), F.to_json("reference"))
    once = hits.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))).filter("_nth = 1").drop("_nth")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).filter(F.col("place") <= limit)


def allowed(values, known: tuple[str, ...]) -> Column:
    """The distinct values of an array that are allowed, in their order."""
    return F.array_distinct(F.filter(col(values), lambda v: v.isin(*known)))


def distinct_folded(values) -> Column:
    """The values of an array, cleaned, each once by its folded form, in their order."""
    clean = F.filter(F.transform(col(values), lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", " "))), lambda v: v != "")
    return F.filter(clean, lambda v, i: F.array_position(F.transform(clean, text.fold), text.fold(v)) == i + 1)


def merged_lines(*arrays: Column) -> Column:
    """References of lines (structs of line and more) of several arrays, each once, by line."""
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def reference_rows(hits: DataFrame) -> DataFrame:
    """What a caller sees of a hit: its reference in words, document, modality, images as served, reasons, score and an excerpt.

    hits: query_id, rank, id, chunk, document, section, chapter, article, clause, point, modality, images, reasons, score, text."""
    images = F.transform("images", cleaning.asset_path)
    return hits.select(
        "query_id", "rank", F.col("chunk").alias("source_chunk_id"), text.format_reference("point", "clause", "article", "section", "chapter", "document").alias("reference_text"), F.col("document").alias("doc_name"), "modality",
        F.coalesce(F.get(images, F.lit(0)), F.lit("")).alias("image"), images.alias("images"), "reasons", "score", text.snippet("text", 900).alias("excerpt"),
    )


def normalized_reference(chunk, reference: Column, prefer=None) -> Column:
    """A record's reference with the article, clause and point that its chunk's id spells out, unless the record says to keep its own."""
    own = text.chunk_ref(chunk)
    part = lambda k: F.coalesce(F.nullif(own[k], F.lit("")), reference[k])
    mended = F.struct(reference["document"].alias("document"), part("article").alias("article"), part("clause").alias("clause"), part("point").alias("point"))
    plain = F.struct(*[reference[k].alias(k) for k in ("document", "article", "clause", "point")])
    return mended if prefer is None else F.when(F.coalesce(col(prefer), F.lit(False)), plain).otherwise(mended)


def index_text(reference, context, body) -> Column:
    """What an index reads of a record: its reference, its context and its text."""
    parts = F.filter(F.array(col(reference), col(context), col(body)), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.trim(F.array_join(parts, "\n"))


def penalty_summary(main_min, main_max, person_min, person_max) -> Column:
    """The least and greatest fine, from either of two schemas."""
    some = lambda a, b: F.coalesce(F.nullif(col(a), F.lit(0)), F.nullif(col(b), F.lit(0)))
    return F.struct(some(main_min, person_min).alias("fine_min"), some(main_max, person_max).alias("fine_max"))


def evidence_rows(hits: DataFrame) -> DataFrame:
    """Distinct pairs of reference and summary of each query's usable hits, best first. hits: query_id, id, reference, summary, score."""
    rows = hits.filter(cleaning.usable_snippet("summary"))
    one = Window.partitionBy("query_id", text.fold("reference"), text.fold(F.substring("summary", 1, 220))).orderBy(F.desc("score"), "id")
    once = rows.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").drop("_nth")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def context_matches(context: Column, expected: Column) -> Column:
    """Whether a context (structs chunk, reference, metadata) stands for an expected reference, by any of its three."""
    ref = lambda r: F.struct(r["document"].alias("document"), r["article"].alias("article"), r["clause"].alias("clause"), r["point"].alias("point"))
    by_chunk = text.chunk_ref(context["chunk"])
    return F.coalesce(references.reference_matches(by_chunk, expected), F.lit(False)) | F.coalesce(references.reference_matches(ref(context["reference"]), expected), F.lit(False))


def contexts_hit(contexts, expected, k: int | None = None) -> Column:
    """1 if one of the first k contexts stands for an expected reference (array of structs), and if none is expected."""
    some = col(contexts) if k is None else F.slice(col(contexts), 1, k)
    hit = F.exists(some, lambda c: F.exists(col(expected), lambda e: context_matches(c, e)))
    return F.when((F.size(col(expected)) == 0) | hit, F.lit(1.0)).otherwise(F.lit(0.0))


def contexts_reciprocal_rank(contexts, expected) -> Column:
    places = F.filter(F.transform(col(contexts), lambda c, i: F.when(F.exists(col(expected), lambda e: context_matches(c, e)), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(col(expected)) == 0, F.lit(1.0)).otherwise(F.coalesce(1.0 / F.array_min(places), F.lit(0.0)))


#: Phrases of texts that a flag holds for: fixed values.
PENALTY_PHRASES = ("phạt tiền", "trừ điểm", "tước quyền", "mức phạt")
PROCEDURE_PHRASES = ("hồ sơ", "thủ tục", "trình tự", "thời hạn")


def modality_flags(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """has_table, has_figure, has_sign, has_penalty, has_procedure of each query's contexts (modality, text, has_penalty of the record)."""
    norm = text.normalize_text("text")
    return hits.groupBy(by).agg(
        F.max(F.col("modality") == "table").alias("has_table"), F.max(F.col("modality") == "figure").alias("has_figure"), F.max(F.col("modality") == "sign").alias("has_sign"),
        F.max(F.coalesce("penal", F.lit(False)) | text.contains_any(norm, PENALTY_PHRASES)).alias("has_penalty"), F.max(text.contains_any(norm, PROCEDURE_PHRASES)).alias("has_procedure"),
    )


def claim_support(answer, claims) -> Column:
    """The share of claims (structs claim, quote) that an answer holds nearly, or whose quote it holds; 1 of none."""
    from . import evaluation

    given = lambda x: F.coalesce(x, F.lit("")) != ""
    held = lambda own, c: evaluation.holds_fuzzy(own, c["claim"], 0.55) | (given(c["quote"]) & evaluation.holds_fuzzy(own, c["quote"], 0.45))
    hits = lambda told: let(evaluation.fuzzy_parts(answer), lambda own: F.size(F.filter(told, lambda c: held(own, c))))
    told = F.filter(col(claims), lambda c: given(c["claim"]))
    return let(told, lambda told: F.when(F.size(told) == 0, F.lit(1.0)).otherwise(hits(told) / F.size(told)))


def markdown(messages: DataFrame, references: int = 30) -> DataFrame:
    """conv_id, markdown: a conversation as a document, its images left out and at most so many references a message.

    messages: conv_id, turn, role, text, refs array<string>."""
    refs = F.transform(F.slice(F.coalesce("refs", F.array().cast("array<string>")), 1, references), lambda r: F.concat(F.lit("- "), r))
    body = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.when(F.size(refs) > 0, F.concat(F.lit("\n\n"), F.array_join(refs, "\n"))).otherwise(""))
    parts = messages.select("conv_id", F.struct("turn", body.alias("body")).alias("_m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_m")).alias("_m"))
    return parts.select("conv_id", F.array_join(F.transform("_m", lambda m: m["body"]), "\n\n").alias("markdown"))
