"""Records: expansion to one row for each modality, metadata, merging, and rows of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text

TABLE = "struct<id:string,page:int,headers:array<string>,rows:array<array<string>>,note:string>"
FIGURE = "struct<id:string,code:string,name:string,page:int,image_path:string>"
RECORD = f"id string, doc_name string, source_chunk_id string, article string, clause string, point string, text string, fine_min long, fine_max long, sign_codes array<string>, tables array<{TABLE}>, figures array<{FIGURE}>"


def metadata(modality: Column) -> Column:
    """The flags that filters use, of every modality."""
    return F.struct(
        F.coalesce("source_chunk_id", "id").alias("source_chunk_id"),
        F.col("doc_name").alias("doc"),
        "article",
        "clause",
        "point",
        modality.alias("modality"),
        (F.size(F.coalesce("sign_codes", F.array().cast("array<string>"))) > 0).alias("has_sign"),
        (F.col("fine_min").isNotNull() | F.col("fine_max").isNotNull()).alias("has_penalty"),
        (F.size(F.coalesce("tables", F.array().cast(f"array<{TABLE}>"))) > 0).alias("has_table"),
        (F.size(F.coalesce("figures", F.array().cast(f"array<{FIGURE}>"))) > 0).alias("has_figure"),
        text.contains_any(F.lower(F.coalesce("text", F.lit(""))), text.PROCEDURE_TERMS).alias("has_procedure"),
    )


def expand(records: DataFrame) -> DataFrame:
    """One row for each record's text, each of its tables, figures and sign codes without a figure: id, parent_id, modality, rag_text, metadata."""
    none = lambda kind: F.array().cast(kind)
    tables = F.transform(F.coalesce("tables", none(f"array<{TABLE}>")), lambda t, i: F.struct(F.concat(F.lit("table_"), F.coalesce(t["id"], i.cast("string"))).alias("part"), F.lit("table").alias("modality"), table_text(t["headers"], t["rows"], t["note"]).alias("rag_text")))
    figures = F.transform(
        F.coalesce("figures", none(f"array<{FIGURE}>")),
        lambda f, i: F.struct(F.concat(F.lit("figure_"), F.coalesce(f["id"], i.cast("string"))).alias("part"), F.when(F.coalesce(f["code"], F.lit("")) != "", "sign").otherwise("figure").alias("modality"), F.concat_ws(": ", f["code"], f["name"]).alias("rag_text")),
    )
    known = F.transform(F.coalesce("figures", none(f"array<{FIGURE}>")), lambda f: text.normalize_sign_code(f["code"]))
    bare = F.array_except(F.transform(F.coalesce("sign_codes", none("array<string>")), text.normalize_sign_code), known)
    signs = F.transform(bare, lambda c: F.struct(F.concat(F.lit("sign_"), c).alias("part"), F.lit("sign").alias("modality"), c.alias("rag_text")))
    body = F.array(F.struct(F.lit("text").alias("part"), F.lit("text").alias("modality"), F.coalesce("text", F.lit("")).alias("rag_text")))
    rows = records.select("*", F.explode(F.concat(body, tables, figures, signs)).alias("_p"))
    return rows.select(F.when(F.col("_p.part") == "text", F.col("id")).otherwise(F.concat_ws("::", "id", "_p.part")).alias("id"), F.col("id").alias("parent_id"), F.col("_p.modality").alias("modality"), F.col("_p.rag_text").alias("rag_text"), metadata(F.col("_p.modality")).alias("metadata"))


def table_text(headers, rows, note=None) -> Column:
    padded = arrays.pad_rows(rows)
    lines = F.transform(padded, lambda r: arrays.row_text(F.coalesce(headers, F.array().cast("array<string>")), r))
    return F.concat_ws("\n", note if note is not None else F.lit(None).cast("string"), F.array_join(lines, "\n"))


def table_rows(records: DataFrame) -> DataFrame:
    """id, table, row_index, row_text of every row of every table."""
    tables = records.select("id", F.posexplode("tables").alias("table", "t"))
    rows = tables.select("id", "table", F.col("t.headers").alias("headers"), F.posexplode(arrays.pad_rows("t.rows")).alias("row_index", "row"))
    return rows.select("id", "table", "row_index", arrays.row_text(F.coalesce("headers", F.array().cast("array<string>")), "row").alias("row_text"))


def filtered(rows: DataFrame, documents=None, modality=None, **flags: bool) -> DataFrame:
    """Rows of expand() whose metadata meet all filters, before anything is ranked."""
    out = rows
    if documents:
        out = out.filter(F.col("metadata.doc").isin(*documents))
    if modality:
        out = out.filter(F.col("modality") == modality)
    for flag, wanted in flags.items():
        if wanted:
            out = out.filter(F.col(f"metadata.{flag}"))
    return out


def merge_assets(rows: DataFrame, key: str, sets: list[str], score: str = "score", bonus: float = 0.05) -> DataFrame:
    """Rows of a key as one: unions of arrays, the greatest score plus a part of the least."""
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(s, F.array().cast("array<string>")))))).alias(s) for s in sets]
    merged = (F.max(score) + F.when(F.count(F.lit(1)) > 1, bonus * F.min(score)).otherwise(F.lit(0.0))).alias(score)
    return rows.groupBy(key).agg(merged, *unions)


def penalty_issues(records: DataFrame) -> DataFrame:
    """id, issue: least amounts above the greatest, and organisations' greatest far from twice that of individuals."""
    pairs = (("min_amount", "max_amount"), ("individual_min", "individual_max"), ("organization_min", "organization_max"))
    found = [F.when(F.col(a) > F.col(b), F.lit(f"{a} > {b}")) for a, b in pairs if a in records.columns and b in records.columns]
    ratio = F.when(F.abs(F.col("organization_max") - 2 * F.col("individual_max")) > 0.15 * F.col("individual_max"), F.lit("organization_ratio"))
    return records.select("id", F.explode(F.array_compact(F.array(*found, ratio))).alias("issue"))
