"""Search in rounds: the parts of questions are searched, what is still open becomes further parts, until nothing is open.

Questions are a table, and so are their parts and what was found: a round searches the new parts of all questions at once.
A question is done when a round brings it no new part, or its parts are used up. Each round's tables are written, so a lost
executor costs no round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import index
from ..sources.tables import cut
from . import decompose, planner, scoring

#: What is asked for a gap: the facet, and the words that are put behind the question.
FOLLOW_UPS = {
    "speed": ("penalty", "mức phạt chạy quá tốc độ"), "vehicle": ("penalty", "mức phạt"), "amount": ("penalty", "số tiền phạt, trừ điểm, tước giấy phép"),
    "sign": ("sign", "biển báo, ký hiệu"), "source_image": ("source_image", "hình ảnh trong văn bản"),
}
VEHICLES = {"car": "xe ô tô", "motorbike": "xe mô tô, xe gắn máy", "specialized": "xe máy chuyên dùng", "bicycle": "xe đạp, xe thô sơ"}
#: The part that a question without any hit gets.
FALLBACK = 99


def retriever(rows: DataFrame, id_column: str = "id", text_column: str = "rag_text") -> Callable[[DataFrame, int], DataFrame]:
    """A lexical search of probes (query_id, question), whose index is made once for all rounds."""
    find = index.search_index(rows, id_column, text_column)

    def search(probes: DataFrame, k: int) -> DataFrame:
        return index.top_k(find(index.query_tokens(probes, "query_id", "question"), k), k).select("query_id", "id", "score")

    return search


def slots_of(questions: DataFrame, most: int) -> DataFrame:
    """query_id, priority, facet, query: the parts of questions (query_id, question), each as a question of its own."""
    parts = decompose.parts(questions, "query_id", "question", most).join(questions.select("query_id", "question"), "query_id")
    named = F.create_map(*[F.lit(x) for pair in VEHICLES.items() for x in pair])
    detail = F.coalesce(named[F.col("detail")], F.col("detail"))
    return parts.select("query_id", "priority", "facet", F.trim(F.concat_ws(" ", "question", detail)).alias("query"))


def follow_ups(questions: DataFrame, gaps: DataFrame, slots: DataFrame) -> DataFrame:
    """query_id, priority, facet, query of what gaps (query_id, kind, detail, place) ask for, behind the parts that there are."""
    named = F.create_map(*[F.lit(x) for pair in VEHICLES.items() for x in pair])
    facet, words = (F.create_map(*[F.lit(x) for kind, said in FOLLOW_UPS.items() for x in (kind, said[k])]) for k in (0, 1))
    last = slots.groupBy("query_id").agg(F.max("priority").alias("_last"))
    rows = gaps.join(questions.select("query_id", "question"), "query_id").join(last, "query_id", "left")
    query = F.trim(F.concat_ws(" ", "question", named[F.col("detail")], words[F.col("kind")]))
    return rows.select("query_id", (F.coalesce("_last", F.lit(0)) + F.col("place") + 1).cast("int").alias("priority"), facet[F.col("kind")].alias("facet"), query.alias("query"))


def repairs(questions: DataFrame, answers: DataFrame, gaps: DataFrame, slots: DataFrame, most: int = 8) -> DataFrame:
    """Further parts of questions (query_id, question, facets) whose answers (query_id, answer) leave something open: what the search left
    open, and the amount of a penalty that the answer doesn't name. Questions that only count something have none."""
    counted = F.array_contains("facets", "aggregation") & ~F.array_contains("facets", "penalty")
    open_ = questions.join(answers, "query_id").filter(~counted & decompose.unresolved("answer", "question", F.col("facets")))
    silent = scoring.is_penalty(text.fold("question")) & ~text.contains_any(text.fold("answer"), ("dong", "vnd"))
    amount = open_.filter(silent).select("query_id", F.lit("amount").alias("kind"), F.lit("").alias("detail"), F.lit(most).alias("place"))
    both = gaps.select("query_id", "kind", "detail", "place").join(open_.select("query_id"), "query_id", "left_semi").unionByName(amount)
    once = both.groupBy("query_id", "kind", "detail").agg(F.min("place").alias("place"))
    kept = once.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "kind", "detail"))).filter(F.col("_nth") <= most).drop("_nth")
    return follow_ups(questions, kept, slots)


def _slot(query_id: Column) -> Column:
    return F.concat_ws("|", query_id.cast("string"), "facet", F.md5(text.fold("query")))


def search(
    rows: DataFrame, questions: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame] | None = None, rounds: int = 3, most_slots: int = 18, per_slot: int = 6, contexts: int = 24,
) -> tuple[DataFrame, DataFrame]:
    """hits (query_id, id, score, facet, place, rank) of questions (query_id, question), and their parts (query_id, place, facet, query, round,
    n_rows).

    rows: id, rag_text, document, article, images. retrieve(probes, k): query_id, id, score; the lexical search if it isn't given.
    A question has most_slots parts at most, and contexts hits; one without any hit is searched once more as a whole."""
    retrieve = retrieve or retriever(rows)
    asked = cut(questions.select("query_id", "question", planner.facets("question").alias("facets")), "questions")
    body = rows.select("id", "document", "article", F.col("rag_text").alias("text"), "images")
    columns = ["query_id", "priority", "facet", "query"]
    first = slots_of(asked, most_slots)
    slots = cut(decompose.appended(first, first.limit(0), "query_id", most_slots).select(*columns, F.lit(0).alias("round")), "slots")
    found, pending = None, slots
    for n in range(rounds):
        probes = pending.withColumn("slot", _slot(F.col("query_id")))
        hits = retrieve(probes.select(F.col("slot").alias("query_id"), F.col("query").alias("question")), per_slot).withColumnRenamed("query_id", "slot")
        hits = hits.join(probes.select("slot", *columns), "slot").select(*columns, "id", "score")
        found = cut(hits if found is None else found.unionByName(hits), "found")
        if n + 1 == rounds:
            break
        gaps = decompose.gaps(asked, found.join(body, "id"))
        new = follow_ups(asked, gaps, slots)
        grown = decompose.appended(slots.select(columns), new, "query_id", most_slots).select(columns)
        known = slots.select(F.col("query_id").alias("_q"), F.col("facet").alias("_f"), text.fold("query").alias("_t"))
        fresh = grown.join(known, (F.col("query_id") == F.col("_q")) & (F.col("facet") == F.col("_f")) & (text.fold("query") == F.col("_t")), "left_anti")
        pending = cut(fresh.withColumn("round", F.lit(n + 1)), "pending")
        if not pending.take(1):
            break
        slots = cut(slots.unionByName(pending), "slots")
    empty = asked.join(found.select("query_id").distinct(), "query_id", "left_anti")
    if empty.take(1):
        whole = retrieve(empty.select("query_id", "question"), max(per_slot, contexts))
        more = whole.join(empty.select("query_id", F.col("question").alias("query")), "query_id")
        found = cut(found.unionByName(more.select("query_id", F.lit(FALLBACK).alias("priority"), F.lit("general").alias("facet"), "query", "id", "score")), "found")
        slots = slots.unionByName(empty.select("query_id", F.lit(FALLBACK).alias("priority"), F.lit("general").alias("facet"), F.col("question").alias("query"), F.lit(-1).alias("round")))
    placed = cut(slots.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "facet", "query"))), "placed")
    keys = ["query_id", "facet", "query"]
    hits = decompose.merged(found.drop("priority").join(placed.select(*keys, "place"), keys).select("query_id", "id", "score", "facet", "place"), contexts)
    n_rows = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return hits, placed.join(n_rows, keys, "left").select("query_id", "place", "facet", "query", "round", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
