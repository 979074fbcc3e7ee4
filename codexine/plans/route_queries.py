"""Queries of the routes: questions on traffic, each before the whole text of a benchmark item, over statutes made out of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decompose, planner, rounds, routes, scoring
from .registry import SQL, fold, query
from .statute_queries import _REC, asked, statutes


def corpus(orders):
    """Statutes with their kind as modality, a sign's code for some, and an image for others."""
    modality = F.when(F.col("kind") == "5-LOW", "table").when(F.col("kind") == "4-NOT SPECIFIED", "sign").otherwise("text")
    codes = F.when(F.col("id") % 50 == 0, F.array(F.lit("P.102"), F.concat(F.lit("W."), (200 + F.col("id") % 40).cast("string")))).otherwise(F.array().cast("array<string>"))
    images = F.when(F.col("id") % 4 == 0, F.array(F.concat(F.lit("page-"), F.col("id").cast("string"), F.lit(".png")))).otherwise(F.array().cast("array<string>"))
    return statutes(orders).select("id", F.col("text").alias("rag_text"), "document", "article", "clause", "point", modality.alias("modality"), codes.alias("sign_codes"), images.alias("images"))


def _route(name: str):
    def run(orders, benchmark):
        return routes.ROUTES[name](corpus(orders), asked(benchmark)).select("query_id", "id", "rank", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))

    run.__name__ = f"route_{name}"
    run.__doc__ = f"Rows only: the route of {name} for every question; tests hold it against a plain search."
    return query("orders", "benchmark")(run)


for _name in ("penalty", "table", "definition", "procedure", "priority", "scenario", "source_image"):
    _route(_name)

@query(
    "orders", "benchmark",
    sql=f"""WITH {_REC}, q AS (SELECT item_id AS query_id FROM benchmark WHERE item_id % 8 = 3),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY clause, point, id) AS rank FROM q, rec WHERE article = '6' AND document = 'Nghị định 168/2024/NĐ-CP')
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, CAST(120 - rank AS DOUBLE) AS score FROM h WHERE rank <= 40""",
)
def route_legal_detail(orders, benchmark):
    return routes.legal_rows(corpus(orders), asked(benchmark)).select("query_id", "id", "rank", "score")


@query(
    "orders", "benchmark",
    sql=f"""WITH {_REC}, q AS (SELECT item_id AS query_id FROM benchmark WHERE item_id % 8 = 3), a AS (SELECT article, min(id) AS id FROM rec WHERE document = 'Nghị định 168/2024/NĐ-CP' GROUP BY 1),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY article) AS rank FROM q, a) SELECT query_id, id, CAST(rank AS INTEGER) AS rank, CAST(100 - rank AS DOUBLE) AS score FROM h""",
)
def route_document_overview(orders, benchmark):
    return routes.overview(corpus(orders), asked(benchmark)).select("query_id", "id", "rank", "score")


@query(
    "orders", "benchmark",
    sql=f"""WITH {_REC} SELECT item_id AS query_id, id FROM benchmark JOIN rec ON id % 50 = 0 WHERE item_id % 8 = 5""",
)
def route_sign(orders, benchmark):
    """All rows of the codes that questions name."""
    return routes.coded(corpus(orders), asked(benchmark)).select("query_id", "id")


@query("benchmark")
def expanded_questions(benchmark):
    """Rows only: questions with their synonyms, behaviours, documents and terms; tests hold them against worked examples."""
    rows = asked(benchmark)
    return rows.select("query_id", F.md5(scoring.expanded("question")).alias("expanded")).join(routes.prepared(rows).select("query_id", "behaviours", "meant", "terms"), "query_id")


@query("benchmark", sql="SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'fines' WHEN 1 THEN 'frequency' WHEN 2 THEN 'points' ELSE 'suspension' END AS kind FROM benchmark")
def aggregation_kinds(benchmark):
    said = F.expr("CASE item_id % 4 WHEN 0 THEN 'Mức phạt nào cao nhất' WHEN 1 THEN 'Điều nào hay vi phạm nhất' WHEN 2 THEN 'Hành vi nào bị trừ điểm nhiều nhất' ELSE 'Các hành vi bị tước bằng lái' END")
    return benchmark.select(F.col("item_id").alias("query_id"), routes.aggregation_kind(F.concat_ws(" ", said, "text")).alias("kind"))


@query("benchmark")
def rerank_gate(benchmark):
    """Rows only: whether a model would rerank a question's hits."""
    rows = asked(benchmark).withColumn("f", planner.facets("question")).withColumn("s", decompose.complexity("question", F.col("f"), F.size("f")))
    return rows.select("query_id", scoring.should_rerank("question").alias("unknown"), scoring.should_rerank("question", planner.difficulty(F.col("s")), "s").alias("known"))


@query("orders", "benchmark")
def search_rounds(orders, benchmark):
    """Rows only: every question searched in rounds until nothing is open; tests hold it against a plain loop."""
    hits, _ = rounds.search(corpus(orders), asked(benchmark))
    return hits.withColumn("score", F.round("score", 6))


_NINE = "CASE item_id % 9 WHEN 0 THEN 'Mức phạt nào cao nhất' WHEN 1 THEN 'Điều nào hay vi phạm nhất' WHEN 2 THEN 'Hành vi nào bị trừ điểm nhiều nhất' WHEN 3 THEN 'Danh sách hành vi bị tước giấy phép lái xe' WHEN 4 THEN 'Mức phạt nào thấp nhất' WHEN 5 THEN 'Trừ điểm ít nhất bao nhiêu' WHEN 6 THEN 'Điều nào vi phạm phổ biến nhất' WHEN 7 THEN 'Toàn bộ hành vi bị tước bằng lái' ELSE 'xyz' END"
_KIND = "CASE item_id % 9 WHEN 0 THEN 'fines' WHEN 1 THEN 'frequency' WHEN 2 THEN 'points' WHEN 3 THEN 'suspension' WHEN 4 THEN 'fines' WHEN 5 THEN 'points' WHEN 6 THEN 'frequency' WHEN 7 THEN 'suspension' ELSE 'unsupported' END"


@query(
    "orders", "benchmark",
    sql=f"""
WITH {_REC}, q AS (SELECT item_id AS query_id, {_KIND} AS kind, item_id % 9 IN (4, 5) AS least FROM benchmark),
o AS (SELECT document, article, count(*) AS n, min(id) AS id FROM rec WHERE contains({fold("text")}, 'phat') OR contains({fold("text")}, 'vi pham') GROUP BY 1, 2),
a AS ({SQL["fine_amounts"]}),
r AS (
 SELECT 'frequency' AS kind, false AS least, row_number() OVER (ORDER BY n DESC, document, article) AS rank, document || ', Điều ' || article AS label, id, CAST(n AS DOUBLE) AS value FROM o QUALIFY rank <= 12
 UNION ALL SELECT 'fines', false, row_number() OVER (ORDER BY amount_max DESC, id) AS rank, 'Điều ' || article, id, CAST(amount_max AS DOUBLE) FROM a WHERE amount_max > 0 QUALIFY rank <= 12
 UNION ALL SELECT 'fines', true, row_number() OVER (ORDER BY amount_min, id) AS rank, 'Điều ' || article, id, CAST(amount_min AS DOUBLE) FROM a WHERE amount_min > 0 QUALIFY rank <= 12
 UNION ALL SELECT 'points', false, rank, '', id, CAST(points AS DOUBLE) FROM ({SQL["point_ranking"]}) UNION ALL SELECT 'points', true, rank, '', id, CAST(points AS DOUBLE) FROM ({SQL["fewest_points"]})
 UNION ALL SELECT 'suspension', false, row_number() OVER (ORDER BY act_id, act || ': ' || suspension) AS rank, act || ': ' || suspension, act_id, NULL FROM ({SQL["suspension_catalog"]})
)
SELECT query_id, kind, CAST(rank AS INTEGER) AS rank, label, id, value FROM q LEFT JOIN r USING (kind, least) WHERE kind = 'unsupported' OR rank IS NOT NULL
""",
)
def aggregation_answers(orders, benchmark):
    """The statistic that each question asks for, over all statutes."""
    questions = benchmark.select(F.col("item_id").alias("query_id"), F.expr(_NINE).alias("question"))
    return routes.aggregation(statutes(orders), questions)
