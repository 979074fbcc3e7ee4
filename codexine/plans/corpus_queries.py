"""Queries of chunking, answers, references and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import references, text
from ..operators import aggregates, answers, chunking, index, joins, spatial
from .registry import content, fold, query, tokens


def _pages(lineitem):
    """Statutes out of order lines: a supplier is a document, a part an article, a line number a clause."""
    line = F.concat(F.col("l_linenumber"), F.lit(". Phạt tiền "), F.col("l_orderkey"), F.lit(" đồng đối với hành vi "), "l_returnflag")
    rows = lineitem.select(F.concat(F.lit("NĐ "), "l_suppkey").alias("doc"), F.col("l_partkey").alias("part"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("k"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc", F.col("part").alias("page")).agg(F.concat(F.lit("Điều 1a. Phần "), F.col("page"), F.lit("\n"), body).alias("text"))


_CLAUSE = "l_linenumber || '. Phạt tiền ' || l_orderkey || ' đồng đối với hành vi ' || l_returnflag"
_ARTICLE = "'Điều 1a. Phần ' || l_partkey"
_SUMS = "count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS n_chars, CAST(sum(len(c)) AS BIGINT) AS n_context, min(t) AS first_text, max(t) AS last_text, max(c) AS last_context"


@query("lineitem", sql=f"SELECT 'NĐ ' || l_suppkey AS doc, 'clause' AS kind, {_SUMS} FROM (SELECT l_suppkey, {_CLAUSE} AS t, 'Điều 1a. Phần ' || min(l_partkey) OVER (PARTITION BY l_suppkey) AS c FROM lineitem) GROUP BY 1 UNION ALL SELECT 'NĐ ' || l_suppkey, 'article', {_SUMS} FROM (SELECT DISTINCT l_suppkey, {_ARTICLE} AS t, '' AS c FROM lineitem) GROUP BY 1")
def decree_chunks(lineitem):
    """All articles of a document have one number here, so the first one's heading is the context of every clause."""
    out = chunking.decree_chunks(_pages(lineitem)).groupBy("doc", "kind")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.length("context")).alias("n_context"), F.min("text").alias("first_text"), F.max("text").alias("last_text"), F.max("context").alias("last_context"))


_HEADED = "CASE WHEN doc_id % 3 = 0 THEN 'Phụ lục ' || doc_id % 7 ELSE (doc_id % 9) || '.' || (doc_id % 4) || ' Phần mở đầu' END || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10) || (doc_id % 5) || ' ')"


@query(
    "documents",
    sql=rf"""
WITH t AS (SELECT source AS doc, doc_id AS page, string_split({_HEADED}, chr(10)) AS l FROM documents), l AS (SELECT doc, page, unnest(range(len(l))) AS pos, unnest(l) AS line FROM t),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*(?:#\s*)?[pP][hH][ụỤ]\s+[lL][ụỤ][cC]\s+[a-zA-ZđĐ\d]+\b') THEN 'PL ' || upper(regexp_extract(line, '[cC]\s+([a-zA-ZđĐ\d]+)', 1)) ELSE nullif(regexp_extract(line, '^\s*(?:#\s*)?(\d+(?:\.\d+){{0,2}})\.?\s+\p{{Lu}}', 1), '') END AS head FROM l WHERE trim(line) <> ''),
i AS (SELECT *, count(head) OVER (PARTITION BY doc ORDER BY page, pos ROWS UNBOUNDED PRECEDING) AS island FROM h),
s AS (SELECT doc, island, max(head) AS section, min(page) AS page_start, max(page) AS page_end, string_agg(line, chr(10) ORDER BY page, pos) AS text FROM i GROUP BY 1, 2)
SELECT doc, section, count(*) AS n_sections, min(page_start) AS first_page, max(page_end) AS last_page, CAST(sum(len(text)) AS BIGINT) AS n_chars FROM s WHERE len(string_split_regex(trim(text), '\s+')) >= 3 GROUP BY 1, 2
""",
)
def regulation_chunks(documents):
    """Whole texts as pages of their source: each begins with a heading or an appendix, and its sentences with a number, which is a
    heading where a capital follows."""
    pages = documents.selectExpr("source AS doc", "doc_id AS page", f"{_HEADED} AS text")
    out = chunking.regulation_chunks(pages).groupBy("doc", "section")
    return out.agg(F.count(F.lit(1)).alias("n_sections"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.sum(F.length("text")).alias("n_chars"))


_NAMED = "CASE doc_id % 4 WHEN 0 THEN 'QCVN 41:2024' WHEN 1 THEN 'Nghị định 168/2024/NĐ-CP' WHEN 2 THEN 'Thông tư 35' ELSE 'Luật Đường bộ' END || ' ' || coalesce(text, '')"


@query("documents", sql=f"SELECT doc_id, CASE WHEN contains(f, 'qcvn') OR contains(f, 'quy chuan') THEN 'regulation' WHEN contains(f, 'nghi dinh') OR contains(f, 'nd-cp') THEN 'decree' WHEN contains(f, 'thong tu') THEN 'circular' ELSE 'law' END AS kind FROM (SELECT doc_id, {fold(f'({_NAMED})')} AS f FROM documents)")
def document_router(documents):
    """Documents by the names that stand before their whole texts."""
    return documents.selectExpr("doc_id", f"{_NAMED} AS name").select("doc_id", chunking.document_kind("name").alias("kind"))


@query("documents", sql=r"WITH l AS (SELECT doc_id, unnest(list_distinct([trim(regexp_replace(x, '^\s*(?:[-*+]|\d+[.)])\s*', '')) for x in string_split_regex(coalesce(text, ''), '\r?\n')])) AS line FROM documents) SELECT doc_id, least(count(*), 24) AS n_claims FROM l WHERE len(line) >= 28 AND line NOT LIKE '#%' AND NOT regexp_matches(line, '^[-:|\s]+$') AND len(string_split(line, '|')) < 3 GROUP BY doc_id")
def answer_claims(documents):
    plain = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1), lambda x: F.size(F.split(x, r"\|", -1)) < 3), "\n")
    return documents.select("doc_id", F.size(answers.claims(plain)).cast("long").alias("n_claims")).filter("n_claims > 0")


@query("orders", sql="SELECT o_orderkey, o_orderkey % 7 = o_custkey % 7 AS article, o_orderkey % 7 = o_custkey % 7 OR (o_orderkey % 2 = 0 AND o_orderkey % 7 = o_custkey % 7) AS both FROM orders".replace("AS both", "AS matches"))
def reference_match(orders):
    have = F.struct(F.lit("Nghị định 168/2024/NĐ-CP").alias("document"), F.concat(F.lit("Điều "), (F.col("o_orderkey") % 7).cast("string")).alias("article"), F.lit("2, 3").alias("clause"), F.lit("đ").alias("point"))
    want = F.struct(F.lit("nghi dinh 168").alias("document"), (F.col("o_custkey") % 7).cast("string").alias("article"), F.when(F.col("o_orderkey") % 2 == 0, "3").otherwise("").alias("clause"), F.lit("Đ").alias("point"))
    rows = orders.select("o_orderkey", have.alias("h"), want.alias("w"))
    return rows.select("o_orderkey", references.part_matches("h.article", "w.article").alias("article"), references.reference_matches(F.col("h"), F.col("w")).alias("matches"))


@query("part", sql="SELECT code, CAST(min(CASE WHEN nth = 1 THEN p_name END) AS VARCHAR) AS name, CAST(least(max(nth) - 1, 4) AS INTEGER) AS n_support FROM (SELECT 'P' || (101 + p_partkey % 50) AS code, p_name, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_size DESC, p_partkey) AS nth FROM part) GROUP BY code")
def sign_catalog(part):
    figures = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("p. "), 101 + F.col("p_partkey") % 50).alias("code"), F.col("p_name").alias("name"), F.col("p_size").alias("quality"))
    return answers.sign_catalog(figures).select("code", "name", F.size("support").alias("n_support"))


_SIGNS = ", ".join(f"('{f}', '{t}', {w})" for f, targets, w in answers.SIGN_FEATURES for t in targets)


@query(
    "benchmark", "part",
    sql=rf"""
WITH f AS (SELECT (['P', 'W', 'R'])[CAST(p_partkey % 3 + 1 AS INTEGER)] || (101 + p_partkey % 150) AS code, p_name, row_number() OVER (PARTITION BY p_partkey % 3, p_partkey % 150 ORDER BY p_size DESC, p_partkey) AS nth FROM part),
c AS (SELECT code, {fold("p_name")} AS folded FROM f WHERE nth = 1), s AS (SELECT * FROM (VALUES {_SIGNS}) AS v(feature, target, weight)),
r AS (SELECT feature, code, weight FROM s JOIN c ON (len(target) > 1 AND target = code) OR (len(target) = 1 AND target = code[1]) UNION ALL SELECT folded, code, 3.0 FROM c WHERE folded <> ''),
q AS (SELECT item_id AS query_id, (['Biển tròn nền đỏ vạch ngang là gì?', 'Biển cảnh báo trẻ em', 'Ý nghĩa biển P.122', 'Biển stop hình bát giác'])[CAST(item_id % 4 + 1 AS INTEGER)] || coalesce(' ' || text, '') AS question FROM benchmark),
e AS (SELECT query_id, unnest(list_distinct([upper(regexp_replace(x, '[\s.]+', '', 'g')) FOR x IN regexp_extract_all(question, '(?i)\b(?:DP|IE|P|W|R|I|S|E)\s*\.?\s*\d{{2,3}}[a-zđ]?\b')])) AS code FROM q),
h AS (SELECT query_id, code, weight FROM (SELECT query_id, {fold("question")} AS body FROM q) JOIN r ON contains(body, feature) UNION ALL SELECT query_id, code, 1000.0 FROM e),
t AS (SELECT query_id, code, sum(CAST(weight AS DOUBLE)) AS score FROM h GROUP BY 1, 2 HAVING sum(CAST(weight AS DOUBLE)) >= 1.2)
SELECT query_id, code, CAST(round(score, 6) AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, code) AS INTEGER) AS rank FROM t QUALIFY rank <= 15
""",
)
def sign_search(benchmark, part):
    """Codes that questions, before every whole benchmark text, speak for."""
    figures = part.select(F.col("p_partkey").alias("id"), F.concat(F.element_at(F.array(*map(F.lit, ("P. ", "W. ", "R. "))), (F.col("p_partkey") % 3 + 1).cast("int")), 101 + F.col("p_partkey") % 150).alias("code"), F.col("p_name").alias("name"), F.col("p_size").alias("quality"))
    asked = F.array(*map(F.lit, ("Biển tròn nền đỏ vạch ngang là gì?", "Biển cảnh báo trẻ em", "Ý nghĩa biển P.122", "Biển stop hình bát giác")))
    questions = benchmark.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.element_at(asked, (F.col("item_id") % 4 + 1).cast("int")), "text").alias("question"))
    return answers.find_codes(questions, answers.sign_catalog(figures).select("code", "name")).withColumn("score", F.round("score", 6))


@query("benchmark", "documents")
def table_row_search(benchmark, documents):
    """Rows only: rows of tables that the sentences of a document make, for every benchmark item."""
    rows = documents.select(F.col("doc_id").alias("id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("row_index", "row_text"))
    return answers.table_row_scores(rows, benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))


@query("documents", sql="SELECT CASE WHEN t LIKE '%biển%' OR t LIKE '%vạch%' THEN 'SIGN_MEANING' WHEN t LIKE '%phạt%' OR t LIKE '%tiền%' THEN 'PENALTY' WHEN doc_id % 2 = 0 THEN 'PROCEDURE' ELSE 'DEFINITION' END AS intent, count(*) AS n FROM (SELECT doc_id, lower(text) AS t FROM documents) GROUP BY 1")
def fallback_questions(documents):
    rows = documents.select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "Hồ sơ: ").otherwise("Điều này: "), "text").alias("body"), F.lit("Điều 5").alias("citation"))
    return answers.fallback_qa(rows, "body", "citation").groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


_CANON = "trim(regexp_replace(translate(lower({0}), '“”„‟‘’‚‛–—', '\"\"\"\"''--'), '\\s+', ' ', 'g'))"
_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@query("documents", sql=f"WITH q AS (SELECT d.doc_id, d.text AS t, substring(s.text, CAST(len(s.text) // 2 AS BIGINT), 40) AS quote FROM documents d JOIN documents s ON s.doc_id = CASE WHEN d.doc_id % 2 = 0 THEN d.doc_id ELSE d.doc_id - 1 END WHERE d.text IS NOT NULL AND len(s.text) >= 80) SELECT doc_id, len(quote) >= 8 AND (contains({_CANON.format('t')}, {_CANON.format('quote')}) OR contains({_NORM.format('t')}, {_NORM.format('quote')})) AS found FROM q")
def quote_audit(documents):
    """Quotes from the middle of a text, sought in that text or in the next document's."""
    source = documents.select(F.col("doc_id").alias("_s"), F.col("text").alias("_t")).filter(F.length("_t") >= 80)
    rows = documents.filter("text IS NOT NULL").join(source, F.col("_s") == F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1))
    quote = F.substring("_t", F.floor(F.length("_t") / 2).cast("int"), F.lit(40))
    return rows.select("doc_id", "text", quote.alias("quote")).select("doc_id", answers.quote_in_source("quote", "text").alias("found"))


@query("documents", "benchmark")
def best_extracts(documents, benchmark):
    """Rows only: the best sentences of the first documents by shared words, for every benchmark item."""
    from .search_queries import _bm25

    best = index.top_k(_bm25(documents, benchmark, 3), 3)
    rows = best.join(documents.select(F.col("doc_id").alias("id"), "text"), "id").join(benchmark.select(F.col("item_id").alias("query_id"), text.content_tokens("text").alias("words")), "query_id")
    return answers.extracts(rows, "words", "text")


@query("conversations", sql=f"WITH t AS (SELECT conv_id, turn, role, {tokens('text')} AS w FROM conversations) SELECT role, CAST(grouping(role) AS INTEGER) AS is_total, count(*) AS n, CAST(round(avg(len(w)), 6) AS DOUBLE) AS mean_words, CAST(round(avg(CASE WHEN len(w) >= 20 THEN 1.0 ELSE 0 END), 6) AS DOUBLE) AS pass_rate FROM t GROUP BY ROLLUP (role)")
def case_report(conversations):
    rows = conversations.withColumn("mean_words", F.size(text.tokens("text"))).withColumn("passed", F.col("mean_words") >= 20)
    out = rows.rollup("role").agg(F.grouping("role").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), F.round(F.avg("mean_words"), 6).alias("mean_words"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))
    return out


@query("benchmark", "documents", sql=f"WITH b AS (SELECT item_id, {content('text')} AS w FROM benchmark), d AS (SELECT doc_id, {content('text')} AS w FROM documents), x AS (SELECT item_id, unnest(w) AS t FROM b), y AS (SELECT doc_id, unnest(w) AS t FROM d), j AS (SELECT item_id, doc_id, count(*) AS shared FROM x JOIN y USING (t) GROUP BY 1, 2) SELECT item_id, doc_id FROM j JOIN b USING (item_id) WHERE shared = len(w)")
def contained_passages(benchmark, documents):
    """Documents that hold every content word of a benchmark item; they meet by the item's rarest word."""
    asked = benchmark.select("item_id", text.content_tokens("text").alias("words"))
    held = documents.select("doc_id", text.content_tokens("text").alias("words"))
    return joins.contained(asked, held, "item_id", "doc_id", "words")


@query("orders", "lineitem", sql="SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'missing' WHEN abs(o_totalprice - sum(l_extendedprice)) <= 0.15 * o_totalprice THEN 'near' ELSE 'off' END AS state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice")
def amount_audit(orders, lineitem):
    sums = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    state = F.when(F.col("s").isNull(), "missing").when(F.abs(F.col("o_totalprice") - F.col("s")) <= 0.15 * F.col("o_totalprice"), "near").otherwise("off")
    return orders.join(sums, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("events", sql="SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_of_kind(events):
    return aggregates.best_by(events, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_id")


@query("documents", sql="SELECT doc_id, CASE WHEN length(trim(text)) < 80 THEN 'short' WHEN lang = 'en' THEN 'en' ELSE 'other' END AS modality, CASE WHEN lang = 'en' THEN 'src' ELSE source END AS label FROM documents")
def page_choice(documents):
    modality = F.when(F.length(F.trim("text")) < 80, "short").when(F.col("lang") == "en", "en").otherwise("other")
    return documents.select("doc_id", modality.alias("modality"), F.when(F.col("lang") == "en", "src").otherwise(F.col("source")).alias("label"))




#: Boxes out of parts and orders: pages grow in number with the tables.
_TABLE_BOXES = "p_partkey // 50 AS page, p_partkey AS id, CAST((p_partkey * 37) % 500 AS DOUBLE) AS x0, CAST((p_partkey * 91) % 700 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 500 + p_size * 3 AS DOUBLE) AS x1, CAST((p_partkey * 91) % 700 + 40 AS DOUBLE) AS y1"
_SPAN_BOXES = "o_orderkey // 1500 AS page, o_orderkey AS id, CAST((o_orderkey * 53) % 560 AS DOUBLE) AS x0, CAST((o_custkey * 29) % 760 AS DOUBLE) AS y0, CAST((o_orderkey * 53) % 560 + 10 + o_orderkey % 90 AS DOUBLE) AS x1, CAST((o_custkey * 29) % 760 + 10 AS DOUBLE) AS y1"
_BOXES = f"l AS (SELECT {_TABLE_BOXES} FROM part), r AS (SELECT {_SPAN_BOXES} FROM orders)"
_BESIDE = "least(abs(l.y0 - r.y1), abs(l.y1 - r.y0))"


def _boxes(part, orders):
    spell = lambda x: x.replace("p_partkey // 50", "p_partkey div 50").replace("o_orderkey // 1500", "o_orderkey div 1500")
    return part.selectExpr(*spell(_TABLE_BOXES).split(", ")), orders.selectExpr(*spell(_SPAN_BOXES).split(", "))


@query("part", "orders", sql=f"WITH {_BOXES} SELECT l.page, l.id, r.id AS caption_id, {_BESIDE} AS distance FROM l JOIN r ON l.page = r.page AND {_BESIDE} < 50 AND (least(l.x1, r.x1) > greatest(l.x0, r.x0) OR abs(l.x0 - r.x0) < 100) QUALIFY row_number() OVER (PARTITION BY l.page, l.id ORDER BY distance, r.id) = 1")
def nearest_captions(part, orders):
    return spatial.nearest_caption(*_boxes(part, orders), ["page"])


@query("part", "orders", sql=f"WITH {_BOXES} SELECT l.page, l.id, r.id AS other_id, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS area FROM l JOIN r ON l.page = r.page AND least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0) QUALIFY row_number() OVER (PARTITION BY l.page, l.id ORDER BY area DESC, (r.x1 - r.x0) * (r.y1 - r.y0), r.id) = 1")
def overlapping_boxes(part, orders):
    return spatial.best_overlap(*_boxes(part, orders), ["page"], 64)


@query("part", "orders", sql=f"WITH {_BOXES}, d AS (SELECT l.page, l.id, r.id AS other_id, sqrt(greatest(0, r.x0 - l.x1, l.x0 - r.x1) ** 2 + greatest(0, r.y0 - l.y1, l.y0 - r.y1) ** 2) AS distance, (r.x1 - r.x0) * (r.y1 - r.y0) AS own FROM l JOIN r ON l.page = r.page) SELECT page, id, other_id, CAST(round(distance, 6) AS DOUBLE) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY distance, own, other_id) = 1")
def nearest_boxes(part, orders):
    return spatial.nearest(*_boxes(part, orders), ["page"], 8).withColumn("distance", F.round("distance", 6))
