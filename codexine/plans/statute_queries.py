"""Queries of sanctions, cleaning, audits, assets, test sets and questions taken apart.

Statutes are made out of orders: the expressions of STATUTE mean the same in Spark and in the SQL of the oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning, text
from ..operators import assets, audits, evaluation, sanctions, truth
from . import decompose, planner, rules, scoring
from .registry import content, fold, query, tokens

_FINE = "'Phạt tiền từ ' || CAST((o_orderkey % 900 + 100) * 1000 AS STRING) || ' đồng đến ' || CAST((o_orderkey % 900 + 300) * 1000 AS STRING) || ' đồng đối với '"
#: A record's columns as SQL of both engines.
STATUTE = {
    "id": "o_orderkey",
    "document": "CASE o_custkey % 3 WHEN 0 THEN 'Luật Đường bộ 2024' ELSE 'Nghị định 168/2024/NĐ-CP' END",
    "article": "CAST(6 + o_custkey % 4 AS STRING)",
    "clause": "CAST(1 + o_orderkey % 5 AS STRING)",
    "point": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END",
    "text": f"""CASE o_orderpriority WHEN '1-URGENT' THEN {_FINE} || 'hành vi điều khiển xe chạy quá tốc độ quy định ' || CASE o_orderkey % 3 WHEN 0 THEN 'từ 10 km/h đến 20 km/h' WHEN 1 THEN 'trên 35 km/h' ELSE 'gây tai nạn' END
WHEN '2-HIGH' THEN 'Hành vi vượt đèn đỏ thì bị trừ ' || CAST(o_orderkey % 12 AS STRING) || ' điểm giấy phép lái xe'
WHEN '3-MEDIUM' THEN 'Thực hiện hành vi quy định tại điểm a, điểm b khoản ' || CAST(1 + o_orderkey % 3 AS STRING) || '; khoản 5 Điều này thì bị tước quyền sử dụng giấy phép lái xe từ ' || CAST(1 + o_orderkey % 4 AS STRING) || ' tháng'
WHEN '4-NOT SPECIFIED' THEN 'Hồ sơ cấp đổi giấy tờ trong thời hạn ' || CAST(o_orderkey % 30 AS STRING) || ' ngày' ELSE 'Mức phạt tiền tối đa là ' || CAST(1 + o_orderkey % 70 AS STRING) || ' triệu đồng' END""",
    "fine_min": "CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 END",
    "fine_max": "CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey * 2 + 1 END",
    "violation": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Điều khiển xe số ' || CAST(o_orderkey % 50 AS STRING) END",
    "context": "'Người điều khiển xe số ' || CAST(o_orderkey % 50 AS STRING) || ' bị xử phạt'",
}
_REC = "rec AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in STATUTE.items()) + ", o_orderpriority AS kind FROM orders)"


def statutes(orders):
    return orders.selectExpr(*[f"{e} AS {c}" for c, e in STATUTE.items()], "o_orderpriority AS kind")


_AMOUNTS = f"""WITH {_REC}, v AS (SELECT *, [CAST(x AS BIGINT) * CASE WHEN text LIKE '%triệu%' THEN 1000000 ELSE 1 END FOR x IN regexp_extract_all(text, '(\\d+) (?:triệu )?đồng', 1)] AS said, list_filter([fine_min, fine_max], lambda x: x > 0) AS given FROM rec)
SELECT DISTINCT id, article, clause, point, list_min(CASE WHEN len(said) > 0 THEN said ELSE given END) AS amount_min, list_max(CASE WHEN len(said) > 0 THEN said ELSE given END) AS amount_max FROM v
WHERE (text ILIKE '%phạt tiền%' OR len(given) > 0) AND text NOT LIKE 'Mức phạt tiền tối đa%' AND len(said) + len(given) > 0"""


@query("orders", sql=_AMOUNTS)
def fine_amounts(orders):
    return sanctions.amounts(statutes(orders))


@query("orders", sql=f"WITH {_REC}, p AS (SELECT id, CAST(regexp_extract(text, 'trừ (\\d+) điểm', 1) AS INTEGER) AS points FROM rec WHERE text LIKE '%trừ % điểm%') SELECT id, points, CAST(row_number() OVER (ORDER BY points DESC, id) AS INTEGER) AS rank FROM p WHERE points > 0 QUALIFY rank <= 12")
def point_ranking(orders):
    return sanctions.point_ranking(statutes(orders), 12)


@query("orders", sql=f"WITH {_REC}, p AS (SELECT id, CAST(regexp_extract(text, 'trừ (\\d+) điểm', 1) AS INTEGER) AS points FROM rec WHERE text LIKE '%trừ % điểm%') SELECT id, points, CAST(row_number() OVER (ORDER BY points, id) AS INTEGER) AS rank FROM p WHERE points > 0 QUALIFY rank <= 12")
def fewest_points(orders):
    return sanctions.point_ranking(statutes(orders), 12, lowest=True)


@query(
    "orders",
    sql=f"""WITH {_REC}, r AS (SELECT *, coalesce(violation, regexp_replace(context, ' bị xử phạt$', '')) AS act FROM rec),
s AS (SELECT id AS sanction_id, document, article, act AS own, 'bị tước' || regexp_extract(text, 'bị tước(.*)$', 1) AS suspension, regexp_extract(text, 'điểm b khoản (\\d+)', 1) AS c FROM r WHERE text LIKE '%tước%'),
n AS (SELECT sanction_id, document, article, suspension, c AS clause, unnest(['a', 'b']) AS point FROM s UNION ALL SELECT sanction_id, document, article, suspension, '5', '*' FROM s),
a AS (SELECT id AS act_id, document, article, clause, point, act FROM r WHERE text NOT LIKE '%tước%'),
f AS (SELECT DISTINCT act_id, act, suspension, sanction_id FROM n JOIN a ON n.document = a.document AND n.article = a.article AND n.clause = a.clause AND (n.point = '*' OR n.point = a.point)),
b AS (SELECT * FROM f UNION ALL SELECT sanction_id, own, suspension, sanction_id FROM s WHERE sanction_id NOT IN (SELECT sanction_id FROM f))
SELECT act_id, act, suspension, sanction_id FROM b QUALIFY row_number() OVER (PARTITION BY act_id, act, suspension ORDER BY sanction_id) = 1""",
)
def suspension_catalog(orders):
    return sanctions.suspensions(statutes(orders))


@query("orders", sql=f"WITH {_REC}, v AS (SELECT id, list_distinct([CAST(x AS BIGINT) FOR x IN regexp_extract_all(text, '(\\d{{1,3}}) đồng', 1)]) AS said, fine_min, fine_max FROM rec) SELECT id, field, value FROM (SELECT id, said, 'fine_min' AS field, fine_min AS value FROM v UNION ALL SELECT id, said, 'fine_max', fine_max FROM v) WHERE len(said) > 0 AND value <> 0 AND NOT list_contains(said, value)")
def amount_mismatches(orders):
    return sanctions.mismatched_amounts(statutes(orders), ["fine_min", "fine_max"])


@query(
    "orders",
    sql=f"""WITH {_REC}, r AS (SELECT *, regexp_extract(text, '^Phạt tiền từ \\d+ đồng đến \\d+ đồng', 0) AS said FROM rec WHERE article IN ('6', '7', '8')),
m AS (SELECT *, CASE WHEN said <> '' THEN said WHEN fine_min IS NOT NULL THEN regexp_replace(printf('%,d', fine_min), ',', '.', 'g') || ' đồng - ' || regexp_replace(printf('%,d', fine_max), ',', '.', 'g') || ' đồng' END AS own FROM r),
p AS (SELECT document, article, clause, max_by(own, id) AS above FROM m WHERE point = '' AND own IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT m.*, CASE WHEN text LIKE '%từ 10 km/h đến 20 km/h' THEN 'Từ 10 km/h đến 20 km/h' WHEN text LIKE '%trên 35 km/h' THEN 'Trên 35 km/h' ELSE 'Chạy quá tốc độ quy định gây tai nạn giao thông' END AS threshold FROM m WHERE text LIKE '%chạy quá tốc độ%')
SELECT article, threshold, coalesce(above, own) AS fine, min(id) AS id, CAST((CAST(article AS INTEGER) - 6) * 10 + CASE WHEN threshold LIKE 'Từ%' THEN 2 WHEN threshold LIKE 'Trên%' THEN 4 ELSE 8 END AS INTEGER) AS rank
FROM s LEFT JOIN p USING (document, article, clause) GROUP BY ALL""",
)
def speed_table(orders):
    rows = statutes(orders)
    return sanctions.speed_rows(rows.withColumn("penalty", F.nullif(F.regexp_extract("text", r"^Phạt tiền từ \d+ đồng đến \d+ đồng", 0), F.lit(""))))


@query("orders", sql=f"WITH {_REC} SELECT count(DISTINCT document) AS n_documents, array_to_string((SELECT list(document ORDER BY document) FROM (SELECT DISTINCT document FROM rec ORDER BY 1 LIMIT 3)), '; ') AS names FROM rec")
def corpus_scope(orders):
    return sanctions.scope(statutes(orders)).select("n_documents", F.array_join("names", "; ").alias("names"))


@query("orders", sql=f"WITH {_REC} SELECT article, array_to_string(list_sort(list(DISTINCT document || '|' || clause)), '; ') AS refs FROM rec GROUP BY 1")
def article_references(orders):
    return sanctions.by_article(statutes(orders).withColumn("reference", F.concat_ws("|", "document", "clause"))).select("article", F.array_join("references", "; ").alias("refs"))


@query("orders", sql=f"WITH {_REC} SELECT id, coalesce(array_to_string([CAST(CAST(x AS INTEGER) AS VARCHAR) FOR x IN regexp_extract_all(text, 'trừ (\\d+) điểm', 1)], ','), '') AS points, text LIKE '%chạy quá tốc độ%' AS speeding, text ILIKE '%phạt%' OR text LIKE '%tiền%' OR text LIKE '%tước%' OR text LIKE '%trừ điểm%' OR text LIKE '%đối với%' OR text ILIKE '%hành vi%' AS penal FROM rec")
def sanction_flags(orders):
    rows = statutes(orders)
    # Two of the patterns see the same number, so it stands twice.
    points = F.array_distinct(sanctions.point_values("text"))
    return rows.select("id", F.array_join(points, ",").alias("points"), sanctions.is_speeding("text").alias("speeding"), cleaning.is_penalty_chunk("text").alias("penal"))


# --- Cleaning ---


@query("documents", sql="SELECT doc_id, md5('Đi' || 'ều ' || doc_id || ' người lái xe phải điều khiển đúng làn đường' || chr(10) || regexp_replace(text, '\\s+', ' ', 'g')) AS joined FROM documents WHERE text IS NOT NULL")
def split_words(documents):
    """Split syllables put before every whole text are joined; the text itself, which has none, stays."""
    broken = F.concat(F.lit("Đi ều "), "doc_id", F.lit(" ngư ời lái xe phải đi ều khi ển đúng làn đ ường\n"), F.regexp_replace("text", r"\s+", " "))
    return documents.filter("text IS NOT NULL").select("doc_id", F.md5(cleaning.join_split_words(broken)).alias("joined"))


@query("documents", sql="SELECT doc_id, md5('Làn đường dành cho xe máy và xe ô tô con, kết thúc làn đường theo phương tiện; buýt ' || text) AS spaced FROM documents WHERE text IS NOT NULL")
def caption_spaces(documents):
    glued = F.concat(F.lit("Lànđườngdànhcho xemáy vàxeôtôcon, kếtthúclànđườngtheophươngtiện; bu ýt "), "text")
    return documents.filter("text IS NOT NULL").select("doc_id", F.md5(cleaning.space_captions(glued)).alias("spaced"))


@query("documents", sql="SELECT doc_id, md5('Điều 5' || chr(10) || 'Khoản 2 điểm a của Điều 7 và khoản 3' || chr(10) || 'Chương IV' || chr(10) || text) AS mended FROM documents WHERE text IS NOT NULL")
def keyword_recovery(documents):
    broken = F.concat(F.lit("Diêu 5\nKhoan 2 diêm a của ĐIều 7 và Khoân 3\nChuong IV\n"), "text")
    return documents.filter("text IS NOT NULL").select("doc_id", F.md5(cleaning.recover_keywords(broken)).alias("mended"))


@query("customer", sql="SELECT c_custkey, v IS NULL OR trim(v) = '' OR lower(v) LIKE '%unknown%' OR lower(v) LIKE '%n/a%' AS garbage, coalesce(lower(v) LIKE '%unknown%' OR lower(v) LIKE '%n/a%', false) AS marked, CASE WHEN v IS NULL OR trim(v) = '' OR lower(v) LIKE '%unknown%' OR lower(v) LIKE '%n/a%' THEN c_name ELSE trim(v) END AS kept FROM (SELECT c_custkey, c_name, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Unknown ' || c_mktsegment WHEN 3 THEN 'N/A' ELSE ' ' || c_mktsegment END AS v FROM customer)")
def garbage_values(customer):
    rows = customer.select("c_custkey", "c_name", F.expr("CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Unknown ' || c_mktsegment WHEN 3 THEN 'N/A' ELSE ' ' || c_mktsegment END").alias("v"))
    return rows.select("c_custkey", cleaning.is_garbage("v").alias("garbage"), cleaning.has_placeholder("v").alias("marked"), cleaning.clean_value("v", "c_name").alias("kept"))


_INT = "CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS STRING) || ' ngày' WHEN 1 THEN '1.500.000 đồng' WHEN 2 THEN 'từ ' || CAST(o_orderkey AS STRING) || ' đến 9' WHEN 3 THEN 'N/A' ELSE NULL END"


@query("orders", sql="SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey WHEN 1 THEN 1500000 END AS value FROM orders")
def optional_ints(orders):
    return orders.selectExpr("o_orderkey", f"{_INT} AS v").select("o_orderkey", cleaning.optional_int("v").alias("value"))


@query("events", sql="SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS BIGINT) END AS k FROM events")
def json_objects(events):
    """Objects within fences, prose or alone; an answer without one has none."""
    said = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json\\n' || props || '\\n```' WHEN 2 THEN 'The answer is ' || props || ' as asked.' ELSE 'none' END")
    return events.select("event_id", F.get_json_object(cleaning.json_object(said), "$.k").cast("long").alias("k"))


@query("events", sql="SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'P102,W' || (200 + event_id % 50) WHEN 1 THEN 'P102,R' || (300 + event_id % 50) ELSE 'I' || (400 + event_id % 50) END AS codes, CASE WHEN event_id % 3 < 2 AND value >= 58 THEN 'P102' WHEN event_id % 3 < 2 AND value >= 45 THEN 'P102' ELSE '' END AS trusted FROM events")
def vision_codes(events):
    said = F.expr("CASE event_id % 3 WHEN 0 THEN '{\"candidate_codes\": [\"p.102\", \"W.' || (200 + event_id % 50) || '\"]}' WHEN 1 THEN '```json {\"candidate_codes\": [\"P102\"], \"alternatives\": [\"R. ' || (300 + event_id % 50) || '\", \"P.102\"]} ```' ELSE 'perhaps I.' || (400 + event_id % 50) || ' or so' END")
    rows = events.select("event_id", cleaning.vision_codes(said).alias("codes"), (F.col("value") / 100).alias("sure"))
    known = F.array(F.lit("P102"), F.lit("W999"))
    return rows.select("event_id", F.array_join("codes", ",").alias("codes"), F.array_join(cleaning.trusted_codes("codes", "sure", known), ",").alias("trusted"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE regexp_replace(printf('%,d', o_orderkey * 1000), ',', '.', 'g') || ' đồng' END AS amount FROM orders")
def vnd_format(orders):
    return orders.select("o_orderkey", cleaning.format_vnd(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") * 1000)).alias("amount"))


@query("pages", sql="SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/processed/a/' || page_id || '.png' WHEN 2 THEN '/processed/' || page_id || '.png' WHEN 3 THEN '/root/' || page_id ELSE '/processed/fig/' || page_id || '.png' END AS path FROM pages")
def asset_paths(pages):
    path = F.expr("CASE page_id % 5 WHEN 0 THEN ' ' || url WHEN 1 THEN 'x/data/processed/a/' || page_id || '.png' WHEN 2 THEN 'processed/' || page_id || '.png' WHEN 3 THEN '/root/' || page_id ELSE 'fig\\\\' || page_id || '.png' END")
    return pages.select("page_id", cleaning.asset_path(path).alias("path"))


@query("pages", sql="SELECT page_id, trim(regexp_replace(url, '[^0-9A-Za-zÀ-ỹ_:.|-]+', '_', 'g'), '_') AS id, CAST(greatest(len(regexp_extract_all(html, '\\S+')), len(html) // 4) AS INTEGER) AS tokens FROM pages")
def safe_ids(pages):
    return pages.select("page_id", cleaning.safe_id("url").alias("id"), cleaning.rough_tokens("html").alias("tokens"))


_ONE = "regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^[ #;-]+|[ #;-]+$', '', 'g')"


@query("documents", sql=f"SELECT doc_id, md5(CASE WHEN len(c) <= 200 THEN c ELSE regexp_replace(left(c, 199), '[ ,;]+$', '') || '…' END) AS cut, len(trim(text)) >= 24 AND text NOT LIKE '%�%' AND {fold('text')} NOT LIKE '%placeholder%' AS usable FROM (SELECT doc_id, text, {_ONE} AS c FROM documents) WHERE text IS NOT NULL")
def snippets(documents):
    return documents.filter("text IS NOT NULL").select("doc_id", F.md5(cleaning.trimmed("text", 200)).alias("cut"), cleaning.usable_snippet("text").alias("usable"))


@query("documents", "benchmark", sql="SELECT doc_id, CASE WHEN h <> '' AND long THEN 'history_and_long_query' WHEN h <> '' THEN 'history_context' WHEN long THEN 'long_query' WHEN greatest(len(regexp_extract_all(h || chr(10) || q, '\\S+')), (len(h) + 1 + len(q)) // 4) >= 1400 THEN 'large_input' ELSE '' END AS reason FROM (SELECT doc_id, coalesce(text, '') AS q, CASE WHEN lang = 'en' THEN source ELSE '' END AS h, len(coalesce(text, '')) >= 3200 OR len(regexp_extract_all(coalesce(text, ''), '\\S+')) >= 550 AS long FROM documents)")
def preprocess_reasons(documents, benchmark):
    return documents.select("doc_id", cleaning.preprocess_reason("text", F.when(F.col("lang") == "en", F.col("source")).otherwise("")).alias("reason"))


@query("documents")
def cleaned_pages(documents):
    """Rows only: the whole cleaner over every text, with its hashes; tests hold it against plain Python."""
    return cleaning.processed(documents, "text").select("doc_id", "raw_sha256", "normalized_sha256", F.length("normalized").alias("n_chars"))


# --- Audits ---


@query("orders", sql=f"WITH {_REC}, w AS (SELECT document, 'article' AS unit, article AS value FROM rec UNION SELECT document, 'clause', clause FROM rec UNION SELECT document, 'point', point FROM rec WHERE point <> ''), h AS (SELECT document, 'article' AS unit, article AS value FROM rec WHERE kind = '1-URGENT' UNION SELECT document, 'clause', clause FROM rec WHERE kind = '1-URGENT' AND id % 5 < 3), j AS (SELECT w.*, h.value IS NOT NULL AS hit FROM w LEFT JOIN h USING (document, unit, value)) SELECT document, unit, count(*) AS expected, CAST(count_if(hit) AS BIGINT) AS found, CAST(round(count_if(hit) / count(*), 6) AS DOUBLE) AS coverage, array_to_string(list(value ORDER BY length(value), value) FILTER (WHERE NOT hit), ',') AS missing FROM j GROUP BY 1, 2")
def unit_audit(orders):
    """Articles, clauses and points that texts spell out against those of the records extracted from them."""
    rows = statutes(orders)
    spelled = F.concat(F.lit("Điều "), "article", F.lit(". Tên\n"), "clause", F.lit(". Nội dung\n"), F.when(F.col("point") != "", F.concat("point", F.lit(") Chi tiết"))).otherwise(""))
    want = audits.expected_units(rows.withColumn("text", spelled), ["document"])
    some = rows.filter("kind = '1-URGENT'").select("document", "article", F.when(F.col("id") % 5 < 3, F.col("clause")).otherwise("N/A").alias("clause"), F.lit(None).cast("string").alias("point"))
    out = audits.unit_coverage(want, audits.extracted_units(some, ["document"]), ["document"])
    return out.select("document", "unit", "expected", "found", F.round("coverage", 6).alias("coverage"), F.nullif(F.array_join("missing", ","), F.lit("")).alias("missing"))


@query("orders", sql=f"WITH {_REC}, r AS (SELECT *, CASE id % 6 WHEN 0 THEN 'source_legal_unit' ELSE 'enriched_rule' END AS rt, id % 10 = 0 AS bad FROM rec) SELECT document, count(*) AS records, CAST(count_if(rt = 'source_legal_unit') AS BIGINT) AS source_only, CAST(count_if(bad) AS BIGINT) AS bad_references, CAST(3 * CAST(count_if(bad) AS BIGINT) AS BIGINT) AS garbled_values, CAST(count_if(rt <> 'source_legal_unit' AND id % 7 = 0) AS BIGINT) AS not_in_source, CAST(count_if(rt <> 'source_legal_unit' AND id % 7 > 0 AND id % 4 = 0) AS BIGINT) AS very_short FROM r GROUP BY 1")
def record_audit(orders):
    bad = lambda c: F.when(F.col("id") % 10 == 0, "không xác định").otherwise(F.col(c))
    said = F.when(F.col("id") % 7 == 0, F.concat(F.lit("zq "), "text")).when(F.col("id") % 4 == 0, F.substring("text", 1, 10)).otherwise(F.upper("text"))
    rows = statutes(orders).select("document", "id", F.lit("I").alias("chapter"), bad("article").alias("article"), bad("clause").alias("clause"), bad("point").alias("point"), F.col("text").alias("source"), said.alias("extracted"), F.when(F.col("id") % 6 == 0, "source_legal_unit").otherwise("enriched_rule").alias("record_type"))
    return audits.records_by_file(rows)


@query("orders", sql=f"WITH {_REC}, c AS (SELECT document, article || '|' || clause AS chunk, min(id) AS m FROM rec GROUP BY 1, 2), p AS (SELECT r.document, r.article || '|' || r.clause AS chunk, r.id, r.kind, left(x.text, 20) AS quote FROM rec r JOIN rec x ON x.id = CASE WHEN r.id % 2 = 0 THEN r.id ELSE r.id END WHERE r.id % 3 = 0), s AS (SELECT c.document, c.chunk, r.text FROM c JOIN rec r ON r.id = c.m), j AS (SELECT p.*, s.text AS src FROM p LEFT JOIN s USING (document, chunk)), q AS (SELECT document, count(*) AS questions, count(*) - count(DISTINCT kind) AS duplicates, CAST(0 AS BIGINT) AS bad_intents, CAST(count_if(id % 9 = 0) AS BIGINT) AS bad_difficulties, CAST(count_if(id % 6 = 0) AS BIGINT) AS missing_citations, CAST(count_if(NOT contains(lower(src), lower(quote))) AS BIGINT) AS bad_quotes FROM j GROUP BY 1) SELECT q.*, (SELECT count(*) FROM c WHERE c.document = q.document AND NOT EXISTS (SELECT 1 FROM p WHERE p.document = c.document AND p.chunk = c.chunk)) AS chunks_without FROM q")
def question_audit(orders):
    """Questions of every third record against one text of each chunk: quotes that come from another record's text aren't found."""
    rows = statutes(orders).withColumn("chunk", F.concat_ws("|", "article", "clause"))
    chunks = rows.groupBy("document", "chunk").agg(F.min_by("text", "id").alias("text"))
    pairs = rows.filter("id % 3 = 0").select("document", "chunk", F.col("kind").alias("question"), F.lit("PENALTY").alias("intent"), F.when(F.col("id") % 9 == 0, "?").otherwise("easy").alias("difficulty"), F.when(F.col("id") % 6 == 0, "").otherwise("Điều 6").alias("citation"), F.substring("text", 1, 20).alias("quote"), F.lit("một câu trả lời đủ dài").alias("answer"))
    return audits.questions_by_file(pairs, chunks)


@query("documents", sql="WITH p AS (SELECT CASE WHEN lang = 'en' THEN 'qcvn-' ELSE 'doc-' END || source AS document, len(coalesce(text, '')) AS n, CAST(doc_id % 13 AS INTEGER) AS images FROM documents), a AS (SELECT document, count(*) AS pages, avg(n) AS l, avg(CASE WHEN n >= 500 THEN 1.0 ELSE 0 END) AS rich, avg(CASE WHEN n < 80 THEN 1.0 ELSE 0 END) AS low, avg(CASE WHEN images > 0 AND n < 250 THEN 1.0 ELSE 0 END) AS heavy, avg(images) AS per FROM p GROUP BY 1) SELECT document, pages, CASE WHEN document LIKE 'qcvn%' AND heavy >= 0.2 AND per >= 5 THEN 'ocr' WHEN rich >= 0.3 AND low >= 0.15 THEN 'hybrid' WHEN l < 500 AND rich < 0.3 AND (low > 0.15 OR heavy > 0.25) THEN 'ocr' ELSE 'text' END AS engine FROM a")
def page_engines(documents):
    pages = documents.select(F.concat(F.when(F.col("lang") == "en", "qcvn-").otherwise("doc-"), "source").alias("document"), F.length(F.coalesce("text", F.lit(""))).alias("text_len"), (F.col("doc_id") % 13).cast("int").alias("images"))
    return audits.pages_by_document(pages).select("document", "pages", "engine")


@query("customer", sql="SELECT c_custkey, c_custkey % 3 <> 1 AS header, CAST(CASE c_custkey % 3 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS n_rows, c_custkey % 3 = 2 AS merged FROM customer")
def table_headers(customer):
    """Tables with a header in letters, one whose first row is numbers, and one with a merged cell."""
    first = F.when(F.col("c_custkey") % 3 == 1, F.array(F.col("c_custkey").cast("string"), F.lit("2,5"))).otherwise(F.array(F.col("c_mktsegment"), F.lit("mức")))
    second = F.when(F.col("c_custkey") % 3 == 2, F.array(F.col("c_name"), F.lit(None).cast("string"))).otherwise(F.array(F.col("c_name"), F.col("c_acctbal").cast("string")))
    rows = customer.select("c_custkey", F.array(first, second).alias("rows"))
    return rows.select("c_custkey", F.size(audits.table_parts("rows")["headers"]).alias("h"), F.size(audits.table_parts("rows")["rows"]).alias("n_rows"), audits.has_merged_cells("rows").alias("merged")).select("c_custkey", (F.col("h") > 0).alias("header"), "n_rows", "merged")


@query("orders", "lineitem", sql="SELECT DISTINCT o_orderkey AS chunk, l_orderkey * 10 + l_linenumber AS table FROM orders JOIN lineitem ON l_orderkey // 200 = o_orderkey // 200 AND l_partkey % 50 BETWEEN o_orderkey % 50 AND o_orderkey % 50 + 1 WHERE l_linenumber = o_orderkey % 8 AND l_returnflag = 'R'")
def chunk_tables(orders, lineitem):
    """Tables on a chunk's pages whose first cell stands in its text; documents grow in number with the orders."""
    chunks = orders.select(F.expr("o_orderkey div 200").alias("document"), F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") % 50).cast("int").alias("page_start"), (F.col("o_orderkey") % 50 + 1).cast("int").alias("page_end"), F.concat(F.lit("Phần mở đầu của văn bản này có dòng số "), (F.col("o_orderkey") % 8).cast("string"), F.lit(". Hết phần này ở đây")).alias("text"), F.lit(None).cast("double").alias("y_from"), F.lit(None).cast("double").alias("y_to"))
    cell = F.concat(F.lit("dòng số "), F.col("l_linenumber").cast("string"), F.lit(". | x"))
    tables = lineitem.filter("l_returnflag = 'R'").select(F.expr("l_orderkey div 200").alias("document"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("table"), (F.col("l_partkey") % 50).cast("int").alias("page"), cell.alias("text"), F.lit(None).cast("double").alias("y"))
    return audits.tables_of_chunks(chunks, tables)


@query("part", sql="WITH a AS (SELECT 'P' || (100 + p_partkey % 40) AS code, p_brand AS image, CASE WHEN p_partkey % 40 < 3 THEN '' ELSE p_name END AS name, CASE WHEN p_size > 25 THEN 'appendix_band' ELSE 'region' END AS mode FROM part), q AS (SELECT *, CASE WHEN name = '' THEN -100 ELSE len(name) + CASE WHEN mode = 'appendix_band' THEN 80 ELSE 0 END - 25 END AS q FROM a), b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY code ORDER BY q DESC, name DESC) = 1) SELECT DISTINCT a.code, a.image, CASE WHEN b.name = '' THEN 'Biển số ' || a.code ELSE b.name END AS name FROM a JOIN b USING (code)")
def caption_best(part):
    rows = part.select(F.concat(F.lit("P "), 100 + F.col("p_partkey") % 40).alias("code"), F.col("p_brand").alias("image"), F.when(F.col("p_partkey") % 40 < 3, "").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") > 25, "appendix_band").otherwise("region").alias("mode"))
    return audits.best_captions(rows).select("code", "image", "name")


@query("documents", sql="SELECT CAST(count_if(NOT ok) AS BIGINT) AS n_failed, array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE NOT ok)), ',') AS failed FROM (SELECT source, avg(len(coalesce(text, ''))) > 2500 AS ok FROM documents GROUP BY 1)")
def preflight_gate(documents):
    checks = documents.groupBy(F.col("source").alias("name")).agg((F.avg(F.length(F.coalesce("text", F.lit("")))) > 2500).alias("passed"))
    return audits.gate(checks).select("n_failed", F.array_join("failed", ",").alias("failed"))


@query("documents", sql=f"SELECT topic, count(*) AS n FROM (SELECT unnest([x.k FOR x IN [{{'k': 'the', 'h': contains(f, 'the ')}}, {{'k': 'und', 'h': contains(f, 'und ') OR contains(f, 'chen')}}, {{'k': 'cion', 'h': contains(f, 'cion')}}] IF x.h]) AS topic FROM (SELECT {fold('text')} AS f FROM documents)) GROUP BY 1")
def topic_coverage(documents):
    return audits.topic_counts(documents, {"the": ("the ",), "und": ("und ", "chen"), "cion": ("cion",)})


@query(
    "documents",
    sql=f"""
WITH w AS (SELECT doc_id AS id, list_sort(list_distinct({tokens("text")})) AS s FROM documents), g AS (SELECT id, s, min(id) OVER (PARTITION BY s) AS rep FROM w WHERE len(s) > 0),
train AS (SELECT rep, min(id) AS train_id FROM g WHERE id % 5 <> 0 GROUP BY 1), x AS (SELECT id, len(s) AS n, unnest(s) AS t FROM g WHERE id = rep),
j AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id HAVING similarity >= 0.88),
both_ways AS (SELECT a, b, similarity FROM j UNION ALL SELECT b, a, similarity FROM j UNION ALL SELECT id, id, 1 FROM g WHERE id = rep)
SELECT g.id AS test_id, train_id, CAST(round(similarity, 6) AS DOUBLE) AS similarity FROM g JOIN both_ways ON g.rep = a JOIN train ON train.rep = b WHERE g.id % 5 = 0
""",
)
def leakage_pairs(documents):
    """Every fifth document against the others: those outside that are nearly the same."""
    rows = documents.select(F.col("doc_id").alias("id"), text.tokens("text").alias("words"))
    return evaluation.leakage(rows, "id", "words", F.col("id") % 5 == 0).withColumn("similarity", F.round("similarity", 6))


# --- Assets and projections ---


@query("orders", sql="SELECT query_id, image, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, image) AS INTEGER) AS rank FROM (SELECT o_custkey AS query_id, '/processed/' || (o_orderkey % 50) || '.png' AS image, min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 20 ELSE 50 END + n - 1) AS p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1, 2) QUALIFY rank <= 5")
def image_ranks(orders):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    modality = F.when(F.col("o_orderstatus") == "F", "sign").when(F.col("o_orderstatus") == "O", "table").otherwise("text")
    hits = orders.select(F.col("o_custkey").alias("query_id"), rank.alias("rank"), modality.alias("modality"), F.lit("").alias("facet"), F.array(F.lit("x")).alias("reasons"), F.array(F.concat(F.lit("processed/"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".png"))).alias("images"))
    return assets.context_images(hits, 5)


@query("orders", sql="SELECT query_id, id, CAST(place AS INTEGER) AS place FROM (SELECT o_custkey AS query_id, min(o_orderkey) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) AS place FROM orders GROUP BY o_custkey, o_orderpriority) WHERE place <= 3")
def first_per_chunk(orders):
    hits = orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("chunk"), F.col("o_orderkey").cast("string").alias("id"), F.struct("o_orderkey").alias("reference"))
    return assets.first_records(hits, 3).select("query_id", F.col("id").cast("long").alias("id"), "place")


@query("orders", sql=f"WITH {_REC} SELECT id, concat_ws(', ', CASE WHEN point <> '' THEN 'Điểm ' || point END, 'Khoản ' || clause, 'Điều ' || article, document) AS reference_text, '/processed/' || id || '.png' AS image, text AS excerpt FROM rec")
def reference_projection(orders):
    rows = statutes(orders).withColumns({"query_id": F.lit(1), "rank": F.lit(1), "chunk": F.col("id").cast("string"), "section": F.lit(""), "chapter": F.lit(""), "modality": F.lit("text"), "images": F.array(F.concat(F.lit("processed/"), F.col("id").cast("string"), F.lit(".png"))), "reasons": F.array(F.lit("x")), "score": F.lit(1.0)})
    return assets.reference_rows(rows).select(F.col("source_chunk_id").cast("long").alias("id"), "reference_text", "image", "excerpt")


@query("orders", sql=f"WITH {_REC} SELECT id, CASE WHEN id % 3 = 0 THEN article ELSE '77' END AS article, CASE WHEN id % 3 > 0 AND id % 2 = 0 THEN '5' ELSE clause END AS clause, CASE WHEN id % 3 > 0 THEN 'z' ELSE point END AS point FROM rec")
def normalized_references(orders):
    """Ids of chunks that spell out another article and point, and a clause or none; every third record keeps its own."""
    rows = statutes(orders)
    chunk = F.concat(F.lit("luat_77_"), F.when(F.col("id") % 2 == 0, "5").otherwise("0"), F.lit("_z_1"))
    ref = assets.normalized_reference(chunk, F.struct("document", "article", "clause", "point"), F.col("id") % 3 == 0)
    return rows.select("id", ref.alias("r")).select("id", "r.article", "r.clause", "r.point")


@query("orders", sql=f"WITH {_REC}, h AS (SELECT id % 97 AS query_id, id, article AS reference, text AS summary, CAST(id % 13 AS DOUBLE) AS score FROM rec), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, reference, summary ORDER BY score DESC, id) AS n FROM h WHERE len(summary) >= 24) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM o WHERE n = 1")
def evidence(orders):
    hits = statutes(orders).select((F.col("id") % 97).alias("query_id"), "id", F.col("article").alias("reference"), F.col("text").alias("summary"), (F.col("id") % 13).cast("double").alias("score"))
    return assets.evidence_rows(hits).select("query_id", "id", "rank")


_GOT = "SELECT o_custkey, list(6 + o_custkey % 4 + o_orderkey % 2 ORDER BY o_orderkey) AS got FROM orders GROUP BY 1"


@query("orders", sql=f"WITH c AS ({_GOT}) SELECT o_custkey, CAST(CASE WHEN list_contains(got[1:3], 7) THEN 1 ELSE 0 END AS DOUBLE) AS hit, CAST(round(coalesce(1.0 / list_position(got, 7), 0), 6) AS DOUBLE) AS reciprocal FROM c")
def context_hits(orders):
    """Contexts in order, of which those of article 7 are expected: by the ids of their chunks, or by their references."""
    article = (6 + F.col("o_custkey") % 4 + F.col("o_orderkey") % 2).cast("string")
    ref = F.struct(F.lit("Nghị định 168").alias("document"), F.when(F.col("o_orderkey") % 3 == 0, article).otherwise("").alias("article"), F.lit("").alias("clause"), F.lit("").alias("point"))
    context = F.struct(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("nghi_dinh_168_"), article, F.lit("_0_0_1"))).otherwise(F.lit("")).alias("chunk"), ref.alias("reference"))
    rows = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(context)).alias("c"))
    want = F.array(F.struct(F.lit("nghi dinh 168").alias("document"), F.lit("7").alias("article"), F.lit("").alias("clause"), F.lit("").alias("point")))
    return rows.select("o_custkey", assets.contexts_hit("c", want, 3).alias("hit"), F.round(assets.contexts_reciprocal_rank("c", want), 6).alias("reciprocal"))


@query("orders", sql=f"WITH {_REC} SELECT article, bool_or(kind = '5-LOW') AS has_table, false AS has_figure, bool_or(kind = '2-HIGH') AS has_sign, bool_or(text ILIKE '%phạt tiền%' OR text LIKE '%trừ điểm%' OR text LIKE '%tước quyền%') AS has_penalty, bool_or(text ILIKE '%hồ sơ%' OR text LIKE '%thời hạn%') AS has_procedure FROM rec WHERE id % 31 = 0 GROUP BY 1")
def context_flags(orders):
    rows = statutes(orders).filter("id % 31 = 0").select("article", "text", F.lit(None).cast("boolean").alias("penal"), F.when(F.col("kind") == "5-LOW", "table").when(F.col("kind") == "2-HIGH", "sign").otherwise("text").alias("modality"))
    return assets.modality_flags(rows, "article")


@query("orders", sql=f"WITH {_REC} SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 1 ELSE 0.5 END AS DOUBLE) AS support FROM rec")
def claim_support_share(orders):
    rows = statutes(orders)
    claim = lambda c, q: F.struct(c.alias("claim"), q.alias("quote"))
    claims = F.array(claim(F.col("text"), F.lit("")), claim(F.lit("zq xw vk"), F.when(F.col("id") % 2 == 0, F.substring("text", 1, 30)).otherwise("")), claim(F.lit(""), F.lit("")))
    return rows.select("id", assets.claim_support("text", claims).alias("support"))


@query("conversations", sql="SELECT conv_id, md5(string_agg('## ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '- turn ' || turn, chr(10) || chr(10) ORDER BY turn)) AS document FROM conversations GROUP BY 1")
def conversation_markdown(conversations):
    rows = conversations.withColumn("refs", F.array(F.concat(F.lit("turn "), F.col("turn").cast("string"))))
    return assets.markdown(rows).select("conv_id", F.md5("markdown").alias("document"))


# --- Test sets ---

_BASIS = "'Căn cứ ' || CASE o_orderkey % 4 WHEN 0 THEN 'điểm ' || chr(CAST(97 + o_orderkey % 5 AS INT)) || ' ' ELSE '' END || CASE WHEN o_orderkey % 3 < 2 THEN 'khoản ' || CAST(o_orderkey % 9 AS STRING) || ' Điều ' || CAST(o_orderkey % 60 AS STRING) || 'a' ELSE 'Mục ' || CAST(o_orderkey % 7 AS STRING) || '.2' END"


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN (o_orderkey % 60) || 'A' ELSE (o_orderkey % 7) || '.2' END AS article, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 9 AS VARCHAR) ELSE '' END AS clause, CASE WHEN o_orderkey % 4 = 0 THEN chr(CAST(97 + o_orderkey % 5 AS INT)) ELSE '' END AS point, CASE WHEN o_orderkey % 3 = 2 THEN (o_orderkey % 7) || '.2' ELSE '' END AS section FROM orders")
def basis_parts(orders):
    rows = orders.selectExpr("o_orderkey", f"{_BASIS} AS b").select("o_orderkey", truth.legal_basis("b", F.lit("d")).alias("r"))
    return rows.select("o_orderkey", "r.article", "r.clause", "r.point", "r.section")


_KIND = "CASE WHEN q LIKE '%là gì%' THEN 'DEFINITION' WHEN b LIKE '%biển báo%' OR regexp_matches(b, '(?i)\\b(DP|IE|P|W|R|I|S|E)\\s*\\.?\\s*\\d{2,3}[a-zđ]?\\b') THEN 'SIGN_MEANING' WHEN b LIKE '%phạt%' OR b LIKE '%tiền%' THEN 'PENALTY' WHEN b LIKE '%hồ sơ%' OR b LIKE '%thời hạn%' THEN 'PROCEDURE' ELSE 'DEFINITION' END"


@query("benchmark", sql=f"SELECT item_id, {_KIND} AS kind FROM (SELECT item_id, lower(q0) AS q, lower(q0 || ' trả lời  ' || text) AS b FROM (SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN 'Vạch là gì ' WHEN 1 THEN 'Biển báo nào ' WHEN 2 THEN 'Mức phạt ' ELSE 'Cần hồ sơ nào ' END || text AS q0 FROM benchmark))")
def case_kinds(benchmark):
    asked = F.concat(F.expr("CASE item_id % 4 WHEN 0 THEN 'Vạch là gì ' WHEN 1 THEN 'Biển báo nào ' WHEN 2 THEN 'Mức phạt ' ELSE 'Cần hồ sơ nào ' END"), "text")
    return benchmark.select("item_id", truth.case_kind(asked, F.lit("trả lời"), F.lit(""), "text").alias("kind"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'VND:' || (o_orderkey % 900 + 100) || '000 number:' || (o_orderkey % 30) ELSE 'VND:' || (o_orderkey % 900 + 100) || '000' END AS numbers FROM orders")
def case_numbers(orders):
    answer = F.concat(F.lit("Phạt "), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit(".000 đồng trong "), (F.col("o_orderkey") % 30).cast("string"), F.lit(" ngày"))
    found = truth.expected_numbers(answer, F.lit(""), F.when(F.col("o_orderkey") % 2 == 0, "PROCEDURE").otherwise("PENALTY"))
    return orders.select("o_orderkey", F.array_join(F.transform(found, lambda n: F.concat(F.when(n["unit"] == "", n["type"]).otherwise(n["unit"]), F.lit(":"), n["value"])), " ").alias("numbers"))


@query("benchmark", sql="SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'has_penalty' WHEN 1 THEN 'has_sign' WHEN 2 THEN 'has_table' END AS flag FROM benchmark")
def needed_modalities(benchmark):
    rows = benchmark.selectExpr("item_id", "CASE item_id % 4 WHEN 0 THEN 'PENALTY' WHEN 1 THEN 'SIGN_MEANING' WHEN 2 THEN 'TABLE_LOOKUP' ELSE 'PENALTY' END AS kind", "CASE item_id % 4 WHEN 0 THEN 'Bị phạt thế nào? ' WHEN 1 THEN 'Ý nghĩa? ' WHEN 2 THEN 'Tra bảng ' ELSE 'Bị phạt? ' END || text AS q", "CASE item_id % 4 WHEN 0 THEN 'Nghị định 168' WHEN 1 THEN 'QCVN 41' ELSE 'Luật' END AS d")
    return rows.select("item_id", truth.needed_modality("kind", "q", "d").alias("flag"))


_LEX = f"""WITH d AS (SELECT doc_id AS id, {content('text')} AS w, {fold('text')} AS body FROM documents), x AS (SELECT id, unnest(w) AS t FROM d), b AS (SELECT item_id AS query_id, {content('text')} AS w, [v FOR v IN regexp_extract_all({fold('text')}, '[a-z0-9]+') IF len(v) >= 3] AS q FROM benchmark), y AS (SELECT query_id, unnest(w) AS t FROM b),
s AS (SELECT query_id, id, count(*) AS n FROM x JOIN y USING (t) GROUP BY 1, 2),
p AS (SELECT query_id, list_concat(list_concat([array_to_string(q[i:i + 4], ' ') FOR i IN range(1, len(q) - 3)], [array_to_string(q[i:i + 3], ' ') FOR i IN range(1, len(q) - 2)]), [array_to_string(q[i:i + 2], ' ') FOR i IN range(1, len(q) - 1)]) AS g FROM b),
k AS (SELECT query_id, list(v ORDER BY i) AS phrases FROM (SELECT query_id, v, min(i) AS i FROM (SELECT query_id, unnest(g) AS v, generate_subscripts(g, 1) AS i FROM p) GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT query_id, id, round(least(n, 30) * 0.15 + len([v FOR v IN phrases IF contains(body, v)]), 6) AS score FROM s JOIN d USING (id) JOIN k USING (query_id))
SELECT query_id, id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM z QUALIFY rank <= 8"""


@query("documents", "benchmark", sql=_LEX)
def lexical_search(documents, benchmark):
    """Search by shared words and phrases alone, every benchmark item over all documents."""
    rows = documents.select(F.col("doc_id").alias("id"), F.col("source").alias("document"), "text")
    asked = benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.array().cast("array<string>").alias("documents"))
    return truth.lexical_only(rows, asked).withColumn("score", F.round("score", 6))


@query("orders", "benchmark")
def case_chunks(orders, benchmark):
    """Rows only: the chunks that answers should come from; tests hold it against a plain search in tiers."""
    rows = statutes(orders).withColumn("chunk", F.concat_ws("|", "document", "article", "clause"))
    basis = F.concat(F.lit("khoản "), (1 + F.col("item_id") % 5).cast("string"), F.lit(" Điều "), (5 + F.col("item_id") % 6).cast("string"))
    cases = benchmark.select(F.col("item_id").alias("case_id"), truth.legal_basis(basis, F.lit("Nghị định 168/2024/NĐ-CP")).alias("ref"), F.concat(F.lit("trừ "), (F.col("item_id") % 12).cast("string"), F.lit(" điểm giấy phép lái xe")).alias("quote"))
    return truth.expected_chunks(cases, rows.select("id", "chunk", "document", "article", "clause", "point", "text"))


# --- Questions taken apart ---

_ASKED = "CASE item_id % 8 WHEN 0 THEN 'Xe máy vượt đèn đỏ bị phạt bao nhiêu?' WHEN 1 THEN 'Vượt đèn đỏ và không đội mũ bảo hiểm bị phạt thế nào?' WHEN 2 THEN 'Chạy quá tốc độ bị xử phạt ra sao?' WHEN 3 THEN 'Chi tiết Điều 6 Nghị định 168' WHEN 4 THEN 'Thủ tục cấp đổi giấy phép lái xe' WHEN 5 THEN 'Biển P.102 là gì?' WHEN 6 THEN 'Nếu gây tai nạn đồng thời có nồng độ cồn thì bị xử lý thế nào?' ELSE 'Xe ô tô chạy quá tốc độ 25 km/h bị phạt bao nhiêu tiền?' END"


def asked(benchmark):
    """Every benchmark item's whole text after a question on traffic."""
    return benchmark.selectExpr("item_id AS query_id", f"{_ASKED} || ' ' || text AS question")


@query("benchmark")
def question_complexity(benchmark):
    """Rows only: how complex questions are, and what may be spent on them; tests hold them against worked examples."""
    rows = asked(benchmark).withColumn("facets", planner.facets("question"))
    rows = rows.withColumn("score", decompose.complexity("question", F.col("facets"), F.size("facets")))
    return rows.select("query_id", "score", decompose.budget(F.col("score")).alias("b")).select("query_id", "score", "b.*")


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(f, '{t}')" for t in terms) + ")"


_VEHICLE = "CASE " + " ".join(f"WHEN {_any(terms)} THEN '{name}'" for name, terms in rules.VEHICLES) + " END"
_OPEN = f"CASE WHEN {_VEHICLE} IS NULL AND {_any(rules.PENALTY_QUESTION)} AND {_any(rules.ANY_VEHICLE)} THEN 'car,motorbike,specialized' || CASE WHEN NOT {_any(rules.SPEED_QUESTION)} OR {_any(('tat ca', 'toan bo', 'phuong tien', 'chay xe'))} THEN ',bicycle' ELSE '' END ELSE '' END"


@query("benchmark", sql=f"SELECT query_id, {_VEHICLE} AS vehicle, {_OPEN} AS open FROM (SELECT item_id AS query_id, {fold(f'({_ASKED} || chr(32) || text)')} AS f FROM benchmark)")
def question_vehicles(benchmark):
    return asked(benchmark).select("query_id", scoring.vehicle(text.fold("question")).alias("vehicle"), F.array_join(decompose.open_vehicles("question"), ",").alias("open"))


@query("benchmark", sql="SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'vượt đèn đỏ | không đội mũ bảo hiểm' ELSE '' END AS acts FROM benchmark")
def compound_questions(benchmark):
    rows = benchmark.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("vượt đèn đỏ và không đội mũ bảo hiểm và "), F.lit("phạt"))).otherwise(F.concat(F.lit("vượt đèn đỏ "), F.lit("bị phạt"))).alias("q"))
    return rows.select("query_id", F.array_join(decompose.compound_acts("q"), " | ").alias("acts"))


@query("benchmark")
def question_parts(benchmark):
    """Rows only: the parts of questions; tests hold them against worked examples."""
    return decompose.parts(asked(benchmark), "query_id", "question")


@query("orders", sql="WITH u AS (SELECT o_custkey AS query_id, o_orderpriority AS query, min(o_orderkey) AS p, 0 AS age FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT o_custkey, o_orderpriority, min(o_orderkey), 1 FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, query ORDER BY age, p) = 1), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY age, p, query) <= 4) SELECT query_id, query, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, age, query) AS INTEGER) AS place FROM f")
def slot_append(orders):
    part = lambda n: orders.filter(f"o_orderkey % 2 = {n}").groupBy(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("query")).agg(F.min("o_orderkey").alias("priority")).withColumn("facet", F.lit("penalty"))
    return decompose.appended(part(0), part(1), "query_id", 4).select("query_id", "query", "place")


@query("orders", sql="WITH h AS (SELECT o_custkey AS query_id, o_orderkey % 40 AS id, min(o_orderkey % 3) AS place FROM orders GROUP BY 1, 2), s AS (SELECT h.*, max(CAST(o_orderkey % 17 AS DOUBLE)) AS score FROM h JOIN orders ON o_custkey = query_id AND o_orderkey % 40 = id AND o_orderkey % 3 = place GROUP BY ALL) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def slot_merge(orders):
    hits = orders.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 3).alias("place"), (F.col("o_orderkey") % 40).alias("id"), (F.col("o_orderkey") % 17).cast("double").alias("score"))
    return decompose.merged(hits, 5).select("query_id", "id", "rank")


@query("orders", "customer", sql="SELECT c_custkey AS query_id, p AS place, coalesce(n, 0) AS n_rows, CASE WHEN n > 0 THEN 'hit' ELSE 'empty' END AS status FROM (SELECT c_custkey, unnest([0, 1, 2]) AS p FROM customer) LEFT JOIN (SELECT o_custkey, o_orderkey % 3 AS m, count(*) AS n FROM orders GROUP BY 1, 2) ON o_custkey = c_custkey AND m = p")
def slot_coverage(orders, customer):
    slots = customer.select(F.col("c_custkey").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("place"), F.lit("rule").alias("facet"))
    hits = orders.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 3).cast("int").alias("place"), F.array(F.lit("x")).alias("images"))
    return decompose.coverage(slots, hits).select("query_id", "place", "n_rows", "status")


@query("orders", sql="WITH v AS (SELECT o_custkey AS query_id, list_distinct(list(CASE 6 + o_orderkey % 3 WHEN 6 THEN 'car' WHEN 7 THEN 'motorbike' ELSE 'specialized' END)) AS have, bool_or(o_orderkey % 4 = 0) AS money FROM orders GROUP BY 1), g AS (SELECT query_id, list_concat([{'k': 'vehicle', 'd': x} FOR x IN ['car', 'motorbike', 'specialized', 'bicycle'] IF NOT list_contains(have, x)], CASE WHEN NOT money THEN [{'k': 'amount', 'd': ''}] ELSE [] END) AS g FROM v) SELECT query_id, u.k AS kind, u.d AS detail FROM (SELECT query_id, unnest(g) AS u FROM g)")
def search_gaps(orders):
    """What searches left open: vehicles without rows, and amounts; each customer is a question, each order a row found."""
    asked = orders.select(F.col("o_custkey").alias("query_id")).distinct().select("query_id", F.lit("Xe vi phạm bị phạt thế nào").alias("question"), F.array(F.lit("penalty")).alias("facets"))
    found = orders.select(F.col("o_custkey").alias("query_id"), F.lit("penalty").alias("facet"), F.lit("Nghị định 168/2024/NĐ-CP").alias("document"), (6 + F.col("o_orderkey") % 3).cast("string").alias("article"), F.when(F.col("o_orderkey") % 4 == 0, "Phạt 1.000.000 đồng").otherwise("Hành vi khác").alias("text"), F.array(F.lit("x")).alias("images"))
    return decompose.gaps(asked, found).select("query_id", "kind", "detail")


@query("orders", sql="SELECT o_orderkey, o_orderkey % 3 <> 0 AS unresolved FROM orders")
def answer_ambiguity(orders):
    answer = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Phạt ' || o_orderkey || ' đồng' WHEN 1 THEN 'Phạt tiền theo quy định' ELSE 'Có thể bị phạt ' || o_orderkey END")
    return orders.select("o_orderkey", decompose.unresolved(answer, F.lit("Xe máy vượt đèn đỏ phạt bao nhiêu"), F.array(F.lit("penalty"))).alias("unresolved"))
