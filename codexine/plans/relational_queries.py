"""Queries of joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import aggregates, joins, windows
from ..sources import sinks
from .registry import query, tokens

_PROBES = "SELECT c_custkey AS probe_id, c_custkey AS document, CASE WHEN c_nationkey % 2 = 0 THEN '1-URGENT' END AS article, CASE WHEN c_nationkey % 4 = 0 THEN 'F' END AS clause FROM customer"
_ROWS = "SELECT o_orderkey AS id, o_custkey AS document, o_orderpriority AS article, o_orderstatus AS clause FROM orders"


def _probes(customer):
    even, fourth = F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") % 4 == 0
    return customer.select(F.col("c_custkey").alias("probe_id"), F.col("c_custkey").alias("document"), F.when(even, "1-URGENT").alias("article"), F.when(fourth, "F").alias("clause"))


def _rows(orders):
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("article"), F.col("o_orderstatus").alias("clause"))


_LEVELS = [["document", "article", "clause"], ["document", "article"], ["document"]]
_LEVEL_SQL = f"""
WITH p AS ({_PROBES}), r AS ({_ROWS}), f AS (
  SELECT p.probe_id, r.id, CASE WHEN p.article = r.article AND p.clause = r.clause THEN 0 WHEN p.article = r.article THEN 1 ELSE 2 END AS level
  FROM p JOIN r ON p.document = r.document)
"""


@query("customer", "orders", sql=_LEVEL_SQL + "SELECT probe_id, id, CAST(level AS INTEGER) AS level FROM f")
def reference_levels(customer, orders):
    return joins.level_join(_probes(customer), _rows(orders), _LEVELS).select("probe_id", "id", "level")


@query("customer", "orders", sql=_LEVEL_SQL + "SELECT probe_id, id, CAST(level AS INTEGER) AS level FROM f QUALIFY level = min(level) OVER (PARTITION BY probe_id)")
def tiered_fallback(customer, orders):
    return joins.level_join(_probes(customer), _rows(orders), _LEVELS, first_only=True).dropDuplicates(["probe_id", "id"]).select("probe_id", "id", "level")


@query("customer", "orders", sql=f"WITH p AS ({_PROBES}), r AS ({_ROWS}) SELECT p.probe_id, r.id FROM p JOIN r ON p.document = r.document AND (p.article IS NULL OR p.article = r.article) AND (p.clause IS NULL OR p.clause = r.clause)")
def reference_prefix(customer, orders):
    return joins.prefix_join(_probes(customer), _rows(orders), ["document", "article", "clause"], "id").select("probe_id", "id")


@query("part", "nation", sql="SELECT n_nationkey, count(*) AS n_parts, CAST(sum(p_partkey) AS BIGINT) AS key_sum FROM part JOIN nation ON p_size BETWEEN n_nationkey AND n_nationkey + n_regionkey GROUP BY n_nationkey")
def interval_pages(part, nation):
    spans = nation.select("n_nationkey", F.col("n_nationkey").alias("page_start"), (F.col("n_nationkey") + F.col("n_regionkey")).alias("page_end"))
    return joins.interval_join(part, spans, "p_size", "page_start", "page_end", width=4).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("p_partkey").alias("key_sum"))


@query(
    "events", "orders",
    sql="""
WITH o AS (SELECT o_custkey AS user_id, o_orderdate + INTERVAL 9000 DAY AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT e.event_id, o.o_orderkey AS last_order FROM events e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.at
""",
)
def asof_last_order(events, orders):
    o = orders.groupBy(F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 9000 DAY")).alias("at")).agg(F.max("o_orderkey").alias("last_order"))
    return joins.asof_backward(events.select("event_id", "user_id", "ts"), o, ["user_id"], "ts", "at", ["last_order"]).select("event_id", "last_order")


@query("customer", "orders", sql="SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_missing(customer, orders):
    return joins.linked_anti(customer, orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("supplier", "lineitem", sql="SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 45)")
def semi_exists(supplier, lineitem):
    hit = lineitem.filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return supplier.join(hit, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("customer", "nation", sql="SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'c_mktsegment' ELSE '' END AS repaired FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def left_repair(customer, nation):
    fixes = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_mktsegment"))
    out = joins.coalesce_join(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), fixes, ["c_nationkey"], ["c_mktsegment"], lambda c: c.isNull() | (c == "BUILDING"))
    return out.select("c_custkey", "c_mktsegment", F.array_join("repaired", ",").alias("repaired"))


@query("lineitem", sql="WITH p AS (SELECT l_orderkey, min(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, p.q AS parent_l_quantity FROM lineitem l LEFT JOIN p USING (l_orderkey) WHERE l.l_linenumber <> 1")
def self_parent(lineitem):
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.parent_join(rows, ["l_orderkey"], "l_quantity", F.col("l_linenumber") == 1, ["l_quantity"])


@query(
    "supplier", "customer",
    sql="""
SELECT s_suppkey, CAST(abs(floor(s_acctbal) - floor(c_acctbal)) AS BIGINT) AS distance, c_custkey AS near_c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey
WHERE abs(floor(s_acctbal) - floor(c_acctbal)) <= 300
QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(floor(s_acctbal) - floor(c_acctbal)), floor(c_acctbal), c_custkey) = 1
""",
)
def nearest_customer(supplier, customer):
    s = supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor("s_acctbal").alias("at"))
    c = customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor("c_acctbal").alias("c_at"))
    return joins.nearest_join(s, c, ["nation"], "s_suppkey", "at", "c_at", 300, ["c_custkey"]).select("s_suppkey", "distance", "near_c_custkey")


@query("orders", sql="SELECT * FROM (SELECT 'max' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12) UNION ALL SELECT * FROM (SELECT 'min' AS side, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY o_totalprice, o_orderkey LIMIT 12)")
def extreme_amounts(orders):
    top = aggregates.extremes(orders, "o_totalprice", "o_orderkey", 12).select(F.lit("max").alias("side"), "o_orderkey", "o_totalprice")
    return top.unionByName(aggregates.extremes(orders, "o_totalprice", "o_orderkey", 12, False).select(F.lit("min").alias("side"), "o_orderkey", "o_totalprice"))


@query("orders", sql="WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 12) SELECT o_custkey, n, array_to_string(list_sort(list(o_orderkey))[1:4], ',') AS samples FROM b JOIN orders USING (o_custkey) GROUP BY ALL")
def frequent_groups(orders):
    out = aggregates.frequencies(orders, ["o_custkey"], 12, "o_orderkey")
    return out.select("o_custkey", "n", F.concat_ws(",", F.transform("samples", lambda x: x.cast("string"))).alias("samples"))


@query("part", sql="SELECT p_brand, p_type, count(DISTINCT p_size) AS n_sizes, count(*) AS n, CAST(min(p_retailprice) AS DOUBLE) AS low, CAST(max(p_retailprice) AS DOUBLE) AS high FROM part GROUP BY 1, 2")
def distinct_catalog(part):
    return part.groupBy("p_brand", "p_type").agg(F.countDistinct("p_size").alias("n_sizes"), F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("customer", sql="WITH x AS (SELECT c_nationkey, CAST(max(c_custkey) AS BIGINT) AS last, list(DISTINCT c_custkey) AS have FROM customer WHERE c_custkey >= 1 GROUP BY 1) SELECT c_nationkey, last, CAST(last - len(have) AS BIGINT) AS n_missing, array_to_string([i for i in range(1, last + 1) if not list_contains(have, i)][1:20], ',') AS missing FROM x")
def missing_sequence(customer):
    out = aggregates.missing_numbers(customer, ["c_nationkey"], "c_custkey")
    return out.select("c_nationkey", "last", "n_missing", F.concat_ws(",", F.transform("missing", lambda x: x.cast("string"))).alias("missing"))


_WORDS = tokens("text")


@query("documents", sql=f"SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE len({_WORDS}) < 20) AS n_short, count(*) FILTER (WHERE len({_WORDS}) > 900) AS n_long, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS n_blank, count(*) FILTER (WHERE lang = 'en') AS n_en FROM documents GROUP BY source")
def record_profile(documents):
    n = F.size(text.tokens("text"))
    return aggregates.profile(documents, ["source"], n_short=n < 20, n_long=n > 900, n_blank=F.col("text").isNull() | (F.trim("text") == ""), n_en=F.col("lang") == "en")


@query("documents", sql="WITH s AS (SELECT lang, list_sort(list(n_chars)) AS v, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY lang) SELECT lang, v[CAST(round_even((n - 1) * 0.5, 0) AS INTEGER) + 1] AS p50, v[CAST(round_even((n - 1) * 0.9, 0) AS INTEGER) + 1] AS p90, v[CAST(round_even((n - 1) * 0.95, 0) AS INTEGER) + 1] AS p95, v[CAST(round_even((n - 1) * 0.99, 0) AS INTEGER) + 1] AS p99 FROM s")
def length_percentiles(documents):
    return aggregates.nearest_percentiles(documents, ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query("documents", "labels", sql="SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, count(*) AS n, CAST(round(avg(quality), 6) AS DOUBLE) AS quality, CAST(round(avg(toxic), 6) AS DOUBLE) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def evaluation_summary(documents, labels):
    return aggregates.summary_with_total(documents.join(labels, "doc_id"), "lang", F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("documents", sql="SELECT what, name, n FROM (SELECT 'source' AS what, source AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2)")
def system_status(documents):
    count = lambda c: documents.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("what"), "name", "n")
    return count("source").unionByName(count("lang"))


@query("documents", sql="SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(documents):
    return documents.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("documents", sql=f"WITH t AS (SELECT lang, unnest({_WORDS}) AS w FROM documents) SELECT lang, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct, CAST(round(count(DISTINCT w) / count(*), 6) AS DOUBLE) AS ratio FROM t GROUP BY lang")
def type_token_ratio(documents):
    t = documents.select("lang", F.explode(text.tokens("text")).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct")).withColumn("ratio", F.round(F.col("n_distinct") / F.col("n_tokens"), 6))


@query("documents", sql=f"WITH t AS (SELECT lang, unnest({_WORDS}) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY 1, 2) SELECT lang, w, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 30")
def top_terms(documents):
    c = documents.select("lang", F.explode(text.tokens("text")).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter("r <= 30").drop("r")


@query("part", "lineitem", sql="WITH h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 25) SELECT p_brand, count(*) AS expected, count(l_partkey) AS found, CAST(round(count(l_partkey) / count(*), 6) AS DOUBLE) AS coverage FROM part LEFT JOIN h ON l_partkey = p_partkey GROUP BY p_brand")
def chunk_coverage(part, lineitem):
    brands = part.select("p_brand", "p_partkey")
    have = lineitem.filter("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey")).distinct().join(brands, "p_partkey")
    return aggregates.set_coverage(brands, have, ["p_brand"], "p_partkey").withColumn("coverage", F.round("coverage", 6))


_SCORE = "greatest(0, 0.6 * (found / n) + 0.25 * (big / n) + 0.15 * (flagged / n) - least(0.2, 0.5 * (small / n))) * (1 - returned / n)"


@query("lineitem", sql=f"WITH x AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 5) AS found, count(*) FILTER (WHERE l_quantity > 10) AS big, count(*) FILTER (WHERE l_linestatus = 'O') AS flagged, count(*) FILTER (WHERE l_quantity < 3) AS small, count(*) FILTER (WHERE l_discount > 0.09) AS returned FROM lineitem GROUP BY 1) SELECT l_suppkey, CAST(round({_SCORE}, 6) AS DOUBLE) AS score, CASE WHEN returned / n > 0.1 THEN 'dirty' WHEN {_SCORE} > 0.95 THEN 'ready' ELSE 'incomplete' END AS status FROM x")
def coverage_scores(lineitem):
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    x = lineitem.groupBy("l_suppkey").agg(share(F.col("l_quantity") > 5).alias("a"), share(F.col("l_quantity") > 10).alias("b"), share(F.col("l_linestatus") == "O").alias("c"), share(F.col("l_quantity") < 3).alias("d"), share(F.col("l_discount") > 0.09).alias("g"))
    x = x.withColumn("s", aggregates.coverage_score(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("g")))
    return x.select("l_suppkey", F.round("s", 6).alias("score"), aggregates.coverage_status(F.col("s"), F.col("g")).alias("status"))


@query("documents", sql="WITH c AS (SELECT count(*) AS n, count(*) - count(DISTINCT text) AS dup, count(*) FILTER (WHERE len(text) < 100) AS short FROM documents) SELECT 'duplicates' AS name, dup AS n, CASE WHEN dup = 0 THEN 'PASS' WHEN dup < 0.2 * n THEN 'WARN' ELSE 'FAIL' END AS status FROM c UNION ALL SELECT 'short', short, CASE WHEN short = 0 THEN 'PASS' WHEN short < 0.2 * n THEN 'WARN' ELSE 'FAIL' END FROM c")
def quality_gate(documents):
    c = documents.agg(F.count(F.lit(1)).alias("all"), (F.count(F.lit(1)) - F.countDistinct("text")).alias("duplicates"), F.count_if(F.length("text") < 100).alias("short"))
    rows = c.unpivot(["all"], ["duplicates", "short"], "name", "n")
    return rows.select("name", "n", F.when(F.col("n") == 0, "PASS").when(F.col("n") < 0.2 * F.col("all"), "WARN").otherwise("FAIL").alias("status"))


@query(
    "orders",
    sql="""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, 200.0 * count(*) / sum(count(*)) OVER () AS exact FROM orders GROUP BY 1, 2),
r AS (SELECT *, floor(exact) AS whole, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, o_orderstatus, o_orderpriority) AS nth, 200 - sum(floor(exact)) OVER () AS remaining FROM c)
SELECT o_orderstatus, o_orderpriority, CAST(least(n, whole + CASE WHEN nth <= remaining THEN 1 ELSE 0 END) AS BIGINT) AS n FROM r
""",
)
def stratified_allocation(orders):
    return aggregates.stratified_sample(orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 200, 7).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "documents",
    sql="""
WITH l AS (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT DISTINCT source, doc_id, trim(unnest(list_concat(l[1:5], l[greatest(len(l) - 4, 1):]))) AS line FROM l),
c AS (SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM e WHERE line <> '' AND len(line) < 150 GROUP BY 1, 2)
SELECT source, line, n_pages, of_pages FROM c JOIN (SELECT source, count(DISTINCT doc_id) AS of_pages FROM documents GROUP BY 1) USING (source) WHERE n_pages >= 0.02 * of_pages AND n_pages > 1
""",
)
def boilerplate(documents):
    return aggregates.boilerplate_lines(documents, "source", "doc_id", "text", share=0.02).filter("n_pages > 1").select("source", "line", "n_pages", "of_pages")


@query(
    "events",
    sql="""
WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN event_id END AS chapter, CASE WHEN event_type = 'purchase' THEN event_id END AS article FROM events),
a AS (SELECT *, last_value(chapter IGNORE NULLS) OVER w AS ch FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, ch AS chapter, last_value(article IGNORE NULLS) OVER (PARTITION BY user_id, ch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS article FROM a
""",
)
def carried_forward(events):
    rows = events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("chapter"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("article"))
    return windows.carry_forward(rows, ["user_id"], ["ts", "event_id"], ["chapter", "article"]).select("event_id", "chapter", "article")


@query(
    "events",
    sql="""
WITH m AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events)
SELECT user_id, island, count(*) AS n_lines, min(event_id) AS first, max(event_id) AS last, string_agg(event_type, chr(10) ORDER BY event_id) AS text FROM m GROUP BY 1, 2
""",
)
def chunk_islands(events):
    return windows.island_texts(windows.islands(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup"), ["user_id"], "event_id", "event_type")


@query("part", sql="SELECT p_partkey, CAST(greatest(coalesce(lag(p_retailprice) OVER w + 8, p_retailprice - 220), p_retailprice - 220) AS DOUBLE) AS band_from, CAST(p_retailprice - 5 AS DOUBLE) AS band_to FROM (SELECT min(p_partkey) AS p_partkey, p_brand, p_retailprice FROM part GROUP BY 2, 3) WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)")
def caption_bands(part):
    rows = part.groupBy("p_brand", "p_retailprice").agg(F.min("p_partkey").alias("p_partkey"))
    return windows.bands(rows, ["p_brand"], "p_retailprice", 8, 220).select("p_partkey", "band_from", "band_to")


@query("conversations", sql="SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8")
def history_window(conversations):
    return windows.last_of(conversations.filter(F.col("role").isin("user", "assistant")), ["conv_id"], "turn", 8)


@query("conversations", sql="SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user') AS last_user, max_by(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id")
def history_summary(conversations):
    return windows.last_by_role(conversations, ["conv_id"], "turn", "role", "text", ["user", "assistant"])


@query("conversations", sql="SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 1000")
def budgeted_turns(conversations):
    rows = conversations.withColumn("n", F.length("text"))
    return windows.within_budget(rows, ["conv_id"], ["turn"], "n", 1000).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@query("orders", sql="SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_per_group(orders):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return orders.withColumn("r", r).filter("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("customer", sql="WITH s AS (SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN 1 ELSE 0 END) AS inside FROM customer GROUP BY 1) SELECT c_custkey, c_nationkey FROM customer JOIN s USING (c_nationkey) WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 9000) OR inside = 0")
def scope_or_all(customer):
    inside = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)
    return windows.keep_all_if_none(customer, ["c_nationkey"], inside).select("c_custkey", "c_nationkey")


@query("documents", sql="SELECT doc_id, CAST((CASE WHEN t LIKE '%the%' OR t LIKE '%der%' THEN 1 ELSE 0 END) + (CASE WHEN t LIKE '%ing%' OR t LIKE '%ung%' THEN 1 ELSE 0 END) AS INTEGER) AS groups FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE (t LIKE '%the%' OR t LIKE '%der%') AND (t LIKE '%ing%' OR t LIKE '%ung%')")
def term_groups(documents):
    t = F.lower("text")
    groups = [text.contains_any(t, g) for g in (("the", "der"), ("ing", "ung"))]
    return documents.filter(groups[0] & groups[1]).select("doc_id", (groups[0].cast("int") + groups[1].cast("int")).alias("groups"))


@query("documents", sql="SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND n_chars > 1000")
def filtered_flags(documents):
    return documents.filter(F.col("source").isin("src1", "src2") & (F.col("lang") == "en") & (F.col("n_chars") > 1000)).select("doc_id", "source")


@query("lineitem", sql="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_extendedprice) = 1")
def keyed_upsert(lineitem):
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return sinks.upserted(rows.filter("l_quantity < 25"), rows.filter("l_quantity >= 25"), ["l_orderkey", "l_linenumber"], [F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_extendedprice")


@query(
    "orders",
    sql="""
WITH r AS (SELECT o_orderkey AS id, o_custkey AS source_chunk_id, CASE o_orderstatus WHEN 'F' THEN 'enriched_rule' WHEN 'O' THEN 'source_legal_unit' ELSE 'legacy' END AS record_type, CASE WHEN o_orderpriority = '1-URGENT' THEN 'source_table_preserved' END AS enrichment_status FROM orders)
SELECT id, source_chunk_id, record_type FROM r WHERE NOT (record_type = 'source_legal_unit' AND enrichment_status IS NULL AND source_chunk_id IN (SELECT source_chunk_id FROM r WHERE record_type = 'enriched_rule'))
""",
)
def fallback_rows_dropped(orders):
    kind = F.when(F.col("o_orderstatus") == "F", "enriched_rule").when(F.col("o_orderstatus") == "O", "source_legal_unit").otherwise("legacy")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_chunk_id"), kind.alias("record_type"), F.when(F.col("o_orderpriority") == "1-URGENT", "source_table_preserved").alias("enrichment_status"))
    return sinks.without_fallbacks(rows).select("id", "source_chunk_id", "record_type")


@query("customer", "supplier", sql="SELECT c_nationkey AS nation, 'both' AS what FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customers only' FROM customer EXCEPT SELECT s_nationkey, 'customers only' FROM supplier)")
def set_operations(customer, supplier):
    c, s = customer.select(F.col("c_nationkey").alias("nation")), supplier.select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).withColumn("what", F.lit("both")).unionByName(c.subtract(s).withColumn("what", F.lit("customers only")))


@query("lineitem", sql="SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS DOUBLE) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) AS r FROM lineitem GROUP BY 1")
def flag_pivot(lineitem):
    return lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).select("l_suppkey", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f.lower()) for f in "ANR"])


@query("part", sql="SELECT p_partkey, regexp_replace(p_brand, '\\d+', '') || lpad(regexp_extract(p_brand, '\\d+'), 12, '0') AS natural_key FROM part")
def natural_order(part):
    return part.select("p_partkey", arrays.natural_key("p_brand").alias("natural_key"))
