"""Queries of the text, array and record functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import aggregates, records
from ..sources import readers
from . import planner
from .registry import content, fold, query, tokens


@query("documents", sql=f"SELECT doc_id, md5({fold('text')}) AS folded, CAST(len({fold('text')}) AS INTEGER) AS n_folded FROM documents")
def fold_ascii(documents):
    return documents.select("doc_id", F.md5(text.fold("text")).alias("folded"), F.length(text.fold("text")).alias("n_folded"))


@query("documents", sql=f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)")
def tokenize_count(documents):
    rows = documents.select("doc_id", text.tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("benchmark", sql=f"SELECT item_id, array_to_string(list_sort({content('text')}), ' ') AS words FROM benchmark")
def content_words(benchmark):
    return benchmark.select("item_id", F.array_join(F.array_sort(text.content_tokens("text")), " ").alias("words"))


@query("documents", sql=r"SELECT doc_id, md5(n) AS normal, md5(replace(n, ' ', '')) AS compact FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g')) AS n FROM documents)")
def normalize_compact(documents):
    return documents.select("doc_id", F.md5(text.normalize_text("text")).alias("normal"), F.md5(text.compact_text("text")).alias("compact"))


@query("documents", sql="SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, regexp_replace(left(sha256(concat_ws('|', source, lang, CAST(doc_id AS VARCHAR))), 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id FROM documents")
def sha_fingerprint(documents):
    return documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), text.fingerprint("source", "lang", "doc_id").alias("point_id"))


_CODE = "concat(element_at(array('P', 'W', 'R', 'I', 'S', 'DP', 'IE', 'X'), cast(p_partkey % 8 as int) + 1), '. ', 100 + p_partkey % 200, 'a')"
_CODE_SQL = "['P', 'W', 'R', 'I', 'S', 'DP', 'IE', 'X'][p_partkey % 8 + 1] || '. ' || (100 + p_partkey % 200) || 'a'"


@query("part", sql=f"SELECT p_partkey, upper(regexp_replace({_CODE_SQL}, '[\\s.]+', '', 'g')) AS code, ['prohibition', 'warning', 'mandatory', 'guide', 'supplementary', 'highway', 'guide', 'unknown'][p_partkey % 8 + 1] AS sign_group FROM part")
def sign_code_groups(part):
    rows = part.select("p_partkey", F.expr(_CODE).alias("raw"))
    return rows.select("p_partkey", text.normalize_sign_code("raw").alias("code"), text.sign_group("raw").alias("sign_group"))


@query("part", sql=f"SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN '' ELSE upper(regexp_replace({_CODE_SQL}, '[\\s.]+', '', 'g')) END AS codes FROM part")
def sign_code_extract(part):
    rows = part.select("p_partkey", F.concat(F.lit("biển "), F.expr(_CODE), F.lit(" và "), F.expr(_CODE)).alias("t"))
    return rows.select("p_partkey", F.array_join(text.sign_codes("t"), ",").alias("codes"))


@query(
    "orders",
    sql="SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS first_amount, CASE WHEN o_orderkey % 50 > 0 THEN CAST((o_orderkey % 50) * 1000000 + 500000 AS BIGINT) ELSE CAST(500000 AS BIGINT) END AS largest_unit, CAST(2 AS INTEGER) AS n FROM orders WHERE floor(o_totalprice) > 0",
)
def money_extract(orders):
    grouped = F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit("."))
    said = F.concat(F.lit("Phạt tiền từ "), grouped, F.lit(" đồng hoặc "), (F.col("o_orderkey") % 50).cast("string"), F.lit(",5 Triệu đồng"))
    rows = orders.filter(F.floor("o_totalprice") > 0).select("o_orderkey", text.money_values(said).alias("v"))
    return rows.select("o_orderkey", F.get("v", F.lit(0)).alias("first_amount"), F.get("v", F.lit(1)).alias("largest_unit"), F.size("v").alias("n"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS article, CAST(l_linenumber AS VARCHAR) AS clause, l_linestatus AS point, count(*) AS n FROM lineitem GROUP BY ALL")
def reference_parse(lineitem):
    said = F.concat(F.lit("Theo Điểm "), "l_linestatus", F.lit(" khoản "), F.col("l_linenumber").cast("string"), F.lit(" ĐIỀU "), F.col("l_suppkey").cast("string"), F.lit(" Nghị định"))
    ref = lineitem.select("l_orderkey", "l_linenumber", F.get(text.explicit_refs(said), F.lit(0)).alias("r"))
    return ref.select("l_orderkey", "l_linenumber", "r.article", "r.clause", "r.point").groupBy("l_orderkey", "l_linenumber", "article", "clause", "point").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lineitem",
    sql="SELECT 'Nghi dinh ' || l_suppkey AS document, CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS clause, 'Nghi dinh ' || l_suppkey || '|D' || l_partkey || CASE WHEN l_linenumber = 1 THEN '' ELSE '|K' || l_linenumber END AS ref_key, CASE WHEN l_linenumber = 1 THEN '' ELSE 'Khoản ' || l_linenumber || ', ' END || 'Điều ' || l_partkey || ', Nghi dinh ' || l_suppkey AS reference, count(*) AS n FROM lineitem WHERE l_partkey > 0 GROUP BY ALL",
)
def chunk_reference(lineitem):
    ident = F.concat(F.lit("Nghi_dinh_"), "l_suppkey", F.lit("_"), "l_partkey", F.lit("_"), F.when(F.col("l_linenumber") == 1, "0").otherwise(F.col("l_linenumber").cast("string")), F.lit("_0_ab12cd"))
    r = lineitem.filter("l_partkey > 0").select(text.chunk_ref(ident).alias("r")).select("r.*")
    none = F.lit(None).cast("string")
    named = r.select("document", "clause", text.ref_key("document", "article", "clause", "point").alias("ref_key"), text.format_reference("point", "clause", "article", none, none, "document").alias("reference"))
    return named.groupBy("document", "clause", "ref_key", "reference").agg(F.count(F.lit(1)).alias("n"))


@query("events", sql="SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM events GROUP BY ALL")
def json_properties(events):
    rows = events.withColumn("k", F.from_json("props", "k long")["k"])
    return rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "documents",
    sql=r"""
WITH raw AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])\s+', E'\\1\n', 'g'), '\n+')) AS s FROM documents),
clean AS (SELECT doc_id, regexp_replace(s, '^[\s•-]+|[\s•-]+$', '', 'g') AS s FROM raw),
counted AS (SELECT doc_id, len(string_split_regex(s, '\s+')) AS w FROM clean WHERE s <> '')
SELECT doc_id, CAST(sum(CASE WHEN w <= 85 THEN 1 ELSE ceil(w / 60.0) END) AS BIGINT) AS n_pieces, CAST(sum(w) AS BIGINT) AS n_words FROM counted GROUP BY doc_id
""",
)
def sentence_pieces(documents):
    rows = documents.select("doc_id", F.explode(text.sentence_pieces("text")).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(F.size(F.split("s", r"\s+", -1))).alias("n_words"))


@query("documents", sql=r"WITH c AS (SELECT doc_id, text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN len(s) > 220 THEN rtrim(left(s, 220)) || '…' ELSE s END AS snippet, md5(CASE WHEN len(text) > 1800 THEN left(text, 1350) || chr(10) || '...' || chr(10) || right(text, 450) ELSE coalesce(text, '') END) AS embedded FROM c")
def snippets(documents):
    return documents.select("doc_id", text.snippet("text").alias("snippet"), F.md5(text.embedding_text("text")).alias("embedded"))


@query("documents")
def cleaned_text(documents):
    """Rows only: the cleaner's lookaheads have no counterpart in the other engine."""
    return documents.select("doc_id", text.clean_text("text").alias("clean"), F.sha2(text.clean_text("text"), 256).alias("norm_sha256"))


@query("documents", sql=r"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(line) AS line, lower(trim(line)) AS low FROM l) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line <> '' AND (regexp_matches(low, '^-?\s*\d{1,4}\s*-?$') OR regexp_matches(low, '^trang\s+\d{1,4}(\s*/\s*\d{1,4})?$') OR regexp_matches(low, '^[ivxlcdm]{1,4}$') OR (len(line) <= 5 AND regexp_matches(line, '^[A-ZĐ\s.]+$') AND line NOT IN ('MỤC', 'PHẦN')) OR regexp_matches(low, 'https?://|www\.') OR regexp_matches(low, '^(?:ngày|ngay)\s*:\s*\d{6,}[\s.]*$'))) AS n_noise FROM t GROUP BY doc_id")
def noise_lines(documents):
    rows = documents.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(text.is_noise_line("line")).alias("n_noise"))


@query("documents", sql=r"SELECT doc_id, list_sort(list_distinct(flatten([CASE WHEN regexp_full_match(r, '\d+|\d{1,3}(\.\d{3})+') THEN [replace(r, ',', '.'), coalesce(nullif(ltrim(replace(r, '.', ''), '0'), ''), '0')] ELSE [replace(r, ',', '.')] END for r in regexp_extract_all(coalesce(text, ''), '\d+(?:[.,]\d+)*')]))) AS numbers FROM documents")
def answer_numbers(documents):
    return documents.select("doc_id", F.array_sort(text.answer_numbers("text")).alias("numbers"))


@query("pages", sql=r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1)) AS INTEGER) AS n_items, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading FROM pages")
def page_items(pages):
    return pages.select("page_id", F.size(readers.html_items("li")).alias("n_items"), F.coalesce(F.get(readers.html_items("h1"), F.lit(0)), F.lit("")).alias("heading"))


_HTML = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query("pages", sql=rf"WITH p AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace({_HTML}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, md5(t) AS text_md5, CAST(len(t) AS INTEGER) AS text_len, CAST(len(regexp_extract_all(t, '\S+')) AS INTEGER) AS word_count, len(t) < 80 AS low_text FROM p")
def page_text(pages):
    rows = pages.select("page_id", readers.html_text().alias("text"))
    return rows.select("page_id", F.md5("text").alias("text_md5"), readers.page_stats().alias("s")).select("page_id", "text_md5", "s.*")


@query("embeddings", sql="SELECT vec_id, CAST(round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])), 5) AS DOUBLE) AS norm, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def vector_norms(embeddings):
    return embeddings.select("vec_id", F.round(F.sqrt(arrays.dot("embedding", "embedding")), 5).alias("norm"), F.size("embedding").alias("dims"))


def _as_records(orders, lineitem, part):
    """Orders as records: their lines are a table, their parts' names figures."""
    lines = lineitem.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    row = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus"))).alias("row"), F.col("p_name").alias("name"))
    by_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(row)).alias("l"))
    rows = orders.join(by_order, "o_orderkey", "left")
    lists = F.transform("l", lambda x: x["row"])
    table = F.struct(F.lit("t").alias("id"), F.lit(1).alias("page"), F.array(F.lit("line"), F.lit("flag"), F.lit("status")).alias("headers"), lists.alias("rows"), F.lit(None).cast("string").alias("note"))
    figures = F.transform("l", lambda x, i: F.struct(i.cast("string").alias("id"), F.lit("").alias("code"), x["name"].alias("name"), F.lit(1).alias("page"), F.lit("").alias("image_path")))
    return rows.select(
        F.concat(F.lit("order_"), F.col("o_orderkey")).alias("id"),
        F.col("o_orderpriority").alias("doc_name"),
        F.lit(None).cast("string").alias("source_chunk_id"),
        F.col("o_custkey").cast("string").alias("article"),
        F.lit(None).cast("string").alias("clause"),
        F.lit(None).cast("string").alias("point"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Hồ sơ đăng ký")).otherwise(F.lit("Khác")).alias("text"),
        F.when(F.col("o_totalprice") > 200000, F.floor("o_totalprice")).alias("fine_min"),
        F.lit(None).cast("long").alias("fine_max"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("p.102"), F.lit("P 102"))).otherwise(F.array().cast("array<string>")).alias("sign_codes"),
        F.when(F.col("l").isNotNull(), F.array(table)).otherwise(F.array().cast(f"array<{records.TABLE}>")).alias("tables"),
        F.coalesce(figures, F.array().cast(f"array<{records.FIGURE}>")).alias("figures"),
    )


@query(
    "orders", "lineitem", "part",
    sql="""
WITH has AS (SELECT l_orderkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
o AS (SELECT orders.*, coalesce(n, 0) AS n FROM orders LEFT JOIN has ON o_orderkey = l_orderkey),
e AS (SELECT 'text' AS modality, o.* FROM o UNION ALL SELECT 'table', o.* FROM o WHERE n > 0
  UNION ALL SELECT 'figure', o.* FROM o, range(n) WHERE n > 0 UNION ALL SELECT 'sign', o.* FROM o WHERE o_orderstatus = 'F')
SELECT o_orderpriority AS doc, modality, count(*) AS n_rows, count(*) FILTER (WHERE o_totalprice > 200000) AS n_penalty, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_sign, count(*) FILTER (WHERE n > 0) AS n_table, count(*) FILTER (WHERE n > 0) AS n_figure, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_procedure
FROM e GROUP BY 1, 2
""",
)
def expand_records(orders, lineitem, part):
    rows = records.expand(_as_records(orders, lineitem, part))
    return aggregates.profile(rows.withColumn("doc", F.col("metadata.doc")), ["doc", "modality"], **{f"n_{f}": F.col(f"metadata.has_{f}") for f in ("penalty", "sign", "table", "figure", "procedure")})


@query(
    "orders", "lineitem", "part",
    sql="""SELECT row_text, count(*) AS n FROM (
SELECT concat_ws(' | ', 'line: ' || l_linenumber, 'flag: ' || l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'status: O' END) AS row_text
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey) GROUP BY row_text""",
)
def table_row_texts(orders, lineitem, part):
    return records.table_rows(_as_records(orders, lineitem, part)).groupBy("row_text").agg(F.count(F.lit(1)).alias("n"))


@query("customer", sql="SELECT c_nationkey AS id, unnest(list_filter([CASE WHEN max(c_acctbal) < min(c_custkey) THEN 'min_amount > max_amount' END, CASE WHEN abs(count(*) - 2 * count(DISTINCT c_mktsegment)) > 0.15 * count(DISTINCT c_mktsegment) THEN 'organization_ratio' END], lambda x: x IS NOT NULL)) AS issue FROM customer GROUP BY c_nationkey")
def penalty_issues(customer):
    rows = customer.groupBy(F.col("c_nationkey").alias("id")).agg(F.min("c_custkey").alias("min_amount"), F.max("c_acctbal").alias("max_amount"), F.countDistinct("c_mktsegment").alias("individual_max"), F.count(F.lit(1)).alias("organization_max"))
    return records.penalty_issues(rows)


@query(
    "lineitem",
    sql="SELECT l_suppkey AS id, CAST(round(max(l_quantity) + CASE WHEN count(*) > 1 THEN 0.05 * min(l_quantity) ELSE 0 END, 6) AS DOUBLE) AS score, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS reasons FROM lineitem GROUP BY l_suppkey",
)
def merged_assets(lineitem):
    rows = lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("score"), F.array("l_returnflag").alias("reasons"))
    return records.merge_assets(rows, "id", ["reasons"]).select("id", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


_ASKED = (
    "Mức phạt vượt đèn đỏ và nồng độ cồn với xe máy là bao nhiêu tiền?", "Biển P.102 có ý nghĩa là gì?", "Nghị định 168/2024 có bao nhiêu điều?", "Thủ tục đăng ký xe cần hồ sơ gì?",
    "Cách nấu phở ngon nhất", "Hành vi nào bị phạt tiền cao nhất?", "Bảng thông số trong phụ lục", "Chạy quá tốc độ bị phạt thế nào?",
)


@query("benchmark")
def planned_questions(benchmark):
    """Rows only: facets, intent, modalities and hints of questions; tests hold them against worked examples."""
    asked = F.array(*map(F.lit, _ASKED))
    rows = benchmark.select("item_id", F.concat_ws(" ", F.element_at(asked, (F.col("item_id") % len(_ASKED) + 1).cast("int")), "text").alias("question"))
    rows = rows.withColumn("facets", planner.facets("question"))
    return rows.select("item_id", "facets", planner.intent(F.col("facets")).alias("intent"), planner.modalities(F.col("facets")).alias("modalities"), planner.hints("question").alias("hints"))


@query("benchmark")
def question_slots(benchmark):
    """Rows only, as planned_questions."""
    asked = F.array(*map(F.lit, _ASKED))
    rows = benchmark.select("item_id", F.concat_ws(" ", F.element_at(asked, (F.col("item_id") % len(_ASKED) + 1).cast("int")), "text").alias("question"))
    return planner.slots(rows, "item_id", "question")


@query("documents")
def salient_sentences(documents):
    """Rows only: the sentences that the planner would keep of a long question."""
    return planner.salient(documents, "doc_id", "text")
