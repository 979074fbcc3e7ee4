"""Query routes: fixed compositions of the operators, for tables of questions over expanded records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import graph, index, joins, sanctions
from ..sources.tables import cut
from . import planner, rules, scoring


#: The first rows of each question that the lexical score is added to.
RERANKED = 96


def search(rows: DataFrame, questions: DataFrame, k: int = 8, id_column: str = "id", text_column: str = "rag_text", question_id: str = "query_id", question: str = "question", condition=None, filter_mode: str = "pre") -> DataFrame:
    """Lexical search with a filter before ranking (pre), or after the first max(3k, 100) of each question (post)."""
    kept = rows.filter(condition) if condition is not None and filter_mode == "pre" else rows
    few = condition is None or filter_mode == "pre"
    first = k if few else max(3 * k, 100)
    scored = index.bm25_top(kept, id_column, text_column, index.query_tokens(questions, question_id, question), first)
    if few:
        return index.top_k(scored, k)
    first = index.top_k(scored, first).drop("rank")
    inside = rows.filter(condition).select(F.col(id_column).alias("id"))
    return index.top_k(first.join(inside, "id", "left_semi"), k)


def general(rows: DataFrame, questions: DataFrame, k: int = 8, edges: DataFrame | None = None, depth: int = 2, vectors: DataFrame | None = None) -> DataFrame:
    """Exact references, then lexical search of the first 3k, deduplicated and reranked by the lexical score.

    vectors (query_id, id, score): hits of a vector search, which are fused with the lexical ones by rank. edges: a graph whose
    nodes around the hits come in, up to depth hops. One row stays of those that share document, article, clause, point and
    the first 240 folded characters; a row without text is known by its id. rows: id, rag_text, article (upper case or null),
    and document, clause and point where rows have them. questions: query_id, question."""
    hits = search(rows, questions, 3 * k).select("query_id", "id", "score")
    if vectors is not None:
        hits = index.top_k(index.fuse_ranks(vectors, hits, 3 * k), 3 * k).select("query_id", "id", "score")
    refs = questions.select("query_id", F.explode(F.array_distinct(F.transform(text.explicit_refs("question"), lambda r: r["article"]))).alias("article"))
    exact = refs.join(_exact(rows) if edges is None else rows.select("id", "article"), "article").select("query_id", "id", F.lit(5.0).alias("score"))
    both = hits.unionByName(exact).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    if edges is not None:
        both = cut(both, "hits")
        both = both.unionByName(graph.expand_hits(both, edges, depth))
    full = both.join(rows.select("id", "rag_text", *place(rows)), "id").join(questions.select("query_id", "question"), "query_id")
    return index.top_k(deduped(reranked(full), place(rows)).select("query_id", "id", "score"), k)


def _exact(rows: DataFrame) -> DataFrame:
    """id, article of the rows that may remain of those that a reference brings in, all with one score: the first of an article, which
    the lexical score is added to, and the first of those that only one is kept of."""
    keyed = rows.select("id", "article", *[c for c in place(rows) if c != "article"], _start("rag_text").alias("_start")).filter(F.col("article").isNotNull())
    nth = F.row_number().over(Window.partitionBy("article").orderBy("id"))
    first = keyed.select("id", "article").withColumn("_nth", nth).filter(F.col("_nth") <= RERANKED).drop("_nth")
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in place(rows) if c != "article"]
    empty = F.col("_start") == ""
    once = keyed.groupBy("article", *[F.when(~empty, k).alias(f"_k{i}") for i, k in enumerate(key)], "_start", F.when(empty, F.col("id")).alias("_own")).agg(F.min("id").alias("id"))
    return cut(first.unionByName(once.select("id", "article")).distinct(), "exact")


def _start(x) -> Column:
    """What rows are known by besides their place."""
    return F.substring(text.fold(x), 1, 240)


def place(rows: DataFrame) -> list[str]:
    return [c for c in ("document", "article", "clause", "point") if c in rows.columns]


def reranked(full: DataFrame) -> DataFrame:
    """Adds the lexical score to the first of each query. full: score, rag_text, question."""
    words = text.content_tokens("question", digits=True)
    return index.rerank(full, index.lexical_score(words, text.fold("rag_text"), text.content_tokens("rag_text", digits=True)), RERANKED)


def deduped(full: DataFrame, place: list[str]) -> DataFrame:
    start = _start("rag_text")
    empty = start == ""
    # Null and empty references are one; rows without text have their id as the key.
    key = [F.when(~empty, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in place]
    own = Window.partitionBy("query_id", start, *key, F.when(empty, F.col("id"))).orderBy(F.desc("score"), "id")
    return full.withColumn("_nth", F.row_number().over(own)).filter("_nth = 1").drop("_nth")


def prepared(questions: DataFrame) -> DataFrame:
    """Questions with what routes look at: qa (folded, of a sub-question its focus), vehicle, named and meant documents, behaviours, terms."""
    own = questions.select("query_id", "question", text.fold(scoring.focused("question")).alias("qa"), text.fold("question").alias("_q"))
    return own.select("query_id", "question", "qa", scoring.vehicle(F.col("_q")).alias("vehicle"), scoring.documents(F.col("_q")).alias("named"), scoring.scope(F.col("_q")).alias("meant"), scoring.searched(F.col("qa")).alias("behaviours"), scoring.definition_terms("question").alias("terms"))


#: What rows of a corpus hold, besides id and rag_text; columns that a table lacks are null.
ROW = "document string, article string, clause string, point string, modality string, sign_codes array<string>, images array<string>"


def corpus(rows: DataFrame) -> DataFrame:
    kinds = [c.strip().split(" ") for c in ROW.split(", ")]
    return rows.select("id", "rag_text", *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])


def representatives(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The first of the rows of a corpus that differ in nothing but their id and the names of their images, and every row of hits (id).

    Rows that are alike get the same score by whatever brings them in without a ranking, and of these only the first stays."""
    alike = [F.col(c) for c in rows.columns if c not in ("id", "rag_text", "images")]
    texts = [F.xxhash64("rag_text"), F.xxhash64(F.lit("more"), "rag_text"), F.col("rag_text").isNull(), F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0]
    # Rows without text are known by their id.
    own = F.when(text.fold("rag_text") == "", F.col("id"))
    first = rows.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate([*alike, *texts, own])]).agg(F.min("id").alias("id")).select("id")
    return cut(rows.join(first.unionByName(hits.select("id")).distinct(), "id", "left_semi"), "representatives")


def _full(hits: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """hits (query_id, id, score, reasons), each once, with the columns that scoring reads."""
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.array_distinct(F.flatten(F.collect_list("reasons"))).alias("reasons"))
    return best.join(rows, "id").join(asked, "query_id").withColumn("body", text.fold("rag_text"))


def _general(rows: DataFrame, questions: DataFrame, route: str, k: int, edges=None) -> DataFrame:
    """The k hits of general search for each question, as a table: routes put several of these together, and their plans stay short."""
    worded = cut(questions.select("query_id", F.concat_ws(" ", scoring.expanded("question"), F.lit(rules.ROUTE_WORDS[route])).alias("question")), "worded")
    return cut(general(rows, worded, k, edges).select("query_id", "id", "score", F.array(F.lit(f"{route}_route")).alias("reasons")), "general")


def _finished(full: DataFrame, k: int) -> DataFrame:
    """The k best of each question after reranking: query_id, id, rank, score, reasons."""
    return index.top_k(reranked(deduped(full, ["document", "article", "clause", "point"])).select("query_id", "id", "score", "reasons"), k)


def behaviour_rows(rows: DataFrame) -> DataFrame:
    """behaviour, article, id, score, reason of all rows of the penalty decree that are about a behaviour, and of the clauses above them."""
    inside = rows.filter(F.contains(text.fold("document"), F.lit("nghi dinh 168")) & F.col("article").isin(*rules.RULE_ARTICLES.values()))
    own = inside.select("id", "document", "article", "clause", "point", F.explode(scoring.shown(text.fold("rag_text"))).alias("behaviour"))
    above = inside.filter((F.coalesce("point", F.lit("")) == "") & (F.coalesce("clause", F.lit("")) != "")).select("document", "article", "clause", F.col("id").alias("above"))
    held = own.filter(F.coalesce("point", F.lit("")) != "").select("behaviour", "document", "article", "clause").distinct()
    parents = held.join(above, ["document", "article", "clause"]).select("behaviour", "article", F.col("above").alias("id"), F.lit(6.5).alias("score"), F.lit("behavior_clause_context").alias("reason")).distinct()
    return own.select("behaviour", "article", "id", F.lit(9.0).alias("score"), F.lit("behavior_anchor").alias("reason")).unionByName(parents)


def _scoped(full: DataFrame, inside: Column, add: float = 0.0) -> DataFrame:
    """The rows inside a scope, with a boost, or all of a question that has none there."""
    some = F.max(inside.cast("int")).over(Window.partitionBy("query_id"))
    kept = full.withColumn("_some", some).filter(inside | (F.col("_some") == 0)).drop("_some")
    return kept.withColumn("score", F.col("score") + F.when(inside, add).otherwise(0.0)) if add else kept


def penalty(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """General search, the rows on the behaviours that are asked for, the rows of the vehicle's article; then the boosts of penalties."""
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    named = F.when(F.size("meant") > 0, F.array_join("meant", " ")).otherwise(F.lit(rules.PENALTY_DOCUMENT))
    worded = asked.select("query_id", F.concat_ws(" ", scoring.expanded("question"), named).alias("question"))
    known = F.size("behaviours") > 0
    first = _general(rows, worded, "penalty", max(2 * k, 16), edges)
    rows = representatives(rows, first)
    acts = asked.select("query_id", "vehicle", F.explode("behaviours").alias("behaviour")).join(cut(behaviour_rows(rows), "behaviours"), "behaviour")
    article = F.create_map(*[F.lit(x) for pair in rules.RULE_ARTICLES.items() for x in pair])
    own = F.get(F.transform(F.array("vehicle"), lambda v: article[v]), F.lit(0))
    acts = acts.filter(F.col("vehicle").isNull() | (F.col("article") == own)).withColumn("score", F.col("score") + F.when(F.col("vehicle").isNotNull() & (F.col("score") == 9.0), 1.0).otherwise(0.0))
    acts = acts.select("query_id", "id", "score", F.array("reason").alias("reasons"))
    wide = F.create_map(*[y for v, a in rules.VEHICLE_ARTICLES.items() for y in (F.lit(v), F.array(*map(F.lit, a)))])
    of_article = rows.filter(F.contains(text.fold("document"), F.lit("nghi dinh 168"))).select("id", "article")
    articles = F.when(known, F.array(own)).otherwise(F.get(F.transform(F.array("vehicle"), lambda v: wide[v]), F.lit(0)))
    here = (F.size("meant") == 0) | F.array_contains("meant", rules.PENALTY_DOCUMENT)
    prefix = asked.filter(F.col("vehicle").isNotNull() & here).select("query_id", F.explode(articles).alias("article")).join(of_article, "article").select("query_id", "id", F.lit(0.8).alias("score"), F.array(F.lit("vehicle_article_prefix")).alias("reasons"))
    full = _full(first.unionByName(acts).unionByName(prefix), rows, asked)
    full = _scoped(full, (F.size("meant") > 0) & F.array_contains("meant", F.col("document")), 3.0)
    out = _finished(scoring.boosted(full, *scoring.vehicle_boosts(), *scoring.penalty_boosts(), *scoring.license_boosts()), max(k, 12))
    wider = asked.select("query_id", F.when(known & F.col("vehicle").isNull(), max(k, 12)).otherwise(k).alias("_k"))
    return out.join(wider, "query_id").filter(F.col("rank") <= F.col("_k")).drop("_k")


def coded(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, id, score of all rows that hold a code that a question names: 1.0, and 9.0 of a sign's own row."""
    named = questions.select("query_id", F.explode(F.array_distinct(text.sign_codes("question"))).alias("code"))
    held = corpus(rows).select("id", "modality", F.explode(F.array_distinct(F.transform("sign_codes", text.normalize_sign_code))).alias("code"))
    score = F.max(F.when(F.col("modality") == "sign", 9.0).otherwise(1.0)).alias("score")
    return named.join(held, "code").groupBy("query_id", "id").agg(score)


def sign(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """The k best rows of the codes that a question names, and lexical search of questions without any."""
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    held = representatives(rows.filter(F.size("sign_codes") > 0), rows.select("id").limit(0))
    hits = cut(coded(held, questions).withColumn("reasons", F.array(F.lit("sign_code"))), "coded")
    rest = questions.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return _finished(_full(hits.unionByName(_general(rows, rest, "sign", max(2 * k, 12))), rows, asked), k)


def table(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """Search among tables, in the documents that are meant; a question on the limit of expressways takes only tables on it."""
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    full = _full(_general(rows.filter("modality = 'table'"), questions, "table", max(2 * k, 16)), rows, asked)
    full = _scoped(full, (F.size("meant") > 0) & F.array_contains("meant", F.col("document")), 3.0)
    limit = F.contains("qa", F.lit("toc do")) & F.contains("qa", F.lit("cao toc"))
    return _finished(full.filter(~limit | scoring.speed_on_expressway(F.col("qa"), F.col("body"))), k)


def definition_rows(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """All rows with a mark of definitions that hold the term that is asked for: they meet by the term's first word."""
    marked = rows.select("id", text.fold("rag_text").alias("body")).filter(text.contains_any("body", rules.DEFINITION_MARKS))
    words = marked.select("id", "body", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([a-z0-9]+)"), 1))).alias("word"))
    terms = asked.select("query_id", F.explode("terms").alias("term")).withColumn("word", F.regexp_extract("term", r"([a-z0-9]+)", 1))
    hits = terms.join(words, "word").filter(F.contains("body", "term")).select("query_id", "id").distinct()
    return hits.select("query_id", "id", F.lit(3.0).alias("score"), F.array(F.lit("deterministic_definition_match")).alias("reasons"))


def definition(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    first = _general(rows, questions, "definition", max(2 * k, 16), edges)
    rows = representatives(rows, first)
    hits = first.unionByName(definition_rows(rows, asked))
    return _finished(scoring.boosted(_full(hits, rows, asked), *scoring.definition_boosts()), k)


def procedure(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    return _finished(scoring.boosted(_full(_general(rows, questions, "procedure", max(3 * k, 24), edges), rows, asked), *scoring.procedure_boosts()), k)


def priority(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    return _finished(scoring.boosted(_full(_general(rows, questions, "priority", max(3 * k, 24), edges), rows, asked), *scoring.priority_boosts()), k)


def scenario(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """General search; tables only where nothing else is found, or where the question asks for one."""
    # Written first, as what a question asks for is dear to find, and else is found for each of its hits.
    wants = questions.select("query_id", F.array_contains(planner.facets("question"), "table").alias("wants"))
    rows, asked = corpus(rows), cut(prepared(questions).join(wants, "query_id"), "asked")
    full = _full(_general(rows, questions, "scenario", max(3 * k, 24), edges), rows, asked)
    full = _scoped(full, F.col("wants") | (F.coalesce("modality", F.lit("text")) != "table"))
    return _finished(scoring.boosted(full, *scoring.scenario_boosts()), k)


def source_image(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """General search with tables and signs; rows with images come first, and alone if there are any."""
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    n = max(3 * k, 24)
    facets = cut(questions.select("query_id", "question", planner.facets("question").alias("_f")), "facets")
    of = lambda facet: facets.filter(F.array_contains("_f", facet)).select("query_id", "question")
    hits = _general(rows, questions, "source_image", n, edges)
    for route, facet in ((table, "table"), (sign, "sign")):
        hits = hits.unionByName(cut(route(rows, of(facet), max(k, 8)).select("query_id", "id", "score", "reasons"), facet))
    full = _full(hits, rows, asked)
    family = text.contains_any(text.fold("document"), ("nghi dinh 168", "luat trat tu", "qcvn", "thong tu 51"))
    act = (F.size("behaviours") > 0) | text.contains_any("qa", ("phat", "xu phat", "tai nan", "vi pham"))
    paper = text.contains_any("qa", ("thu tuc", "ho so", "cap doi", "cap lai", "sat hach", "dao tao"))
    # Written between, as the plan of both scopes and the boosts in one takes minutes to be made.
    full = cut(_scoped(full, ~act | paper | F.coalesce(family, F.lit(False))), "scoped")
    full = cut(scoring.boosted(full, *scoring.image_boosts()), "boosted")
    return _finished(_scoped(full, F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0), k)


def license_points(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """The clause on the points of a licence: rows that name the twelve points first."""
    rows = corpus(rows).filter((F.col("document") == "Luật Trật tự ATGT 2024 (Tiếp)") & (F.col("article") == "58") & (F.col("clause") == "1"))
    said = F.contains(text.fold("rag_text"), F.lit("bao gom 12 diem"))
    best = rows.select("id", (F.lit(72.0) + F.when(said, 1.0).otherwise(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(k)  # a top-k: k rows
    hits = questions.select("query_id").join(F.broadcast(best)).withColumn("reasons", F.array(F.lit("topic_license_points_total")))
    return index.top_k(hits.select("query_id", "id", "score", "reasons"), k)


def legal_rows(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """Every row under the reference that a question names, in natural order, up to 40: in the documents that it names, or in any."""
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    ref = F.get(text.explicit_refs("question"), F.lit(0))
    probes = asked.select("query_id", "named", ref.alias("r")).select("query_id", "named", F.col("r.article").alias("article"), F.coalesce("r.clause", F.lit("")).alias("_c"), F.coalesce("r.point", F.lit("")).alias("_p")).filter("article IS NOT NULL")
    same = lambda want, have: (F.col(want) == "") | (F.lower(F.coalesce(F.col(have), F.lit(""))) == F.lower(F.col(want)))
    ref = ["named", "article", "_c", "_p"]
    # Rows are ranked once for each reference, however many questions name it.
    hits = probes.select(ref).distinct().join(rows, "article").filter(((F.size("named") == 0) | F.array_contains("named", F.col("document"))) & same("_c", "clause") & same("_p", "point"))
    order = F.struct("document", arrays.natural_key("clause"), arrays.natural_key("point"), "id")
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*ref).orderBy(order))).filter(F.col("rank") <= max(k, 40))
    ranked = probes.join(first.select(*ref, "id", "rank"), ref)
    return ranked.select("query_id", "id", (F.lit(120.0) - F.col("rank")).alias("score"), F.array(F.lit("legal_detail_route")).alias("reasons"), "rank")


def overview(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """The first row of each article of the documents that a question names, in natural order, up to 64."""
    rows, asked = corpus(rows), cut(prepared(questions), "asked")
    heads = rows.filter(F.coalesce("article", F.lit("")) != "").groupBy("document", "article").agg(F.min("id").alias("id"))
    hits = asked.select("query_id", F.explode("named").alias("document")).join(heads, "document")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("document", arrays.natural_key("article")))).filter(F.col("rank") <= max(k, 64))
    return ranked.select("query_id", "id", (F.lit(100.0) - F.col("rank")).alias("score"), F.array(F.lit("document_overview_route")).alias("reasons"), "rank")


def aggregation_kind(question) -> Column:
    """Which statistic of the corpus a question asks for: frequency, suspension, points, fines, or unsupported."""
    q = text.fold(question)
    listed = text.contains_any(q, rules.TERMS["catalog"]) & F.contains(q, F.lit("tuoc")) & text.contains_any(q, ("bang lai", "gplx", "giay phep lai xe"))
    return (
        F.when(text.contains_any(q, ("hay vi pham", "pho bien nhat", "thuong gap", "nhieu vi pham", "dieu nao vi pham nhat")), "frequency")
        .when(listed, "suspension")
        .when(F.contains(q, F.lit("tru diem")), "points")
        .when(text.contains_any(q, ("phat", "tien")), "fines")
        .otherwise("unsupported")
    )


def asks_least(question) -> Column:
    """Whether a question asks for the lowest in place of the highest."""
    return text.contains_any(text.fold(question), ("thap nhat", "it nhat", "nho nhat", "nhe nhat"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their rank in that order. Rows are dealt by ranges of the order and counted there, so no task holds all of them."""
    # A column of its own, as the parts of a table that is read again are others.
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row for each part
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def aggregation(records: DataFrame, questions: DataFrame, k: int = 12) -> DataFrame:
    """query_id, kind, rank, label, id, value of the statistic that each question (query_id, question) asks for, over all records.

    Frequency: the articles with most rows on violations; fines: the highest amounts (the lowest above zero, if those are asked
    for); points: the most, or fewest; each the k best. Suspension lists every act, in order of id. Each statistic is taken once,
    whatever the number of questions; an unsupported question has one row without a value.
    records: as in sanctions.suspensions, with fine_min and fine_max besides."""
    asked = questions.select("query_id", aggregation_kind("question").alias("kind"), asks_least("question").alias("_least"))
    report = lambda df, kind, least, label, value: df.select(F.lit(kind).alias("kind"), F.lit(least).alias("_least"), F.col("rank").cast("int").alias("rank"), label.alias("label"), "id", value.cast("double").alias("value"))
    ranked = lambda df, *order: df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  a top-k report
    told = records.filter(text.let(text.fold("text"), lambda f: text.contains_any(f, ("vi pham", "phat"))) & (F.coalesce("article", F.lit("")) != ""))
    # Tables, as the reports of the highest and of the lowest both read them.
    often = cut(told.groupBy("document", "article").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")), "often")
    fines = cut(sanctions.amounts(records), "fines")
    place = F.concat_ws(" ", F.lit("Điều"), "article")
    parts = []
    for least in (False, True):
        parts.append(report(ranked(often, F.desc("n"), "document", "article"), "frequency", least, F.concat_ws(", ", "document", place), F.col("n")))
        amount = F.col("amount_min" if least else "amount_max")
        parts.append(report(ranked(fines.filter(amount > 0), F.asc(amount) if least else F.desc(amount), "id"), "fines", least, place, amount))
        parts.append(report(sanctions.point_ranking(records, k, least), "points", least, F.lit(""), F.col("points")))
    acts = sanctions.suspensions(records).select(F.col("act_id").alias("id"), F.concat_ws(": ", "act", "suspension").alias("label"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    few = asked.join(F.broadcast(cut(every, "reports")), ["kind", "_least"], "left").filter((F.col("kind") == "unsupported") | F.col("rank").isNotNull())
    # Every question for acts gets all of them, so they are dealt once and stay there, and meet those questions in a product.
    listed = report(numbered(acts, "id", "label"), "suspension", False, F.col("label"), F.lit(None)).drop("kind", "_least")
    out = few.unionByName(listed.crossJoin(F.broadcast(asked.filter("kind = 'suspension'"))))
    return out.select("query_id", "kind", "rank", "label", "id", "value")


#: The route of each intent; others take the general one.
ROUTES = {
    "penalty": penalty, "sign": sign, "table": table, "definition": definition, "procedure": procedure, "priority": priority, "scenario": scenario, "source_image": source_image,
    "legal_detail": legal_rows, "document_overview": overview,
}


def retrieve(rows: DataFrame, questions: DataFrame, k: int = 8, edges=None) -> DataFrame:
    """Each question by the route of its intent: query_id, id, score, rank, reasons, route. Questions out of scope find nothing."""
    known = cut(questions.select("query_id", "question", planner.intent(planner.facets("question")).alias("intent")), "questions")
    found = None
    for (name,) in known.select("intent").distinct().collect():  # at most one row for each intent
        if name == "out_of_scope":
            continue
        own = known.filter(F.col("intent") == name).select("query_id", "question")
        if name in ROUTES:
            out = ROUTES[name](rows, own, k, edges)
        else:
            out = general(corpus(rows), own, k, edges).withColumn("reasons", F.array(F.lit("general_route")))
        out = out.select("query_id", "id", "score", "rank", "reasons", F.lit(name).alias("route"))
        found = out if found is None else found.unionByName(out)
    return found


def routed(questions: DataFrame, question: str = "question") -> DataFrame:
    """Questions with facets, intent and the modalities that their route searches."""
    return questions.withColumn("facets", planner.facets(question)).withColumn("intent", planner.intent(F.col("facets"))).withColumn("modalities", planner.modalities(F.col("facets")))


def legal_detail(rows: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """All rows under a reference as one text, in natural order: probe_id, n_rows, text. The result is the text itself."""
    found = joins.prefix_join(probes, rows, keys, "id")
    return found.groupBy("probe_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_list(F.struct(*keys, "id", "text"))).alias("_p")).select("probe_id", "n_rows", F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("text"))
