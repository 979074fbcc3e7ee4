"""Test sets made from questions with answers: references, kinds, numbers, and the chunks that an answer should come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import col
from ..plans import rules
from ..sources.tables import cut
from . import phrases

#: Words of all questions that may be broadcast after they were counted.
FEW_WORDS = 100_000

#: Parts of a citation: fixed values.
BASIS = {"point": r"(?iuU)điểm\s+([a-zđ])\b", "clause": r"(?iuU)khoản\s+(\d+[a-z]?)\b", "article": r"(?iuU)điều\s+(\d+[a-z]?)\b", "section": r"(?iuU)mục\s+(\d+(?:\.\d+)*)\b"}


def legal_basis(x, document) -> Column:
    """doc, article, clause, point, section, raw of a citation in prose; a numbered section stands in for an article."""
    part = {k: F.regexp_extract(F.coalesce(col(x), F.lit("")), p, 1) for k, p in BASIS.items()}
    none = part["article"] == ""
    return F.struct(
        F.coalesce(col(document), F.lit("")).alias("doc"), F.when(none, part["section"]).otherwise(F.upper(part["article"])).alias("article"), part["clause"].alias("clause"), F.lower(part["point"]).alias("point"),
        F.when(none, part["section"]).otherwise("").alias("section"), col(x).alias("raw"),
    )


def case_kind(question, answer, basis, reference) -> Column:
    """The kind of a question by the first rule that its question, or all its texts, meet."""
    asked = F.lower(F.coalesce(col(question), F.lit("")))
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in (question, answer, basis, reference)]))
    out = None
    for kind, alone, terms in rules.CASE_KINDS:
        hit = text.contains_any(asked if alone else whole, terms)
        if kind == "SIGN_MEANING":
            hit = hit | whole.rlike(text.SIGN_CODE)
        if kind == "TABLE_LOOKUP":
            hit = hit | F.contains(F.coalesce(col(reference), F.lit("")), F.lit("|"))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("DEFINITION")


def expected_numbers(answer, reference, kind) -> Column:
    """value, unit, type of the amounts of the texts, and of other numbers where the kind of question asks for them; each once."""
    whole = F.concat_ws(" ", F.coalesce(col(answer), F.lit("")), F.coalesce(col(reference), F.lit("")))
    number = lambda value, unit, what: F.struct(value.alias("value"), F.lit(unit).alias("unit"), F.lit(what).alias("type"))
    money = F.transform(F.regexp_extract_all(whole, F.lit(r"(?iu)(\d{1,3}(?:\.\d{3})+)\s*(?:đồng|vnđ|vnd)"), 1), lambda v: number(F.replace(v, F.lit("."), F.lit("")), "VND", "amount"))
    other = F.filter(F.regexp_extract_all(whole, F.lit(r"(\d+(?:[.,]\d+)*)"), 1), lambda v: ~v.rlike(r"^\d{1,3}(\.\d{3})+"))
    plain = F.transform(other, lambda v: number(F.replace(v, F.lit(","), F.lit(".")), "", "number"))
    wide = col(kind).isin("TABLE_LOOKUP", "SIGN_MEANING", "PROCEDURE")
    first = F.array_distinct(money)
    return F.when(wide, F.slice(F.array_distinct(F.concat(first, plain)), 1, F.greatest(F.size(first), F.lit(21)))).otherwise(first)


def similarity(a: Column, b: Column) -> Column:
    """How alike two texts are, from 0 to 1, by their distinct runs of three letters: twice the shared ones over all."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
    both = lambda x, y: 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return text.let(a, lambda s: text.let(grams(s), lambda x: text.let(b, lambda t: text.let(grams(t), lambda y: both(x, y)))))


def evidence_score(article, clause, point, want: Column, body, quote) -> Column:
    """score and reasons of a record for an expected reference: 2, 1 and 1 for the parts, 4 for holding the quote, or up to 2 for being like it."""
    same = lambda have, part: (want[part] != "") & (F.lower(F.coalesce(col(have), F.lit(""))) == F.lower(want[part]))
    whole, said = text.compact_text(body), text.compact_text(quote)
    exact = (said != "") & F.contains(whole, said)
    ratio = similarity(F.substring(said, 1, 1200), F.substring(whole, 1, 2000))
    fuzzy = (said != "") & ~exact & (ratio > 0.55)
    score = F.when(same(article, "article"), 2.0).otherwise(0.0) + F.when(same(clause, "clause"), 1.0).otherwise(0.0) + F.when(same(point, "point"), 1.0).otherwise(0.0) + F.when(exact, 4.0).when(fuzzy, ratio * 2).otherwise(0.0)
    names = F.array_compact(F.array(F.when(same(article, "article"), "article"), F.when(same(clause, "clause"), "clause"), F.when(same(point, "point"), "point"), F.when(exact, "quote_exact").when(fuzzy, "quote_fuzzy")))
    return F.struct(F.round(score, 3).alias("score"), names.alias("reasons"))


def expected_chunks(cases: DataFrame, records: DataFrame, first: int = 8, most: int = 3) -> DataFrame:
    """case_id, chunk, id, score, rank: the chunks that a case's answer should come from.

    Candidates are, in tiers, records of exactly the reference, records of its article, and records that share enough long
    words with the quote. Each tier is an equal join, and only the first that finds records counts. cases: case_id, ref (of
    legal_basis), quote. records: id, chunk, document, article, clause, point, text.

    Records that differ in their id alone are scored once; the first of them come in behind the scores."""
    alike = [c for c in records.columns if c != "id"]
    keyed = records.select("id", F.xxhash64(*alike).alias("_x"), F.xxhash64(F.lit("more"), *alike, *[F.col(c).isNull() for c in alike]).alias("_y"))
    nth = F.row_number().over(Window.partitionBy("_x", "_y").orderBy("id"))
    members = keyed.withColumn("_nth", nth).filter(F.col("_nth") <= first)
    members = cut(members.select(F.min("id").over(Window.partitionBy("_x", "_y")).alias("_first"), "id"), "members")
    records = cut(records.join(members.select(F.col("_first").alias("id")).distinct(), "id", "left_semi"), "records")
    want = F.col("ref")
    asked = cases.select("case_id", "ref", "quote", F.upper(want["article"]).alias("_a"))
    own = records.withColumn("_a", F.upper(F.coalesce("article", F.lit(""))))
    fits = lambda part: (want[part] == "") | (F.lower(F.coalesce(F.col(part), F.lit(""))) == F.lower(want[part]))
    by_article = asked.filter("_a <> ''").join(own, "_a").select("case_id", "id", F.when(fits("clause") & fits("point"), 0).otherwise(1).alias("tier"))
    long_ = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"(?U)(\w{4,})"), 1))
    rest = asked.join(by_article.select("case_id").distinct(), "case_id", "left_anti").withColumn("_w", long_("quote"))
    need = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.size("_w") / 4).cast("int")))
    words = rest.select("case_id", need.alias("need"), F.explode("_w").alias("word"))
    shared = words.join(records.select("id", F.explode(long_("text")).alias("word")), "word").groupBy("case_id", "id", "need").agg(F.count(F.lit(1)).alias("n"))
    found = by_article.unionByName(shared.filter("n >= need").select("case_id", "id", F.lit(2).alias("tier")))
    least = found.groupBy("case_id").agg(F.min("tier").alias("tier"))
    chosen = found.join(least, ["case_id", "tier"], "left_semi")
    full = chosen.join(records, "id").join(cases.select("case_id", "ref", "quote"), "case_id")
    scored = full.withColumn("_s", evidence_score("article", "clause", "point", F.col("ref"), "text", "quote")).filter("_s.score > 0").filter("chunk IS NOT NULL")
    by = Window.partitionBy("case_id").orderBy(F.desc("_s.score"), "id")
    few = scored.withColumn("_nth", F.row_number().over(by)).filter(F.col("_nth") <= first).withColumnRenamed("id", "_first").drop("_nth")
    top = few.join(members, "_first").withColumn("_nth", F.row_number().over(by)).filter(F.col("_nth") <= first)
    once = top.withColumn("_again", F.row_number().over(Window.partitionBy("case_id", "chunk").orderBy("_nth"))).filter("_again = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("_nth"))).filter(F.col("rank") <= most)
    return ranked.select("case_id", "chunk", "id", F.col("_s.score").alias("score"), F.col("_s.reasons").alias("reasons"), "rank")


def review(cases: DataFrame, chunks: DataFrame, least: float = 4.0) -> DataFrame:
    """case_id, best, review_required: whether a case's best match is too weak to be trusted."""
    best = chunks.groupBy("case_id").agg(F.max("score").alias("best"))
    return cases.select("case_id").join(best, "case_id", "left").withColumn("review_required", F.coalesce(F.col("best") < least, F.lit(True)))


def needed_modality(kind, question, document) -> Column:
    """The flag that a case's contexts must have: has_penalty, has_sign or has_table; null if none."""
    q, doc = F.lower(F.coalesce(col(question), F.lit(""))), F.coalesce(col(document), F.lit(""))
    penal = text.contains_any(q, ("phạt", "xử phạt", "bị phạt", "mức phạt", "bao nhiêu tiền", "trừ điểm", "tước"))
    decree = F.contains(doc, F.lit("Nghị định"))
    technical = text.contains_any(doc, ("QCVN", "Thông tư 51")) | (F.size(text.sign_codes(question)) > 0)
    table = text.contains_any(q, ("bảng", "dòng", "cột", "ô bảng", "tra bảng"))
    return (
        F.when((col(kind) == "SIGN_MEANING") & decree & penal, "has_penalty")
        .when((col(kind) == "SIGN_MEANING") & technical, "has_sign")
        .when((col(kind) == "TABLE_LOOKUP") & table, "has_table")
        .when((col(kind) == "PENALTY") & decree & penal, "has_penalty")
    )


def stratum(kind, document) -> Column:
    return F.struct(F.coalesce(col(kind), F.lit("UNKNOWN")).alias("kind"), text.first_text(document, F.lit("UNKNOWN_DOC")).alias("document"))


def subject_phrases(question, known: tuple[str, ...] = ()) -> Column:
    """Known phrases that a question holds, then all of its runs of five, four and three words, each once."""
    q = text.fold(question)
    words = F.filter(F.regexp_extract_all(q, F.lit(r"([a-z0-9]+)"), 1), lambda w: F.length(w) >= 3)
    named = F.array_compact(F.array(*[F.when(F.contains(q, F.lit(p)), F.lit(p)) for p in known])) if known else F.array().cast("array<string>")
    return F.array_distinct(F.concat(named, *[text.ngrams(words, n) for n in (5, 4, 3)]))


def lexical_only(rows: DataFrame, questions: DataFrame, k: int = 8, scoped: float = 2.0) -> DataFrame:
    """query_id, id, score, rank by shared words (0.15 each, up to 30) and phrases (1 each) alone. Rows and questions meet by
    their words; a question's documents (array, may be empty) limit its rows. rows: id, document, text; questions: query_id, question, documents.

    Rows are dealt by id, and words counted where they are. The k best by words alone are enough of the rows without a phrase;
    those with one are found by the phrases, and counted by themselves. So no text meets every question that it shares a word with."""
    asked = cut(questions.select("query_id", "documents", text.content_tokens("question").alias("words"), subject_phrases("question").alias("phrases")), "asked")
    each = asked.select("query_id", "documents", F.explode("words").alias("word"))
    if len(each.select("word").take(FEW_WORDS + 1)) <= FEW_WORDS:
        each = F.broadcast(each)
    own = rows.select("id", "document", "text").repartition("id").select("id", "document", F.explode(text.content_tokens("text")).alias("word"))
    inside = (F.size("documents") == 0) | F.array_contains("documents", F.col("document"))
    by_words = F.least(F.col("n"), F.lit(30)) * 0.15
    shared = own.join(each, "word").filter(inside).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    plain = ranked(shared.select("query_id", "id", by_words.alias("score"))).select("query_id", "id", "score")
    named = asked.select("query_id", F.explode("phrases").alias("phrase"))
    told = phrases.within(rows.select("id", text.fold("text").alias("body")), named)
    hits = told.join(named, "phrase").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("hits"))
    counted = hits.join(rows.select("id", "document", text.content_tokens("text").alias("held")), "id").join(asked.select("query_id", "documents", "words"), "query_id").filter(inside)
    counted = counted.withColumn("n", F.size(F.array_intersect("words", "held"))).filter("n > 0").select("query_id", "id", (by_words + F.col("hits")).alias("score"))
    best = plain.unionByName(counted).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    scope = F.when(F.size("documents") > 0, scoped).otherwise(0.0)
    return ranked(best.join(asked.select("query_id", "documents"), "query_id").select("query_id", "id", (F.col("score") + scope).alias("score")))
