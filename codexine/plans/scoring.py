"""Scores that routes add to hits, as conditions over columns: nothing is joined or grouped for them.

Hits carry query_id, id, score, reasons, and of their row and question: body (folded text), document, article, qa (folded question).
A boost is a condition, what it adds, and its name, which becomes one of the hit's reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import rules


def boosted(hits: DataFrame, *boosts: tuple[str, Column, float]) -> DataFrame:
    """hits with the sum of what the boosts add, and the names of those that hold."""
    held = [(name, F.coalesce(condition, F.lit(False)), value) for name, condition, value in boosts]
    total = F.col("score")
    for _, condition, value in held:
        total = total + F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition, _ in held]))
    return hits.withColumn("score", total).withColumn("reasons", F.array_sort(F.array_union("reasons", names)))


def vehicle(q: Column) -> Column:
    """The vehicle that a folded question names; null if none."""
    return F.coalesce(*[F.when(text.contains_any(q, terms), F.lit(name)) for name, terms in rules.VEHICLES])


def searched(q: Column) -> Column:
    """The behaviours that a folded question asks for."""
    return F.array_compact(F.array(*[F.when(text.contains_any(q, asked), F.lit(name)) for name, asked, _ in rules.SEARCHED]))


def shown(body: Column) -> Column:
    """The behaviours that a folded text is about; with an accident only if that is what is asked for."""
    accident = F.contains(body, F.lit("gay tai nan"))
    found = [F.when(text.contains_any(body, terms) & (F.lit(name == "accident") | ~accident), F.lit(name)) for name, _, terms in rules.SEARCHED]
    return F.array_compact(F.array(*found))


def focused(question) -> Column:
    """The part of a sub-question that names its behaviour, or the whole question."""
    part = F.regexp_extract(F.coalesce(text.col(question), F.lit("")), r"(?isu)riêng\s+(?:hành vi|vấn đề):\s*(.+?)(?:\.\s*Ngữ cảnh|$)", 1)
    return F.when(part == "", text.col(question)).otherwise(F.trim(part))


def expanded(question) -> Column:
    """A question with the synonyms of what it names."""
    q = text.fold(question)
    more = [F.when(text.contains_any(q, some) & (text.contains_any(q, also) if also else F.lit(True)), F.lit(words)) for some, also, words in rules.SYNONYMS]
    return F.trim(F.concat_ws(" ", text.col(question), *more))


def documents(q: Column) -> Column:
    """The documents that a folded question names."""
    named = [F.when(text.contains_any(q, names), F.array(*map(F.lit, meant))).otherwise(F.array().cast("array<string>")) for _, names, meant in rules.DOCUMENTS]
    return F.array_distinct(F.concat(*named))


def is_penalty(q: Column) -> Column:
    return text.contains_any(q, rules.PENALTY_QUESTION)


def scope(q: Column) -> Column:
    """The documents that a folded question names, or that its terms imply if it is about penalties."""
    named = documents(q)
    implied = (is_penalty(q) | text.contains_any(q, rules.PENALTY_CONTEXT)) & text.contains_any(q, rules.SERVICES)
    return F.when(F.size(named) > 0, named).when(implied, F.array(F.lit(rules.SERVICES_DOCUMENT))).otherwise(F.array().cast("array<string>"))


def _of(document: Column, *names: str) -> Column:
    return text.contains_any(text.fold(document), names)


def vehicle_boosts() -> list:
    """Rows of the articles for the question's vehicle."""
    own = F.lit(False)
    for name, articles in rules.VEHICLE_ARTICLES.items():
        own = own | ((F.col("vehicle") == name) & F.col("article").isin(*articles))
    return [("vehicle_scope_boost", own & _of(F.col("document"), "nghi dinh 168", "luat trat tu"), 2.0)]


def penalty_boosts() -> list:
    named = F.size("named") > 0
    inside = F.array_contains("named", F.col("document"))
    rule = F.lit(False)
    wide = F.lit(False)
    for name, article in rules.RULE_ARTICLES.items():
        rule = rule | ((F.col("vehicle") == name) & (F.col("article") == article))
        wide = wide | ((F.col("vehicle") == name) & F.col("article").isin(*rules.VEHICLE_ARTICLES[name]))
    extra = F.lit(False)
    for term in ("toc do", "khong du tuoi", "chua du tuoi"):
        extra = extra | (F.contains("qa", F.lit(term)) & F.contains("body", F.lit(term)))
    same = F.lit(False)
    for name, _, terms in rules.SEARCHED:
        same = same | (F.array_contains("behaviours", name) & text.contains_any("body", terms))
    return [
        ("penalty_scoped_document_boost", named & inside, 0.6),
        ("penalty_document_boost", ~named & _of(F.col("document"), "nghi dinh 168"), 0.5),
        ("vehicle_penalty_article_boost", F.when(F.size("behaviours") > 0, rule).otherwise(wide), 0.8),
        ("penalty_text_boost", text.contains_any("body", rules.PENALTY_MARKS), 0.4),
        ("behavior_text_boost", same | extra, 1.6),
    ]


def license_boosts() -> list:
    asked = text.contains_any("qa", rules.LICENSE_QUESTION) & _of(F.col("document"), "luat trat tu atgt")
    return [
        ("license_class_boost", asked & (F.col("article") == "57") & text.contains_any("body", rules.LICENSE_CLASS), 3.2),
        ("driver_age_boost", asked & (F.col("article") == "59") & text.contains_any("body", rules.DRIVER_AGE), 3.0),
    ]


def definition_terms(question) -> Column:
    """What a question asks the meaning of."""
    q = F.regexp_replace(text.fold(question), r"[?!.]+$", "")
    tidy = lambda t: F.regexp_replace(F.regexp_replace(t, r"\b(?:the nao|trong luat|theo luat|quy dinh)\b", ""), r"^[ ?.,;:]+|[ ?.,;:]+$", "")
    found = F.transform(F.array(*[F.regexp_extract(q, p, 1) for p in rules.DEFINITION_PATTERNS]), tidy)
    return F.filter(F.array_distinct(found), lambda t: F.length(t).between(2, 80))


def definition_boosts() -> list:
    return [
        ("definition_text_boost", text.contains_any("body", rules.DEFINITION_MARKS), 1.2),
        ("definition_term_boost", F.exists("terms", lambda t: F.contains(F.col("body"), t)), 1.5),
        ("definition_law_article_boost", F.col("article").isin("2", "3") & _of(F.col("document"), "luat duong bo", "luat trat tu"), 1.0),
    ]


def priority_boosts() -> list:
    return [("priority_text_boost", text.contains_any("body", rules.PRIORITY_MARKS), 1.5), ("priority_law_boost", _of(F.col("document"), "luat trat tu", "luat duong bo"), 0.5)]


def scenario_boosts() -> list:
    both = F.lit(False)
    for term in rules.SCENARIO_MARKS:
        both = both | (F.contains("qa", F.lit(term)) & F.contains("body", F.lit(term)))
    return [("scenario_term_boost", both, 1.0)]


def procedure_boosts() -> list:
    return [(name, text.contains_any("qa", asked) & text.contains_any("body", terms), value) for name, asked, terms, value in rules.PROCEDURE_MARKS]


def image_boosts() -> list:
    return [("source_image_route", F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0, 1.5)]


def speed_on_expressway(q: Column, body: Column) -> Column:
    """Whether a question on the speed limit of expressways meets a text on it."""
    return F.contains(q, F.lit("toc do")) & F.contains(q, F.lit("cao toc")) & F.contains(body, F.lit("toc do")) & F.contains(body, F.lit("cao toc"))


def should_rerank(question, difficulty=None, score=None, least_score: int = 5, least_words: int = 28) -> Column:
    """Whether a model should rerank: hard questions; where nothing is known of that, long ones, ones of two behaviours, and penalties without a vehicle."""
    q = text.fold(question)
    known = text.col(difficulty) if difficulty is not None else F.lit(None).cast("string")
    points = F.coalesce(text.col(score), F.lit(0)) if score is not None else F.lit(0)
    open_ = is_penalty(q) & vehicle(q).isNull() & text.contains_any(q, rules.ANY_VEHICLE)
    unknown = (F.size(F.split(F.trim(text.col(question)), r"\s+")) >= least_words) | (F.size(searched(text.fold(focused(question)))) >= 2) | open_
    return F.when((known == "hard") | (points >= least_score), True).when(known.isNotNull() | (points > 0), False).otherwise(unknown)
