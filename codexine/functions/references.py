"""Matching of legal references as column functions: parts, whole references, and references within answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays, text


def normalize_part(x) -> Column:
    """A part of a reference without accents, the words for article, clause and point, and other signs."""
    folded = F.replace(text.fold(x), F.lit("_"), F.lit(" "))
    folded = F.regexp_replace(folded, r"\b(?:dieu|khoan|diem)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9.,;/\s]+", " "), r"\s+", " "))


def part_values(x) -> Column:
    """All values that a part may stand for: itself, the items of a list, and its numbers and letters."""
    norm = normalize_part(x)
    items = F.split(norm, r"\s*[,;/]\s*|\s+va\s+|\s+hoac\s+", -1)
    atoms = F.regexp_extract_all(norm, F.lit(r"(\b\d+(?:\.\d+)?\b|[a-z])"), 1)
    return F.filter(F.array_distinct(F.concat(F.array(norm), items, atoms)), lambda v: v != "")


def part_matches(actual, expected) -> Column:
    """A blank expectation is met by anything; a blank part meets no other."""
    want, have = normalize_part(expected), normalize_part(actual)
    return (want == "") | ((have != "") & ((have == want) | F.array_contains(part_values(actual), want)))


def clause_matches(article, clause, expected_article, expected_clause) -> Column:
    """A clause, also in the numbering of regulations: 4.1 is clause 1 of article 4, or article 4.1."""
    want = normalize_part(expected_clause)
    left, right = F.regexp_extract(want, r"^(\d+)\.(\d+)$", 1), F.regexp_extract(want, r"^(\d+)\.(\d+)$", 2)
    whole = normalize_part(article) == want
    split = part_matches(article, left) & (normalize_part(article) != "") & part_matches(clause, right) & (normalize_part(clause) != "")
    nested = part_matches(expected_article, left) & part_matches(article, want)
    return part_matches(clause, expected_clause) | ((left != "") & (whole | split | nested))


def document_matches(actual, expected) -> Column:
    """Documents whose folded names hold one another."""
    clean = lambda c: F.trim(F.regexp_replace(F.replace(text.fold(c), F.lit("_"), F.lit(" ")), r"[^a-z0-9]+", " "))
    a, b = clean(actual), clean(expected)
    return (b == "") | ((a != "") & (F.contains(a, b) | F.contains(b, a)))


def reference_matches(actual: Column, expected: Column) -> Column:
    """Structs of document, article, clause and point."""
    return (
        document_matches(actual["document"], expected["document"])
        & part_matches(actual["article"], expected["article"])
        & clause_matches(actual["article"], actual["clause"], expected["article"], expected["clause"])
        & part_matches(actual["point"], expected["point"])
    )


def variants(ref: Column) -> Column:
    """The ways in which an answer may write a reference: with and without its document."""
    named = lambda word, c: F.when(text.blank_to_null(c).isNotNull(), F.concat(F.lit(word), c))
    detail = F.concat_ws(" ", named("điểm ", ref["point"]), named("khoản ", ref["clause"]), named("điều ", ref["article"]))
    document = F.coalesce(F.trim(ref["document"]), F.lit(""))
    both = F.when((detail != "") & (document != ""), F.concat_ws(" ", detail, document))
    return F.array_distinct(F.array_compact(F.array(both, F.when(detail != "", detail))))


def in_answer(answer, ref: Column) -> Column:
    """Whether an answer holds a reference in one of its forms, or nearly so."""
    return text.let(text.normalize_text(answer), lambda norm: F.exists(variants(ref), lambda v: F.contains(norm, text.normalize_text(v)) | (arrays.token_recall(F.split(norm, " "), text.tokens(v)) >= 1.0)))
