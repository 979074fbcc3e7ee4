"""Functions of arrays, vectors and tables as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let


def dot(a, b) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def l2_normalize(v) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(col(v), lambda x: x.cast("double") / norm)


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def jaccard(a, b) -> Column:
    """Of sets as arrays; two empty ones are alike, an empty one and another aren't."""
    both, any_ = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def overlap(a, b) -> Column:
    """Shared elements over the smaller set; 0 if one is empty."""
    a, b = F.array_distinct(col(a)), F.array_distinct(col(b))
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def nearest_rank(values, share: float) -> Column:
    """The element of sorted values at index round((n - 1) * share), halves to even; null of none."""
    values = F.sort_array(F.filter(col(values), lambda x: x.isNotNull()))
    return F.get(values, F.bround((F.size(values) - 1) * F.lit(share)).cast("int"))


def bag_overlap(a, b) -> Column:
    """Tokens that two bags share, with their counts. Each bag is made once, however many tokens it has."""
    count = lambda bag, t: F.size(F.filter(bag, lambda x: x == t))
    shared = lambda a, b: F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))
    return let(col(a), lambda a: let(col(b), lambda b: shared(a, b)))


def token_f1(prediction, gold) -> Column:
    """F1 of two bags of tokens; both empty 1, one empty 0."""
    return let(col(prediction), lambda p: let(col(gold), lambda g: let(bag_overlap(p, g), lambda shared: f1_of(shared, p, g))))


def f1_of(shared: Column, p: Column, g: Column) -> Column:
    """F1 of two bags that share so many tokens."""
    score = F.when(shared == 0, F.lit(0.0)).otherwise(2.0 * shared / (F.size(p) + F.size(g)))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).otherwise(score)


def token_recall(container, needle) -> Column:
    return let(col(needle), lambda g: recall_of(bag_overlap(container, g), g))


def recall_of(shared: Column, needle: Column) -> Column:
    """The share of a bag's tokens that another has, which shares so many of them."""
    return F.when(F.size(needle) == 0, F.lit(1.0)).otherwise(shared / F.size(needle))


def hit_at(retrieved, expected, k: int) -> Column:
    """1 if one of the first k is expected, and if nothing is."""
    hit = F.arrays_overlap(F.slice(col(retrieved), 1, k), col(expected))
    return F.when((F.size(col(expected)) == 0) | hit, F.lit(1.0)).otherwise(F.lit(0.0))


def reciprocal_rank(retrieved, expected) -> Column:
    places = F.filter(F.transform(col(retrieved), lambda x, i: F.when(F.array_contains(col(expected), x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(col(expected)) == 0, F.lit(1.0)).otherwise(F.coalesce(1.0 / F.array_min(places), F.lit(0.0)))


def pad_rows(rows) -> Column:
    """Rows of a table at the length of the longest, cells trimmed, rows without text dropped."""
    rows = F.transform(col(rows), lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    rows = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def row_text(headers, row) -> Column:
    """"header: cell" of the cells that have text, joined by bars."""
    cells = F.zip_with(col(headers), col(row), lambda h, c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(F.coalesce(h, F.lit("")) == "", c).otherwise(F.concat(h, F.lit(": "), c)))
    return F.array_join(F.filter(cells, lambda x: x.isNotNull()), " | ")


def table_issues(rows) -> Column:
    """RAGGED_ROWS, MANY_EMPTY_CELLS (over 45 %) and TOO_FEW_ROWS (under 2)."""
    rows = col(rows)
    widths = F.array_distinct(F.transform(rows, F.size))
    cells = F.flatten(rows)
    empty = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""))
    return F.array_compact(F.array(F.when(F.size(widths) > 1, "RAGGED_ROWS"), F.when(empty > 0.45 * F.size(cells), "MANY_EMPTY_CELLS"), F.when(F.size(rows) < 2, "TOO_FEW_ROWS")))


def natural_key(x) -> Column:
    """Digits padded to a width, so that texts sort by their numbers."""
    parts = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")
