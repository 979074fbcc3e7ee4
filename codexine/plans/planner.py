"""The query planner as column functions over a table of questions: facets, intent, slots, hints and salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from . import rules


def _any(q: Column, name: str) -> Column:
    return text.contains_any(q, rules.TERMS[name])


def behaviours(q: Column, facet: str | None = None) -> Column:
    """Names of the behaviours that a folded question mentions."""
    found = [F.when(text.contains_any(q, terms), F.lit(name)) for name, (kind, terms) in rules.BEHAVIOURS.items() if facet in (None, kind)]
    return F.array_compact(F.array(*found))


def statutory_cap(q: Column) -> Column:
    must, some, none = rules.STATUTORY_CAP
    return text.contains_all(q, must) & text.contains_any(q, some) & ~text.contains_any(q, none)


def _aggregation(q: Column) -> Column:
    about = q.rlike(r"\btop\s*[-_ ]?\s*k\b") | _any(q, "about_system")
    return ~statutory_cap(q) & ~about & ((_any(q, "ranking") & _any(q, "ranking_target")) | (_any(q, "catalog") & _any(q, "sanction")))


def _table(q: Column) -> Column:
    return ~_any(q, "not_table") & (_any(q, "table") | q.rlike(r"\bbang\b"))


def _license_points(q: Column) -> Column:
    return _any(q, "license") & _any(q, "license_points")


def _out_of_scope(q: Column) -> Column:
    words = F.size(F.split(q, " "))
    return ~_any(q, "in_scope") & (_any(q, "unrelated") | (~_any(q, "legal_words") & (words > 3) & ~_any(q, "legal_sources")))


def facets(question) -> Column:
    """All facets of a question in a fixed order; ["general"] of one without any, ["out_of_scope"] of one about something else."""
    q = text.fold(question)
    has_code = F.size(text.sign_codes(question)) > 0
    n_behaviours = F.size(behaviours(q))
    aggregation, sign = _aggregation(q), has_code | _any(q, "sign")
    detail = q.rlike(r"\bdieu\s+\d+[a-z]?\b") & _any(q, "document") & (_any(q, "detail") | (F.size(F.split(q, " ")) <= 12))
    image = q.rlike(r"\banh\b") | _any(q, "source_image")
    penalty = (_any(q, "penalty") | (F.size(behaviours(q, "penalty")) > 0)) & ~statutory_cap(q) & ~(aggregation & (n_behaviours == 0))
    conditions = (
        ("aggregation", aggregation),
        ("sign", sign),
        ("table", _table(q)),
        ("document_overview", _any(q, "document") & _any(q, "overview")),
        ("legal_detail", detail),
        ("source_image", image),
        ("priority", _any(q, "priority")),
        ("scenario", ((n_behaviours >= 2) | _any(q, "scenario")) & ~(sign & (n_behaviours < 2))),
        ("penalty", penalty),
        ("procedure", _any(q, "procedure")),
        ("definition", statutory_cap(q) | _any(q, "definition") | _license_points(q)),
        ("rule", (_any(q, "rule") | (n_behaviours > 0)) & ~_license_points(q)),
        ("source_image", (n_behaviours >= 2) & ~image),
    )
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions]))
    return F.when(~has_code & _out_of_scope(q), F.array(F.lit("out_of_scope"))).when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found)


def intent(found: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(found, name), F.lit(name)) for name in rules.INTENTS], F.lit("general"))


def modalities(found: Column) -> Column:
    more = [F.when(F.array_contains(found, name), F.array(*map(F.lit, kinds))).otherwise(F.array().cast("array<string>")) for name, kinds in rules.MODALITIES.items()]
    return F.array_distinct(F.concat(F.array(F.lit("text")), *more))


def salience(piece) -> Column:
    """How telling a sentence is."""
    q = text.fold(piece)
    score = F.when(F.size(text.sign_codes(piece)) > 0, 5).otherwise(0)
    score = score + F.when(q.rlike(r"\b(?:dieu|khoan|diem)\s+\w+") | q.rlike(r"\d+/\d{4}|qcvn|nghi dinh|thong tu|luat"), 5).otherwise(0)
    score = score + F.when(q.rlike(r"\d"), 3).otherwise(0)
    for value, terms in rules.SALIENCE:
        score = score + F.when(text.contains_any(q, terms), value).otherwise(0)
    return score


def salient(rows: DataFrame, id_column: str, text_column: str, top: int = 24, budget: int = 1200) -> DataFrame:
    """The most telling sentences of each text, in their order, within a budget of characters. First and last sentences count 3 more."""
    pieces = rows.select(id_column, F.posexplode(text.sentence_pieces(text_column)).alias("at", "piece"))
    last = F.max("at").over(Window.partitionBy(id_column))
    pieces = pieces.withColumn("score", salience("piece") + F.when((F.col("at") == 0) | (F.col("at") == last), 3).otherwise(0))
    order = Window.partitionBy(id_column).orderBy(F.desc("score"), "at")
    best = pieces.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)
    used = F.sum(F.length("piece") + 1).over(Window.partitionBy(id_column).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("used", used).filter(F.col("used") <= budget).select(id_column, "at", "piece", "score")


def slots(questions: DataFrame, id_column: str, question: str, most: int = 16) -> DataFrame:
    """One row for each sub-question: a facet of the question, and for penalties one for each behaviour."""
    found = questions.select(id_column, facets(question).alias("facets"), behaviours(text.fold(question), "penalty").alias("acts"))
    acts = F.when(F.size("acts") > 0, F.col("acts")).otherwise(F.array(F.lit("")))
    each = F.flatten(F.transform("facets", lambda f: F.when(f == "penalty", F.transform(acts, lambda a: F.struct(f.alias("facet"), a.alias("behaviour")))).otherwise(F.array(F.struct(f.alias("facet"), F.lit("").alias("behaviour"))))))
    return found.select(id_column, F.posexplode(F.slice(each, 1, most)).alias("at", "slot")).select(id_column, (F.col("at") + 1).alias("priority"), "slot.facet", "slot.behaviour")


def similar_slots(a, b, least: float = 0.62) -> Column:
    """Whether two sub-questions are nearly the same, by the Jaccard similarity of their content words."""
    return arrays.jaccard(text.content_tokens(a), text.content_tokens(b)) >= least


def difficulty(score: Column) -> Column:
    out = F.lit("easy")
    for name, least in reversed(rules.DIFFICULTY):
        out = F.when(score >= least, name).otherwise(out)
    return out


def expected_seconds(level: Column, profile: str = "balanced") -> Column:
    easy, medium, hard = rules.EXPECTED_SECONDS[profile]
    return F.when(level == "hard", hard).when(level == "medium", medium).otherwise(easy)


def hints(question) -> Column:
    """What a question leaves open: the vehicle, the speed, the alcohol level, the outcome of an accident, the sign's code."""
    q = text.fold(question)
    penal, moving = text.contains_any(q, rules.HINT_PENALTY), text.contains_any(q, rules.HINT_MOVING)
    found = (
        ("vehicle", penal & moving & ~(_any(q, "catalog") & _any(q, "sanction")) & ~_any(q, "vehicle")),
        ("speed", text.contains_any(q, rules.HINT_SPEED) & ~q.rlike(r"\d+(?:[.,]\d+)?\s*km/?h")),
        ("alcohol", text.contains_any(q, rules.HINT_ALCOHOL) & ~q.rlike(r"\d")),
        ("accident", text.contains_any(q, ("tai nan", "gay tai nan"))),
        ("sign", text.contains_any(q, ("bien", "vach")) & (F.size(text.sign_codes(question)) == 0) & ~text.contains_any(q, ("anh", "hinh"))),
        ("statistics", text.contains_any(q, rules.HINT_FREQUENT)),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found]))


def merge_slots(slots_: DataFrame, id_column: str, least: float = 0.62) -> DataFrame:
    """Slots without those nearly the same as an earlier one that stays (facet, question, priority), renumbered. A question
    has a few slots, so each group is small."""

    def run(frame):
        kept: list = []
        for row in frame.sort_values(["priority", "facet", "question"]).to_dict("records"):
            words = set(row["words"])
            if not any(k["facet"] == row["facet"] and (len(words & k["_w"]) / len(words | k["_w"]) if words | k["_w"] else 1.0) >= least for k in kept):
                kept.append(row | {"_w": words})
        out = frame.iloc[0:0][[id_column, "facet", "question", "priority"]]
        for n, row in enumerate(kept, 1):
            out.loc[n - 1] = [row[id_column], row["facet"], row["question"], n]
        return out

    rows = slots_.withColumn("words", text.content_tokens("question"))
    kind = dict(rows.dtypes)
    return rows.groupBy(id_column).applyInPandas(run, f"{id_column} {kind[id_column]}, facet string, question string, priority int")
