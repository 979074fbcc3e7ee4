"""Questions taken apart: how complex they are, what may be spent on them, their parts, and what is still missing after a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, text
from . import planner, rules, scoring


def _when(condition: Column, value: int) -> Column:
    return F.when(condition, value).otherwise(0)


def simple_penalty(question, facets: Column, n_slots: Column) -> Column:
    """A penalty for one behaviour of a vehicle that is named."""
    q = text.fold(question)
    told = F.array_except(facets, F.array(F.lit("general")))
    return (F.size(told) > 0) & (F.size(F.array_except(told, F.array(F.lit("rule"), F.lit("penalty")))) == 0) & scoring.vehicle(q).isNotNull() & (n_slots <= 2) & (F.size(planner.behaviours(q, "penalty")) <= 1)


def complexity(question, facets: Column, n_slots: Column, hint: Column | None = None) -> Column:
    """A score from 0 to 12: length, facets, parts, what is left open, references, numbers, conditions. hint: a model's word, hard or medium."""
    q = text.fold(question)
    raw = F.coalesce(text.col(question), F.lit(""))
    words = F.size(F.filter(F.split(F.trim(raw), r"\s+"), lambda w: w != ""))
    told = F.size(F.array_except(facets, F.array(F.lit("general"))))
    has = lambda f: F.array_contains(facets, f)
    penal = has("penalty") | text.contains_any(q, ("phat", "xu phat", "muc phat", "vi pham", "bi gi", "xu ly"))
    open_ = penal & ~has("aggregation") & ~text.contains_any(q, rules.TERMS["vehicle"]) & text.contains_any(q, rules.ANY_VEHICLE)
    score = F.when(words > 35, 4).when(words > 22, 3).when(words > 12, 1).otherwise(0)
    score = score + F.when(told >= 3, 4).when(told == 2, 2).otherwise(0) + F.when(n_slots >= 4, 3).when(n_slots >= 2, 2).otherwise(0)
    score = score + _when(open_, 4) + _when(text.contains_any(q, rules.SPEED_QUESTION) & ~q.rlike(r"\d+(?:[.,]\d+)?\s*km/?h"), 2)
    score = score + _when(F.size(text.sign_codes(raw)) > 0, 2) + _when(F.size(text.explicit_refs(raw)) > 0, 2)
    score = score + _when(F.size(F.regexp_extract_all(q, F.lit(r"(\b\d+(?:[.,]\d+)?\b)"), 1)) >= 2, 1) + _when(text.contains_any(q, rules.COMBINED), 3) + _when(text.contains_any(q, rules.CONDITIONAL), 2)
    for facet, weight in rules.FACET_WEIGHTS.items():
        score = score + _when(has(facet), weight)
    score = score + _when(has("aggregation") & text.contains_any(q, rules.TERMS["catalog"]) & text.contains_any(q, rules.TERMS["sanction"]), 2)
    score = F.when(has("out_of_scope"), F.greatest(score, F.lit(1))).otherwise(score)
    score = F.when(simple_penalty(question, facets, n_slots) | planner.statutory_cap(q), F.least(score, F.lit(2))).otherwise(score)
    if hint is not None:
        score = F.when(hint == "hard", F.greatest(score, F.lit(6))).when(hint == "medium", F.greatest(score, F.lit(3))).otherwise(score)
    return F.least(score, F.lit(12))


def budget(score: Column, profile: str = "balanced") -> Column:
    """What may be spent on a question: difficulty, contexts searched, graph depth, contexts of a part, contexts and images kept, expected seconds."""
    level = planner.difficulty(score)
    names = ("top_k", "expand_depth", "slot_top_k", "max_contexts", "max_images")
    parts = [F.when(level == "hard", rules.BUDGETS[profile]["hard"][k]).when(level == "medium", rules.BUDGETS[profile]["medium"][k]).otherwise(rules.BUDGETS[profile]["easy"][k]).alias(n) for k, n in enumerate(names)]
    return F.struct(level.alias("difficulty"), *parts, planner.expected_seconds(level, profile).alias("expected_seconds"))


def is_act(x) -> Column:
    q = text.fold(x)
    return text.contains_any(q, rules.ACT_PHRASES) | q.rlike(rules.ACT_VERBS)


def compound_acts(question) -> Column:
    """The acts that a question joins by "and" and the like: two to four of at least three words each, or none."""
    raw = F.coalesce(text.col(question), F.lit(""))
    parts = F.transform(F.split(raw, r"(?iu)\s+(?:và|đồng thời|cùng lúc|kèm theo|rồi)\s+", -1), lambda p: F.regexp_replace(p, r"^[ ,.;]+|[ ,.;]+$", ""))
    acts = F.filter(parts, lambda p: (p != "") & is_act(p))
    long_ = F.filter(acts, lambda p: F.size(F.split(p, r"\s+")) >= 3)
    return F.when(text.contains_any(text.fold(raw), rules.JOINED) & F.size(acts).between(2, 4), long_).otherwise(F.array().cast("array<string>"))


def open_vehicles(question) -> Column:
    """The vehicles that a question on penalties leaves open: three or four of them, or none."""
    q = text.fold(question)
    speed = text.contains_any(q, rules.SPEED_QUESTION)
    wide = ~speed | text.contains_any(q, ("tat ca", "toan bo", "phuong tien", "chay xe"))
    every = F.when(wide, F.array(*map(F.lit, ("car", "motorbike", "specialized", "bicycle")))).otherwise(F.array(*map(F.lit, ("car", "motorbike", "specialized"))))
    return F.when(scoring.vehicle(q).isNull() & scoring.is_penalty(q) & text.contains_any(q, rules.ANY_VEHICLE), every).otherwise(F.array().cast("array<string>"))


def parts(questions: DataFrame, id_column: str, question: str, most: int = 16) -> DataFrame:
    """id, priority, facet, detail: a question's parts. A penalty is taken apart by the behaviours that it names, or else by the
    acts that it joins, or else by the vehicles that it leaves open; detail names the behaviour, act or vehicle.

    A simple penalty keeps its first rule and its first penalty."""
    acts, joined, open_ = planner.behaviours(text.fold(question), "penalty"), compound_acts(question), open_vehicles(question)
    detail = F.when(F.size(acts) > 0, acts).when(F.size(joined) > 0, joined).when(F.size(open_) > 0, open_).otherwise(F.array(F.lit("")))
    found = questions.select(id_column, planner.facets(question).alias("_f"), detail.alias("_d"), scoring.vehicle(text.fold(question)).alias("_v"), F.size(acts).alias("_n"))
    pair = lambda f, d: F.struct(f.alias("facet"), d.alias("detail"))
    each = F.flatten(F.transform("_f", lambda f: F.when(f == "penalty", F.transform("_d", lambda d: pair(f, d))).otherwise(F.array(pair(f, F.lit(""))))))
    simple = F.col("_v").isNotNull() & (F.col("_n") <= 1) & (F.size(F.array_except("_f", F.array(F.lit("rule"), F.lit("penalty"), F.lit("general")))) == 0)
    first = lambda a, f: F.slice(F.filter(a, lambda s: s["facet"] == f), 1, 1)
    kept = F.when(simple, F.concat(F.filter(each, lambda s: ~s["facet"].isin("rule", "penalty")), first(each, "rule"), first(each, "penalty"))).otherwise(each)
    rows = found.select(id_column, F.posexplode(F.slice(kept, 1, most)).alias("_at", "_s"))
    return rows.select(id_column, (F.col("_at") + 1).alias("priority"), "_s.facet", "_s.detail")


def appended(slots: DataFrame, new: DataFrame, id_column: str, most: int) -> DataFrame:
    """Parts (id, priority, facet, query) with the new ones that aren't there yet, by priority, up to a number."""
    key = [F.col(id_column), "facet", text.fold("query")]
    rows = slots.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    once = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("_age", "priority"))).filter("_nth = 1")
    # Old ones stay; new ones come in by priority as long as there is room.
    fits = once.withColumn("_at", F.row_number().over(Window.partitionBy(id_column).orderBy("_age", "priority", "query"))).filter(F.col("_at") <= most)
    order = Window.partitionBy(id_column).orderBy("priority", "_age", "query")
    return fits.withColumn("place", F.row_number().over(order)).select(id_column, "place", "priority", "facet", "query")


def has_money(records: DataFrame) -> Column:
    """Whether a record names an amount, in its columns or its text."""
    said = F.coalesce("text", F.lit("")).rlike(r"(?iu)\d{1,3}(?:[.,]\d{3})+\s*(?:đồng|dong)|\d+(?:[.,]\d+)?\s*(?:triệu|trieu)")
    given = [F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("fine_min", "fine_max") if c in records.columns]
    out = said
    for g in given:
        out = out | g
    return out


def gaps(questions: DataFrame, found: DataFrame, most: int = 8) -> DataFrame:
    """query_id, kind, detail, place: what a search left open, up to a number for each question.

    questions: query_id, question, facets. found: query_id, facet, document, article, text, images, and fine_min, fine_max if
    there are. Kinds: a vehicle without rows on speed (speed) or at all (vehicle), no sign (sign), no image (source_image), and
    penalties without an amount (amount)."""
    penal = F.array_contains("facets", "penalty") | (scoring.is_penalty(F.col("q")) & ~F.array_contains("facets", "aggregation"))
    asked = questions.withColumn("q", text.fold("question")).select("query_id", "facets", "q", penal.alias("penal"), text.contains_any("q", rules.SPEED_QUESTION).alias("speed"), open_vehicles("question").alias("open"))
    article = {a: v for v, articles in rules.VEHICLE_ARTICLES.items() for a in articles}
    of_vehicle = F.coalesce(*[F.when(F.col("article") == a, v) for a, v in article.items()])
    from ..operators import sanctions

    rows = found.withColumn("vehicle", F.when(F.contains(text.fold("document"), F.lit("nghi dinh 168")), of_vehicle)).withColumn("on_speed", sanctions.is_speeding("text")).withColumn("money", has_money(found))
    images = F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0
    seen = rows.groupBy("query_id").agg(
        F.collect_set("vehicle").alias("vehicles"), F.collect_set(F.when(F.col("on_speed"), F.col("vehicle"))).alias("speed_vehicles"), F.max(F.col("facet") == "sign").alias("has_sign"), F.max(images).alias("has_image"),
        F.max(F.col("facet") == "penalty").alias("has_penalty"), F.max((F.col("facet") == "penalty") & F.col("money")).alias("has_amount"),
    )
    both = asked.join(seen, "query_id", "left")
    none = F.array().cast("array<string>")
    gap = lambda kind, details: F.transform(details, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("detail")))
    one = lambda condition: F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(""))).otherwise(none)
    wanted = F.array(*map(F.lit, ("car", "motorbike", "specialized")))
    every = F.concat(
        gap("speed", F.when(F.col("penal") & F.col("speed"), F.array_except(F.when(F.size("open") > 0, F.col("open")).otherwise(wanted), F.coalesce("speed_vehicles", none))).otherwise(none)),
        gap("vehicle", F.when(F.col("penal"), F.array_except("open", F.coalesce("vehicles", none))).otherwise(none)),
        gap("sign", one(F.array_contains("facets", "sign") & ~F.coalesce("has_sign", F.lit(False)))),
        gap("source_image", one(F.array_contains("facets", "source_image") & F.col("has_image").isNotNull() & ~F.col("has_image"))),
        gap("amount", one(F.col("has_penalty") & ~F.col("has_amount"))),
    )
    return both.select("query_id", F.posexplode(F.slice(every, 1, most)).alias("place", "_g")).select("query_id", "_g.kind", "_g.detail", "place")


def unresolved(answer, question, facets: Column) -> Column:
    """Whether an answer leaves something open: it is empty or vague, names no amount of a penalty, or not all vehicles."""
    a, q = text.fold(answer), text.fold(question)
    bike = text.contains_any(a, ("mo to", "xe may", "gan may"))
    every = F.contains(a, F.lit("o to")) & bike & F.contains(a, F.lit("may chuyen dung"))
    penal = scoring.is_penalty(q)
    speed = text.contains_any(q, rules.SPEED_QUESTION) & F.contains(a, F.lit("05 km/h")) & F.contains(a, F.lit("theo quy dinh"))
    counted = F.array_contains(facets, "aggregation") & ~F.array_contains(facets, "penalty")
    return F.when(a == "", True).when(counted, False).otherwise(text.contains_any(a, rules.VAGUE_ANSWERS) | (penal & ~text.contains_any(a, ("dong", "vnd"))) | (penal & (F.size(open_vehicles(question)) > 0) & ~every) | speed)


def tagged(hits: DataFrame, slot: str, facet: str) -> DataFrame:
    """Hits with the part that they were found for."""
    return hits.withColumn("slot_id", F.lit(slot)).withColumn("slot_facet", F.lit(facet))


def merged(hits: DataFrame, most: int) -> DataFrame:
    """Hits of all parts (query_id, place of the part, id, score): each id once, by part and score, up to a number."""
    once = hits.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("place", F.desc("score")))).filter("_nth = 1").drop("_nth")
    order = Window.partitionBy("query_id").orderBy("place", F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def coverage(slots: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, place, facet, n_rows, n_images, status of every part: hit, or empty."""
    images = F.size(F.coalesce("images", F.array().cast("array<string>")))
    seen = hits.groupBy("query_id", "place").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(images).alias("n_images"))
    out = slots.select("query_id", "place", "facet").join(seen, ["query_id", "place"], "left").fillna(0, ["n_rows", "n_images"])
    return out.withColumn("status", F.when(F.col("n_rows") > 0, "hit").otherwise("empty"))


def condensed(question, history, limit: int = 1200) -> Column:
    """What is planned in place of a long question: the whole if it needs no condensing, else its beginning and end after the history's last part."""
    reason = cleaning.preprocess_reason(question, history)
    return F.struct(reason.alias("reason"), F.when(reason == "", text.col(question)).otherwise(F.concat_ws("\n", F.nullif(F.substring(F.coalesce(text.col(history), F.lit("")), -limit // 3, limit // 3), F.lit("")), text.embedding_text(question, limit))).alias("question"))
