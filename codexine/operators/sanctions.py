"""Sanctions across a corpus: amounts, points, suspensions with the acts that they refer to, and limits of speed.

Records are rows of id, document, article, clause, point, text; further columns are named in each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, text
from ..functions.text import col, let
from ..sources.tables import cut

#: Terms over folded text: fixed values.
FINE_TERMS = ("phat tien", "muc phat tien")
LIMIT_TERMS = ("muc phat tien toi da", "tham quyen phat tien", "co quyen phat tien den", "gia tri khong vuot qua")
ACT_OF_LIMIT = ("hanh vi", "thuc hien", "vi pham sau")
RESTORED = ("phuc hoi", "du 12 diem", "kiem tra kien thuc")
OF_POINTS = ("hanh vi", "vi pham", "ngoai viec bi ap dung", "hinh thuc xu phat")
NO_ACT_RULES = ("trinh tu, thu tuc tuoc", "nguyen tac tru diem", "tham quyen tru diem", "giay phep lai xe tich hop", "neu co hanh vi vi pham bi tuoc")
NO_ACTS = (
    "trinh tu", "thu tuc", "nguyen tac", "tham quyen", "quy dinh ve cac loai giay phep", "giay phep lai xe tich hop", "ca nhan thuc hien nhieu hanh vi", "truong hop co hanh vi bi tuoc",
    "quy dinh ve viec ap dung hinh thuc tuoc",
)
ACTS = (
    "dieu khien", "nguoi dieu khien", "khong ", "thuc hien hanh vi", "hanh vi vi pham", "vi pham tai", "lui xe", "quay dau", "di vao", "di nguoc", "chay qua", "vuot ", "dung xe", "do xe", "cho nguoi",
    "lang lach", "lap them", "su dung",
)
POINT_PATTERNS = (r"trừ\s+(\d{1,2})\s+điểm", r"bị\s+trừ\s+(\d{1,2})\s+điểm", r"trừ\s+điểm[^.\n]{0,100}?(\d{1,2})\s+điểm", r"bị\s+trừ[^.\n]{0,100}?(\d{1,2})\s+điểm")
SUSPENSION = r"(?iu)((?:có thể\s+)?(?:bị\s+|áp dụng\s+)?tước[^.;\n]{0,180})"
NO_SUSPENSION_TERM = "Có áp dụng hình thức tước GPLX; bản ghi chưa nêu rõ thời hạn."
SPEEDING = ("chay qua toc do quy dinh", "chay qua toc do duoi nhau", "chay qua toc do", "qua toc do quy dinh")
#: Thresholds of speed in the order of their tests: pattern over folded text, label, rank within a vehicle's rows. Fixed values.
THRESHOLDS = (
    (r"tu\s*0?5\s*km/?h\s*den\s*duoi\s*10\s*km/?h", "Từ 05 km/h đến dưới 10 km/h", 1), (r"tu\s*10\s*km/?h\s*den\s*20\s*km/?h", "Từ 10 km/h đến 20 km/h", 2),
    (r"tren\s*20\s*km/?h\s*den\s*35\s*km/?h", "Trên 20 km/h đến 35 km/h", 3), (r"tren\s*35\s*km/?h", "Trên 35 km/h", 4), (r"tren\s*20\s*km/?h", "Trên 20 km/h", 5),
    (r"thanh nhom.*chay qua toc do|chay qua toc do.*thanh nhom", "Chạy thành nhóm từ 02 xe trở lên quá tốc độ quy định", 6), (r"duoi nhau.*chay qua toc do|chay qua toc do.*duoi nhau", "Chạy quá tốc độ đuổi nhau", 7),
    (r"gay tai nan.*chay qua toc do|chay qua toc do.*gay tai nan", "Chạy quá tốc độ quy định gây tai nạn giao thông", 8),
)
ARTICLE_RANK = {"6": 0, "7": 10, "8": 20}


def amounts(records: DataFrame, only_individual: bool = False) -> DataFrame:
    """id, article, clause, point, amount_min, amount_max of each record about fines, one row for each distinct one.

    records: with fine_min and fine_max besides. General limits without an act are left out; amounts come from the text, or
    from the columns where it has none (or first, if only individuals are asked for)."""
    flags = let(text.fold("text"), lambda f: F.struct(text.contains_any(f, FINE_TERMS).alias("fine"), (text.contains_any(f, LIMIT_TERMS) & ~text.contains_any(f, ACT_OF_LIMIT)).alias("limit")))
    given = F.filter(F.array(F.col("fine_min").cast("long"), F.col("fine_max").cast("long")), lambda v: v > 0)
    rows = records.select("id", "article", "clause", "point", text.money_values("text").alias("_said"), given.alias("_given"), flags.alias("_flags"))
    # As a table, since the filters would be pushed below the columns that they read, and a text folded for each term.
    rows = cut(rows.select("id", "article", "clause", "point", "_said", "_given", F.col("_flags.fine").alias("_fine"), F.col("_flags.limit").alias("_limit")), "amounts")
    first, then = ("_given", "_said") if only_individual else ("_said", "_given")
    values = F.when(F.size(first) > 0, F.col(first)).otherwise(F.col(then))
    found = rows.filter((F.col("_fine") | (F.size("_given") > 0)) & ~F.col("_limit")).withColumn("_v", values).filter(F.size("_v") > 0)
    return found.select("id", "article", "clause", "point", F.array_min("_v").alias("amount_min"), F.array_max("_v").alias("amount_max")).distinct()


def point_values(x, deduction=None) -> Column:
    """Points that a text takes off, by four ways to say so, with those of a column."""
    body = F.coalesce(col(x), F.lit(""))
    found = [F.regexp_extract_all(body, F.lit(f"(?iu){p}"), 1) for p in POINT_PATTERNS]
    own = [F.regexp_extract_all(F.coalesce(col(deduction).cast("string"), F.lit("")), F.lit(r"(\d+)"), 1)] if deduction is not None else []
    return F.transform(F.concat(*own, *found), lambda v: v.cast("int"))


def point_ranking(records: DataFrame, k: int, lowest: bool = False, deduction=None) -> DataFrame:
    """id, points, rank of the records that take off most points (or fewest); those on the return of points are left out."""
    values = F.filter(point_values("text", deduction), lambda v: v.isNotNull())
    rows = records.filter(let(text.fold("text"), lambda f: ~text.contains_any(f, RESTORED) & text.contains_any(f, OF_POINTS))).withColumn("_v", values)
    rows = rows.select("id", (F.array_min("_v") if lowest else F.array_max("_v")).alias("points")).filter("points > 0")
    order = Window.orderBy(F.asc("points") if lowest else F.desc("points"), "id")
    best = rows.orderBy(F.asc("points") if lowest else F.desc("points"), "id").limit(k)  # a top-k report: few rows reach the window
    return best.withColumn("rank", F.row_number().over(order))


def suspension_text(x) -> Column:
    """The clause that says for how long a licence is suspended."""
    found = F.regexp_extract(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+", " "), SUSPENSION, 1)
    return F.when(found == "", F.lit(NO_SUSPENSION_TERM)).otherwise(F.regexp_replace(found, "^[ .;:]+|[ .;:]+$", ""))


def act(violation, context) -> Column:
    """The act that a record is about: its own words for it, or what its context says before the sanction; null if it is none."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(col(c) if isinstance(c, str) else c, F.lit("")), r"\s+", " "), "^[ .;:]+|[ .;:]+$", "")
    # Each text is folded once, not once for each term.
    fits = lambda c: let(text.fold(c), lambda f: ~text.contains_any(f, NO_ACTS) & text.contains_any(f, ACTS))
    before = tidy(F.get(F.split(tidy(context), r"(?iu)\s+(?:bị|sẽ bị|chịu|còn bị|được áp dụng)\s+", 2), F.lit(0)))
    both = F.struct(tidy(violation).alias("own"), before.alias("before"))
    return let(both, lambda s: F.when((s["own"] != "") & fits(s["own"]), s["own"]).when((F.size(F.split(s["before"], " ")) >= 4) & fits(s["before"]), s["before"]))


def suspended_clauses(x) -> Column:
    """The clauses that a sanction names, each with its points: array of clause, points (none means all)."""
    norm = text.fold(x)
    # A part ends with its clause; points stand before it, since the last semicolon.
    parts = F.regexp_extract_all(norm, F.lit(r"([^;]*?\bkhoan\s+\d+\b)"), 1)
    spec = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"\bkhoan\s+(\d+)$", 1).alias("clause"), F.regexp_extract_all(p, F.lit(r"\bdiem\s+([a-z])\b"), 1).alias("points")))
    return F.filter(spec, lambda s: s["clause"] != "")


def suspensions(records: DataFrame) -> DataFrame:
    """act_id, act, suspension, sanction_id: the acts whose licence is suspended.

    records: with violation and context besides. A sanction that names clauses and points is joined to the records of its
    document and article that have them and aren't sanctions themselves; one that names none, or whose acts aren't there,
    stands for itself. Equal pairs of act and suspension of one reference are one."""
    said = let(text.fold("text"), lambda f: F.struct((F.contains(f, F.lit("tuoc")) & text.contains_any(f, ("giay phep lai xe", "gplx"))).alias("s"), text.contains_any(f, NO_ACT_RULES).alias("none")))
    rows = records.select("id", "document", "article", F.coalesce("clause", F.lit("")).alias("clause"), F.lower(F.coalesce("point", F.lit(""))).alias("point"), "text", act("violation", "context").alias("act"), said.alias("_said"))
    # As a table, since filters on these columns would be pushed below them, and acts and folded texts made anew for each use.
    rows = cut(rows.select("id", "document", "article", "clause", "point", F.when(F.col("_said.s"), F.col("text")).alias("text"), "act", F.substring(text.fold("act"), 1, 360).alias("_act"), F.col("_said.s").alias("_s"), F.col("_said.none").alias("_none")), "acts")
    sanctions = rows.filter(F.col("_s") & ~F.col("_none") & F.col("article").rlike(r"^\d+$"))
    sanctions = sanctions.select(F.col("id").alias("sanction_id"), "document", "article", suspension_text("text").alias("suspension"), suspended_clauses("text").alias("_specs"), F.col("act").alias("_own"), F.col("_act").alias("_own_act"))
    sanctions = cut(sanctions.withColumn("_said", F.substring(text.fold("suspension"), 1, 220)), "sanctions")
    named = sanctions.select("sanction_id", "document", "article", "suspension", "_said", F.explode("_specs").alias("_spec")).select("sanction_id", "document", "article", "suspension", "_said", F.col("_spec.clause").alias("clause"), F.explode(F.when(F.size("_spec.points") > 0, F.col("_spec.points")).otherwise(F.array(F.lit("*")))).alias("_point"))
    acts = rows.filter(~F.col("_s") & F.col("act").isNotNull()).select("document", "article", "clause", F.explode(F.array(F.lit("*"), "point")).alias("_point"), F.col("id").alias("act_id"), "act", "_act")
    key = ["document", "article", "clause", "_point"]
    # Of the sanctions of one place and one text only the least counts, so acts meet texts, not sanctions.
    least = cut(named.groupBy(*key, "_said").agg(F.min(F.struct("sanction_id", "suspension")).alias("_m")), "least")
    found = least.join(acts, key).select("act_id", "_act", "_said", "act", "_m.suspension", "_m.sanction_id")
    acted = named.join(acts.select(key).distinct(), key, "left_semi").select("sanction_id").distinct()
    alone = sanctions.filter("_own IS NOT NULL").join(acted, "sanction_id", "left_anti")
    both = found.unionByName(alone.select(F.col("sanction_id").alias("act_id"), F.col("_own_act").alias("_act"), "_said", F.col("_own").alias("act"), "suspension", "sanction_id"))
    first = both.groupBy("act_id", "_act", "_said").agg(F.min(F.struct("sanction_id", "act", "suspension")).alias("_m"))
    return first.select("act_id", "_m.act", "_m.suspension", "_m.sanction_id")


def mismatched_amounts(records: DataFrame, fields: list[str], body: str = "text") -> DataFrame:
    """id, field, value of amounts that the record's text doesn't hold, where the text holds any."""
    said = F.transform(F.regexp_extract_all(F.coalesce(col(body), F.lit("")), F.lit(r"(?iu)(\d{1,3}(?:\.\d{3})*)\s*(?:đồng|VNĐ|VND)"), 1), lambda v: F.replace(v, F.lit("."), F.lit("")).cast("long"))
    rows = records.select("id", said.alias("_said"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("value")) for f in fields])).alias("_f"))
    return rows.filter((F.size("_said") > 0) & (F.col("_f.value") != 0) & ~F.array_contains("_said", F.col("_f.value"))).select("id", "_f.field", "_f.value")


def is_speeding(x) -> Column:
    norm = text.fold(x)
    return text.contains_any(norm, SPEEDING) & ~F.contains(norm, F.lit("toc do thap hon"))


def speed_threshold(x) -> Column:
    """The threshold that a text on speeding names, as a label; the text's beginning if it names none."""
    norm = text.fold(x)
    out = F.when(norm.rlike(THRESHOLDS[0][0]), THRESHOLDS[0][1])
    for pattern, label, _ in THRESHOLDS[1:]:
        out = out.when(norm.rlike(pattern), label)
    return out.when(F.contains(norm, F.lit("chay qua toc do")), cleaning.one_line(F.substring(cleaning.one_line(x), 1, 180))).otherwise("")


def speed_rank(article, threshold) -> Column:
    """The place of a row in the table of speeds: by vehicle, then by threshold."""
    base = F.coalesce(*[F.when(col(article) == a, r) for a, r in ARTICLE_RANK.items()], F.lit(90))
    return base + F.coalesce(*[F.when(col(threshold) == label, r) for _, label, r in THRESHOLDS], F.lit(9))


def speed_rows(records: DataFrame) -> DataFrame:
    """article, threshold, fine, id, rank of the records on speeding: the fine comes from the clause above a point, or else from the row itself.

    records: with penalty (text), fine_min and fine_max besides."""
    usable = F.when(cleaning.usable_penalty("penalty"), cleaning.one_line("penalty"))
    amount = F.when(F.col("fine_min").isNotNull() | F.col("fine_max").isNotNull(), F.concat_ws(" - ", cleaning.format_vnd("fine_min"), cleaning.format_vnd("fine_max")))
    rows = records.filter(F.col("article").isin(*ARTICLE_RANK)).withColumn("_fine", F.coalesce(usable, amount))
    bare = F.coalesce("point", F.lit("")) == ""
    parents = rows.filter(bare & (F.coalesce("clause", F.lit("")) != "") & F.col("_fine").isNotNull()).groupBy("document", "article", "clause").agg(F.max_by("_fine", "id").alias("_above"))
    speeding = rows.filter(is_speeding("text")).withColumn("threshold", speed_threshold("text")).filter("threshold <> ''")
    out = speeding.join(parents, ["document", "article", "clause"], "left")
    out = out.select("article", "threshold", F.coalesce("_above", "_fine").alias("fine"), "id", speed_rank("article", "threshold").alias("rank"))
    return out.groupBy("article", "threshold", "rank", "fine").agg(F.min("id").alias("id"))


def scope(documents: DataFrame, column: str = "document") -> DataFrame:
    """n_documents, names: the distinct names of a corpus, the first three of them by name."""
    names = documents.select(F.col(column).alias("name")).filter(F.coalesce("name", F.lit("")) != "").distinct()
    # Only the first three names are kept, by a top-k that each task reduces.
    few = names.orderBy("name").limit(3).agg(F.array_sort(F.collect_list("name")).alias("names"))
    return names.agg(F.count(F.lit(1)).alias("n_documents")).join(F.broadcast(few))  # one row each


def by_article(rows: DataFrame, reference: str = "reference") -> DataFrame:
    """article, references: the distinct references of each article."""
    return rows.filter(F.coalesce("article", F.lit("")) != "").groupBy("article").agg(F.array_sort(F.collect_set(reference)).alias("references"))
