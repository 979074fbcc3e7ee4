"""Repair of text that comes from printed or scanned pages, and checks of values, as columns. All but the composition of
accents run in the JVM; that goes to Python only for texts that hold combining marks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text
from .text import col

#: Endings that a page's layout splits from their syllables: fixed values.
SPLIT_ENDINGS = "ều ển ời ành ặt ường gược ại ồng ắt ừng ược ổi ẫn ộng ến ỉnh ọng".split()
#: Phrases of captions that come without their spaces. A phrase that ends in a space takes the white space after it. Fixed values.
CAPTION_PHRASES = (
    "làn đường dành cho ", "hết làn đường dành cho ", "biển gộp làn đường theo phương tiện", "kết thúc làn đường theo phương tiện", "hướng đi trên mỗi làn đường", "mỗi làn đường", "làn đường",
    "đường theo phương tiện", "phải theo", "xe ô tô khách", "xe ô tô con", "xe ô tô tải", "xe ô tô", "ô tô khách", "ô tô con", "ô tô tải", "ô tô", "xe máy ", "xe đạp ", "xe buýt ",
)
#: Words of headings and citations that scans get wrong: pattern, what must follow, right form, only at the start of a line. Fixed values.
KEYWORDS = (
    (r"[ĐD]Iều", r"\s+\d+[a-zA-Z]?\b", "Điều", True), (r"[ĐD]iêu", r"\s+\d+[a-zA-Z]?\b", "Điều", True), (r"Kho[âa]n", r"\s+\d+\b", "Khoản", True), (r"Chuong", r"\s+[IVXLCDM\d]+\b", "Chương", True),
    (r"M[uụ]c", r"\s+[IVXLCDM\d]+\b", "Mục", True), (r"Ph[uụ]\s*l[uụ]c", r"\s+[IVXLCDM\d]+\b", "Phụ lục", True), (r"[ĐD]Iều", r"\s+\d+[a-zA-Z]?\b", "Điều", False), (r"[ĐD]iêu", r"\s+\d+[a-zA-Z]?\b", "Điều", False),
    (r"[DĐ]i[êe]m", r"\s+[a-zđ]\b", "điểm", False), (r"Kho[âa]n", r"\s+\d+\b", "khoản", False),
)
#: Placeholders of missing values: fixed values.
PLACEHOLDERS = ("không xác định", "n/a", "none", "unknown", "null", "khh", "không biết")
#: Texts that stand for no number: fixed values.
NO_NUMBER = ("", "n/a", "na", "none", "null", "không", "khong", "không có", "khong co", "-", "—")


def join_split_words(x) -> Column:
    """Joins endings to the syllables that they were split from. White space goes between a letter and an ending, wherever
    an ending is followed by no letter: that is what repeated joining comes to."""
    endings = "|".join(SPLIT_ENDINGS)
    return F.regexp_replace(col(x), rf"(?U)(?<=[A-Za-zÀ-ỹĐđ])\s(?=(?:{endings})\b)", "")


def space_captions(x) -> Column:
    """Puts the spaces back into phrases of captions, with the case of their first letter."""
    out = col(x)

    def replace(out, before, pattern, phrase):
        if phrase[0] != "k" and not phrase.endswith(" "):
            # The first letter stays as it is, so one reading serves both cases. Not so where a phrase takes white space, as the next
            # one may follow at once, nor for k, which has a second capital.
            return F.regexp_replace(out, rf"(?U)(?iu:{before}({pattern[0]}){pattern[1:]})", f"$1{phrase[1:]}")
        out = F.regexp_replace(out, rf"(?U)(?=\p{{Lu}})(?iu:{before}{pattern})", phrase[0].upper() + phrase[1:])
        return F.regexp_replace(out, rf"(?U)(?!\p{{Lu}})(?iu:{before}{pattern})", phrase)

    for phrase in CAPTION_PHRASES:
        if phrase == "xe ô tô khách":
            out = replace(out, "", "vàxe", "và xe")
        end = r"\s*" if phrase.endswith(" ") else r"\b"
        out = replace(out, r"\b", phrase.replace(" ", "") + end, phrase)
    return replace(out, r"\b", r"bu\s*ýt\b", "buýt")


def recover_keywords(x) -> Column:
    """Right forms of the words for articles, clauses and the like, where a number or letter follows as in a heading or citation."""
    out = col(x)
    for pattern, after, right, heading in KEYWORDS:
        before = r"(?m)^([^\S\n]*+)" if heading else r"()\b"
        out = F.regexp_replace(out, rf"(?iuU){before}{pattern}(?={after})", f"$1{right}")
    return out


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(x) -> Column:
    """Letters with their accents as one character each."""
    marked = col(x).rlike(r"\p{M}")
    return F.when(marked, _composed(F.when(marked, col(x)))).otherwise(col(x))


def normalize(x) -> Column:
    """The whole cleaner: accents, control characters, split words, captions, keywords, then noise, punctuation and white space."""
    out = F.regexp_replace(F.regexp_replace(composed(F.coalesce(col(x), F.lit(""))), r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]+", " ")
    return text.clean_text(recover_keywords(space_captions(join_split_words(out))))


def processed(rows: DataFrame, column: str) -> DataFrame:
    """rows with normalized (the clean text), and a hash of each: raw_sha256, normalized_sha256."""
    out = rows.withColumn("normalized", normalize(column))
    return out.withColumns({"raw_sha256": F.sha2(F.coalesce(F.col(column), F.lit("")), 256), "normalized_sha256": F.sha2("normalized", 256)})


def has_placeholder(x) -> Column:
    """Whether a value holds a placeholder; a null one doesn't."""
    return F.coalesce(text.contains_any(F.lower(F.trim(col(x).cast("string"))), PLACEHOLDERS), F.lit(False))


def is_garbage(x) -> Column:
    """Null, blank, or with a placeholder."""
    return F.coalesce(F.trim(col(x).cast("string")) == "", F.lit(True)) | has_placeholder(x)


def clean_value(x, fallback) -> Column:
    """The value trimmed, or what stands in for it where it is garbage."""
    return F.when(is_garbage(x), F.trim(F.coalesce(col(fallback), F.lit("")))).otherwise(F.trim(col(x)))


def garbage_fields(*columns: str) -> Column:
    """The names of the columns that hold a placeholder."""
    return F.array_compact(F.array(*[F.when(has_placeholder(c), F.lit(c)) for c in columns]))


def optional_int(x) -> Column:
    """The one number of a text, with thousands grouped or not; null of placeholders, of none and of several."""
    value = F.trim(col(x).cast("string"))
    found = F.regexp_extract_all(value, F.lit(r"(\d+(?:[.,]\d{3})*)"), 1)
    return F.when(~F.lower(value).isin(*NO_NUMBER) & (F.size(found) == 1), F.regexp_replace(found[0], "[.,]", "").cast("long"))


def json_object(x) -> Column:
    """The text of the JSON object in an answer, also within a fence or prose: what parses from the first brace to the last; null without one."""
    bare = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"```(?:json)?", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda t: F.json_object_keys(t).isNotNull()
    return F.when(valid(bare), bare).when(valid(inner), inner)


def vision_codes(x) -> Column:
    """Sign codes of a vision model's answer: its candidates and alternatives, or, if it isn't JSON, codes in the text; at most six."""
    body = json_object(x)
    parsed = F.from_json(body, "struct<candidate_codes:array<string>,alternatives:array<string>>")
    none = F.array().cast("array<string>")
    named = lambda c: F.coalesce(F.get_json_object(c, "$.code"), F.get_json_object(c, "$.sign_code"), F.get_json_object(c, "$.id"), c)
    listed = F.transform(F.concat(F.coalesce(parsed["candidate_codes"], none), F.coalesce(parsed["alternatives"], none)), lambda c: text.normalize_sign_code(F.when(c.startswith("{"), named(c)).otherwise(c)))
    loose = F.transform(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"(?i)(\b(?:P|W|R|I|S|IE)\.?\d{2,3}[a-zđ]?\b)"), 1), text.normalize_sign_code)
    return F.slice(F.filter(F.array_distinct(F.when(body.isNotNull(), listed).otherwise(loose)), lambda c: c != ""), 1, 6)


def trusted_codes(codes, confidence, known) -> Column:
    """Codes of a vision answer that the catalogue (an array) knows: the first four at a confidence of 0.58, a single one at 0.45."""
    own = F.filter(col(codes), lambda c: F.array_contains(col(known), c))
    sure = F.coalesce(col(confidence).cast("double"), F.lit(0.0))
    return F.when(sure >= 0.58, F.slice(own, 1, 4)).when((F.size(own) == 1) & (sure >= 0.45), own).otherwise(F.array().cast("array<string>"))


def without_nul(x) -> Column:
    return F.replace(col(x), F.lit("\u0000"), F.lit(""))


def one_line(x) -> Column:
    """White space collapsed, and no space, semicolon or full stop at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), r"\s+", " "), r"^[ ;.]+|[ ;.]+$", "")


def table_cell(x) -> Column:
    """A value as a cell of a table in Markdown."""
    return F.replace(one_line(x), F.lit("|"), F.lit("\\|"))


def clean_snippet(x) -> Column:
    """One line without the gazette's header and without marks at the ends."""
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ #;-]+|[ #;-]+$", "")
    return trim(F.regexp_replace(trim(F.coalesce(col(x), F.lit(""))), r"(?iu)CÔNG BÁO/Số\s+\d+\s*\+\s*\d+/Ngày\s+\d+-\d+-\d{4}", ""))


def trimmed(x, limit: int) -> Column:
    """A clean snippet of at most so many characters, with an ellipsis if it was cut."""
    body = clean_snippet(x)
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.regexp_replace(F.substring(body, 1, max(0, limit - 1)), r"[ ,;]+$", ""), F.lit("…")))


def usable_snippet(x) -> Column:
    """Of 24 characters at least, without a replacement character, and no notice that nothing was found."""
    body = F.coalesce(col(x), F.lit(""))
    return (F.length(F.trim(body)) >= 24) & ~F.contains(body, F.lit("�")) & ~text.contains_any(text.fold(body), ("khong tim thay", "placeholder"))


def usable_penalty(x) -> Column:
    """A penalty's text that names a number and isn't vague."""
    body = F.coalesce(col(x), F.lit(""))
    return body.rlike(r"\d") & ~text.contains_any(text.fold(body), ("chua xac dinh", "theo quy dinh", "phu thuoc", "van ban hien hanh"))


def format_vnd(x) -> Column:
    """An amount with its thousands grouped by dots, and its unit; a question mark of none."""
    return F.when(col(x).isNull(), "?").otherwise(F.concat(F.translate(F.format_number(col(x).cast("long"), 0), ",", "."), F.lit(" đồng")))


def rough_tokens(x) -> Column:
    """The greater of a text's words and a quarter of its characters."""
    body = F.coalesce(col(x), F.lit(""))
    return F.greatest(F.size(F.regexp_extract_all(body, F.lit(r"(\S+)"), 1)), F.floor(F.length(body) / 4).cast("int"))


def safe_id(x) -> Column:
    """A value with the characters that ids may have, others as underscores."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[^0-9A-Za-zÀ-ỹ_:.|-]+", "_"), "^_+|_+$", "")


def field(x, label: str) -> Column:
    """What stands after "label:" on its line."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in label)
    return F.trim(F.regexp_extract(F.coalesce(col(x), F.lit("")), rf"(?iu){quoted}\s*:\s*(.+?)(?:\n|$)", 1))


def asset_path(x) -> Column:
    """A file's path as the address at which it is served; a path of that kind stays as it is."""
    path = F.replace(F.trim(F.coalesce(col(x), F.lit(""))), F.lit("\\"), F.lit("/"))
    served = lambda c: F.concat(F.lit("/processed/"), F.regexp_replace(c, "^/+", ""))
    marker = "data/processed/"
    return (
        F.when((path == "") | path.rlike("^https?://") | path.startswith("/processed/"), path)
        .when(path.startswith("processed/"), F.concat(F.lit("/"), path))
        .when(F.contains(path, F.lit(marker)), served(F.substring(path, F.instr(path, marker) + len(marker), F.length(path))))
        .when(path.startswith("/"), path)
        .otherwise(served(path))
    )


def is_penalty_chunk(x) -> Column:
    return text.contains_any(F.lower(F.coalesce(col(x), F.lit(""))), ("phạt", "xử phạt", "tiền", "tước", "trừ điểm", "đối với", "hành vi"))


def valid_rule(reference, *bodies) -> Column:
    """A rule with a reference and a text."""
    return col(reference).isNotNull() & (text.first_text(*bodies) != "")


def preprocess_reason(query, history, chars: int = 3200, words: int = 550, tokens: int = 1400) -> Column:
    """Why a question is condensed before it is planned: history_and_long_query, history_context, long_query, large_input, or no reason."""
    q, h = F.coalesce(col(query), F.lit("")), F.coalesce(col(history), F.lit(""))
    long_ = (F.length(q) >= chars) | (F.size(F.regexp_extract_all(q, F.lit(r"(\S+)"), 1)) >= words)
    large = rough_tokens(F.concat_ws("\n", h, q)) >= tokens
    return F.when((h != "") & long_, "history_and_long_query").when(h != "", "history_context").when(long_, "long_query").when(large, "large_input").otherwise("")
