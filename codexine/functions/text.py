"""Text functions as columns: folding, tokens, references, amounts, codes and cleaning. All run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STOPWORDS = (
    "nhung gi nao bao nhieu duoc quy dinh la cua trong doi voi nguoi ca nhan to chuc mot cac the khong co ve tai khi neu thi nay theo"
).split()
SIGN_GROUPS = (("P", "prohibition"), ("W", "warning"), ("R", "mandatory"), ("I", "guide"), ("S", "supplementary"), ("DP", "highway"), ("IE", "highway"))
SIGN_CODE = r"(?i)\b(?:DP|IE|P|W|R|I|S|E)\s*\.?\s*\d{2,3}[a-zđ]?\b"
MONEY_UNITS = r"triệu\s*đồng|triệu|trieu\s*dong|trieu|đồng|dong"
PROCEDURE_TERMS = ("thủ tục", "hồ sơ", "trình tự", "cấp giấy phép", "đăng ký", "kiểm định")
PENALTY_TERMS = ("phạt", "xử phạt", "tiền", "tước", "trừ điểm", "đối với", "hành vi")
TOKEN = r"[\p{L}\p{N}_]+"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value computed once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(x) -> Column:
    return F.nullif(F.trim(col(x)), F.lit(""))


def first_text(*columns) -> Column:
    """The first of the columns that is neither null nor blank, or the empty text."""
    return F.coalesce(*[F.when(F.trim(col(c)) != "", col(c)) for c in columns], F.lit(""))


@lru_cache(1)
def accents() -> tuple[str, str]:
    """Letters that decompose into one base character and marks, in both cases, and their base in lower case."""
    plain = {"đ": "d", "Đ": "d"}
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
        if len(base) == 1 and base != c.lower():
            plain[c] = base
    return "".join(plain), "".join(plain.values())


def fold(x) -> Column:
    """Lower case without diacritics, white space collapsed and trimmed; null becomes the empty text."""
    a, b = accents()
    marks = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(F.translate(marks, a, b), r"(?U)\s+", " "))


def tokens(x) -> Column:
    """Words of letters, numbers and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(f"({TOKEN})"), 1)


def content_tokens(x, least: int = 3, digits: bool = False, stop=STOPWORDS) -> Column:
    """Distinct folded words of at least so many letters that aren't stopwords; with digits, also short ones that hold a digit."""
    words = F.regexp_extract_all(fold(x), F.lit("([a-z0-9]+)"), 1)
    stop = F.array(*map(F.lit, stop))

    def keep(w):
        long = F.length(w) >= least
        return (long | w.rlike(r"\d") if digits else long) & ~F.array_contains(stop, w)

    return F.array_distinct(F.filter(words, keep))


def ngrams(words, size: int, joiner: str = " ") -> Column:
    """All runs of so many words."""
    words = col(words)
    n = F.size(words) - (size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(size)), joiner))).otherwise(F.array().cast("array<string>"))


def normalize_text(x) -> Column:
    """Lower case, with anything but letters, numbers and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def compact_text(x) -> Column:
    return F.replace(normalize_text(x), F.lit(" "), F.lit(""))


def normalize_sign_code(x) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[\s.]+", ""))


def sign_group(x) -> Column:
    """Group of a sign code by the first prefix that fits; "I" stands before "IE", so codes of IE are guides."""
    code = normalize_sign_code(x)
    out = None
    for prefix, group in SIGN_GROUPS:
        out = F.when(code.startswith(prefix), group) if out is None else out.when(code.startswith(prefix), group)
    return out.otherwise("unknown")


def sign_codes(x) -> Column:
    """Distinct normalised codes in a text."""
    found = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(f"({SIGN_CODE})"), 1)
    return F.array_distinct(F.transform(found, normalize_sign_code))


def money_values(x) -> Column:
    """Amounts in a text: thousands grouped by dots or commas, or decimals, with a unit; millions are multiplied out."""
    text = F.coalesce(col(x), F.lit(""))
    pattern = rf"(?iu)(\d{{1,3}}(?:[.,]\d{{3}})+|\d+(?:[.,]\d+)?)\s*({MONEY_UNITS})"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2))

    def value(p):
        grouped = p["0"].rlike(r"^\d{1,3}([.,]\d{3})+$")
        number = F.when(grouped, F.regexp_replace(p["0"], "[.,]", "")).otherwise(F.replace(p["0"], F.lit(","), F.lit("."))).cast("double")
        millions = fold(p["1"]).startswith("trieu") & (number < 100000)
        return F.round(F.when(millions, number * 1000000).otherwise(number)).cast("long")

    return F.filter(F.transform(pairs, value), lambda v: v > 0)


def explicit_refs(x) -> Column:
    """References "điểm x khoản n điều m" in a text as structs of article (upper case), clause and point."""
    pattern = r"(?iu)(?:điểm\s+([a-zđ])\s+)?(?:khoản\s+(\d+)\s+)?điều\s+(\d+[a-z]?)"
    text = F.coalesce(col(x), F.lit(""))
    parts = [F.regexp_extract_all(text, F.lit(pattern), k) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(*parts), lambda p: F.struct(F.upper(p["2"]).alias("article"), p["1"].alias("clause"), p["0"].alias("point")))


def chunk_ref(x) -> Column:
    """document, article, clause, point of an id of five parts joined by underscores; "0" means none; null if there are fewer parts."""
    parts = r"^(.*)_([^_]*)_([^_]*)_([^_]*)_([^_]*)$"
    part = lambda k: F.regexp_extract(col(x), parts, k)
    none = lambda c: F.when(c == "0", "").otherwise(c)
    ref = F.struct(F.replace(part(1), F.lit("_"), F.lit(" ")).alias("document"), none(part(2)).alias("article"), none(part(3)).alias("clause"), none(part(4)).alias("point"))
    return F.when(col(x).rlike(parts), ref)


def ref_key(document, article=None, clause=None, point=None) -> Column:
    """document|Darticle|Kclause|Ppoint, without the parts that are blank."""
    parts = [blank_to_null(document)] + [F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(p), col(c))) for p, c in (("D", article), ("K", clause), ("P", point)) if c is not None]
    return F.concat_ws("|", *parts)


def format_reference(point, clause, article, section, chapter, document) -> Column:
    named = (("Điểm ", point), ("Khoản ", clause), ("Điều ", article), ("Mục ", section), ("Chương ", chapter))
    parts = [F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(p), col(c))) for p, c in named]
    return F.concat_ws(", ", *parts, first_text(document, F.lit("Văn bản pháp luật")))


def snippet(x, limit: int = 220) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+", " "))
    return F.when(F.length(clean) > limit, F.concat(F.rtrim(F.substring(clean, 1, limit)), F.lit("…"))).otherwise(clean)


def embedding_text(x, limit: int = 1800) -> Column:
    """Head and tail of a long text, three quarters and one quarter of the limit."""
    head = limit * 3 // 4
    text = F.coalesce(col(x), F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.substring(text, -(limit - head), limit - head))).otherwise(text)


def canonical_quote(x) -> Column:
    """Lower case with plain quotation marks and single spaces."""
    text = F.translate(F.lower(F.coalesce(col(x), F.lit(""))), "“”„‟‘’‚‛–—", "\"\"\"\"''''--")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_noise_line(x) -> Column:
    """Page numbers, roman numerals, very short capitals, page labels, addresses of sites and bare date ids."""
    line = F.trim(F.coalesce(col(x), F.lit("")))
    capitals = (F.length(line) <= 5) & line.rlike(r"^[A-ZĐ\s.]+$") & ~line.isin("MỤC", "PHẦN")
    # One pattern for what is looked for in lower case, as each would read the line again.
    other = F.lower(line).rlike(r"^(?:[ivxlcdm]{1,4}|-?\s*\d{1,4}\s*-?|trang\s+\d{1,4}(?:\s*/\s*\d{1,4})?|(?:ngày|ngay)\s*:\s*\d{6,}[\s.]*)$|https?://|www\.")
    return (line != "") & (capitals | other)


def clean_text(x) -> Column:
    """Control characters as spaces, noise lines dropped, spaces put right around punctuation, white space collapsed."""
    text = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", " ")
    text = F.array_join(F.transform(F.filter(F.split(text, "\n", -1), lambda line: ~is_noise_line(line)), lambda line: F.rtrim(line)), "\n")
    # A run of white space is tried from its start only, so that long runs take linear time.
    text = F.regexp_replace(text, r"(?<!\s)\s++([.,:;!?])", "$1")
    text = F.regexp_replace(text, r"([.,:;!?])(?=[^\s\d])", "$1 ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s++|(?<!\s)\s++$", "")


def sentence_pieces(x, most: int = 85, piece: int = 60) -> Column:
    """Sentences and lines; those of more than most words in pieces."""
    raw = F.split(F.coalesce(col(x), F.lit("")), r"(?<=[.!?;:])\s+|\n+", -1)
    clean = F.filter(F.transform(raw, lambda s: F.regexp_replace(s, r"^[\s•-]+|[\s•-]+$", "")), lambda s: s != "")

    def cut(s):
        words = F.split(s, r"\s+", -1)
        parts = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(piece)), lambda k: F.array_join(F.slice(words, k + 1, F.lit(piece)), " "))
        return F.when(F.size(words) <= most, F.array(s)).otherwise(parts)

    return F.flatten(F.transform(clean, cut))


def answer_numbers(x) -> Column:
    """Numbers of an answer in their normal forms: as written with a decimal point, and grouped thousands as one integer."""
    raw = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"(\d+(?:[.,]\d+)*)"), 1)

    def forms(r):
        dotted = F.replace(r, F.lit(","), F.lit("."))
        whole = F.regexp_replace(F.replace(r, F.lit("."), F.lit("")), r"^0+(?=\d)", "")
        return F.when(r.rlike(r"^\d+$") | r.rlike(r"^\d{1,3}(\.\d{3})+$"), F.array(dotted, whole)).otherwise(F.array(dotted))

    return F.array_distinct(F.flatten(F.transform(raw, forms)))


def contains_any(x, terms) -> Column:
    """Whether a text holds one of the terms anywhere, also inside words."""
    out = F.lit(False)
    for t in terms:
        out = out | col(x).contains(t)
    return out


def contains_all(x, terms) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & col(x).contains(t)
    return out


def fingerprint(*columns) -> Column:
    """A stable id of the columns in the form of a UUID."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return F.regexp_replace(F.substring(digest, 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


