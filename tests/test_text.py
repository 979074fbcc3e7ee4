"""Text, array and reference functions on worked examples, and traps of the semantics."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from codexine.functions import arrays, references, text


@pytest.fixture
def value(spark):
    def get(column, **literals):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]) if literals else spark.range(1)
        return row.select(column.alias("x")).collect()[0]["x"]

    return get


def test_fold_of_every_letter(spark):
    letters = [chr(c) for c in range(0x20, 0x1F00) if unicodedata.category(chr(c))[0] == "L" and len(unicodedata.normalize("NFD", chr(c)).rstrip("".join(map(chr, range(0x300, 0x370))))) == 1 and chr(c).isalpha() and (c < 0x250 or c >= 0x1E00)]

    def want(s):
        bare = "".join(x for x in unicodedata.normalize("NFD", s) if unicodedata.category(x) != "Mn")
        return " ".join(bare.replace("đ", "d").replace("Đ", "d").lower().split())

    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", text.fold("c").alias("f")).collect()
    wrong = [(r["c"], r["f"], want(r["c"])) for r in rows if r["f"] != want(r["c"]) and r["c"] not in "İ"]
    assert not wrong


def test_fold_cases(value):
    assert value(text.fold(F.lit("  Điều \n khiển  XE "))) == "dieu khien xe"
    assert value(text.fold(F.lit(None).cast("string"))) == ""
    assert value(text.tokens(F.lit("Điều 5_a, khoản-2"))) == ["điều", "5_a", "khoản", "2"]


def test_sign_codes(value):
    assert value(text.sign_codes(F.lit("biển P.102, p 102 và IE.454 hoặc W.225a"))) == ["P102", "IE454", "W225A"]
    for code, group in (("P.102", "prohibition"), ("IE454", "guide"), ("DP.135", "highway"), ("S501", "supplementary"), ("Z1", "unknown"), ("", "unknown")):
        assert value(text.sign_group(F.lit(code))) == group


def test_money(value):
    said = "từ 4.000.000 đồng đến 6,5 triệu đồng, 200 000 đồng, 5 trieu, 300.000 triệu và 7 km"
    assert value(text.money_values(F.lit(said))) == [4000000, 6500000, 5000000, 300000]


def test_references(value):
    found = value(text.explicit_refs(F.lit("theo điểm đ khoản 3 Điều 6a và điều 9")))
    assert [tuple(r) for r in found] == [("6A", "3", "đ"), ("9", "", "")]
    assert tuple(value(text.chunk_ref(F.lit("nghi_dinh_168_6_0_a_ab12")))) == ("nghi dinh 168", "6", "", "a")
    assert value(text.chunk_ref(F.lit("x_y"))) is None
    assert value(text.ref_key(F.lit("D"), F.lit("6"), F.lit(""), F.lit("a"))) == "D|D6|Pa"
    none = F.lit(None).cast("string")
    assert value(text.format_reference(F.lit("a"), F.lit("3"), F.lit("6"), none, none, none)) == "Điểm a, Khoản 3, Điều 6, Văn bản pháp luật"


def test_reference_matching(value):
    part = lambda a, b: value(references.part_matches(F.lit(a), F.lit(b)))
    assert part("Điều 6", "6") and part("6, 7 và 8", "8") and part("x", "") and not part("", "6") and not part("16", "6")
    clause = lambda *x: value(references.clause_matches(*map(F.lit, x)))
    assert clause("4", "1", "4", "4.1") and clause("4.1", "", "4", "4.1") and not clause("4", "2", "4", "4.1") and clause("4", "2", "4", "")
    ref = lambda **k: F.struct(*[F.lit(k.get(n, "")).alias(n) for n in ("document", "article", "clause", "point")])
    assert value(references.reference_matches(ref(document="Nghị định 168/2024", article="6", clause="3"), ref(document="nghi dinh 168", article="Điều 6")))
    assert not value(references.reference_matches(ref(document="Luật 36", article="6"), ref(document="nghi dinh 168", article="6")))
    assert value(references.in_answer(F.lit("Theo điểm a khoản 3 Điều 6 thì phạt"), ref(article="6", clause="3", point="a")))


def test_clean_text(value):
    raw = "Điều 1\x05khoản 2 ,có\r\n12\nwww.example.com\nTrang 3/10\n\n\n\nĐiểm a.Nội dung  dài"
    assert value(text.clean_text(F.lit(raw))) == "Điều 1 khoản 2, có\n\nĐiểm a. Nội dung dài"


def test_pieces_and_quotes(value):
    long = " ".join(f"w{k}" for k in range(130))
    assert [len(p.split()) for p in value(text.sentence_pieces(F.lit(f"Một. Hai;\n- ba\n{long}")))] == [1, 1, 1, 60, 60, 10]
    assert value(text.canonical_quote(F.lit("“A”  ‘b’ – c"))) == "\"a\" 'b' - c"
    assert value(text.answer_numbers(F.lit("1.000.000 và 3,5 và 007"))) == ["1.000.000", "1000000", "3.5", "007", "7"]


def test_metrics(value):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert value(arrays.token_f1(a("x", "x", "y"), a("x", "y", "y"))) == pytest.approx(2 / 3)
    assert value(arrays.token_f1(a(), a())) == 1 and value(arrays.token_f1(a(), a("x"))) == 0
    assert value(arrays.token_recall(a("x"), a())) == 1 and value(arrays.jaccard(a(), a())) == 1
    assert value(arrays.hit_at(a("p", "q"), a("q"), 1)) == 0 and value(arrays.hit_at(a("p"), a(), 1)) == 1
    assert value(arrays.reciprocal_rank(a("p", "q"), a("q"))) == 0.5 and value(arrays.reciprocal_rank(a("p"), a("z"))) == 0 and value(arrays.reciprocal_rank(a(), a())) == 1


def test_nearest_rank_rounds_halves_to_even(value):
    values = F.array(*map(F.lit, (50, 10, 20, 40, 30, 60)))
    assert value(arrays.nearest_rank(values, 0.5)) == 30  # index 2.5 becomes 2
    assert value(arrays.nearest_rank(values, 0.95)) == 60 and value(arrays.nearest_rank(F.array().cast("array<int>"), 0.5)) is None


def test_tables(value):
    rows = F.expr("array(array('a', ' b '), array('c'), array('', null))")
    assert value(arrays.pad_rows(rows)) == [["a", "b"], ["c", ""]]
    assert value(arrays.row_text(F.array(F.lit("h"), F.lit("")), F.array(F.lit("x"), F.lit("y")))) == "h: x | y"
    assert value(arrays.table_issues(rows)) == ["RAGGED_ROWS"] and value(arrays.table_issues(F.expr("array(array('a'))"))) == ["TOO_FEW_ROWS"]
