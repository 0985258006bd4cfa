"""Worked examples and properties of the text functions."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from doclathe.functions import text as tx
from doclathe.operators.text_queries import token_distance


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {"1.540.000 VNĐ": 1540000, "254.000": 254000, "1.540.000,00": 1540000, "12,345.67": 12.34567, "1,5": 1.5, "0,08": 0.08, "1.2.3": None, "-500": 500, ".": None, "1.": 1, "1,234,567": 1234567, "abc": None, "12.5": 12.5, None: None}
    assert values(spark, tx.clean_amount, cases) == list(cases.values())


def test_dates(spark):
    cases = {"5/3/2024": "2024-03-05", "x 2023.1.9 y": "2023-01-09", "Ngày 7 tháng 11 năm 2020": "2020-11-07", "99/99/2024": "2024-99-99", "không": "không", None: None}
    assert values(spark, tx.clean_date, cases) == list(cases.values())


def test_values_with_their_sources(spark):
    df = spark.createDataFrame([(1, " 5/3/2024 ", "1.540.000 VNĐ"), (2, "", "x"), (3, None, None)], "i int, d string, a string")
    got = [tuple(r) for r in df.orderBy("i").select(tx.date_value(F.col("d")), tx.amount_value(F.col("a"))).collect()]
    assert got == [(("2024-03-05", "5/3/2024"), (1540000.0, "ocr")), (None, None), (None, None)]


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (12.125,), (99.96,)], "x double")
    assert [r.v for r in df.select(tx.format_line(F.lit(7), F.col("x"), F.lit("t")).alias("v")).collect()] == ["[007 - 0.2%] t", "[007 - 0.8%] t", "[007 - 12.1%] t", "[007 - 100.0%] t"]


def test_two_number_rules_differ(spark):
    assert values(spark, tx.parse_number, ["12,345.67", "(1)\n3\n10%\n7,000", "a=5", ""]) == [12345.67, 7000.0, None, None]


def test_accents_match_unicode_data(spark):
    def plain(x):
        x = "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
        return unicodedata.normalize("NFC", x).replace("Đ", "D").replace("đ", "d")

    words = ["HÓA ĐƠN GIÁ TRỊ GIA TĂNG", "Tiền thuế", "straße çñ", "ế", "", "Đường"]
    assert values(spark, tx.remove_accents, words) == [plain(w) for w in words]


def test_lines_and_types(spark):
    assert values(spark, tx.normalize_text, ["|priority\r\n  a \t b\n\n...\x01c", None]) == ["a b\n...c", ""]
    assert values(spark, tx.line_type, ["ĐIỀU 1: x", "II. Phạm vi", "1. Ăn", "- x", "1.2 y", "a) z", "CỘNG HÒA", "Chữ thường."]) == ["heading", "heading", "heading", "list", "list", "list", "heading", "paragraph"]


def test_ignore_case_knows_vietnamese(spark):
    df = spark.createDataFrame([("SỐ TIỀN: 5",)], "x string")
    assert df.select(F.regexp_extract("x", tx.java(r"số tiền:\s*(\d+)"), 1)).first()[0] == "5"


@pytest.mark.parametrize(("a", "b", "d"), [("a b c", "a c", 1), ("", "a b", 2), ("a", "", 1), ("", "", 0), ("x y z", "z y x", 2)])
def test_token_distance(spark, a, b, d):
    df = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>")
    assert df.select(token_distance(F.col("a"), F.col("b"))).first()[0] == d


def test_numbers_of_a_cell_by_its_lines(spark):
    cells = ["12", "007", "5", "001", "0005", "12\r", "1\n2", "40\n50", "(1)", "1,000", "1.5\n7", "abc", "", None, "٣", "NaN", "-3", "- . ,", "9=9", "10%", "6 ", "123456789012345678901", "1e5"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    plain = F.filter(F.transform(tx.lines(F.col("c")), tx.parse_number), lambda v: v.isNotNull())
    rows = df.select("c", tx.numbers(F.col("c")).alias("a"), plain.alias("b")).collect()
    assert [(r.c, r.a) for r in rows] == [(r.c, r.b) for r in rows]


def test_pairs_keep_line_numbers_and_leave_clock_times(spark):
    df = spark.createDataFrame([("no pair\nSố: 12\n10:15\n\n Tên hàng - Bàn: gỗ \nx=y\nab=c=d\n10:15:30",), ("",), (None,)], "t string")
    got = [r.p and [(p.line_index, p.key, p.value, p.raw_line) for p in r.p] for r in df.select(tx.key_values(F.col("t")).alias("p")).collect()]
    assert got[0] == [(2, "Số", "12", "Số: 12"), (4, "Tên hàng", "Bàn: gỗ", "Tên hàng - Bàn: gỗ"), (6, "ab", "c=d", "ab=c=d"), (7, "10", "15:30", "10:15:30")] and got[1] == [] and got[2] is None
