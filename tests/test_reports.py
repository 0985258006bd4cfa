"""Reports, cached results and typed values on worked examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclathe.functions import text as tx
from doclathe.operators import reports


def test_values_are_typed_or_null(spark):
    rows = spark.createDataFrame([(" 5/3/2024 ", "1.540.000"), ("", "none"), (None, None)], "d string, a string")
    got = rows.select(tx.date_value(F.col("d")).alias("d"), tx.amount_value(F.col("a"), "text").alias("a")).collect()
    assert (got[0].d.value, got[0].d.raw_value) == ("2024-03-05", "5/3/2024")
    assert (got[0].a.value, got[0].a.source) == (1540000.0, "text")
    assert [r.d for r in got[1:]] == [None, None] and [r.a for r in got[1:]] == [None, None]


def test_the_latest_result_of_a_user_is_reused_under_the_new_name(spark):
    docs = spark.createDataFrame(
        [(1, "u", "h", "completed", "hop_dong", '{"k": 1, "category": "x"}'), (2, "u", "h", "completed", "", '{"k": 2}'), (3, "u", "h", "failed", "hoa_don", '{"k": 3}'),
         (4, "v", "h", "completed", "hoa_don", "{bad"), (5, "u", None, "completed", "hoa_don", '{"k": 5}')],
        "id long, user_id string, file_hash string, status string, category string, ocr_data_json string",
    )
    new = spark.createDataFrame([(7, "u", "h", "/a", "a.txt"), (8, "v", "h", "/b", "b.txt"), (9, "u", None, "/c", "c.txt")], "seq long, user_id string, file_hash string, file_path string, file_name string")
    (got,) = reports.reuse_cached(new, docs, "k long, category string").collect()
    assert (got.seq, got.cached_id) == (7, 2)
    assert got.result.asDict() == {"k": 2, "category": "khac", "file_hash": "h", "file_path": "/a", "original_filename": "a.txt"}
    assert reports.reuse_cached(new.limit(0), docs, "k long").count() == 0
    typed = reports.reuse_cached(new, docs).first().result
    assert (typed.original_filename, typed.category, typed.tables, typed.full_text) == ("a.txt", "khac", None, None)


def test_evaluations_without_lines_or_truth(spark):
    truths = spark.createDataFrame([(1, "abcd", "abcx"), (2, "", "abc"), (3, "ab cd", "ab cd")], "item_id long, truth string, predicted string")
    lines = spark.createDataFrame([(1, 0.9), (1, 0.5), (2, 0.95), (9, 0.1)], "item_id long, prob double")
    metrics = reports.evaluation(truths, lines)
    got = {r.item_id: r for r in metrics.collect()}
    assert (got[1].avg_confidence, got[1].high_confidence_ratio, got[1].cer_percent, got[1].char_accuracy, got[1].word_accuracy) == (70.0, 50.0, 25.0, 75.0, 0.0)
    assert got[2].char_accuracy is None and got[2].avg_confidence == 95.0
    assert got[3].avg_confidence is None and got[3].word_accuracy == 100.0
    said = {r.item_id: r.report for r in reports.evaluation_report(metrics).collect()}
    assert "TRUNG BÌNH" in said[1] and "Character Accuracy):  75.0%" in said[1]
    assert "XUẤT SẮC" in said[2] and "GROUND TRUTH" not in said[2]
    assert "Model Confidence" not in said[3] and said[3].endswith("(WER):                        0.0%\n" + "=" * 60)


def test_text_reports_without_tables_and_with_an_evaluation(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "hop_dong", "pdf", None, "body"), (2, "b", "other", "image", "ocr", None)], "id long, name string, category string, source_type string, method string, text string")
    shown = spark.createDataFrame([(1, "SUMMARY")], "id long, report string")
    tables = spark.createDataFrame([(2, 3, "| b |"), (2, 1, "| a |")], "id long, page int, markdown string")
    judged = spark.createDataFrame([(2, "GOOD")], "id long, report string")
    got = {r.id: r.report for r in reports.text_report(docs, shown, tables, judged).collect()}
    assert got[1] == "=== KẾT QUẢ TRÍCH XUẤT TÀI LIỆU: a.pdf ===\nDanh mục: hop_dong\nLoại tài liệu (Document Type): contract\nĐịnh dạng nguồn (Source Type): pdf\nPhương pháp trích xuất: None\n\nSUMMARY\n\n--- NỘI DUNG VĂN BẢN ĐỌC ĐƯỢC ---\nbody\n\n"
    assert "(Document Type): unknown" in got[2]
    assert got[2].endswith("--- CẤU TRÚC BẢNG TRÍCH XUẤT ---\n\n[Bảng 1 - Trang 1]\n| a |\n\n[Bảng 2 - Trang 3]\n| b |\n\nGOOD\n")
