"""Extracted fields against what the texts were made of, not against the patterns again."""

from __future__ import annotations

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from doclathe.operators import extract
from doclathe.plans import fixtures as fx

#: Expressions over orders and customers, by field. A voucher's long date is read only if it
#: has the word "date", and its month is taken for a term: so say the rules.
WHOLE, ISO = "CAST(total AS double)", "concat_ws('-', yy, mm, dd)"
MADE = {
    "invoice": {
        "so_hoa_don": "CAST(o_orderkey AS string)", "ky_hieu": "CASE WHEN o_orderkey % 2 = 0 THEN 'AA/23E' ELSE 'BB/24T' END", "mau_so": "CAST(NULL AS string)",
        "ban_ten": "concat('Công ty ', c_nationkey)", "ban_mst": "lpad(o_orderkey, 10, '1')", "ban_dia_chi": "concat('Số nhà ', o_custkey)", "ban_so_tai_khoan": "lpad(o_custkey, 12, '9')",
        "mua_mst": "concat(lpad(o_custkey, 10, '2'), '-001')", "tien_chua_thue": WHOLE, "thue_suat": "10", "tien_thue_gtgt": "CAST(o_custkey AS double)", "tong_tien_thanh_toan": WHOLE, "so_tien_bang_chu": "'một trăm đồng'",
    },
    "contract": {
        "so_hop_dong": "CASE WHEN o_orderkey % 2 = 0 THEN concat('HD-', o_orderkey) ELSE concat(lpad(o_orderkey, 6, '1'), '/', yy, '-AB') END", "ngay_ky": ISO, "a_ten_to_chuc": "c_name", "a_dai_dien": "'Ông Nam'",
        "b_ten_to_chuc": "concat('Nhà cung cấp ', c_nationkey)", "a_mst": "lpad(o_custkey, 10, '3')", "b_mst": "lpad(o_orderkey, 10, '4')", "b_so_tai_khoan": "lpad(o_custkey, 9, '7')", "b_ngan_hang": "'ACB'", "tong_tien": WHOLE, "hinh_thuc_thanh_toan": "'Chuyển khoản ngân hàng'",
    },
    "voucher": {
        "loai_chung_tu": "element_at(array('bien_ban_ban_giao_nghiem_thu', 'phieu_xuat_kho', 'bien_ban_thanh_ly', 'phieu_thu', 'chung_tu_khac'), CAST(o_orderkey % 5 + 1 AS int))", "so_chung_tu": "concat('PX-', o_orderkey)", "ngay_lap": f"CASE WHEN o_orderkey % 2 = 1 THEN {ISO} END",
        "can_cu": "concat('Căn cứ theo lệnh ', o_custkey)", "dia_diem": "concat('Kho ', c_nationkey)", "giao_ten_don_vi": "c_name", "nhan_ten_don_vi": "concat('Chi nhánh ', c_nationkey)", "thoi_han_bao_hanh": "CASE WHEN o_orderkey % 2 = 0 THEN concat(dd, ' tháng') ELSE '12 tháng' END", "ket_luan": "'đạt'", "tong_gia_tri": WHOLE,
    },
    "transfer": {
        "so_tien": WHOLE, "ma_giao_dich": "concat('FT', lpad(o_orderkey, 8, '0'))", "trang_thai": "element_at(array('thanh_cong', 'that_bai', 'dang_xu_ly'), CAST(o_orderkey % 3 + 1 AS int))",
        "thoi_gian_giao_dich": f"CASE WHEN o_orderkey % 2 = 0 THEN concat({ISO}, ' 10:15:30') ELSE {ISO} END", "so_tai_khoan": "lpad(o_custkey, 10, '5')", "ngan_hang": "CASE WHEN o_orderkey % 5 = 0 THEN 'ACB' ELSE 'Techcombank' END", "noi_dung": "concat('thanh toan ', o_orderkey)",
        "ho_ten": "CASE WHEN o_orderkey % 4 = 0 THEN 'NGUYEN VAN AN' ELSE c_name END",
    },
}
TEXTS = {"invoice": fx.invoice_texts, "contract": fx.contract_texts, "voucher": fx.voucher_texts, "transfer": fx.transfer_texts}


@pytest.mark.parametrize("kind", sorted(MADE))
def test_fields_are_what_the_texts_were_made_of(spark, kind):
    got = {r.id: r for r in getattr(extract, kind)(fx.rows(spark, SF, TEXTS[kind])).collect()}
    want = fx.spark_view(spark, SF, f"SELECT o_orderkey AS id, {', '.join(f'{e} AS {n}' for n, e in MADE[kind].items())} FROM ({fx._ORDER}) o").collect()
    assert len(got) == len(want) > 1000
    wrong = [(r.id, n, got[r.id][n], r[n]) for r in want for n in MADE[kind] if got[r.id][n] != r[n]]
    by_field = {n: sum(w[1] == n for w in wrong) for n in MADE[kind]}
    assert not wrong, (by_field, wrong[:5])


def test_patterns_begin_with_a_look_at_one_character(spark):
    from pyspark.sql import functions as F

    from doclathe.functions import text as tx
    from doclathe.operators import extract as ex

    labels = [p for d in (ex.INVOICE, ex.CONTRACT, ex.VOUCHER) for f in d.values() for p in f.patterns if not p.startswith((r"(\d", "(["))]
    assert all(ex.begun(p).startswith("(?=(?-iU:[") and ex.begun(p).endswith(p) for p in labels)
    assert ex.begun(r"(\d{4})-x") == r"(\d{4})-x" and ex.begun("(?:tài|stk)?x") == "(?:tài|stk)?x" and ex.begun("a?b") == "a?b"
    df = spark.createDataFrame([(t,) for t in ("ſố 5", "x SỐ: 6", "Kho 7", "kHO\n8", "số", "đại 9", "Đại 1", "")], "t string")
    p = r"(?:Số|Kho|ĐẠI)\s*[:\-]?\s*(\d+)"
    found = df.select(F.regexp_extract("t", tx.java(p), 1).alias("a"), F.regexp_extract("t", tx.java(ex.begun(p)), 1).alias("b")).collect()
    assert [r.b for r in found] == [r.a for r in found] == ["5", "6", "7", "8", "", "9", "1", ""]


def test_large_tables_are_dealt_to_tasks_by_their_size(spark):
    from conftest import SF

    from doclathe.plans import fixtures as fx

    table = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert fx.spread(table, "l_orderkey", 1 << 14).rdd.getNumPartitions() > 4
    plan = fx.spark_view(spark, SF, "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_lines_of_marks_count_in_the_header(spark):
    from doclathe.operators import classify

    lines = ["́"] * 19 + ["HỢP ĐỒNG", "HOÁ ĐƠN", "MÃ SỐ THUẾ"]
    rows = [(1, "/a/b", "\n".join(lines)), (2, "/a/b", "\n \n".join(["x"] * 19 + lines[19:])), (3, "/a/b", " \n "), (4, None, None), (5, "/a/b", "́ hợp đồng")]
    got = {r.id: (r.hop_dong, r.hoa_don) for r in classify.scores(spark.createDataFrame(rows, "id int, file_path string, extracted_text string")).collect()}
    assert got[1] == got[2] == (40, 20) and got[3] == (0, 0) and got[5][0] == 40


def test_points_are_the_sums_of_the_rules(spark):
    from doclathe.operators import classify as cl

    rng = random.Random(5)
    words = [*cl.CONTRACT_WORDS, *cl.INVOICE_WORDS, *cl.VOUCHER_WORDS, *cl.TRANSFER_WORDS, "VỀ HÓA ĐƠN", "HÓA VỀ HÓA ĐƠN ĐƠN", "Điều 3", "á", "  ", "", "khác"]
    docs = [(i, "/in/" + rng.choice(("hd_1.pdf", "vcb.png", "a.xlsx", "x")), "\n".join(rng.choice(words).lower() for _ in range(rng.choice((0, 3, 30, 60))))) for i in range(200)]
    df = cl.scores(spark.createDataFrame(docs, "id int, file_path string, extracted_text string"))
    sums = df.select(*cl.CATEGORIES, *[F.expr(cl._sum(cl.RULES[c])).alias(f"_{c}") for c in cl.CATEGORIES]).collect()
    assert all(r[c] == r[f"_{c}"] for r in sums for c in cl.CATEGORIES) and len({tuple(r) for r in sums}) > 50
    # a word that a text doesn't have is looked for once
    assert all(cl._points(c).count(f"WHEN contains(full_text, '{w}') THEN CASE") == 1 for c, ws in (("hop_dong", cl.CONTRACT_WORDS), ("chung_tu", cl.VOUCHER_WORDS)) for w in ws)


def test_patterns_meet_texts_from_their_first_word_on(spark):
    from pyspark.sql import functions as F

    from doclathe.functions import text as tx
    from doclathe.operators import extract as ex

    assert ex.words_of(r"(?:Địa chỉ \(Address\)|Địa chỉ)x") == ["địa chỉ"] and ex.words_of(r"(?:No\.|Số|Số HĐ)x") == ["no.", "số"] and ex.words_of(r"Ngày\s*x") == ["ngày"]
    assert ex.words_of(r"(\d{4})-x") == ex.words_of("(?:tài|stk)?x") == ex.words_of("a?b") == ex.words_of("Kho|x") == ex.words_of("(?:a.|b)c") == []
    texts = ["", None, "không có gì", "Mã ſố thuế: 0123456789\nMST: 9876543210-001", "İ Mã số thuế 0123456789 MST 9876543210", "SỐ: 12 số 13", "No 1 NO. 7", "NGÀY 3 tháng 4 năm 2024", "x" * 3000 + "Kho xuất: b\ntại c", "K hàng; Iſſued: ab", "BÊN GIAO (BÊN A): x\nBÊN GIAO: y", "Bên A (Bên mua): x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for fields in (ex.INVOICE, ex.CONTRACT, ex.VOUCHER, ex.TRANSFER, *ex.ENTITIES.values()):
        # each pattern on the whole text
        whole = [ex._raw(F.col("text"), f, p).alias(f"{n}_{i}") for n, f in fields.items() for i, p in enumerate(f.patterns)]
        plain = df.select("id", *whole).orderBy("id").collect()
        got = ex.extract(df, {f"{n}_{i}": ex.Field((p,), "text", f.nth, f.group, f.case) for n, f in fields.items() for i, p in enumerate(f.patterns)}).drop("text").orderBy("id").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in plain]


def test_overviews_make_only_what_they_read(spark):
    from conftest import SF

    from doclathe.operators import overview as ov

    plan = lambda q: ov.QUERIES[q](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # patterns of fields that no summary has, and the items' rows
    assert "Mẫu số" not in plan("overview_invoice") and "_rows" not in plan("overview_invoice")
    assert "Kèm theo" not in plan("overview_report_voucher") and "Mã số doanh nghiệp" in plan("overview_contract")
    assert "_rows" in plan("overview_report_invoice") and "Mẫu số" not in plan("overview_report_invoice")
