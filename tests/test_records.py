"""Typed records, their older names, the envelope, payloads and stored results."""

from __future__ import annotations

import json
import random
import unicodedata

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from doclathe.functions import schemas as sc
from doclathe.functions import text as tx
from doclathe.operators import extract, records, store, tables
from doclathe.operators.text_queries import edit_distance, token_distance
from doclathe.plans import fixtures as fx

TEXT = "HÓA ĐƠN\nKý hiệu: AA/23E\nSố: 12\nNgày 5/3/2024\nĐơn vị bán hàng: Công ty A\nMã số thuế: 0123456789\nTên đơn vị: B\nTổng thanh toán: 1.540.000"
MATRIX = [["STT", "Tên hàng", "ĐVT", "SL", "Giá", "Tiền"], ["1", "Bàn\ngỗ", "Cái", "2", "1.000", "2.000"], ["2", "", "Ghế", "Cái", "3", ""], ["", "Tổng", "x", "y", "1", "2"], ["3", "a", "b"], [None, " "]]
TYPED = f"id long, text string, tables array<{sc.TABLE}>"


def one(spark, text, matrices, kind):
    docs = spark.createDataFrame([(1, text, [(1, None, "x", None, m, None, None, None) for m in matrices] if matrices is not None else None)], TYPED)
    return records.record(docs, kind)


def test_goods_of_an_invoice(spark):
    df = one(spark, TEXT, [MATRIX], "invoice")
    assert df.schema["data"].dataType == spark.createDataFrame([], f"d {sc.RECORDS['invoice']}").schema["d"].dataType
    d = df.first().data
    assert (d.so_hoa_don, d.ngay_hoa_don, d.ben_ban.ten, d.ben_ban.mst, d.ben_mua.ten, d.tai_chinh.tong_tien_thanh_toan, d.ghi_chu) == ("12", "2024-03-05", "Công ty A", "0123456789", "B", 1540000.0, [])
    assert [tuple(i) for i in d.danh_sach_hang_hoa] == [(1, "Bàn gỗ", "Cái", 2.0, 1000.0, 2000.0), (2, "Ghế", "Cái", 3.0, None, None), (3, "x", "y", 1.0, 2.0, None)]


def test_services_and_assets(spark):
    services = one(spark, "HỢP ĐỒNG", [[["STT", "Tên", "Hạn"], ["1", "Mạng", "12 tháng", "5.000"], ["", "Cộng", "a", "b"], ["2", "Web", "1.5"]]], "contract").first().data.dich_vu_chinh
    assert [tuple(s) for s in services] == [(1, "Mạng", "12 tháng", 5000.0), (2, "a", "b", None), (3, "Web", "1.5", 1.5)]
    rows = [["STT", "Tên thiết bị", "x"], ["1", "Máy", "Bộ", "S/N: AB-1 S/N: C2", "3", "Hoạt động tốt lắm"], ["x", "Loa", "12345678901", "12345678902", "Cái", "Hệ"]]
    assets = one(spark, "PHIẾU XUẤT KHO", [rows], "voucher").first().data.danh_muc_tai_san
    assert [tuple(a) for a in assets] == [(1.0, "Máy", ["AB-1", "C2"], "Bộ", 3, "Hoạt động tốt lắm"), (2.0, "Loa", [], "Hệ", None, "12345678902")]


@pytest.mark.parametrize("kind", sorted(sc.RECORDS))
def test_records_without_tables_or_text(spark, kind):
    docs = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    out = records.record(docs, kind)
    assert out.count() == 2 and records.record(docs.limit(0), kind).count() == 0
    older = out.select(records.legacy(F.col("data"), kind).alias("o")).first().o
    assert older is not None
    if kind in sc.CATEGORIES:
        assert records.envelope(docs, kind).count() == 2
    said = json.loads(records.payload(out, kind, processed_at="2024-01-01 00:00:00").first().payload)
    assert said["document_type"] == sc.CATEGORIES.get(kind, "khac") and said["file_metadata"]["processed_at"] == "2024-01-01 00:00:00" and "data" in said


def test_payloads_are_written_by_category(spark, tmp_path):
    rows = records.record(spark.createDataFrame([(1, TEXT)], "id long, text string"), "invoice")
    files = spark.createDataFrame([(1, "a.pdf", "pdf_text", 3)], "id long, file_name string, source_type string, total_pages int")
    records.write_payloads(records.payload(rows, "invoice", files), str(tmp_path / "out"))
    (got,) = spark.read.text(str(tmp_path / "out")).collect()
    assert got.category == "hoa_don"
    said = json.loads(got.value)
    assert said["file_metadata"] == {"file_name": "a.pdf", "category": "hoa_don", "source_type": "pdf_text", "total_pages": 3}
    assert list(said["data"]) == ["so_hoa_don", "ky_hieu", "mau_so", "ngay_hoa_don", "ma_cqt", "ma_tra_cuu", "ben_ban", "ben_mua", "danh_sach_hang_hoa", "tai_chinh", "ghi_chu"]


def test_stored_results_are_typed_or_kept_raw(spark):
    rows = ['{"full_text": "x", "total_pages": 2, "tables": [{"page": 1, "matrix": [["a"]], "more": 1}], "other": {"k": 1}}', '{"total_pages": "many", "full_text": "y"}', "[1]", "{bad", None]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(records.read_result(F.col("x")).alias("s")).collect()]
    assert (got[0].result.full_text, got[0].result.total_pages, got[0].result.tables[0].matrix) == ("x", 2, [["a"]])
    assert got[0].raw.toPython()["other"] == {"k": 1}
    assert (got[1].result.total_pages, got[1].result.full_text, got[1].raw.toPython()["total_pages"]) == (None, "y", "many")
    assert got[2].raw.toPython() == [1] and [(g.result, g.raw) for g in got[3:]] == [(None, None)] * 2


def test_one_scan_and_no_join_in_the_envelope(spark):
    docs = fx.rows(spark, SF, fx.invoice_texts).select("id", "text")
    plan = records.envelope(docs, "invoice")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == docs._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_decomposed_text_is_read_like_composed(spark):
    rows = [(1, TEXT), (2, unicodedata.normalize("NFD", TEXT))]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("text", tx.normalize_text(F.col("text")))
    a, b = extract.invoice(df).orderBy("id").collect()
    assert tuple(a)[1:] == tuple(b)[1:] and a.ban_ten == "Công ty A"


def test_composed_form_equals_the_standard(spark):
    rng = random.Random(9)
    letters = [c for c in map(chr, [*range(0xC0, 0x600), *range(0x1E00, 0x2000)]) if unicodedata.normalize("NFD", c) != c]
    marks = [c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c)]
    texts = [None, "", "plain\n text", "K Å Ω", *letters, *(unicodedata.normalize("NFD", c) for c in letters)]
    texts += ["".join(rng.choice([rng.choice("aâêơưdAEou1 \n"), rng.choice(letters), rng.choice(marks), rng.choice("̛̣́̀̂")]) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    got = [r.y for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(tx.nfc(F.col("x")).alias("y")).collect()]
    assert got == [x and unicodedata.normalize("NFC", x) for x in texts]


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_distances_by_the_plain_table(spark):
    rng = random.Random(4)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(999, None, ["a"])], "i int, a array<string>, b array<string>")
    got = {r.i: r.d for r in df.select("i", token_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: slow_distance(*p) for i, p in enumerate(pairs)} | {999: None}
    assert edit_distance(np.arange(5000), np.arange(5000)[::-1].copy()) > 4000


def test_sums_of_long_rows(spark):
    numbers = [str(10 + 7 * i) for i in range(10_000)]
    rows = [(1, [["h"], [*numbers, "139950"]]), (2, [["h"], [*numbers, "500000"]]), (3, [["h"], ["8", "12", "20"]]), (4, [["h"], ["9", "9", "18.5"]]), (5, [["h"], ["9", "30", "60"]])]
    out = tables.validation(spark.createDataFrame(rows, "id long, matrix array<array<string>>")).select("id", "v.*").orderBy("id").collect()
    assert [(r.status, r.checked) for r in out] == [("pass", 1), ("not_checkable", 0), ("pass", 1), ("pass", 1), ("not_checkable", 0)]


def test_documents_of_users_stay_apart(spark):
    old = [(1, "alice", "a.pdf", "/a", 10, ".pdf", "h1", "hop_dong", "old", "{}", None, "completed", None, None), (2, "bob", "a.pdf", "/b", 10, ".pdf", "h1", "khac", "his", "{}", None, "completed", None, None)]
    cols = "id long, user_id string, file_name string, file_path string, file_size long, file_type string, file_hash string, category string, extracted_text string, ocr_data_json string, eval_report string, status string, error_message string, created_at timestamp_ntz"
    docs = spark.createDataFrame(old, cols)
    new = spark.createDataFrame([(70, "alice", "b.pdf", 5, "h1", "new"), (1 << 50, None, "c.pdf", 0, "", "mine"), (71, "bob", "a.pdf", 10, "h9", "by name"), (72, "carol", "a.pdf", 10, "h1", "hers")], "seq long, user_id string, file_name string, file_size long, file_hash string, extracted_text string")
    got = {r.id: r for r in store.upsert_documents(docs, new).collect()}
    assert {i: (r.user_id, r.file_name, r.extracted_text, r.change) for i, r in got.items()} == {1: ("alice", "b.pdf", "new", "updated"), 2: ("bob", "a.pdf", "by name", "updated"), 3: ("carol", "a.pdf", "hers", "inserted"), 4: ("default_user", "c.pdf", "mine", "inserted")}
    assert (got[1].category, got[1].status, got[1].ocr_data_json, got[3].file_path) == ("unclassified", "completed", None, None)
    listed = store.list_documents(store.upsert_documents(docs, new), "alice").collect()
    assert [r.id for r in listed] == [1]
    assert store.upsert_documents(docs, new.limit(0)).where("change = 'kept'").count() == 2 and store.upsert_documents(docs.limit(0), new).count() == 4


def test_new_ids_need_no_window_over_all_rows(spark):
    messages = spark.createDataFrame([(5, "s", "u", "user", "x", "shown", None)], "id long, session_id string, user_id string, role string, content string, display_content string, doc_result_json string")
    new = spark.createDataFrame([(i * 10**6, "s", None, "user", str(i)) for i in range(50)], "seq long, session_id string, user_id string, role string, content string")
    out = store.append_messages(messages, new)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.content, r.user_id) for r in out.orderBy("id").collect()][1:] == [(6 + i, str(i), "default_user") for i in range(50)]
    assert out.where("id = 5").first().display_content == "shown"


def test_numbers_in_json_have_no_exponent(spark):
    values = [1.83595e7, -2.5e8, 1.5e20, 1e21, 1.5e22, 1e-5, 1.23e-4, 1.5e-7, 12.5, 9999999.0, 1234567890123456.7, None]
    texts = ['1.0E7 "x" \\ 2E9', "", None]
    df = spark.createDataFrame([([(t, v) for t in texts for v in values],)], "a array<struct<t: string, v: double>>")
    json_text = df.select(F.to_json("a", {"ignoreNullFields": "false"}).alias("j"))
    got = json_text.select(tx.plain_numbers(F.col("j"))).first()[0]
    assert [(x["t"], x["v"]) for x in json.loads(got)] == [(t, v) for t in texts for v in values]
    assert [x.split("}")[0] for x in got.split('"v":')[1:13]] == ["18359500.0", "-250000000.0", "150000000000000000000.0", "1e21", "1.5e22", "0.00001", "0.000123", "1.5e-7", "12.5", "9999999.0", "1234567890123456.8", "null"]


def test_large_amounts_of_records_and_payloads(spark):
    matrix = [["STT", "Tên hàng", "ĐVT", "SL", "Giá", "Tiền"], ["1", "Bàn 1.0E7", "Cái", "2", "1.000", "18359.500"]]
    for kind in ("invoice", "contract"):
        out = one(spark, TEXT, [matrix], kind)
        for said in (records._json(out, "data").first().data, records.payload(out, kind).first().payload):
            assert '"thanh_tien":18359500.0' in said and "Bàn 1.0E7" in said


def test_json_without_exponents_is_one_part_and_long_json_is_read(spark):
    import json

    from pyspark.sql import functions as F

    from doclathe.functions import text as tx

    plain = json.dumps({"a": ["x-1", "1E5", 'say \\"2E7\\" -', -3, 0.5] * 20000, "b": None}, ensure_ascii=False)
    odd = '{"n":[1.2345999E7,-2.5E8,3,-4.5,1.0E-5],"s":"1.0E7 \\"-2E8\\" -","t":-1.0E30}'
    df = spark.createDataFrame([(plain,), (odd,)], "j string")
    got = df.select(F.size(F.regexp_extract_all("j", F.lit(tx.JSON_PART), F.lit(0))).alias("n"), tx.plain_numbers(F.col("j")).alias("p")).collect()
    assert (got[0].n, got[0].p) == (1, plain)
    assert got[1].n == 9 and got[1].p == '{"n":[12345999.0,-250000000.0,3,-4.5,0.00001],"s":"1.0E7 \\"-2E8\\" -","t":-1e30}'


def test_titles_are_found_as_in_upper_case(spark):
    import sys

    from pyspark.sql import functions as F

    from doclathe.operators import extract as ex

    words = ("hợp đồng", "hop dong", "agreement")
    signs = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and any(u in "".join(words).upper() for u in chr(c).upper()[:1])]
    texts = [w[:i] + s + w[i + 1 :] for w in words for i in range(len(w)) for s in signs] + ["HỢP ĐỒNG số 1", "Biên bản", "x Agreement y", "hop  dong"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.rlike("t", F.lit(ex.TITLE)).alias("a"), F.rlike(F.upper("t"), F.lit("HỢP ĐỒNG|HOP DONG|AGREEMENT")).alias("b"))
    assert [r.t for r in df.collect() if r.a != r.b] == []
