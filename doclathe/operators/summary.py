"""Summaries of extracted documents, their rendering, context strings and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import fixtures as fx
from . import extract as ex
from . import tables as tb

RULE = "=" * 60
TITLES = {"invoice": "TÓM TẮT HÓA ĐƠN (INVOICE)", "contract": "TÓM TẮT HỢP ĐỒNG (CONTRACT)", "voucher": "TÓM TẮT CHỨNG TỪ (VOUCHER)", "bank_transfer": "TÓM TẮT CHUYỂN KHOẢN (BANK TRANSFER)", "generic": "TÓM TẮT TÀI LIỆU (GENERIC)"}


def money(x: Column) -> Column:
    return F.concat(F.format_number(F.bround(x), 0), F.lit(" VND"))


def _if(c: str, *parts: str | Column) -> Column:
    """The parts joined if the column is neither null nor empty, else nothing."""
    has = F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return F.when(has, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def _summary(df: DataFrame, short: Column, keys: dict[str, str], date: str | None, amount: str | None) -> DataFrame:
    """short_summary, key information (a map of what isn't null), and the date and amount that matter."""
    info = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys.values()]))
    return df.select("id", short.alias("short_summary"), info.alias("key_information"), (F.col(date) if date else F.lit("")).alias("important_date"), (F.col(amount) if amount else F.lit(None).cast("double")).alias("important_amount"))


def invoice(docs: DataFrame) -> DataFrame:
    d = ex.invoice(docs)
    short = F.concat(
        F.when(F.coalesce("so_hoa_don", F.lit("")) != "", F.concat(F.lit("Hóa đơn GTGT/Bán hàng số "), "so_hoa_don")).otherwise("Hóa đơn"),
        _if("ky_hieu", " (Ký hiệu: ", F.col("ky_hieu"), ")"), _if("ban_ten", " phát hành bởi ", F.col("ban_ten")), _if("mua_ten", " cho ", F.col("mua_ten")),
        F.when(F.col("tong_tien_thanh_toan") > 0, F.concat(F.lit(" với tổng thanh toán "), money(F.col("tong_tien_thanh_toan")), F.lit("."))).otherwise(""),
    )
    keys = {"số_hóa_đơn": "so_hoa_don", "ký_hiệu": "ky_hieu", "ngày_lập": "ngay_hoa_don", "người_bán": "ban_ten", "người_mua": "mua_ten"}
    return _summary(d, short, keys, "ngay_hoa_don", "tong_tien_thanh_toan")


def contract(docs: DataFrame) -> DataFrame:
    d = ex.contract(docs)
    names = F.array_compact(F.array(F.nullif("a_ten_to_chuc", F.lit("")), F.nullif("b_ten_to_chuc", F.lit(""))))
    parties = F.when(F.size(names) > 0, F.array_join(names, " và ")).otherwise("Các bên tham gia")
    short = F.concat("tieu_de", _if("so_hop_dong", " số ", F.col("so_hop_dong")), F.lit(" được ký kết giữa "), parties, F.lit("."), F.when(F.col("tong_tien") > 0, F.concat(F.lit(" Tổng giá trị hợp đồng là "), money(F.col("tong_tien")), F.lit("."))).otherwise(""))
    return _summary(d, short, {"mã_hợp_đồng": "so_hop_dong", "tiêu_đề": "tieu_de", "bên_a": "a_ten_to_chuc", "bên_b": "b_ten_to_chuc"}, "ngay_ky", "tong_tien")


def voucher(docs: DataFrame) -> DataFrame:
    d = ex.voucher(docs)
    both = (F.coalesce("giao_ten_don_vi", F.lit("")) != "") & (F.coalesce("nhan_ten_don_vi", F.lit("")) != "")
    who = F.when(both, F.concat(F.lit(" giữa "), "giao_ten_don_vi", F.lit(" và "), "nhan_ten_don_vi")).otherwise(_if("giao_ten_don_vi", " của đơn vị ", F.col("giao_ten_don_vi")))
    short = F.concat("loai_chung_tu", _if("so_chung_tu", " số ", F.col("so_chung_tu")), who, F.when(F.col("tong_gia_tri") > 0, F.concat(F.lit(" trị giá "), money(F.col("tong_gia_tri")), F.lit("."))).otherwise(""))
    keys = {"loại_chứng_từ": "loai_chung_tu", "số_chứng_từ": "so_chung_tu", "ngày_chứng_từ": "ngay_lap", "đơn_vị_giao": "giao_ten_don_vi", "đơn_vị_nhận": "nhan_ten_don_vi"}
    return _summary(d, short, keys, "ngay_lap", "tong_gia_tri")


def bank_transfer(docs: DataFrame) -> DataFrame:
    d = ex.transfer(docs).withColumn("bank", F.coalesce("ngan_hang", F.lit("Ngân hàng")))
    short = F.concat(F.lit("Biên nhận chuyển khoản "), "bank", _if("ma_giao_dich", " (Mã GD: ", F.col("ma_giao_dich"), ")"), _if("ho_ten", " tới người thụ hưởng ", F.col("ho_ten")), F.when(F.col("so_tien") > 0, F.concat(F.lit(" với số tiền "), money(F.col("so_tien")), F.lit("."))).otherwise(""))
    keys = {"ngân_hàng": "bank", "mã_giao_dịch": "ma_giao_dich", "người_nhận": "ho_ten", "nội_dung": "noi_dung"}
    return _summary(d, short, keys, "thoi_gian_giao_dich", "so_tien")


def generic(docs: DataFrame) -> DataFrame:
    d = ex.generic(docs).join(docs.select(F.col("id").alias("i"), F.size(F.split("text", tx.LINE_END)).alias("n")), F.col("id") == F.col("i"))
    short = F.concat(F.lit("Tài liệu không xác định chủng loại ("), F.coalesce("title", F.lit("")), F.lit("). Nguồn văn bản gồm "), F.col("n").cast("string"), F.lit(" dòng."))
    return _summary(d, short, {"tiêu_đề": "title", "số_hiệu": "document_number", "ngày": "date"}, "date", None)


SUMMARIES = {"invoice": invoice, "contract": contract, "voucher": voucher, "bank_transfer": bank_transfer, "generic": generic}


def render(summaries: DataFrame, kind: str) -> DataFrame:
    """A boxed report of each summary; what is missing is shown as unknown."""
    shown = F.transform(F.map_entries("key_information"), lambda e: F.concat(F.lit("• "), e["key"], F.lit(": "), F.when(e["value"] == "", "Chưa rõ").otherwise(e["value"])))
    amount = F.when(F.col("important_amount").isNotNull(), F.array(F.concat(F.lit("• Tổng: "), money(F.col("important_amount"))))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit(RULE), F.lit(" " * 16 + TITLES[kind]), F.lit(RULE), F.concat(F.lit("• Tóm tắt: "), "short_summary"))
    return summaries.select("id", F.array_join(F.concat(head, shown, amount, F.array(F.lit(RULE))), "\n").alias("report"))


def context(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """The text given to a language model: facts of a document, its tables as Markdown, its text.

    docs has id, name, category, text; tables has id, page, markdown, with any number for a document.
    """
    own = tables.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", "markdown"))).alias("ts"))
    d = docs.join(own, "id", "left").withColumn("ts", F.coalesce("ts", F.array().cast("array<struct<page:int,markdown:string>>")))
    n = F.size("ts")
    head = F.array(
        F.lit("=== THÔNG TIN TÀI LIỆU ==="), F.concat(F.lit("- Tên file: "), "name"), F.concat(F.lit("- Danh mục phân loại: "), "category"), F.lit("- Định dạng: text (Nguồn: plain_text, Phương pháp đọc: direct_read)"), F.lit("- Số trang/sheet: 1"),
        F.concat(F.lit("- Có bảng biểu: "), F.when(n > 0, F.concat(F.lit("Có ("), n.cast("string"), F.lit(" bảng)"))).otherwise("Không")), F.lit(""),
    )
    each = F.flatten(F.transform("ts", lambda t, i: F.array(F.concat(F.lit("\n[Bảng "), (i + 1).cast("string"), F.lit(" - Trang "), t["page"].cast("string"), F.lit("]")), t["markdown"])))
    shown = F.when(n > 0, F.concat(F.array(F.lit("=== CẤU TRÚC BẢNG TRÍCH XUẤT TỪ TÀI LIỆU ===")), each, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    body = tx.strip(F.col("text"))
    tail = F.array(F.lit("=== NỘI DUNG VĂN BẢN TRÍCH XUẤT ==="), F.when(body == "", "(Không có nội dung văn bản nào được trích xuất)").otherwise(body))
    return d.select("id", F.array_join(F.concat(head, shown, tail), "\n").alias("context"))


def clean_json(docs: DataFrame, category: str = "hoa_don") -> DataFrame:
    """The JSON payload of extracted invoices: type, file facts and data."""
    d = ex.invoice(docs)
    own = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    data = F.struct(*[own(c, c) for c in ("so_hoa_don", "ky_hieu", "ngay_hoa_don")], F.struct(own("ban_ten", "ten"), own("ban_mst", "mst")).alias("ben_ban"))
    meta = F.struct(F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("file_name"), F.lit(category).alias("category"), F.lit(1).alias("total_pages"))
    return d.select("id", F.to_json(F.struct(F.lit("invoice").alias("document_type"), meta.alias("file_metadata"), data.alias("data"))).alias("payload"))


def write_json(payloads: DataFrame, path: str, category: str) -> None:
    """One line of JSON for each document, in a folder for each category."""
    payloads.select(F.lit(category).alias("category"), "payload").write.mode("overwrite").partitionBy("category").text(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("report").write.mode("overwrite").text(path, lineSep="\n\n")


FIXTURES = {"invoice": fx.invoice_texts, "contract": fx.contract_texts, "voucher": fx.voucher_texts, "bank_transfer": fx.transfer_texts, "generic": fx.transfer_texts}


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "short_summary", F.array_join(F.transform(F.map_entries("key_information"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("key_information"), "important_date", "important_amount")


def _context(spark, sf_dir):
    docs = fx.rows(spark, sf_dir, fx.invoice_texts).select("id", F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.lit("hoa_don").alias("category"), "text")
    tables = tb.markdown(tb.matrices(fx.rows(spark, sf_dir, tb.table_rows))).select("id", F.lit(1).alias("page"), "markdown")
    return context(docs, tables)


QUERIES = {f"summary_{k}": (lambda spark, sf_dir, k=k: _flat(SUMMARIES[k](fx.rows(spark, sf_dir, FIXTURES[k])))) for k in SUMMARIES}
QUERIES |= {f"render_{k}": (lambda spark, sf_dir, k=k: render(SUMMARIES[k](fx.rows(spark, sf_dir, FIXTURES[k])), k)) for k in SUMMARIES}
QUERIES |= {"document_context": _context, "clean_json": lambda spark, sf_dir: clean_json(fx.rows(spark, sf_dir, fx.invoice_texts))}


def _sql_if(c: str, text: str) -> str:
    return f"CASE WHEN coalesce({c}, '') <> '' THEN {text} ELSE '' END"


def _sql_money(c: str, before: str) -> str:
    return f"CASE WHEN {c} > 0 THEN '{before}' || format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT)) || ' VND.' ELSE '' END"


def _sql_keys(keys: dict[str, str]) -> str:
    return " || ';' || ".join(f"'{k}=' || coalesce({c}, '')" for k, c in keys.items())


_FLAT = {
    "invoice": (ex.SQL_INVOICE, f"CASE WHEN coalesce(so_hoa_don, '') <> '' THEN 'Hóa đơn GTGT/Bán hàng số ' || so_hoa_don ELSE 'Hóa đơn' END || {_sql_if('ky_hieu', chr(39) + ' (Ký hiệu: ' + chr(39) + ' || ky_hieu || ' + chr(39) + ')' + chr(39))} || {_sql_if('ban_ten', chr(39) + ' phát hành bởi ' + chr(39) + ' || ban_ten')} || {_sql_if('mua_ten', chr(39) + ' cho ' + chr(39) + ' || mua_ten')} || {_sql_money('tong_tien_thanh_toan', ' với tổng thanh toán ')}",
                {"số_hóa_đơn": "so_hoa_don", "ký_hiệu": "ky_hieu", "ngày_lập": "ngay_hoa_don", "người_bán": "ban_ten", "người_mua": "mua_ten"}, "ngay_hoa_don", "tong_tien_thanh_toan"),
    "contract": (ex.SQL_CONTRACT, f"tieu_de || {_sql_if('so_hop_dong', chr(39) + ' số ' + chr(39) + ' || so_hop_dong')} || ' được ký kết giữa ' || coalesce(nullif(concat_ws(' và ', nullif(a_ten_to_chuc, ''), nullif(b_ten_to_chuc, '')), ''), 'Các bên tham gia') || '.' || {_sql_money('tong_tien', ' Tổng giá trị hợp đồng là ')}",
                 {"mã_hợp_đồng": "so_hop_dong", "tiêu_đề": "tieu_de", "bên_a": "a_ten_to_chuc", "bên_b": "b_ten_to_chuc"}, "ngay_ky", "tong_tien"),
    "voucher": (ex.SQL_VOUCHER, f"loai_chung_tu || {_sql_if('so_chung_tu', chr(39) + ' số ' + chr(39) + ' || so_chung_tu')} || ' giữa ' || giao_ten_don_vi || ' và ' || nhan_ten_don_vi || {_sql_money('tong_gia_tri', ' trị giá ')}",
                {"loại_chứng_từ": "loai_chung_tu", "số_chứng_từ": "so_chung_tu", "ngày_chứng_từ": "ngay_lap", "đơn_vị_giao": "giao_ten_don_vi", "đơn_vị_nhận": "nhan_ten_don_vi"}, "ngay_lap", "tong_gia_tri"),
    "bank_transfer": (ex.SQL_TRANSFER, f"'Biên nhận chuyển khoản ' || coalesce(ngan_hang, 'Ngân hàng') || {_sql_if('ma_giao_dich', chr(39) + ' (Mã GD: ' + chr(39) + ' || ma_giao_dich || ' + chr(39) + ')' + chr(39))} || {_sql_if('ho_ten', chr(39) + ' tới người thụ hưởng ' + chr(39) + ' || ho_ten')} || {_sql_money('so_tien', ' với số tiền ')}",
                      {"ngân_hàng": "coalesce(ngan_hang, 'Ngân hàng')", "mã_giao_dịch": "ma_giao_dich", "người_nhận": "ho_ten", "nội_dung": "noi_dung"}, "thoi_gian_giao_dich", "so_tien"),
    "generic": (f"SELECT g.*, len(string_split(x.text, chr(10))) AS n FROM ({ex.SQL_GENERIC}) g JOIN {fx.duck(fx.transfer_texts)} x ON g.id = x.id", "'Tài liệu không xác định chủng loại (' || coalesce(title, '') || '). Nguồn văn bản gồm ' || n || ' dòng.'",
                {"tiêu_đề": "title", "số_hiệu": "document_number", "ngày": "date"}, "date", "CAST(NULL AS DOUBLE)"),
}
ORACLES = {f"summary_{k}": f"SELECT id, {short} AS short_summary, {_sql_keys(keys)} AS key_information, {date} AS important_date, {amount} AS important_amount FROM ({base})" for k, (base, short, keys, date, amount) in _FLAT.items()}
for _k, (_base, _short, _keys, _date, _amount) in _FLAT.items():
    _shown = " || chr(10) || ".join(f"'• {k}: ' || CASE WHEN coalesce({c}, '') = '' THEN 'Chưa rõ' ELSE {c} END" for k, c in _keys.items())
    _sum = f"CASE WHEN {_amount} IS NOT NULL THEN '• Tổng: ' || format('{{:,}}', CAST(round_even({_amount}, 0) AS BIGINT)) || ' VND' || chr(10) ELSE '' END"
    ORACLES[f"render_{_k}"] = f"SELECT id, '{RULE}' || chr(10) || '{' ' * 16}{TITLES[_k]}' || chr(10) || '{RULE}' || chr(10) || '• Tóm tắt: ' || {_short} || chr(10) || {_shown} || chr(10) || {_sum} || '{RULE}' AS report FROM ({_base})"
ORACLES["clean_json"] = f"""SELECT id, '{{"document_type":"invoice","file_metadata":{{"file_name":"' || id || '.pdf","category":"hoa_don","total_pages":1}},"data":{{"so_hoa_don":"' || coalesce(so_hoa_don, '') || '","ky_hieu":"' || coalesce(ky_hieu, '') || '","ngay_hoa_don":"' || coalesce(ngay_hoa_don, '') || '","ben_ban":{{"ten":"' || ban_ten || '","mst":"' || ban_mst || '"}}}}}}' AS payload FROM ({ex.SQL_INVOICE})"""
ORACLES["document_context"] = f"""WITH t AS ({tb.ORACLES['markdown_table']}), d AS (SELECT x.id, x.text, t.value AS m FROM {fx.duck(fx.invoice_texts)} x LEFT JOIN t ON t.id = x.id)
SELECT id, '=== THÔNG TIN TÀI LIỆU ===' || chr(10) || '- Tên file: ' || id || '.txt' || chr(10) || '- Danh mục phân loại: hoa_don' || chr(10) || '- Định dạng: text (Nguồn: plain_text, Phương pháp đọc: direct_read)' || chr(10) || '- Số trang/sheet: 1' || chr(10) || '- Có bảng biểu: ' || CASE WHEN m IS NULL THEN 'Không' ELSE 'Có (1 bảng)' END || chr(10) || chr(10)
 || CASE WHEN m IS NULL THEN '' ELSE '=== CẤU TRÚC BẢNG TRÍCH XUẤT TỪ TÀI LIỆU ===' || chr(10) || chr(10) || '[Bảng 1 - Trang 1]' || chr(10) || m || chr(10) || chr(10) END || '=== NỘI DUNG VĂN BẢN TRÍCH XUẤT ===' || chr(10) || trim(text) AS context FROM d"""
