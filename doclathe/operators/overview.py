"""What matters in a document: summaries with dates, amounts and parties from typed records, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schemas as sc
from . import extract as ex
from . import records as rc
from .summary import money

# Labels, roles and places, and the heads and words of the reports.
SUMMARY = "STRUCT<short_summary: STRING, key_information: MAP<STRING, STRING>, important_dates: ARRAY<STRUCT<label: STRING, value: STRING, raw_value: STRING, source: STRING>>, important_amounts: ARRAY<STRUCT<label: STRING, value: DOUBLE, currency: STRING, source: STRING>>, parties: ARRAY<STRUCT<role: STRING, name: STRING, tax_id: STRING>>>"
DATES = {"invoice": ("Ngày lập hóa đơn", "Tiêu đề hóa đơn"), "contract": ("Ngày hiệu lực / Ngày ký", "Trang đầu hợp đồng"), "voucher": ("Ngày chứng từ", "Tiêu đề chứng từ"), "bank_transfer": ("Thời gian giao dịch", "Màn hình chuyển khoản"), "generic": ("Ngày phát hiện", "Văn bản")}
AMOUNTS = {"invoice": ("Tổng cộng tiền thanh toán", "Cuối hóa đơn"), "contract": ("Tổng giá trị thanh toán hợp đồng", "Phụ lục / Điều khoản thanh toán"), "voucher": ("Số tiền chứng từ", "Tổng cộng chứng từ"), "bank_transfer": ("Số tiền chuyển khoản", "Số tiền trên biên nhận"), "generic": ("Số tiền phát hiện", "Văn bản")}
RULE = "=" * 60
HEADS = {"invoice": " " * 16 + "TÓM TẮT HÓA ĐƠN (INVOICE)", "contract": " " * 16 + "TÓM TẮT HỢP ĐỒNG (CONTRACT)", "voucher": " " * 16 + "TÓM TẮT CHỨNG TỪ (VOUCHER)", "bank_transfer": " " * 10 + "TÓM TẮT ẢNH CHUYỂN KHOẢN (BANK TRANSFER)", "generic": " " * 12 + "TÓM TẮT TÀI LIỆU CHUNG (GENERIC DOCUMENT)"}
UNKNOWN = "Chưa rõ"


def _if(test: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def _some(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _kept(*items: tuple[Column, Column]) -> Column:
    """An array of the items whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), item) for test, item in items]))


def _data(records: DataFrame, kind: str) -> Column | rc.Leaves:
    return F.col("data") if "data" in records.columns else rc.Leaves(rc.declared(kind))


def summarise(records: DataFrame, kind: str) -> DataFrame:
    """Adds `summary` to records (id, data, or the leaves of it) of a kind; a number of 0 is no amount. Generic ones tell how long their `text` is, if it is kept."""
    d = _data(records, kind)
    party = lambda role, name, tax: F.struct(F.lit(role).alias("role"), name.alias("name"), tax.alias("tax_id"))
    day = lambda v: F.struct(F.lit(DATES[kind][0]).alias("label"), v.alias("value"), v.alias("raw_value"), F.lit(DATES[kind][1]).alias("source"))
    sum_ = lambda v: F.struct(F.lit(AMOUNTS[kind][0]).alias("label"), v.alias("value"), F.lit("VND").alias("currency"), F.lit(AMOUNTS[kind][1]).alias("source"))
    keys = lambda **of: F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("string"))])
    empty = F.lit("")
    if kind == "invoice":
        a, b, total, date = d["ben_ban"], d["ben_mua"], d["tai_chinh"]["tong_tien_thanh_toan"], d["ngay_hoa_don"]
        short = F.concat(F.when(_some(d["so_hoa_don"]), F.concat(F.lit("Hóa đơn GTGT/Bán hàng số "), d["so_hoa_don"])).otherwise("Hóa đơn"), _if(_some(d["ky_hieu"]), " (Ký hiệu: ", d["ky_hieu"], ")"), _if(_some(a["ten"]), " phát hành bởi ", a["ten"]), _if(_some(b["ten"]), " cho ", b["ten"]), _if(total > 0, " với tổng thanh toán ", money(total), "."))
        info = keys(số_hóa_đơn=d["so_hoa_don"], ký_hiệu=d["ky_hieu"], ngày_lập=date, người_bán=a["ten"], người_mua=b["ten"], tổng_thanh_toán=total)
        parties = _kept((_some(a["ten"]), party("Người bán", a["ten"], a["mst"])), (_some(b["ten"]), party("Người mua", b["ten"], b["mst"])))
    elif kind == "contract":
        a, b, total, date = d["ben_a"], d["ben_b"], d["gia_tri_hop_dong"]["tong_tien"], d["ngay_hieu_luc"]
        parties = _kept((_some(a["ten_to_chuc"]), party("Bên A", a["ten_to_chuc"], a["mst"])), (_some(b["ten_to_chuc"]), party("Bên B", b["ten_to_chuc"], b["mst"])))
        names = F.transform(parties, lambda p: p["name"])
        short = F.concat(d["tieu_de"], _if(_some(d["so_hop_dong"]), " số ", d["so_hop_dong"]), F.lit(" được ký kết giữa "), F.when(F.size(names) > 0, F.array_join(names, " và ")).otherwise("Các bên tham gia"), F.lit("."), _if(total > 0, " Tổng giá trị hợp đồng là ", money(total), "."))
        info = keys(mã_hợp_đồng=d["so_hop_dong"], tiêu_đề=d["tieu_de"], bên_a=F.coalesce(F.nullif(a["ten_to_chuc"], empty), F.get(names, F.lit(0)), empty), bên_b=F.coalesce(F.nullif(b["ten_to_chuc"], empty), F.get(names, F.lit(1)), empty), giá_trị=total)
    elif kind == "voucher":
        a, b, total, date = d["ben_giao"], d["ben_nhan"], d["nghia_vu_thanh_toan"]["tong_gia_tri"], d["ngay_lap"]
        one, two = _some(a["ten_don_vi"]), _some(b["ten_don_vi"])
        short = F.concat(d["loai_chung_tu"], _if(_some(d["so_chung_tu"]), " số ", d["so_chung_tu"]), F.when(one & two, F.concat(F.lit(" giữa "), a["ten_don_vi"], F.lit(" và "), b["ten_don_vi"])).otherwise(_if(one, " của đơn vị ", a["ten_don_vi"])), _if(total > 0, " trị giá ", money(total), "."))
        info = keys(loại_chứng_từ=d["loai_chung_tu"], số_chứng_từ=d["so_chung_tu"], ngày_chứng_từ=date, đơn_vị_giao=a["ten_don_vi"], đơn_vị_nhận=b["ten_don_vi"], tổng_tiền=total)
        parties = _kept((one, party("Bên giao / Xuất", a["ten_don_vi"], a["mst"])), (two, party("Bên nhận", b["ten_don_vi"], b["mst"])))
    elif kind == "bank_transfer":
        a, b, total, date = d["nguoi_gui"], d["nguoi_nhan"], d["so_tien"], d["thoi_gian_giao_dich"]
        bank = F.coalesce(F.nullif(b["ngan_hang"], empty), F.lit("Ngân hàng"))
        one, two = _some(a["ho_ten"]), _some(b["ho_ten"])
        short = F.concat(F.lit("Biên nhận chuyển khoản "), bank, _if(_some(d["ma_giao_dich"]), " (Mã GD: ", d["ma_giao_dich"], ")"), F.when(one & two, F.concat(F.lit(" từ "), a["ho_ten"], F.lit(" tới "), b["ho_ten"])).otherwise(_if(two, " tới người thụ hưởng ", b["ho_ten"])), _if(total > 0, " với số tiền ", money(total), "."))
        info = keys(ngân_hàng=bank, mã_giao_dịch=d["ma_giao_dich"], người_chuyển=a["ho_ten"], người_nhận=b["ho_ten"], số_tiền=total, nội_dung=d["noi_dung"])
        parties = _kept((one, party("Người chuyển", a["ho_ten"], empty)), (two, party("Người nhận", b["ho_ten"], empty)))
    else:
        n = F.when(_some(F.col("text")), F.size(F.split("text", "\n"))).otherwise(0) if "text" in records.columns else F.lit(0)
        short = F.concat(F.lit("Tài liệu không xác định chủng loại ("), d["title"], F.lit("). Nguồn văn bản gồm "), n.cast("string"), F.lit(" dòng."))
        info = keys(tiêu_đề=d["title"], số_hiệu=d["document_number"], ngày=d["date"])
        parties = F.array().cast("array<struct<role:string,name:string,tax_id:string>>")
    dates = F.transform(F.slice(d["dates"], 1, 3), day) if kind == "generic" else _kept((_some(date), day(date)))
    sums = F.transform(F.slice(d["amounts"], 1, 3), sum_) if kind == "generic" else _kept((total > 0, sum_(total)))
    return records.withColumn("summary", F.struct(short.alias("short_summary"), info.alias("key_information"), dates.alias("important_dates"), sums.alias("important_amounts"), parties.alias("parties")).cast(SUMMARY))


def report(summaries: DataFrame, kind: str) -> DataFrame:
    """Rows (id, report): the report of each record (id, data or the leaves of it, summary); goods and services are listed by their names, three at most."""
    d, s = _data(summaries, kind), F.col("summary")
    line = lambda label, x: F.concat(F.lit(f"• {label}: "), x)
    priced = lambda label, v: F.when(v > 0, line(label, money(v)))
    coded = lambda name, code, mark: F.concat(name, _if(_some(code), f" ({mark}: ", code, ")"))
    listed = lambda items, name: F.transform(F.slice(items, 1, 3), lambda x: F.concat(F.lit("   - "), x[name]))
    none = F.array().cast("array<string>")
    if kind == "invoice":
        t, items = d["tai_chinh"], d["danh_sach_hang_hoa"]
        own = [line("Tóm tắt", s["short_summary"]), line("Số hóa đơn", d["so_hoa_don"]), line("Ký hiệu", d["ky_hieu"]), line("Ngày lập", d["ngay_hoa_don"]), *[F.when(_some(p["ten"]), line(label, coded(p["ten"], p["mst"], "MST"))) for label, p in (("Bên bán", d["ben_ban"]), ("Bên mua", d["ben_mua"]))]]
        own += [priced("Tiền trước thuế", t["tien_chua_thue"]), priced("Tiền thuế GTGT", t["tien_thue_gtgt"]), priced("TỔNG CỘNG THANH TOÁN", t["tong_tien_thanh_toan"]), F.when(F.size(items) > 0, F.format_string("• Danh mục hàng hóa (%d mặt hàng):", F.size(items)))]
        more = listed(items, "ten_hang")
    elif kind == "contract":
        items = d["dich_vu_chinh"]
        own = [line("Tóm tắt", s["short_summary"]), line("Số hợp đồng", d["so_hop_dong"]), line("Tiêu đề", d["tieu_de"]), line("Ngày hiệu lực", d["ngay_hieu_luc"]), line("Ngày hết hạn", F.lit(UNKNOWN)), F.lit("• Các bên tham gia:")]
        own += [F.concat(F.lit(f"   - {role}: "), coded(p["ten_to_chuc"], p["mst"], "MST")) for role, p in (("Bên A", d["ben_a"]), ("Bên B", d["ben_b"]))]
        own += [priced("Tổng giá trị hợp đồng", d["gia_tri_hop_dong"]["tong_tien"]), F.when(F.size(items) > 0, F.format_string("• Dịch vụ / Sản phẩm (%d mục):", F.size(items)))]
        more = listed(items, "ten_dich_vu")
    elif kind == "voucher":
        own = [line("Loại chứng từ", d["loai_chung_tu"]), line("Số chứng từ", d["so_chung_tu"]), line("Ngày lập", d["ngay_lap"]), line("Đơn vị phát hành", d["ben_giao"]["ten_don_vi"]), line("Diễn giải", F.lit(UNKNOWN)), priced("Tổng số tiền", d["nghia_vu_thanh_toan"]["tong_gia_tri"])]
        more = none
    elif kind == "bank_transfer":
        to = d["nguoi_nhan"]
        own = [line("Ngân hàng", to["ngan_hang"]), line("Trạng thái", F.lit("Thành công")), line("Mã giao dịch", d["ma_giao_dich"]), F.rtrim(line("Thời gian GD", d["thoi_gian_giao_dich"])), priced("SỐ TIỀN CHUYỂN", d["so_tien"])]
        own += [F.when(_some(d["nguoi_gui"]["ho_ten"]), line("Người chuyển", d["nguoi_gui"]["ho_ten"])), F.when(_some(to["ho_ten"]), line("Người thụ hưởng", coded(to["ho_ten"], to["so_tai_khoan"], "STK"))), line("Nội dung chuyển khoản", d["noi_dung"])]
        more = none
    else:
        own = [line("Tiêu đề", d["title"]), line("Số hiệu", d["document_number"]), line("Ngày tháng", d["date"]), line("Mô tả tổng quan", s["short_summary"])]
        more = none
    head = F.array(F.lit(RULE), F.lit(HEADS[kind]), F.lit(RULE))
    text = F.array_join(F.concat(head, F.array_compact(F.array(*own)), more, F.array(F.lit(RULE))), "\n")
    return summaries.select("id", text.alias("report"))


def _summaries(spark, sf_dir: str, kind: str) -> DataFrame:
    return summarise(rc.leaves(rc.documents(spark, sf_dir, kind), kind, *(["text"] if kind == "generic" else [])), kind)


QUERIES = {f"overview_{k}": (lambda spark, sf_dir, k=k: rc._json(_summaries(spark, sf_dir, k), "summary")) for k in sc.RECORDS}
QUERIES |= {f"overview_report_{k}": (lambda spark, sf_dir, k=k: report(_summaries(spark, sf_dir, k), k)) for k in sc.RECORDS}

# The same in SQL over the records' SQL
_vnd = lambda x: f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)) || ' VND'"
_then = lambda test, text: f"CASE WHEN {test} THEN {text} ELSE '' END"
_BANK = "coalesce(nullif(data.nguoi_nhan.ngan_hang, ''), 'Ngân hàng')"
_TOTAL = {"invoice": "data.tai_chinh.tong_tien_thanh_toan", "contract": "data.gia_tri_hop_dong.tong_tien", "voucher": "data.nghia_vu_thanh_toan.tong_gia_tri", "bank_transfer": "data.so_tien"}
_DATE = {"invoice": "data.ngay_hoa_don", "contract": "data.ngay_hieu_luc", "voucher": "data.ngay_lap", "bank_transfer": "data.thoi_gian_giao_dich"}
_SHORT = {
    "invoice": f"CASE WHEN data.so_hoa_don <> '' THEN 'Hóa đơn GTGT/Bán hàng số ' || data.so_hoa_don ELSE 'Hóa đơn' END || {_then("data.ky_hieu <> ''", "' (Ký hiệu: ' || data.ky_hieu || ')'")} || {_then("data.ben_ban.ten <> ''", "' phát hành bởi ' || data.ben_ban.ten")} || {_then("data.ben_mua.ten <> ''", "' cho ' || data.ben_mua.ten")} || {_then(_TOTAL['invoice'] + ' > 0', "' với tổng thanh toán ' || " + _vnd(_TOTAL['invoice']) + " || '.'")}",
    "contract": f"data.tieu_de || {_then("data.so_hop_dong <> ''", "' số ' || data.so_hop_dong")} || ' được ký kết giữa ' || coalesce(nullif(concat_ws(' và ', nullif(data.ben_a.ten_to_chuc, ''), nullif(data.ben_b.ten_to_chuc, '')), ''), 'Các bên tham gia') || '.' || {_then(_TOTAL['contract'] + ' > 0', "' Tổng giá trị hợp đồng là ' || " + _vnd(_TOTAL['contract']) + " || '.'")}",
    "voucher": f"data.loai_chung_tu || {_then("data.so_chung_tu <> ''", "' số ' || data.so_chung_tu")} || CASE WHEN data.ben_giao.ten_don_vi <> '' AND data.ben_nhan.ten_don_vi <> '' THEN ' giữa ' || data.ben_giao.ten_don_vi || ' và ' || data.ben_nhan.ten_don_vi WHEN data.ben_giao.ten_don_vi <> '' THEN ' của đơn vị ' || data.ben_giao.ten_don_vi ELSE '' END || {_then(_TOTAL['voucher'] + ' > 0', "' trị giá ' || " + _vnd(_TOTAL['voucher']) + " || '.'")}",
    "bank_transfer": f"'Biên nhận chuyển khoản ' || {_BANK} || {_then("data.ma_giao_dich <> ''", "' (Mã GD: ' || data.ma_giao_dich || ')'")} || {_then("data.nguoi_nhan.ho_ten <> ''", "' tới người thụ hưởng ' || data.nguoi_nhan.ho_ten")} || {_then(_TOTAL['bank_transfer'] + ' > 0', "' với số tiền ' || " + _vnd(_TOTAL['bank_transfer']) + " || '.'")}",
    "generic": "'Tài liệu không xác định chủng loại (' || data.title || '). Nguồn văn bản gồm ' || n || ' dòng.'",
}
_INFO = {
    "invoice": {"số_hóa_đơn": "data.so_hoa_don", "ký_hiệu": "data.ky_hieu", "ngày_lập": "data.ngay_hoa_don", "người_bán": "data.ben_ban.ten", "người_mua": "data.ben_mua.ten", "tổng_thanh_toán": _TOTAL["invoice"]},
    "contract": {"mã_hợp_đồng": "data.so_hop_dong", "tiêu_đề": "data.tieu_de", "bên_a": "coalesce(nullif(data.ben_a.ten_to_chuc, ''), data.ben_b.ten_to_chuc)", "bên_b": "data.ben_b.ten_to_chuc", "giá_trị": _TOTAL["contract"]},
    "voucher": {"loại_chứng_từ": "data.loai_chung_tu", "số_chứng_từ": "data.so_chung_tu", "ngày_chứng_từ": "data.ngay_lap", "đơn_vị_giao": "data.ben_giao.ten_don_vi", "đơn_vị_nhận": "data.ben_nhan.ten_don_vi", "tổng_tiền": _TOTAL["voucher"]},
    "bank_transfer": {"ngân_hàng": _BANK, "mã_giao_dịch": "data.ma_giao_dich", "người_chuyển": "''", "người_nhận": "data.nguoi_nhan.ho_ten", "số_tiền": "data.so_tien", "nội_dung": "data.noi_dung"},
    "generic": {"tiêu_đề": "data.title", "số_hiệu": "data.document_number", "ngày": "data.date"},
}
_PARTIES = {
    "invoice": (("Người bán", "data.ben_ban.ten", "data.ben_ban.mst"), ("Người mua", "data.ben_mua.ten", "data.ben_mua.mst")), "contract": (("Bên A", "data.ben_a.ten_to_chuc", "data.ben_a.mst"), ("Bên B", "data.ben_b.ten_to_chuc", "data.ben_b.mst")),
    "voucher": (("Bên giao / Xuất", "data.ben_giao.ten_don_vi", "''"), ("Bên nhận", "data.ben_nhan.ten_don_vi", "''")), "bank_transfer": (("Người nhận", "data.nguoi_nhan.ho_ten", "''"),), "generic": (),
}


def _base_sql(kind: str) -> str:
    extra = f", len(string_split(x.text, chr(10))) AS n FROM ({rc._record_sql(kind)}) r JOIN {ex._TRA} x ON x.id = r.id" if kind == "generic" else f" FROM ({rc._record_sql(kind)}) r"
    return f"SELECT r.id, r.data{extra}"


def _summary_sql(kind: str) -> str:
    day = lambda v: f"{{'label': '{DATES[kind][0]}', 'value': {v}, 'raw_value': {v}, 'source': '{DATES[kind][1]}'}}"
    sum_ = lambda v: f"{{'label': '{AMOUNTS[kind][0]}', 'value': {v}, 'currency': 'VND', 'source': '{AMOUNTS[kind][1]}'}}"
    if kind == "generic":
        dates, sums = f"list_transform(data.dates[1:3], lambda v: {day('v')})", f"list_transform(data.amounts[1:3], lambda v: {sum_('v')})"
    else:
        dates, sums = f"CASE WHEN {_DATE[kind]} <> '' THEN [{day(_DATE[kind])}] ELSE [] END", f"CASE WHEN {_TOTAL[kind]} > 0 THEN [{sum_(_TOTAL[kind])}] ELSE [] END"
    parties = "list_filter([" + ", ".join(f"{{'role': '{r}', 'name': {n}, 'tax_id': {t}}}" for r, n, t in _PARTIES[kind]) + "], lambda p: p.name <> '')" if _PARTIES[kind] else "[]"
    info = "map {" + ", ".join(f"'{k}': CAST({v} AS VARCHAR)" for k, v in _INFO[kind].items()) + "}"
    return f"SELECT id, CAST(to_json({{'short_summary': {_SHORT[kind]}, 'key_information': {info}, 'important_dates': {dates}, 'important_amounts': {sums}, 'parties': {parties}}}) AS VARCHAR) AS summary FROM ({_base_sql(kind)})"


def _report_sql(kind: str) -> str:
    line = lambda label, x: f"'• {label}: ' || {x}"
    priced = lambda label, v: f"CASE WHEN {v} > 0 THEN '• {label}: ' || {_vnd(v)} END"
    coded = lambda name, code, mark: f"{name} || CASE WHEN {code} <> '' THEN ' ({mark}: ' || {code} || ')' ELSE '' END"
    counted = lambda items, before, after: f"CASE WHEN len({items}) > 0 THEN '• {before} (' || len({items}) || ' {after}):' END"
    listed = lambda items, name: f"nullif(array_to_string(list_transform({items}[1:3], lambda x: '   - ' || x.{name}), chr(10)), '')"
    t = "data.tai_chinh."
    lines = {
        "invoice": lambda: [line("Tóm tắt", _SHORT[kind]), line("Số hóa đơn", "data.so_hoa_don"), line("Ký hiệu", "data.ky_hieu"), line("Ngày lập", "data.ngay_hoa_don"), *[f"CASE WHEN data.{p}.ten <> '' THEN {line(label, coded(f'data.{p}.ten', f'data.{p}.mst', 'MST'))} END" for label, p in (("Bên bán", "ben_ban"), ("Bên mua", "ben_mua"))],
                            priced("Tiền trước thuế", t + "tien_chua_thue"), priced("Tiền thuế GTGT", t + "tien_thue_gtgt"), priced("TỔNG CỘNG THANH TOÁN", t + "tong_tien_thanh_toan"), counted("data.danh_sach_hang_hoa", "Danh mục hàng hóa", "mặt hàng"), listed("data.danh_sach_hang_hoa", "ten_hang")],
        "contract": lambda: [line("Tóm tắt", _SHORT[kind]), line("Số hợp đồng", "data.so_hop_dong"), line("Tiêu đề", "data.tieu_de"), line("Ngày hiệu lực", "data.ngay_hieu_luc"), f"'• Ngày hết hạn: {UNKNOWN}'", "'• Các bên tham gia:'", *[f"'   - {role}: ' || {coded(f'data.{p}.ten_to_chuc', f'data.{p}.mst', 'MST')}" for role, p in (("Bên A", "ben_a"), ("Bên B", "ben_b"))],
                             priced("Tổng giá trị hợp đồng", _TOTAL[kind]), counted("data.dich_vu_chinh", "Dịch vụ / Sản phẩm", "mục"), listed("data.dich_vu_chinh", "ten_dich_vu")],
        "voucher": lambda: [line("Loại chứng từ", "data.loai_chung_tu"), line("Số chứng từ", "data.so_chung_tu"), line("Ngày lập", "data.ngay_lap"), line("Đơn vị phát hành", "data.ben_giao.ten_don_vi"), f"'• Diễn giải: {UNKNOWN}'", priced("Tổng số tiền", _TOTAL[kind])],
        "bank_transfer": lambda: [line("Ngân hàng", "data.nguoi_nhan.ngan_hang"), "'• Trạng thái: Thành công'", line("Mã giao dịch", "data.ma_giao_dich"), f"rtrim({line('Thời gian GD', 'data.thoi_gian_giao_dich')})", priced("SỐ TIỀN CHUYỂN", "data.so_tien"), f"CASE WHEN data.nguoi_nhan.ho_ten <> '' THEN {line('Người thụ hưởng', coded('data.nguoi_nhan.ho_ten', 'data.nguoi_nhan.so_tai_khoan', 'STK'))} END", line("Nội dung chuyển khoản", "data.noi_dung")],
        "generic": lambda: [line("Tiêu đề", "data.title"), line("Số hiệu", "data.document_number"), line("Ngày tháng", "data.date"), line("Mô tả tổng quan", _SHORT[kind])],
    }[kind]()
    return f"SELECT id, concat_ws(chr(10), '{RULE}', '{HEADS[kind]}', '{RULE}', {', '.join(lines)}, '{RULE}') AS report FROM ({_base_sql(kind)})"


ORACLES = {f"overview_{k}": _summary_sql(k) for k in sc.RECORDS} | {f"overview_report_{k}": _report_sql(k) for k in sc.RECORDS}
