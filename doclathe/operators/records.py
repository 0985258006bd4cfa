"""Typed records of documents: nested key information with line items, the envelope, payloads and their reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schemas as sc
from ..functions import text as tx
from ..functions.layout import bound
from ..plans import fixtures as fx
from . import extract as ex
from . import tables as tb
from .text_queries import duck_amount

# Words of header and total rows, units, and the sentences of every contract.
GOODS_HEAD, GOODS_SUM = "stt|tên|item|cộng", "tổng|cộng|thuế|vat"
SERVICE_HEAD, SERVICE_SUM = "stt|gói dịch vụ|tên hàng", "tổng|cộng|thuế"
ASSET_HEAD = "stt|tên thiết bị|hàng hóa"
UNITS = ("Bộ", "Cái", "Hệ", "Chiếc", "Gói")
SERIAL = r"S/N:\s*([A-Za-z0-9\-]+)"
RENEWAL = "Chủ động gia hạn trước 10 ngày trước khi hết hạn."
DISPUTES = "Thương lượng giải quyết hoặc chuyển đến Tòa án nhân dân có thẩm quyền."
FROM_ROLE, TO_ROLE = "Bên A / Bên bán / Người gửi / Ngân hàng", "Bên B / Bên mua / Người nhận"


def with_rows(docs: DataFrame) -> DataFrame:
    """Adds `_rows`: the tables' rows in turn, each without its empty cells, so that later ones move up.

    `tables` is an array of structs with a `matrix`; without the column, or null, there are none.
    """
    if "tables" not in docs.columns:
        docs = docs.withColumn("tables", F.array().cast(f"ARRAY<{sc.TABLE}>"))
    docs = docs.withColumn("tables", F.coalesce("tables", F.array().cast(docs.schema["tables"].dataType)))
    rows = F.flatten(F.transform(F.filter("tables", lambda t: t["matrix"].isNotNull()), lambda t: t["matrix"]))
    tidy = lambda r: F.filter(F.transform(r, lambda x: F.replace(tx.strip(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit(" "))), lambda x: x != "")
    return docs.withColumn("_rows", F.coalesce(F.transform(rows, tidy), F.array().cast("array<array<string>>")))


def _cell(r: Column, i: int) -> Column:
    return F.coalesce(F.get(r, F.lit(i)), F.lit(""))


def _named(rows: Column, least: int, head: str, total: str | None) -> Column:
    """Rows with `least` cells or more whose first isn't a heading and whose second is a name, not a total."""
    low = lambda x, words: F.rlike(F.lower(x), F.lit(words))
    return F.filter(rows, lambda r: (F.size(r) >= least) & ~low(_cell(r, 0), head) & (~low(_cell(r, 1), total) if total else F.lit(True)))


def goods(rows: Column) -> Column:
    amount = lambda r, i: F.when(F.size(r) > i, tx.clean_amount(F.get(r, F.lit(i))))
    return F.transform(
        _named(rows, 4, GOODS_HEAD, GOODS_SUM),
        lambda r, i: F.struct((i + 1).alias("stt"), _cell(r, 1).alias("ten_hang"), _cell(r, 2).alias("dvt"), amount(r, 3).alias("so_luong"), amount(r, 4).alias("don_gia"), F.when(F.size(r) > 5, tx.clean_amount(F.element_at(r, -1))).alias("thanh_tien")),
    )


def services(rows: Column) -> Column:
    return F.transform(_named(rows, 3, SERVICE_HEAD, SERVICE_SUM), lambda r, i: F.struct((i + 1).alias("stt"), _cell(r, 1).alias("ten_dich_vu"), _cell(r, 2).alias("thoi_han"), tx.clean_amount(F.element_at(r, -1)).alias("thanh_tien")))


def assets(rows: Column) -> Column:
    """Goods handed over: serial numbers, unit, the first whole number and the first longer remark among the cells after the name."""

    def one(r: Column, i: Column) -> Column:
        rest = F.transform(F.slice(r, 3, F.size(r)), lambda p: F.struct(p.alias("p"), F.contains(p, F.lit("S/N:")).alias("serial"), p.isin(*UNITS).alias("unit"), F.rlike(p, F.lit(r"^\d+$")).alias("whole")))
        return bound(rest, lambda cells: bound(F.filter(cells, lambda c: ~c["serial"] & ~c["unit"]), lambda other: told(r, i, cells, other)))

    def told(r: Column, i: Column, cells: Column, other: Column) -> Column:
        first = F.array_position(F.transform(other, lambda c: c["whole"]), F.lit(True))
        remark = F.filter(other, lambda c, k: (k + 1 != first) & (F.length(c["p"]) > 10))
        serials = F.flatten(F.transform(F.filter(cells, lambda c: c["serial"]), lambda c: F.regexp_extract_all(c["p"], F.lit(SERIAL), F.lit(1))))
        unit = F.filter(cells, lambda c: ~c["serial"] & c["unit"])
        number = F.nullif(tx.clean_amount(_cell(r, 0)), F.lit(0.0))
        return F.struct(
            F.coalesce(number, (i + 1).cast("double")).alias("stt"), _cell(r, 1).alias("ten_tai_san"), serials.alias("so_serial"), F.coalesce(F.try_element_at(unit, F.lit(-1))["p"], F.lit("")).alias("dvt"),
            F.get(other, (F.nullif(first, F.lit(0)) - 1).cast("int"))["p"].try_cast("int").alias("so_luong"), F.coalesce(F.get(remark, F.lit(0))["p"], F.lit("")).alias("tinh_trang"),
        )

    return F.transform(_named(rows, 3, ASSET_HEAD, None), one)


def _text(*names: str, **renamed: str) -> list[Column]:
    """Text fields, empty where nothing was found: by name, or name=column; an empty column name stays empty."""
    of = {n: n for n in names} | renamed
    return [(F.coalesce(F.col(c), F.lit("")) if c else F.lit("")).alias(n) for n, c in of.items()]



def _list() -> Column:
    return F.array().cast("array<string>")


def _invoice(d: DataFrame) -> Column:
    money = F.struct("tien_chua_thue", "thue_suat", "tien_thue_gtgt", "tong_tien_thanh_toan", *_text("so_tien_bang_chu"), F.lit("VND").alias("loai_tien"), *_text("hinh_thuc_thanh_toan"))
    return F.struct(
        *_text("so_hoa_don", "ky_hieu", "mau_so", "ngay_hoa_don", "ma_cqt", "ma_tra_cuu"),
        F.struct(*_text(ten="ban_ten", mst="ban_mst", dia_chi="ban_dia_chi", so_tai_khoan="ban_so_tai_khoan", ngan_hang="", dien_thoai="")).alias("ben_ban"),
        F.struct(*_text(ten="mua_ten", mst="mua_mst", dia_chi="", nguoi_mua_hang="nguoi_mua_hang", dien_thoai="")).alias("ben_mua"),
        F.col("_items").alias("danh_sach_hang_hoa"), money.alias("tai_chinh"), _list().alias("ghi_chu"),
    )


def _contract(d: DataFrame) -> Column:
    def side(role: str, **of: str) -> Column:
        names = dict.fromkeys(("ten_to_chuc", "dai_dien", "chuc_vu", "mst", "dia_chi", "dien_thoai", "email", "so_tai_khoan", "ngan_hang"), "") | of
        return F.struct(F.lit(role).alias("vai_tro"), *_text(**names))

    none = F.lit(None).cast("double")
    value = F.struct("tong_tien", none.alias("tien_chua_vat"), none.alias("tien_vat"), F.lit("VND").alias("loai_tien"), *_text("hinh_thuc_thanh_toan"))
    return F.struct(
        *_text("so_hop_dong", "tieu_de", "ngay_ky", ngay_hieu_luc="ngay_ky"),
        side("Bên A", ten_to_chuc="a_ten_to_chuc", dai_dien="a_dai_dien", mst="a_mst").alias("ben_a"),
        side("Bên B", ten_to_chuc="b_ten_to_chuc", mst="b_mst", so_tai_khoan="b_so_tai_khoan", ngan_hang="b_ngan_hang").alias("ben_b"),
        value.alias("gia_tri_hop_dong"), F.col("_items").alias("dich_vu_chinh"), F.lit("").alias("thoi_han_hop_dong"),
        F.struct(F.lit(RENEWAL).alias("gia_han"), F.lit("").alias("dieu_kien_cham_dut"), F.lit(DISPUTES).alias("giai_quyet_tranh_chap")).alias("dieu_khoan_quan_trong"), _list().alias("nguoi_ky"),
    )


def _voucher(d: DataFrame) -> Column:
    unit = lambda **of: F.struct(*_text(**(dict.fromkeys(("ten_don_vi", "dai_dien", "chuc_vu", "can_bo_ky_thuat", "mst"), "") | of)))
    due = F.struct("tong_gia_tri", F.col("tong_gia_tri").alias("da_thanh_toan"), F.lit(None).cast("double").alias("con_lai"), _list().alias("chi_tiet_dot"))
    return F.struct(
        *_text("loai_chung_tu", "so_chung_tu", "ngay_lap", "can_cu", "dia_diem"), unit(ten_don_vi="giao_ten_don_vi", dai_dien="giao_dai_dien").alias("ben_giao"), unit(ten_don_vi="nhan_ten_don_vi").alias("ben_nhan"),
        F.col("_items").alias("danh_muc_tai_san"), *_text("thoi_han_bao_hanh"), _list().alias("ho_so_kem_theo"), due.alias("nghia_vu_thanh_toan"), *_text("ket_luan"), _list().alias("nguoi_ky"),
    )


def _transfer(d: DataFrame) -> Column:
    return F.struct(
        "trang_thai", "so_tien", F.lit("VND").alias("loai_tien"), *_text("thoi_gian_giao_dich", "ma_giao_dich"), F.struct(*_text("ho_ten", "so_tai_khoan", "ngan_hang")).alias("nguoi_nhan"),
        F.struct(*_text(ho_ten="", so_tai_khoan="", ngan_hang="")).alias("nguoi_gui"), *_text("noi_dung"), F.lit(0.0).alias("phi_giao_dich"),
    )


def _generic(d: DataFrame) -> Column:
    return F.struct(*_text("title", "document_number", "date"), _list().alias("organizations"), _list().alias("people"), F.col("_items").alias("amounts"), "dates", _list().alias("identifiers"), _list().alias("key_information"), *_text("description"))


def _sums(d: DataFrame) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform("amounts", tx.clean_amount), lambda v: v.isNotNull())))


_KINDS: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], Column]]] = {
    "invoice": (ex.invoice_fields, _invoice), "contract": (ex.contract_fields, _contract), "voucher": (ex.voucher_fields, _voucher), "bank_transfer": (ex.transfer_fields, _transfer), "generic": (ex.generic_fields, _generic),
}
#: The array of a kind's record that takes work, and its type.
_ARRAYS: dict[str, tuple[Callable[[DataFrame], Column], str]] = {
    "invoice": (lambda d: goods(F.col("_rows")), sc.GOODS), "contract": (lambda d: services(F.col("_rows")), sc.SERVICE), "voucher": (lambda d: assets(F.col("_rows")), sc.ASSET), "generic": (_sums, "DOUBLE"),
}


class Leaves:
    """A record spread over columns, read like the struct that it is: by names, down to a leaf's column."""

    def __init__(self, kind: T.StructType, *path: str) -> None:
        self.kind, self.path = kind, path

    def __getitem__(self, name: str) -> Leaves | Column:
        inner, path = self.kind[name].dataType, (*self.path, name)
        return Leaves(inner, *path) if isinstance(inner, T.StructType) else F.col("__".join(("data", *path)))

    def struct(self) -> Column:
        return F.struct(*[(x.struct() if isinstance(x := self[n], Leaves) else x).alias(n) for n in self.kind.names])


def declared(kind: str) -> T.StructType:
    return T.DataType.fromDDL(sc.RECORDS[kind])


def _leaf_columns(x: Column, kind: T.StructType, *path: str) -> list[Column]:
    of = [(x[f.name], f.dataType, (*path, f.name)) for f in kind]
    return [c for y, t, at in of for c in (_leaf_columns(y, t, *at) if isinstance(t, T.StructType) else [y.cast(t).alias("__".join(("data", *at)))])]


def leaves(docs: DataFrame, kind: str, *keep: str) -> DataFrame:
    """Rows (id, the columns to keep, each leaf of the record): columns, so that what nothing reads isn't made.

    Text that isn't found is empty, numbers that aren't are null, as stored records have it.
    Arrays are made once, in a column of their own, however often they are read.
    """
    fields, data = _KINDS[kind]
    d = fields(with_rows(docs))
    if kind in _ARRAYS:
        made, of = _ARRAYS[kind]
        d = d.withColumn("_items", made(d).cast(f"ARRAY<{of}>"))
    return d.select("id", *keep, *_leaf_columns(data(d), declared(kind)))


def record(docs: DataFrame, kind: str, *keep: str) -> DataFrame:
    """Rows (id, data) and the columns to keep: the record of a kind, of the type RECORDS declares, from text and tables (see leaves)."""
    return leaves(docs, kind, *keep).select("id", *keep, Leaves(declared(kind)).struct().cast(sc.RECORDS[kind]).alias("data"))


def legacy(data: Column, kind: str) -> Column:
    """The record under the older English names."""
    money = lambda v: F.struct(v.alias("total"), F.lit("VND").alias("currency"))
    pick = lambda **of: F.struct(*[(v if isinstance(v, Column) else data[v]).alias(n) for n, v in of.items()])
    side = lambda s: F.struct(data[s]["ten"].alias("name"), data[s]["mst"].alias("tax_id"), data[s]["dia_chi"].alias("address"))
    party = lambda s, role: F.struct(F.lit(role).alias("role"), data[s]["ten_to_chuc"].alias("name"), data[s]["mst"].alias("tax_id"))
    if kind == "invoice":
        t = data["tai_chinh"]
        sums = F.struct(t["tien_chua_thue"].alias("subtotal"), t["tien_thue_gtgt"].alias("vat_amount"), t["tong_tien_thanh_toan"].alias("total"), F.lit("VND").alias("currency"))
        return pick(invoice_number="so_hoa_don", invoice_symbol="ky_hieu", invoice_date="ngay_hoa_don", seller=side("ben_ban"), buyer=side("ben_mua"), items="danh_sach_hang_hoa", amounts=sums)
    if kind == "contract":
        return pick(contract_number="so_hop_dong", title="tieu_de", effective_date="ngay_hieu_luc", parties=F.array(party("ben_a", "Bên A"), party("ben_b", "Bên B")), contract_value=money(data["gia_tri_hop_dong"]["tong_tien"]), services="dich_vu_chinh")
    if kind == "voucher":
        return pick(voucher_type="loai_chung_tu", voucher_number="so_chung_tu", voucher_date="ngay_lap", organization=F.struct(data["ben_giao"]["ten_don_vi"].alias("name")), items="danh_muc_tai_san", amounts=money(data["nghia_vu_thanh_toan"]["tong_gia_tri"]))
    if kind == "bank_transfer":
        to = data["nguoi_nhan"]
        receiver = F.struct(to["ho_ten"].alias("name"), to["so_tai_khoan"].alias("account_number"), to["ngan_hang"].alias("bank_name"))
        sender = F.struct(F.lit("").alias("name"), F.lit("").alias("account_number"))
        amount = F.struct(data["so_tien"].alias("value"), F.lit("VND").alias("currency"))
        return pick(bank_name=to["ngan_hang"], transaction_id="ma_giao_dich", transaction_date="thoi_gian_giao_dich", amount=amount, receiver=receiver, sender=sender, transfer_content="noi_dung")
    return pick(title="title", document_number="document_number", date="date", dates="dates", amounts="amounts", description="description")


def payload(records: DataFrame, kind: str, files: DataFrame | None = None, processed_at: str | None = None) -> DataFrame:
    """Rows (id, category, payload): {document_type, file_metadata, data} of each record as JSON, nulls written out.

    files (id, file_name, source_type, total_pages) tells what is known of the files.
    """
    category = sc.CATEGORIES.get(kind, "khac")
    d = records if files is None else records.join(files, "id", "left")
    have = lambda c, other: F.coalesce(F.col(c), other) if c in d.columns else other
    meta = F.struct(have("file_name", F.lit("")).alias("file_name"), F.lit(category).alias("category"), have("source_type", F.lit(None).cast("string")).alias("source_type"), have("total_pages", F.lit(1)).cast("int").alias("total_pages"), *([F.lit(processed_at).alias("processed_at")] if processed_at else []))
    whole = F.struct(F.lit(category).alias("document_type"), meta.alias("file_metadata"), "data")
    return d.select("id", F.lit(category).alias("category"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload")).withColumn("payload", tx.plain_numbers(F.col("payload")))


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One line of JSON a document, in a folder for each category."""
    payloads.select("category", "payload").write.mode("overwrite").partitionBy("category").text(path)


def read_result(json: Column) -> Column:
    """A stored result as struct (result, raw): of the declared type, and the JSON itself as VARIANT.

    What isn't JSON has neither; JSON that isn't a DOC_RESULT has the fields that fit, others
    null, so nothing that was stored is lost.
    """
    raw = F.try_parse_json(json)
    return F.struct(F.when(raw.isNotNull(), F.from_json(json, sc.DOC_RESULT)).alias("result"), raw.alias("raw"))


def envelope(docs: DataFrame, kind: str) -> DataFrame:
    """Rows (id, envelope): overview, metadata, two parties, financials, pairs, fields, tables and text of documents of a kind.

    docs has id, text and, if known, name, document_type, source_type, total_pages and tables.
    Each value is the first of the kind's older fields that isn't empty. One pass over a row:
    the fields are projected once, and nothing is joined.
    """
    d = ex.entity_fields(with_rows(docs), kind)
    got = set(d.columns)
    have = lambda c, other: F.coalesce(F.col(c), other) if c in docs.columns else other
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cs if c in got], F.lit(""))
    empty = F.lit("")
    overview = F.struct(have("name", empty).alias("filename"), F.lit(sc.CATEGORIES.get(kind, "")).alias("category"), have("document_type", F.lit("unknown")).alias("document_type"), have("source_type", F.lit("unknown")).alias("source_type"), have("total_pages", F.lit(1)).cast("int").alias("total_pages"), (F.size("tables") > 0).alias("has_table"))
    metadata = F.struct(first("contract_number", "invoice_number", "doc_number", "account_number").alias("doc_number"), first("issue_date", "sign_date", "transaction_date").alias("issue_date"), empty.alias("effective_date"), first("serial").alias("serial_number"))
    party = lambda role, name, code, account: F.struct(F.lit(role).alias("role"), name.alias("name"), code.alias("tax_code"), empty.alias("address"), account.alias("account_number"))
    parties = F.array(party(FROM_ROLE, first("party_a", "seller_name", "bank_name"), first("seller_tax_code"), first("account_number")), party(TO_ROLE, first("party_b", "buyer_name", "receiver_name"), first("buyer_tax_code"), empty))
    money = F.struct(F.lit("VND").alias("currency"), first("vat_amount").alias("vat_amount"), first("total_amount", "amount").alias("total_amount"), empty.alias("amount_in_words"), first("transfer_content").alias("payment_method"))
    fields = F.map_filter(F.create_map(*[x for c in ex.entity_names(kind) for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: F.coalesce(v, empty) != "")
    clean = F.transform("tables", lambda t: F.struct(F.coalesce(t["page"], F.lit(1)).alias("page"), t["sheet_name"].alias("sheet_name"), F.coalesce(t["headers"], _list()).alias("headers"), F.slice(t["matrix"], 2, F.greatest(F.size(t["matrix"]) - 1, F.lit(0))).alias("rows"), F.coalesce(t["markdown"], empty).alias("markdown")))
    return d.select("id", F.struct(overview.alias("overview"), metadata.alias("metadata"), parties.alias("parties"), money.alias("financials"), tx.key_values(F.col("text")).alias("key_value_pairs"), fields.alias("important_fields"), clean.alias("tables"), F.col("text").alias("full_text")).alias("envelope"))


# Queries: the documents of the fixtures with a table of their order's lines


def line_tables(d: fx.Dialect) -> str:
    """Rows of each order's table: number, name, unit or term, quantity, price, amount; some serials, remarks and totals."""
    return f"""SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_linenumber AS string) AS c1, concat(CASE WHEN l_partkey % 9 = 0 THEN 'Tổng phần ' ELSE 'Hàng ' END, CAST(l_partkey AS string)) AS c2, CASE WHEN l_suppkey % 2 = 0 THEN 'Cái' WHEN l_suppkey % 3 = 0 THEN '' ELSE 'Bộ' END AS c3,
  CAST(l_suppkey % 40 AS string) AS c4, concat(CAST(1 + l_partkey % 900 AS string), '.000') AS c5, CASE WHEN l_partkey % 5 = 0 THEN concat('S/N: AB', CAST(l_partkey AS string), ' S/N: CD-', CAST(l_suppkey AS string)) WHEN l_partkey % 5 = 1 THEN 'Hoạt động tốt' ELSE concat(CAST(l_partkey AS string), '.500') END AS c6 FROM {tb.LINES}"""


KINDS = {"invoice": fx.invoice_texts, "contract": fx.contract_texts, "voucher": fx.voucher_texts, "bank_transfer": fx.transfer_texts, "generic": fx.transfer_texts}
HEAD = ("STT", "Tên", "ĐVT", "Số lượng", "Đơn giá", "Thành tiền")


def documents(spark, sf_dir: str, kind: str) -> DataFrame:
    """The texts of a kind with their tables; transfers have none."""
    docs = fx.rows(spark, sf_dir, KINDS[kind])
    if kind in ("bank_transfer", "generic"):
        return docs
    rows = fx.rows(spark, sf_dir, line_tables)
    cells = F.array(*[F.col(f"c{i}") for i in range(1, 7)])
    met = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", cells.alias("cells")))).alias("rs"))
    head = F.array(*[F.lit(h) for h in HEAD])
    matrix = F.concat(F.array(head), F.transform("rs", lambda r: r["cells"]))
    table = F.struct(F.lit(1).alias("page"), F.lit(None).cast("string").alias("sheet_name"), F.lit("native_pdf_spatial").alias("detection_method"), head.alias("headers"), matrix.alias("matrix"), F.lit("").alias("markdown"), F.lit(0.98).alias("table_confidence"), F.lit(None).cast(sc.VALIDATION).alias("validation"))
    return docs.join(met.select("id", F.array(table).alias("tables")), "id", "left")


def _json(df: DataFrame, name: str) -> DataFrame:
    return df.select("id", F.to_json(name, {"ignoreNullFields": "false"}).alias(name)).withColumn(name, tx.plain_numbers(F.col(name)))


QUERIES = {f"record_{k}": (lambda spark, sf_dir, k=k: _json(record(documents(spark, sf_dir, k), k), "data")) for k in KINDS}
QUERIES |= {f"payload_{k}": (lambda spark, sf_dir, k=k: payload(record(documents(spark, sf_dir, k), k), k)) for k in sc.CATEGORIES}
QUERIES |= {f"envelope_{k}": (lambda spark, sf_dir, k=k: _json(envelope(documents(spark, sf_dir, k), k), "envelope")) for k in sc.CATEGORIES}


# The same in SQL: flat fields come from the patterns' catalogue, items and structs are built anew

_TABLES = f"""lists AS (SELECT id, list_prepend([{', '.join(f"'{h}'" for h in HEAD)}], list([c1, c2, c3, c4, c5, c6] ORDER BY n)) AS m FROM {fx.duck(line_tables)} GROUP BY id),
parts AS (SELECT id, m, list_transform(m, lambda r: list_filter(r, lambda x: x <> '')) AS ps FROM lists)"""
_low = lambda i, words: f"regexp_matches(lower(coalesce(p[{i}], '')), '{words}')"
_ITEMS = {
    "invoice": f"""list_transform(list_filter(ps, lambda p: len(p) >= 4 AND NOT {_low(1, GOODS_HEAD)} AND NOT {_low(2, GOODS_SUM)}), lambda p, i: {{'stt': CAST(i AS INTEGER), 'ten_hang': p[2], 'dvt': p[3], 'so_luong': {duck_amount("p[4]")}, 'don_gia': CASE WHEN len(p) > 4 THEN {duck_amount("p[5]")} END, 'thanh_tien': CASE WHEN len(p) > 5 THEN {duck_amount("p[-1]")} END}})""",
    "contract": f"""list_transform(list_filter(ps, lambda p: len(p) >= 3 AND NOT {_low(1, SERVICE_HEAD)} AND NOT {_low(2, SERVICE_SUM)}), lambda p, i: {{'stt': CAST(i AS INTEGER), 'ten_dich_vu': p[2], 'thoi_han': p[3], 'thanh_tien': {duck_amount("p[-1]")}}})""",
    "voucher": f"""list_transform(list_filter(ps, lambda p: len(p) >= 3 AND NOT {_low(1, ASSET_HEAD)}), lambda p, i: {{'stt': CAST(p[1] AS DOUBLE), 'ten_tai_san': p[2], 'so_serial': regexp_extract_all(array_to_string(list_filter(p[3:], lambda x: contains(x, 'S/N:')), '|'), '{SERIAL}', 1),
      'dvt': coalesce(list_filter(p[3:], lambda x: x IN ('Cái', 'Bộ'))[1], ''), 'so_luong': CAST(list_filter(p[3:], lambda x: regexp_full_match(x, '[0-9]+'))[1] AS INTEGER),
      'tinh_trang': coalesce(list_filter(p[3:], lambda x: length(x) > 10 AND NOT contains(x, 'S/N:'))[1], '')}})""",
}


def _sql_text(*same: str, **of: str) -> str:
    return ", ".join(f"'{n}': coalesce({c}, '')" if c else f"'{n}': ''" for n, c in ({x: x for x in same} | of).items())


def _sql_side(role: str, **of: str) -> str:
    return f"{{'vai_tro': '{role}', {_sql_text(**(dict.fromkeys(('ten_to_chuc', 'dai_dien', 'chuc_vu', 'mst', 'dia_chi', 'dien_thoai', 'email', 'so_tai_khoan', 'ngan_hang'), '') | of))}}}"


def _sql_unit(**of: str) -> str:
    return "{" + _sql_text(**(dict.fromkeys(("ten_don_vi", "dai_dien", "chuc_vu", "can_bo_ky_thuat", "mst"), "") | of)) + "}"


_no, _nil = "CAST([] AS VARCHAR[])", "CAST(NULL AS DOUBLE)"
_DATA = {
    "invoice": f"""{{{_sql_text('so_hoa_don', 'ky_hieu', 'mau_so', 'ngay_hoa_don', 'ma_cqt', 'ma_tra_cuu')}, 'ben_ban': {{{_sql_text(ten='ban_ten', mst='ban_mst', dia_chi='ban_dia_chi', so_tai_khoan='ban_so_tai_khoan', ngan_hang='', dien_thoai='')}}},
  'ben_mua': {{{_sql_text(ten='mua_ten', mst='mua_mst', dia_chi='', nguoi_mua_hang='nguoi_mua_hang', dien_thoai='')}}}, 'danh_sach_hang_hoa': @items,
  'tai_chinh': {{'tien_chua_thue': tien_chua_thue, 'thue_suat': thue_suat, 'tien_thue_gtgt': tien_thue_gtgt, 'tong_tien_thanh_toan': tong_tien_thanh_toan, {_sql_text('so_tien_bang_chu')}, 'loai_tien': 'VND', {_sql_text('hinh_thuc_thanh_toan')}}}, 'ghi_chu': {_no}}}""",
    "contract": f"""{{{_sql_text('so_hop_dong', 'tieu_de', 'ngay_ky', ngay_hieu_luc='ngay_ky')}, 'ben_a': {_sql_side('Bên A', ten_to_chuc='a_ten_to_chuc', dai_dien='a_dai_dien', mst='a_mst')},
  'ben_b': {_sql_side('Bên B', ten_to_chuc='b_ten_to_chuc', mst='b_mst', so_tai_khoan='b_so_tai_khoan', ngan_hang='b_ngan_hang')}, 'gia_tri_hop_dong': {{'tong_tien': tong_tien, 'tien_chua_vat': {_nil}, 'tien_vat': {_nil}, 'loai_tien': 'VND', {_sql_text('hinh_thuc_thanh_toan')}}},
  'dich_vu_chinh': @items, 'thoi_han_hop_dong': '', 'dieu_khoan_quan_trong': {{'gia_han': '{RENEWAL}', 'dieu_kien_cham_dut': '', 'giai_quyet_tranh_chap': '{DISPUTES}'}}, 'nguoi_ky': {_no}}}""",
    "voucher": f"""{{{_sql_text('loai_chung_tu', 'so_chung_tu', 'ngay_lap', 'can_cu', 'dia_diem')}, 'ben_giao': {_sql_unit(ten_don_vi='giao_ten_don_vi', dai_dien='giao_dai_dien')}, 'ben_nhan': {_sql_unit(ten_don_vi='nhan_ten_don_vi')}, 'danh_muc_tai_san': @items,
  {_sql_text('thoi_han_bao_hanh')}, 'ho_so_kem_theo': {_no}, 'nghia_vu_thanh_toan': {{'tong_gia_tri': tong_gia_tri, 'da_thanh_toan': tong_gia_tri, 'con_lai': {_nil}, 'chi_tiet_dot': {_no}}}, {_sql_text('ket_luan')}, 'nguoi_ky': {_no}}}""",
    "bank_transfer": f"""{{'trang_thai': trang_thai, 'so_tien': so_tien, 'loai_tien': 'VND', {_sql_text('thoi_gian_giao_dich', 'ma_giao_dich')}, 'nguoi_nhan': {{{_sql_text('ho_ten', 'so_tai_khoan', 'ngan_hang')}}},
  'nguoi_gui': {{{_sql_text(ho_ten='', so_tai_khoan='', ngan_hang='')}}}, {_sql_text('noi_dung')}, 'phi_giao_dich': CAST(0 AS DOUBLE)}}""",
    "generic": f"""{{{_sql_text('title', 'document_number', 'date')}, 'organizations': {_no}, 'people': {_no}, 'amounts': coalesce(list_sort(list_distinct(list_transform(string_split(nullif(amounts, ''), ';'), lambda a: {duck_amount("a")}))), []), 'dates': string_split(dates, ';'),
  'identifiers': {_no}, 'key_information': {_no}, {_sql_text('description')}}}""",
}
_FLAT = {"invoice": ex.SQL_INVOICE, "contract": ex.SQL_CONTRACT, "voucher": ex.SQL_VOUCHER, "bank_transfer": ex.SQL_TRANSFER, "generic": ex.SQL_GENERIC}


def _record_sql(kind: str) -> str:
    if kind not in _ITEMS:
        return f"SELECT id, {_DATA[kind]} AS data FROM ({_FLAT[kind]})"
    return f"WITH {_TABLES}, its AS (SELECT id, {_ITEMS[kind]} AS its FROM parts) SELECT f.id, {_DATA[kind].replace('@items', 'coalesce(its, [])')} AS data FROM ({_FLAT[kind]}) f LEFT JOIN its ON its.id = f.id"


#: Fields for number, date, serial, first party, its code and account, second party, its code, VAT, total and payment.
_PLACES = {
    "invoice": ("invoice_number", "issue_date", "serial", "seller_name", "seller_tax_code", "", "buyer_name", "buyer_tax_code", "vat_amount", "total_amount", ""),
    "contract": ("contract_number", "sign_date", "", "party_a", "", "", "party_b", "", "", "total_amount", ""),
    "voucher": ("doc_number", "issue_date", "", "", "", "", "", "", "", "amount", ""),
    "bank_transfer": ("account_number", "transaction_date", "", "bank_name", "", "account_number", "receiver_name", "", "", "amount", "transfer_content"),
}
_PAIRS = """list_transform(list_filter(list_transform(ls, lambda t, i: {'i': i, 't': t, 'k': trim(regexp_extract(t, '@', 1)), 'v': trim(regexp_extract(t, '@', 2))}),
  lambda q: regexp_matches(q.t, '@') AND NOT (regexp_full_match(q.k, '[0-9]{1,2}') AND regexp_full_match(q.v, '[0-9]{2}'))), lambda q: {'line_index': CAST(q.i AS INTEGER), 'key': q.k, 'value': q.v, 'raw_line': q.t})""".replace("@", tx.PAIR)


def _envelope_sql(kind: str) -> str:
    number, date, serial, one, one_code, account, two, two_code, vat, total, pay = (f"coalesce({c}, '')" if c else "''" for c in _PLACES[kind])
    party = lambda role, name, code, acc: f"{{'role': '{role}', 'name': {name}, 'tax_code': {code}, 'address': '', 'account_number': {acc}}}"
    fields = "map_from_entries(list_filter([" + ", ".join(f"{{'k': '{c}', 'v': coalesce({c}, '')}}" for c in ex.entity_names(kind)) + "], lambda e: e.v <> ''))"
    tabled = kind != "bank_transfer"
    tables = "CASE WHEN m IS NULL THEN [] ELSE [{'page': 1, 'sheet_name': CAST(NULL AS VARCHAR), 'headers': m[1], 'rows': m[2:], 'markdown': ''}] END" if tabled else "[]"
    entities = ex.ORACLES[f"entities_{kind}" if tabled else "entities_transfer"]
    return f"""WITH {_TABLES}, e AS ({entities}), x AS (SELECT id AS xid, text, {ex._LINES} AS ls FROM {fx.duck(KINDS[kind])})
SELECT e.id, {{'overview': {{'filename': '', 'category': '{sc.CATEGORIES[kind]}', 'document_type': 'unknown', 'source_type': 'unknown', 'total_pages': 1, 'has_table': {"m IS NOT NULL" if tabled else "false"}}},
  'metadata': {{'doc_number': {number}, 'issue_date': {date}, 'effective_date': '', 'serial_number': {serial}}}, 'parties': [{party(FROM_ROLE, one, one_code, account)}, {party(TO_ROLE, two, two_code, "''")}],
  'financials': {{'currency': 'VND', 'vat_amount': {vat}, 'total_amount': {total}, 'amount_in_words': '', 'payment_method': {pay}}}, 'key_value_pairs': {_PAIRS}, 'important_fields': {fields},
  'tables': {tables}, 'full_text': text}} AS envelope FROM e JOIN x ON xid = e.id{" LEFT JOIN lists ON lists.id = e.id" if tabled else ""}"""


def _payload_sql(kind: str, category: str) -> str:
    meta = f"{{'file_name': '', 'category': '{category}', 'source_type': CAST(NULL AS VARCHAR), 'total_pages': 1}}"
    return f"SELECT id, '{category}' AS category, CAST(to_json({{'document_type': '{category}', 'file_metadata': {meta}, 'data': data}}) AS VARCHAR) AS payload FROM ({_record_sql(kind)})"


ORACLES = {f"record_{k}": f"SELECT id, CAST(to_json(data) AS VARCHAR) AS data FROM ({_record_sql(k)})" for k in KINDS}
ORACLES |= {f"payload_{k}": _payload_sql(k, c) for k, c in sc.CATEGORIES.items()}
ORACLES |= {f"envelope_{k}": f"SELECT id, CAST(to_json(envelope) AS VARCHAR) AS envelope FROM ({_envelope_sql(k)})" for k in sc.CATEGORIES}
