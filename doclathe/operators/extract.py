"""Key information from document texts: patterns as data, one struct or flat row a document.

A field is the first match of its first pattern that matches, cleaned. The same catalogue
makes the Spark columns and the SQL they are compared with.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import fixtures as fx
from .text_queries import duck_amount, duck_date

AMOUNT = r"([\d\[.,]+)"
SHORT_AMOUNT = r"([\d\[.,]{4,15})"
DATE = r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})"
LONG_DATE = r"Ngày\s*\(?date\)?\s*(\d{1,2})\s*tháng\s*\(?month\)?\s*(\d{1,2})\s*năm\s*\(?year\)?\s*(\d{4})"
PLAIN_LONG_DATE = r"Ngày\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})"
SEP = r"\s*[:\-]?\s*"


def tax(words: str) -> str:
    return rf"(?:{words}){SEP}(\d{{10}}(?:\-\d{{3}})?)"


@dataclass(frozen=True)
class Field:
    """Patterns in turn, what becomes of the match, and which group or which of several matches it is."""

    patterns: tuple[str, ...]
    clean: str = "text"  # text, trim, paren, words, white, amount, int, iso, or dmy
    nth: int = 1
    group: int = 1
    case: bool = False


def one(pattern: str, clean: str = "text", **more) -> Field:
    return Field((pattern,), clean, **more)


def label(words: str, value: str = r"(.+)", clean: str = "trim", **more) -> Field:
    return one(f"(?:{words}){SEP}{value}", clean, **more)


# Labels as they stand in documents.
INVOICE = {
    "so_hoa_don": label(r"Số|No\.|Số hóa đơn|Số HĐ", r"(\d+)", "text"),
    "ky_hieu": label("Ký hiệu|Serial|Ký hiệu hóa đơn", r"([A-Z0-9/]+)", "text"),
    "mau_so": label("Mẫu số|Mẫu", r"([A-Z0-9/]+)", "text"),
    "ngay_hoa_don": Field((LONG_DATE, rf"Ngày\s*{DATE}"), "iso"),
    "ma_cqt": label("Mã của cơ quan thuế|Mã CQT", r"([A-Z0-9]+)", "text"),
    "ma_tra_cuu": label("Mã số bí mật|Mã tra cứu|Mã tra cứu hóa đơn", r"([A-Za-z0-9]+)", "text"),
    "ban_mst": one(tax("Mã số thuế|Tax code|MST")),
    "mua_mst": one(tax("Mã số thuế|Tax code|MST"), nth=2),
    "ban_ten": label("Đơn vị bán hàng|Issued|Bên bán|Tên đơn vị bán"),
    "ban_dia_chi": label(r"Địa chỉ \(Address\)|Địa chỉ"),
    "ban_so_tai_khoan": label("Số tài khoản|Account No", r"(\d{8,20})", "text"),
    "mua_ten": label("Tên đơn vị|Company|Bên mua|Người mua hàng|Đơn vị mua hàng"),
    "nguoi_mua_hang": label("Họ tên người mua hàng|Customer|Người mua hàng"),
    "tien_chua_thue": label("Cộng tiền hàng|Subtotal|Tiền hàng", AMOUNT, "amount"),
    "thue_suat": label("Thuế suất GTGT|VAT rate", r"(\d{1,2})\s*%", "int"),
    "tien_thue_gtgt": label("Tiền thuế GTGT|VAT amount|Thuế GTGT", AMOUNT, "amount"),
    "tong_tien_thanh_toan": label("Tổng cộng tiền thanh toán|Total payment|Tổng tiền thanh toán|Tổng thanh toán", AMOUNT, "amount"),
    "so_tien_bang_chu": label("Số tiền viết bằng chữ|Amount in words|Bằng chữ", clean="words"),
}
CONTRACT = {
    "so_hop_dong": Field((rf"(?:Mã hợp đồng|Hợp đồng số|Số HĐ|HĐ số|Mã HĐ|Contract No){SEP}([A-Za-z0-9/_\-]{{3,}})", r"(\d{4,}/\d{4}\-[A-Z0-9]+)")),
    "ngay_ky": one(PLAIN_LONG_DATE, "iso"),
    "a_ten_to_chuc": label(r"Bên thuê dịch vụ \(Bên A\)|Bên A \(Bên mua\)|Bên A", r"([^\n]+)"),
    "a_dai_dien": one(rf"(?:Người đại diện|Đại diện){SEP}([^\n]+?)(?:Chức vụ|\z)", "trim"),
    "a_mst": one(tax("Mã số doanh nghiệp|Mã số thuế|MST")),
    "b_mst": one(tax("Mã số doanh nghiệp|Mã số thuế|MST"), nth=2),
    "b_ten_to_chuc": label(r"Bên cung cấp dịch vụ \(Bên B\)|Bên B \(Bên bán\)|Bên B", r"([^\n]+)"),
    "b_so_tai_khoan": one(rf"Tài khoản ngân hàng{SEP}(\d+)\s*\-\s*([^\-]+?)(?:\-|\z|\n)"),
    "b_ngan_hang": one(rf"Tài khoản ngân hàng{SEP}(\d+)\s*\-\s*([^\-]+?)(?:\-|\z|\n)", "trim", group=2),
    "tong_tien": one(rf"(?:Tổng cộng thanh toán|Tổng giá trị|Giá trị hợp đồng)\s*(?:\(VND\))?{SEP}{AMOUNT}", "amount"),
}
VOUCHER = {
    "so_chung_tu": label(r"Số PXK|Số CT|Số BBBG|Số BBTL|Số|No\.", r"([A-Za-z0-9/_\-]{3,})", "text"),
    "ngay_lap": Field((LONG_DATE, DATE), "iso"),
    "can_cu": one(rf"((?:Căn cứ theo|Căn cứ|Kèm theo){SEP}[^\n)]+)", "paren"),
    "dia_diem": label("tại|Địa điểm giao nhận|Kho xuất", r"([^\n]+)"),
    "giao_ten_don_vi": label(r"BÊN GIAO \(BÊN A\)|BÊN A \(BÊN BÁN\)|BÊN GIAO|Đơn vị xuất", r"([^\n]+)"),
    "nhan_ten_don_vi": label(r"BÊN NHẬN \(BÊN B\)|BÊN B \(BÊN MUA\)|BÊN NHẬN|Đơn vị nhận|Người nhận hàng", r"([^\n]+)"),
    "giao_dai_dien": one(rf"(?:Đại diện bên giao|Đại diện){SEP}(?:Ông|Bà)?\s*([^\n]+?)(?:Chức vụ|\z)", "trim"),
    "thoi_han_bao_hanh": one(r"(\d+\s*tháng(?:\s*\(đến\s*[\d/\-]+\))?)"),
    "ket_luan": label("Kết luận|Kết luận chung"),
    "tong_gia_tri": one(rf"(?:tổng số tiền|giá trị hợp đồng là)\s*{AMOUNT}\s*VNĐ", "amount"),
}
# Kinds of vouchers by their words, banks, and what is no person's name.
VOUCHER_TYPES = (("BIÊN BẢN BÀN GIAO", "bien_ban_ban_giao_nghiem_thu"), ("NGHIỆM THU", "bien_ban_ban_giao_nghiem_thu"), ("PHIẾU XUẤT KHO", "phieu_xuat_kho"), ("THANH LÝ", "bien_ban_thanh_ly"), ("PHIẾU THU", "phieu_thu"), ("PHIẾU CHI", "phieu_chi"))
TRANSFER = {
    "so_tien": Field((rf"{SHORT_AMOUNT}\s*(?:đ|VND|VNĐ|đồng)", r"(?m)^(\d{1,3}(?:[.,]\d{3})+)$", rf"(?:Số tiền|Giao dịch thành công){SEP}{SHORT_AMOUNT}"), "amount"),
    "ma_giao_dich": label("Mã giao dịch|Mã GD|FT|Transaction ID|Ref No|Số tham chiếu", r"([A-Za-z0-9]{6,25})", "text"),
    "gio": one(rf"(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)\s*[\-–]\s*{DATE}"),
    "ngay": one(DATE, "iso"),
    "ten_nguoi_nhan": label("Người nhận|Tên người nhận|Đến tài khoản", r"([^\n]+)"),
    "so_tai_khoan": label("Số thẻ/TK|Số tài khoản|Số TK|Tài khoản nhận", r"([A-Za-z0-9]{6,20})", "text"),
    "noi_dung": label("Nội dung|Lời nhắn|Chi tiết giao dịch", r"([^\n]+)"),
}
BANKS = ("Vietcombank", "Techcombank", "MBBank", "MB", "BIDV", "VietinBank", "TPBank", "VPBank", "Agribank", "ACB", "Sacombank", "VIB")
MORE_BANKS = ("Techcombank", "TCB", "Vietcombank", "VCB", "MB", "MBBank", "BIDV", "VietinBank", "TPBank", "VPBank", "Agribank", "ACB", "Sacombank")
# Fixed values. The older set, whose dates stay day first and whose amounts stay as written.
ENTITIES = {
    "invoice": {
        "invoice_number": label(r"Số|No\.", r"(\d+)", "text"),
        "serial": label("Ký hiệu|Serial", "([A-Z0-9]+)", "text"),
        "issue_date": Field((LONG_DATE, rf"Ngày\s*{DATE}"), "dmy"),
        "seller_tax_code": one(tax("Mã số thuế|Tax code|MST")),
        "buyer_tax_code": one(tax("Mã số thuế|Tax code|MST"), nth=2),
        "seller_name": label("Đơn vị bán hàng|Issued|Bên bán", clean="white"),
        "buyer_name": label("Tên đơn vị|Company|Bên mua", clean="white"),
        "total_amount": label("Tổng cộng tiền thanh toán|Total payment|Tổng tiền thanh toán", AMOUNT, "text"),
        "vat_amount": label("Tiền thuế GTGT|Vat amount", AMOUNT, "text"),
    },
    "contract": {
        "contract_number": Field((rf"(?:Mã hợp đồng|Hợp đồng số|Số HĐ|HĐ số){SEP}([A-Z0-9/_\-]{{5,}})", r"(\d{5,}/\d{4}\-[A-Z0-9]+)")),
        "sign_date": one(PLAIN_LONG_DATE, "dmy"),
        "party_a": one(rf"(?:Bên thuê dịch vụ|Bên A)\s*(?:\(Bên A\))?{SEP}(.+)", "trim"),
        "party_b": one(rf"(?:Bên cung cấp dịch vụ|Bên B)\s*(?:\(Bên B\))?{SEP}(.+)", "trim"),
        "total_amount": one(rf"(?:Tổng cộng thanh toán|Tổng giá trị|Tổng tiền thanh toán)\s*(?:\(VND\))?{SEP}{AMOUNT}"),
    },
    "voucher": {
        "doc_number": label(r"Số|No\.", r"([A-Z0-9/_\-]+)", "text"),
        "issue_date": one(DATE),
        "amount": label("Số tiền|Amount", AMOUNT, "text"),
    },
    "transfer": {
        "transaction_date": one(DATE),
        "transaction_time": one(r"(\d{1,2}[:.]\d{2}(?:[:.]\d{2})?)"),
        "account_number": one(r"(?:tài khoản|stk|account|token)?\s*(\d{8,15})"),
        "transfer_content": label("Nội dung|lời nhắn|chuyen|chuyển", clean="white"),
    },
}
GENERIC = {"document_number": label(r"Mã tài sản|Mã số|Số hiệu|Số|No\.", r"([A-Za-z0-9/_\-Đđ]+)", "text")}
PERSON_STOPS = ("công ty", "tnhh", "cổ phần", "đơn vị")
CAPITAL_LINE = r"[A-Z\s]{5,35}"
CAPITAL_STOPS = ("VND", "VCB", "VIETCOMBANK", "GIAO DICH", "DIGIBANK")


def _cases() -> dict[str, str]:
    """Of each character, all that a pattern takes for it without regard to case: those of one lower form of the upper form, and some more."""
    same: dict[str, set[str]] = {}
    for cp in (*range(0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000), 0x2126, 0x212A, 0x212B):
        c = chr(cp)
        for folded in {c.upper().lower()[0], c.lower()[0], c.upper()[0].lower()[0]}:
            same.setdefault(folded, set()).add(c)
    return {c: "".join(sorted(set().union(*(m for m in same.values() if c in m)))) for c in set().union(*same.values())}


_CASES = _cases()
#: Words between bars at a pattern's beginning, in a group or the alternatives of one, or a run of letters.
_WORDS = re.compile(r"\(?\(\?:(?P<words>(?:[^()\[\]?*+{}\\]|\\.)*)\)(?![?*{])|(?P<one>\w+)(?![?*{])")


def words_of(pattern: str) -> list[str]:
    """The words of which one stands at each match's beginning, in lower case, none of them the beginning of another; none if they aren't plain."""
    m, bare = _WORDS.match(pattern), re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    while bare != (bare := re.sub(r"\([^()]*\)", "", bare)):
        pass
    if not m or "|" in bare:
        return []
    words = {re.sub(r"\\([^\w\s])", r"\1", w).lower() for w in (m["words"] or m["one"] or "").split("|")}
    if any(not w or "\\" in w for w in words) or re.search(r"(?<!\\)[.^$]", m[0]):
        return []
    return sorted(w for w in words if not any(w != v and w.startswith(v) for v in words))


def begun(pattern: str) -> str:
    """A pattern that begins with one of some words, and first looks whether a character begins one: most don't, and are passed at once."""
    firsts = {w[:1] for w in words_of(pattern)}
    if not firsts or not all(c.isalpha() and c in _CASES for c in firsts):
        return pattern
    return f"(?=(?-iU:[{''.join(sorted({x for c in firsts for x in _CASES[c]}))}])){pattern}"


def _numbers(f: Field, pattern: str) -> bool:
    """Whether a date is made of a match's numbers; the older set leaves short dates as written."""
    return f.clean == "iso" or (f.clean == "dmy" and pattern in (LONG_DATE, PLAIN_LONG_DATE))


def _prepared(raw: Column, f: Field, pattern: str) -> Column:
    """What cleaning needs more than once of a match: digits and marks of amounts, the numbers of dates."""
    if f.clean == "amount":
        return tx.amount_marks(raw)
    return F.regexp_extract_all(raw, F.lit(tx.java(r"\d+", False)), F.lit(0)) if _numbers(f, pattern) else raw


def _spark_clean(x: Column, f: Field, pattern: str) -> Column:
    """A prepared match as its field's value. Dates have three numbers, day first."""
    if _numbers(f, pattern):
        d, m, y = (F.get(x, F.lit(i)) for i in range(3))
        day, month = F.lpad(d, 2, "0"), F.lpad(m, 2, "0")
        if f.clean == "iso":
            return F.concat_ws("-", y, month, day)
        return F.concat_ws("/", day, month, y)
    return {"text": x, "trim": tx.strip(x, ":\\-"), "paren": tx.strip(x, "()"), "words": tx.strip(x, ":.\\-"), "white": tx.strip(x), "amount": tx.amount_of(x), "int": x.try_cast("int"), "dmy": x}[f.clean]


def _lowered(x: Column, low: Column, words: Iterable[str]) -> Column:
    """`low`, the text in lower case, character by character, where words are found as patterns find them; null for text with a character that a pattern takes for a letter whose lower form it doesn't have."""
    odd = sorted({c for w in words for a in w for c in _CASES.get(a, a) if c.lower() != a})
    return F.when((F.length(low) == F.length(x)) & ~reduce(or_, [F.contains(x, F.lit(c)) for c in odd], F.lit(False)), low)


def _first_at(low: Column, words: tuple[str, ...]) -> Column:
    """Where the first of the words stands, null if none does; 1 if the text wasn't lowered."""
    at = [F.when(F.contains(low, F.lit(w)), F.instr(low, F.lit(w))) for w in words]
    return F.when(low.isNull(), 1).otherwise(F.least(*at) if len(at) > 1 else at[0])


def _raw(x: Column, f: Field, pattern: str) -> Column:
    """What one pattern finds: a group, or all of it for a date of several groups; null if it doesn't match."""
    java = tx.java(begun(pattern), not f.case)
    group = 0 if pattern in (LONG_DATE, PLAIN_LONG_DATE) else f.group
    if f.nth > 1:
        return F.get(F.regexp_extract_all(x, F.lit(java), F.lit(group)), f.nth - 1)
    return F.nullif(F.regexp_extract(x, java, group), F.lit(""))


def extract(docs: DataFrame, fields: dict[str, Field], text: str = "text") -> DataFrame:
    """The fields of a text column beside all columns; null where nothing matches.

    A pattern that begins with one of some words meets a text from the first of them on, and
    not at all without; words are looked for in the text's lower case, once for all fields.
    Each pattern meets each text once: one projection holds what they find, the next what
    cleaning names more than once, and the last cleans it, first pattern first.
    """
    found = {(n, i): f"_{n}_{i}" for n, f in fields.items() for i in range(len(f.patterns))}
    words = {k: tuple(words_of(fields[k[0]].patterns[k[1]])) for k in found}
    at = {w: f"_at_{i}" for i, w in enumerate(dict.fromkeys(w for w in words.values() if w))}
    rest = lambda k: F.substr(F.col(text), F.col(at[words[k]])) if words[k] else F.col(text)
    low = docs.withColumn("_low", F.lower(text)).withColumn("_low", _lowered(F.col(text), F.col("_low"), {x for w in at for x in w}))
    placed = low.select(*docs.columns, *[_first_at(F.col("_low"), w).alias(c) for w, c in at.items()])
    raw = placed.select(*docs.columns, *[_raw(rest((n, i)), fields[n], fields[n].patterns[i]).alias(c) for (n, i), c in found.items()])
    ready = raw.select(*docs.columns, *[_prepared(F.col(c), fields[n], fields[n].patterns[i]).alias(c) for (n, i), c in found.items()])
    out = []
    for n, f in fields.items():
        value = F.lit(None)
        for i in reversed(range(len(f.patterns))):
            c = F.col(found[n, i])
            value = F.when(c.isNotNull(), _spark_clean(c, f, f.patterns[i])).otherwise(value)
        out.append(value.alias(n))
    return ready.select(*docs.columns, *out)


def first_of(x: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that stands in the text as a word."""
    return F.coalesce(*[F.when(F.rlike(x, F.lit(tx.java(rf"\b{w}\b"))), w) for w in words])


def invoice_fields(docs: DataFrame) -> DataFrame:
    """The columns of docs and the fields of an invoice."""
    out = extract(docs, INVOICE)
    company = F.rlike(F.lower("nguoi_mua_hang"), F.lit("|".join(PERSON_STOPS)))
    pay = F.when(F.rlike(F.lower("text"), F.lit("chuyển khoản|ck")), "Chuyển khoản (TM/CK)")
    return out.withColumns({"nguoi_mua_hang": F.when(~company, F.col("nguoi_mua_hang")), "hinh_thuc_thanh_toan": pay})


def invoice(docs: DataFrame) -> DataFrame:
    return invoice_fields(docs).select("id", *INVOICE, "hinh_thuc_thanh_toan")


#: What a line's upper case has if it is a title, without regard to case: the upper case of ẗ begins with T.
TITLE = "(?iu)hợp đồng|hop dong|agreemen[tẗ]"


def contract_fields(docs: DataFrame) -> DataFrame:
    """The columns of docs and the fields of a contract."""
    out = extract(docs, CONTRACT)
    titles = F.filter(F.slice(tx.lines(F.col("text")), 1, 10), lambda x: F.rlike(x, F.lit(TITLE)))
    pay = F.when(F.contains(F.lower("text"), F.lit("chuyển khoản")), "Chuyển khoản ngân hàng")
    return out.withColumns({"tieu_de": F.coalesce(F.get(titles, F.lit(0)), F.lit("HỢP ĐỒNG KINH TẾ")), "hinh_thuc_thanh_toan": pay})


def contract(docs: DataFrame) -> DataFrame:
    return contract_fields(docs).select("id", "tieu_de", *CONTRACT, "hinh_thuc_thanh_toan")


def voucher_fields(docs: DataFrame) -> DataFrame:
    """The columns of docs and the fields of a voucher."""
    kind = F.lit("chung_tu_khac")
    for word, name in reversed(VOUCHER_TYPES):
        kind = F.when(F.contains("_upper", F.lit(word)), name).otherwise(kind)
    return extract(docs, VOUCHER).withColumn("_upper", F.upper("text")).withColumn("loai_chung_tu", kind).drop("_upper")


def voucher(docs: DataFrame) -> DataFrame:
    return voucher_fields(docs).select("id", "loai_chung_tu", *VOUCHER)


def transfer_fields(docs: DataFrame) -> DataFrame:
    """The columns of docs and the fields of a bank transfer."""
    out = extract(docs, TRANSFER)
    low = F.lower("text")
    has = lambda w: F.contains(low, F.lit(w))
    state = F.when(has("thành công"), "thanh_cong").when(has("thất bại"), "that_bai").when(has("đang xử lý") | has("chờ"), "dang_xu_ly").otherwise("thanh_cong")
    named = lambda y: F.rlike(y, F.lit(tx.java(f"^{CAPITAL_LINE}$", False))) & ~F.rlike(y, F.lit("|".join(CAPITAL_STOPS)))
    capitals = F.get(F.filter(tx.lines(F.col("text")), named), F.lit(0))
    when = F.when(F.col("gio").isNotNull(), F.concat_ws(" ", "ngay", "gio")).otherwise(F.col("ngay"))
    cols = {"trang_thai": state, "ngan_hang": first_of(F.col("text"), BANKS), "ho_ten": F.coalesce(F.nullif("ten_nguoi_nhan", F.lit("")), capitals), "thoi_gian_giao_dich": when}
    return out.withColumns(cols)


def transfer(docs: DataFrame) -> DataFrame:
    return transfer_fields(docs).select("id", "trang_thai", "so_tien", "ma_giao_dich", "thoi_gian_giao_dich", "ho_ten", "so_tai_khoan", "ngan_hang", "noi_dung")


def generic_fields(docs: DataFrame) -> DataFrame:
    """The columns of docs and title, all distinct dates and amounts (sorted), number and beginning of any text."""
    x = F.col("text")
    dates = F.regexp_extract_all(x, F.lit(tx.java(DATE)), F.lit(1))
    amounts = F.regexp_extract_all(x, F.lit(tx.java(rf"{SHORT_AMOUNT}\s*(?:VND|VNĐ|đồng)")), F.lit(1))
    return extract(docs, GENERIC).withColumns({
        "title": F.get(tx.lines(x), F.lit(0)), "date": tx.clean_date(F.get(dates, F.lit(0))), "dates": F.array_sort(F.array_distinct(dates)), "amounts": F.array_sort(F.array_distinct(amounts)),
        "description": F.when(F.length(x) > 200, F.concat(F.substring(x, 1, 200), F.lit("..."))).otherwise(x),
    })


def generic(docs: DataFrame) -> DataFrame:
    joined = [F.array_join(c, ";").alias(c) for c in ("dates", "amounts")]
    return generic_fields(docs).select("id", "title", "document_number", "date", *joined, "description")


#: What the older fields of a kind have besides its patterns.
MORE_ENTITIES = {"contract": ("articles",), "bank_transfer": ("amount", "bank_name", "receiver_name"), "generic": ("dates_found", "amounts_found")}


def entity_names(kind: str) -> list[str]:
    return [*ENTITIES.get("transfer" if kind == "bank_transfer" else kind, ()), *MORE_ENTITIES.get(kind, ())]


def entity_fields(docs: DataFrame, kind: str) -> DataFrame:
    """The columns of docs and the older flat fields of a kind: bank_transfer, invoice, contract, voucher or generic."""
    x = F.col("text")
    if kind == "generic":
        dates = F.regexp_extract_all(x, F.lit(tx.java(DATE)), F.lit(1))
        amounts = F.regexp_extract_all(x, F.lit(tx.java(r"([\d\[.,]{5,15})\s*(?:VND|VNĐ|đồng)")), F.lit(1))
        joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ";")
        return docs.withColumns({"dates_found": joined(dates), "amounts_found": joined(amounts)})
    out = extract(docs, ENTITIES["transfer" if kind == "bank_transfer" else kind])
    more: dict[str, Column] = {}
    if kind == "contract":
        more["articles"] = F.array_join(F.filter(tx.lines(x), lambda y: F.rlike(y, F.lit(r"^(?:ĐIỀU|Điều)\s+\d+[:.]?"))), ";")
    if kind == "bank_transfer":
        money = r"([\d\[.,]{4,15})"
        likely = lambda y: F.rlike(y, F.lit(r"^\d{1,3}([.,]\d{3})+$")) | (F.rlike(y, F.lit(r"\d")) & F.rlike(F.lower(y), F.lit("vnd|vnđ|chuyển|thành công")))
        enough = lambda y: F.length(F.translate(F.regexp_extract(y, money, 1), ".,", "")) >= 4
        found = F.filter(tx.lines(x), lambda y: likely(y) & enough(y))
        any_amount = F.nullif(F.regexp_extract(x, tx.java(rf"(?:Số tiền|VND|VNĐ|VND\s+)?{money}\s*(?:VND|VNĐ|đồng)?"), 1), F.lit(""))
        more["amount"] = F.coalesce(F.get(F.transform(found, lambda y: F.regexp_extract(y, money, 1)), F.lit(0)), any_amount)
        more["bank_name"] = first_of(x, MORE_BANKS)
        capital = lambda y: F.rlike(y, F.lit(r"^\p{Lu}+(\s+\p{Lu}+)+$")) & ~F.rlike(y, F.lit("VND|MB|TCB|VCB|CTK|STK"))
        more["receiver_name"] = F.get(F.filter(tx.lines(x), capital), F.lit(0))
    return out.withColumns(more) if more else out


def entities(docs: DataFrame, kind: str) -> DataFrame:
    """The older flat fields of a kind: transfer, invoice, contract, voucher or generic."""
    kind = "bank_transfer" if kind == "transfer" else kind
    return entity_fields(docs, kind).select("id", *entity_names(kind))


def structured_data(docs: DataFrame) -> DataFrame:
    """Number, date, parties and money of invoices: the first that isn't empty of either rule set, in one pass over the texts."""
    both = entity_fields(invoice_fields(docs), "invoice")
    pick = lambda *cs: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cs])
    return both.select("id", pick("so_hoa_don", "invoice_number").alias("number"), pick("ngay_hoa_don", "issue_date").alias("date"), pick("ban_ten", "seller_name").alias("seller"), pick("mua_ten", "buyer_name").alias("buyer"), F.col("tong_tien_thanh_toan").alias("total"))


def source_reference(pages: DataFrame, values: DataFrame) -> DataFrame:
    """First page and running line number (doc_id, value) where a value of two or more characters stands."""
    lines = pages.select("doc_id", "page", F.posexplode(tx.lines(F.col("page_text"))).alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pages.select("doc_id", "page", F.size(tx.lines(F.col("page_text"))).alias("n"))
    starts = sizes.select("doc_id", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    at = lines.join(starts, ["doc_id", "page"]).join(values.where(F.length("value") >= 2), "doc_id").where(F.contains("line", F.col("value")))
    best = at.groupBy("doc_id", "value").agg(F.min(F.struct("page", "pos", "skip")).alias("b"))
    return best.select("doc_id", "value", F.col("b.page").alias("page"), (F.col("b.skip") + F.col("b.pos") + 1).cast("long").alias("line"))


# SQL from the same catalogue


def _duck_clean(x: str, raw: str, f: Field, pattern: str) -> str:
    p = f"(?i){pattern}".replace("'", "''")
    if f.clean in ("iso", "dmy") and pattern in (LONG_DATE, PLAIN_LONG_DATE):
        if f.clean == "iso":
            return duck_date(x, p, (3, 2, 1))
        return f"lpad(regexp_extract({x}, '{p}', 1), 2, '0') || '/' || lpad(regexp_extract({x}, '{p}', 2), 2, '0') || '/' || regexp_extract({x}, '{p}', 3)"
    day = duck_date(raw, tx.DAY_FIRST, (3, 2, 1))
    return {"text": raw, "trim": f"trim({raw}, ' :-' || chr(10))", "paren": f"trim({raw}, ' ()' || chr(10))", "words": f"trim({raw}, ' :.-' || chr(10))", "white": f"trim({raw})", "amount": duck_amount(raw), "int": f"try_cast({raw} AS INTEGER)", "iso": f"coalesce({day}, {raw})", "dmy": raw}[f.clean]


def duck_field(f: Field, x: str = "text") -> str:
    whens = []
    for p in f.patterns:
        re2 = ("" if f.case else "(?i)") + p.replace("'", "''")
        if f.nth > 1:
            raw = f"regexp_extract_all({x}, '{re2}', {f.group})[{f.nth}]"
            return f"nullif({_duck_clean(x, raw, f, p)}, '')"
        whens.append(f"WHEN regexp_matches({x}, '{re2}') THEN {_duck_clean(x, f'''regexp_extract({x}, '{re2}', {f.group})''', f, p)}")
    return f"CASE {' '.join(whens)} END"


def duck_fields(fields: dict[str, Field]) -> str:
    return ", ".join(f"{duck_field(f)} AS {n}" for n, f in fields.items())


def _duck_first(words: tuple[str, ...]) -> str:
    return f"CASE {' '.join(f'''WHEN regexp_matches(text, '(?i)\\b{w}\\b') THEN '{w}' ''' for w in words)} END"


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(y)), lambda y: y <> '')"
_INV, _CON, _VOU, _TRA = (fx.duck(k) for k in (fx.invoice_texts, fx.contract_texts, fx.voucher_texts, fx.transfer_texts))


def _q(fixture, f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: f(fx.rows(spark, sf_dir, fixture))


def _references(spark, sf_dir):
    from .text_queries import pages_of

    pages = fx.rows(spark, sf_dir, pages_of)
    values = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("Foot "), F.col("lang")).alias("value"))
    return source_reference(pages, values)


QUERIES = {
    "kie_invoice": _q(fx.invoice_texts, invoice),
    "kie_contract": _q(fx.contract_texts, contract),
    "kie_voucher": _q(fx.voucher_texts, voucher),
    "kie_bank_transfer": _q(fx.transfer_texts, transfer),
    "kie_generic": _q(fx.transfer_texts, generic),
    "entities_invoice": _q(fx.invoice_texts, lambda d: entities(d, "invoice")),
    "entities_contract": _q(fx.contract_texts, lambda d: entities(d, "contract")),
    "entities_voucher": _q(fx.voucher_texts, lambda d: entities(d, "voucher")),
    "entities_transfer": _q(fx.transfer_texts, lambda d: entities(d, "transfer")),
    "entities_generic": _q(fx.transfer_texts, lambda d: entities(d, "generic")),
    "structured_data": _q(fx.invoice_texts, structured_data),
    "source_reference": _references,
}

_SORTED = "array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{0}', 1))), ';')"
SQL_INVOICE = f"SELECT id, * EXCLUDE (id, text, nguoi_mua_hang), CASE WHEN NOT regexp_matches(lower(nguoi_mua_hang), '{'|'.join(PERSON_STOPS)}') THEN nguoi_mua_hang END AS nguoi_mua_hang, CASE WHEN regexp_matches(lower(text), 'chuyển khoản|ck') THEN 'Chuyển khoản (TM/CK)' END AS hinh_thuc_thanh_toan FROM (SELECT *, {duck_fields(INVOICE)} FROM {_INV})"
SQL_CONTRACT = f"SELECT * EXCLUDE (text), coalesce(list_filter({_LINES}[1:10], lambda y: regexp_matches(upper(y), 'HỢP ĐỒNG|HOP DONG|AGREEMENT'))[1], 'HỢP ĐỒNG KINH TẾ') AS tieu_de, CASE WHEN contains(lower(text), 'chuyển khoản') THEN 'Chuyển khoản ngân hàng' END AS hinh_thuc_thanh_toan FROM (SELECT *, {duck_fields(CONTRACT)} FROM {_CON})"
SQL_VOUCHER = f"SELECT * EXCLUDE (text), CASE {' '.join(f'''WHEN contains(upper(text), '{a}') THEN '{b}' ''' for a, b in VOUCHER_TYPES)} ELSE 'chung_tu_khac' END AS loai_chung_tu FROM (SELECT *, {duck_fields(VOUCHER)} FROM {_VOU})"
SQL_TRANSFER = f"""SELECT id, so_tien, ma_giao_dich, so_tai_khoan, noi_dung, CASE WHEN contains(lower(text), 'thành công') THEN 'thanh_cong' WHEN contains(lower(text), 'thất bại') THEN 'that_bai' WHEN contains(lower(text), 'đang xử lý') OR contains(lower(text), 'chờ') THEN 'dang_xu_ly' ELSE 'thanh_cong' END AS trang_thai,
CASE WHEN gio IS NOT NULL THEN ngay || ' ' || gio ELSE ngay END AS thoi_gian_giao_dich, coalesce(nullif(ten_nguoi_nhan, ''), list_filter({_LINES}, lambda y: regexp_full_match(y, '{CAPITAL_LINE}') AND NOT regexp_matches(y, '{'|'.join(CAPITAL_STOPS)}'))[1]) AS ho_ten, {_duck_first(BANKS)} AS ngan_hang FROM (SELECT *, {duck_fields(TRANSFER)} FROM {_TRA})"""
SQL_GENERIC = f"SELECT id, {_LINES}[1] AS title, {duck_field(GENERIC['document_number'])} AS document_number, {duck_date(f'''regexp_extract(text, '{DATE}', 1)''', tx.DAY_FIRST, (3, 2, 1))} AS date, {_SORTED.format(DATE)} AS dates, {_SORTED.format('(?i)' + SHORT_AMOUNT + chr(92) + 's*(?:VND|VNĐ|đồng)')} AS amounts, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS description FROM {_TRA}"
_ENT = {k: f"SELECT * EXCLUDE (text) FROM (SELECT *, {duck_fields(v)} FROM {s})" for (k, v), s in zip(ENTITIES.items(), (_INV, _CON, _VOU, _TRA))}
_MONEY = "([0-9\\[.,]{4,15})"

ORACLES = {
    "kie_invoice": SQL_INVOICE,
    "kie_contract": SQL_CONTRACT,
    "kie_voucher": SQL_VOUCHER,
    "kie_bank_transfer": SQL_TRANSFER,
    "kie_generic": SQL_GENERIC,
    "entities_invoice": _ENT["invoice"],
    "entities_contract": f"SELECT * EXCLUDE (text), array_to_string(list_filter({_LINES}, lambda y: regexp_matches(y, '^(?:ĐIỀU|Điều)\\s+[0-9]+')), ';') AS articles FROM (SELECT *, {duck_fields(ENTITIES['contract'])} FROM {_CON})",
    "entities_voucher": _ENT["voucher"],
    "entities_transfer": f"""SELECT * EXCLUDE (text), coalesce(regexp_extract(list_filter({_LINES}, lambda y: (regexp_matches(y, '^[0-9]{{1,3}}([.,][0-9]{{3}})+$') OR (regexp_matches(y, '[0-9]') AND regexp_matches(lower(y), 'vnd|vnđ|chuyển|thành công'))) AND length(translate(regexp_extract(y, '{_MONEY}', 1), '.,', '')) >= 4)[1], '{_MONEY}', 1), nullif(regexp_extract(text, '(?i)(?:Số tiền|VND|VNĐ|VND\\s+)?{_MONEY}\\s*(?:VND|VNĐ|đồng)?', 1), '')) AS amount,
{_duck_first(MORE_BANKS)} AS bank_name, list_filter({_LINES}, lambda y: regexp_full_match(y, '\\p{{Lu}}+(\\s+\\p{{Lu}}+)+') AND NOT regexp_matches(y, 'VND|MB|TCB|VCB|CTK|STK'))[1] AS receiver_name FROM (SELECT *, {duck_fields(ENTITIES['transfer'])} FROM {_TRA})""",
    "entities_generic": f"SELECT id, {_SORTED.format(DATE)} AS dates_found, {_SORTED.format('(?i)([0-9' + chr(92) + '[.,]{5,15})' + chr(92) + 's*(?:VND|VNĐ|đồng)')} AS amounts_found FROM {_TRA}",
    "structured_data": f"SELECT a.id, coalesce(nullif(so_hoa_don, ''), invoice_number) AS number, coalesce(nullif(ngay_hoa_don, ''), issue_date) AS date, coalesce(nullif(ban_ten, ''), seller_name) AS seller, coalesce(nullif(mua_ten, ''), buyer_name) AS buyer, tong_tien_thanh_toan AS total FROM ({SQL_INVOICE}) a JOIN ({_ENT['invoice']}) b ON a.id = b.id",
}


def _reference_sql() -> str:
    from .text_queries import PG

    ls = "list_filter(list_transform(string_split(page_text, chr(10)), lambda y: trim(y)), lambda y: y <> '')"
    return f"""WITH p AS (SELECT doc_id, page, {ls} AS ls FROM {PG}), x AS (SELECT doc_id, page, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) AS line_no FROM x)
SELECT doc_id, 'Foot ' || lang AS value, arg_min(page, line_no) AS page, min(line_no) AS line FROM n JOIN documents USING (doc_id) WHERE contains(line, 'Foot ' || lang) GROUP BY doc_id, lang"""


ORACLES["source_reference"] = _reference_sql()
