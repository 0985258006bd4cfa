"""Weighted keyword classifier: rules as data, one summed CASE expression for each category."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.layout import bound, once
from ..plans import fixtures as fx

# Keywords (without accents, upper case) and file-name clues, with their points.
TRANSFER_WORDS = ("CHUYEN KHOAN THANH CONG", "GIAO DICH THANH CONG", "CHUYEN TIEN THANH CONG", "BIEN NHAN CHUYEN TIEN", "XAC NHAN CHUYEN TIEN", "THONG TIN CHUYEN KHOAN", "NOI DUNG CHUYEN KHOAN", "LENH CHUYEN TIEN", "UY NHIEM CHI", "SO THAM CHIEU", "MA GIAO DICH", "NGAN HANG THU HUONG", "TAI KHOAN THU HUONG", "VIETQR", "MOMO", "ZALOPAY", "MB BANK", "MBBANK", "PRIORITY", "TECHCOMBANK", "TCB", "XAC NHAN BOI MB", "CHUYEN KHOAN TT TOKEN")
TRANSFER_NAMES = ("chuyen_khoan", "chuyenkhoan", "chuyen_tien", "giao_dich", "bien_nhan", "ck_", "receipt", "vietcombank", "vcb", "digibank", "mb", "mbbank", "techcombank", "tcb")
BANK_NAMES = ("vietcombank", "vcb", "digibank")
TRANSFER_PAIRS = (("TAI KHOAN NHAN", "NGAN HANG NHAN"), ("SO TAI KHOAN NHAN", "TEN NGUOI NHAN"), ("GIAO DICH THANH CONG", "VND"))
CONTRACT_WORDS = ("HOP DONG", "CONG HOA XA HOI CHU NGHIA VIET NAM", "BIEN BAN GIAO NHAN", "CONTRACT", "AGREEMENT", "BEN A", "BEN B")
CONTRACT_NAMES = ("hop_dong", "hopdong", "hdmb", "hd", "contract", "agreement")
INVOICE_WORDS = ("HOA DON", "VAT INVOICE", "INVOICE", "MA SO THUE", "GTGT", "GIA TRI GIA TANG", "TEN DON VI BAN", "KY HIEU")
INVOICE_HEADER_ONLY = ("HOA DON", "GIA TRI GIA TANG")
INVOICE_NAMES = ("hoadon", "hoa_don", "invoice", "vat", "bill")
VOUCHER_WORDS = ("DON DAT HANG", "DON HANG", "CHUNG TU", "PHIEU XUAT KHO", "PHIEU NHAP KHO", "PHIEU THU", "PHIEU CHI", "SALES ORDER", "PURCHASE ORDER", "BAO CAO", "MA HD", "DOANH THU", "SO TIEN", "KHACH HANG", "STT")
VOUCHER_NAMES = ("so-", "chung_tu", "chungtu", "don_hang", "order", "excel", "report", "pxk", "pnk")
CITATIONS = r"LUAT\s+THUE\s+GIA\s+TRI\s+GIA\s+TANG|VE\s+HOA\s+DON"
#: In the order in which ties are decided.
CATEGORIES = ("hop_dong", "hoa_don", "chung_tu", "anh_chuyen_khoan")
FALLBACKS = (("HOP", "DONG"), ("HOA", "DON"), ("CHUNG", "TU"))
ENGLISH = {"hop_dong": "contract", "hoa_don": "invoice", "chung_tu": "voucher", "anh_chuyen_khoan": "bank_transfer"}

#: Codes, and English names as they are, with their English names.
DOCUMENT_TYPES = {**ENGLISH, **{v: v for v in ENGLISH.values()}, "khac": "unknown"}
REASONS = {
    "contract": "Tài liệu chứa các dấu hiệu đặc trưng hợp đồng như tiêu đề Hợp đồng, điều khoản, bên A, bên B, chữ ký.",
    "invoice": "Tài liệu chứa các trường đặc trưng hóa đơn như số hóa đơn, ký hiệu, ngày lập, thông tin người bán, người mua, thuế VAT.",
    "voucher": "Tài liệu chứa các trường chứng từ như loại chứng từ, đơn vị phát hành, số tiền, ngày chứng từ.",
    "bank_transfer": "Tài liệu là biên nhận/ảnh chuyển khoản ngân hàng chứa mã giao dịch, số tài khoản, số tiền, nội dung chuyển.",
    "unknown": "Bằng chứng từ văn bản chưa đủ căn cứ để gán loại tài liệu cụ thể.",
}

Rule = tuple[str, int]  # a condition as SQL over full, header, cited, name; its points


def _has(where: str, *words: str) -> str:
    return " OR ".join(f"contains({where}, '{w}')" for w in words)


def _else(words: tuple[str, ...], header: int, full: int, where: str = "header", only: tuple[str, ...] = ()) -> list[Rule]:
    """Points for a word in the header, else for the word in the text."""
    out = [(_has(where, w), header) for w in words]
    return out + [(f"NOT {_has(where, w)} AND {_has('full_text', w)}", full) for w in words if w not in only]


RULES: dict[str, list[Rule]] = {
    "hop_dong": [*_else(CONTRACT_WORDS, 40, 20), (_has("name", *CONTRACT_NAMES), 35), ("has_article", 25)],
    "hoa_don": [*_else(INVOICE_WORDS, 45, 20, "cited", INVOICE_HEADER_ONLY), (_has("name", *INVOICE_NAMES), 35)],
    "chung_tu": [*_else(VOUCHER_WORDS, 35, 15), (_has("name", *VOUCHER_NAMES), 35), ("(endswith(name, '.xlsx') OR endswith(name, '.xls'))", 20)],
    "anh_chuyen_khoan": [
        *[(_has("full_text", w), 45) for w in TRANSFER_WORDS],
        *[(_has("header", w), 20) for w in TRANSFER_WORDS],
        (_has("name", *TRANSFER_NAMES), 35),
        (_has("name", *BANK_NAMES), 20),
        *[(f"{_has('full_text', a)} AND {_has('full_text', b)}", 25) for a, b in TRANSFER_PAIRS],
        (f"({_has('full_text', 'SO TIEN', 'TAI KHOAN')}) AND ({_has('full_text', 'THANH CONG', 'NGAN HANG', 'VIETCOMBANK')})", 40),
    ],
}


def _sum(rules: list[Rule]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in rules)


#: All words that rules and fallbacks look for in a text, and what citations and articles begin with.
_CITED, _ARTICLE = ("LUAT", "VE"), "DIEU"
WORDS = {w for rules in RULES.values() for test, _ in rules for w in re.findall(r"contains\((?:full_text|header|cited), '([^']+)'\)", test)} | {w for pair in FALLBACKS for w in pair} | {*_CITED, _ARTICLE}


def _looked_for() -> str:
    """A pattern of all words, found at once wherever they begin; of words that begin alike the longest.

    A place is passed unless its two letters can begin a word; first letters are met in groups.
    """
    by: dict[str, list[str]] = {}
    for w in sorted(WORDS, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    letters = sorted(by)
    groups = [letters[i : i + 4] for i in range(0, len(letters), 4)]
    one = lambda c: f"{c}(?:{'|'.join(by[c])})"
    pair = "".join(f"[{''.join(sorted({w[i] for w in WORDS}))}]" for i in (0, 1))
    return f"(?={pair})(?=({'|'.join(f'(?=[{"".join(g)}])(?:{"|".join(map(one, g))})' for g in groups)}))"


def found_words(x: Column) -> Column:
    """The distinct words of WORDS in a text, a line each but for those that others begin with: a word is in the text just if it is in this."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(x, F.lit(_looked_for()), F.lit(1))), "\n")


def _points(category: str) -> str:
    """The sum of a category's rules as Spark works it out: a word that the text doesn't have isn't looked for in its header.

    Lines of the header are lines of the text, and no word has a line end, so what the header
    has the text has as well; `cited`, from which citations are cut, can have others.
    """
    rules = dict(RULES[category])
    out = []
    for test, n in RULES[category]:
        head = re.fullmatch(r"contains\(header, ('[^']+')\)", test)
        full = head and f"contains(full_text, {head[1]})"
        other = full and f"NOT {test} AND {full}"
        if head and other in rules:
            out.append(f"CASE WHEN {full} THEN CASE WHEN {test} THEN {n} ELSE {rules[other]} END ELSE 0 END")
        elif head and full in rules:
            out.append(f"CASE WHEN {full} THEN {rules[full]} + CASE WHEN {test} THEN {n} ELSE 0 END ELSE 0 END")
        elif not any(test in (f"NOT contains(header, {w}) AND contains(full_text, {w})", f"contains(full_text, {w})") for w in _headed(category)):
            out.append(f"CASE WHEN {test} THEN {n} ELSE 0 END")
    return " + ".join(out)


def _headed(category: str) -> list[str]:
    return [m[1] for test, _ in RULES[category] if (m := re.fullmatch(r"contains\(header, ('[^']+')\)", test))]


#: Letters whose upper form without accents is the upper form of one ASCII letter.
_LATIN = {a: b for a, b in zip(tx._FROM, tx._TO) if a < "\u0250" or "\u1ea0" <= a < "\u1f00" if b.isascii() and b.isalpha() and len(a.upper()) == 1}


def scores(docs: DataFrame, path: str = "file_path", text: str = "extracted_text", prefix: int = 800) -> DataFrame:
    """Adds the score of each category, from the file name and the first `prefix` characters of the text.

    The header is the first 20 non-blank lines. Beside scores, `full_text` has the words found
    in the text (see found_words). The accent-free form is made once a row: text that is ASCII
    once its Latin letters have lost their accents, nearly all, takes no more than that. All
    words are found in one pass, and the rules look at what was found. The header is taken of
    the accent-free text, unless that has marks, which can be all of a line. Text of up to 20
    lines has the words of its header, as no word has a line end or blank ends, but for
    citations, which go over line ends. Scores are summed in a function of arrays, as in code
    of the whole stage their method would be too large for the JVM to compile.
    """
    plain = lambda c: F.upper(tx.remove_accents(F.upper(c)))
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, prefix)

    def top(x: Column) -> Column:
        ls = F.filter(F.transform(F.split(x, "\n"), lambda y: tx.strip(y)), lambda y: y != "")
        return bound(ls, lambda ls: F.when(F.size(ls) > 0, F.array_join(F.slice(ls, 1, 20), "\n")).otherwise(x))

    bare = F.translate("_head", "".join(_LATIN), "".join(_LATIN.values()))
    out = once(once(docs, _head=head), _bare=bare)
    out = once(out, _ascii=F.octet_length("_bare") == F.length("_bare"))
    out = once(out, _full=F.when(F.col("_ascii"), F.upper("_bare")).otherwise(plain(F.col("_head"))))
    out = once(out, full_text=found_words(F.col("_full")))
    has = lambda w: F.contains("full_text", F.lit(w))
    short = F.col("_ascii") & ~has(_CITED[0]) & ~has(_CITED[1]) & (F.substring_index("_full", "\n", 20) == F.col("_full"))
    marked = ~F.col("_ascii") & F.rlike(F.upper("_head"), F.lit(r"\p{Mn}"))
    header = F.when(~short, F.when(marked, plain(top(F.col("_head")))).otherwise(top(F.col("_full"))))
    name = F.element_at(F.split(path, "/"), -1)
    out = once(out, _header=header, has_article=has(_ARTICLE) & F.rlike("_full", F.lit(r"DIEU\s+\d+")), name=F.lower(tx.remove_accents(F.lower(name)))).drop("_head", "_bare", "_ascii", "_full")
    seen = lambda x: F.when(F.col("_header").isNull(), F.col("full_text")).otherwise(found_words(x))
    out = once(out, header=seen(F.col("_header")), cited=seen(F.regexp_replace("_header", CITATIONS, ""))).drop("_header")
    points = F.transform(F.array(F.lit(0)), lambda _: F.struct(*[F.expr(_points(c)).alias(c) for c in CATEGORIES]))
    return out.select("*", F.inline(points))


def classify(docs: DataFrame, path: str = "file_path", text: str = "extracted_text") -> DataFrame:
    """Category and confidence of each document; ties go to the first category."""
    out = scores(docs, path, text)
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, c in enumerate(CATEGORIES)]))
    out = out.withColumn("best", best)
    pair = F.lit(None).cast("string")
    for (a, b), c in reversed(list(zip(FALLBACKS, CATEGORIES))):
        pair = F.when(F.expr(f"{_has('full_text', a)} AND {_has('full_text', b)}"), c).otherwise(pair)
    weak = F.col("best.score") < 15
    category = F.when(~weak, F.col("best.category")).otherwise(F.coalesce(pair, F.lit("khac")))
    confidence = F.when(~weak, F.least(F.lit(99.0), F.round(50 + F.col("best.score") * 0.8, 1))).when(pair.isNotNull(), 70.0).otherwise(0.0)
    return out.withColumns({"category": category, "confidence": confidence}).drop("full_text", "header", "name", "cited", "has_article", "best", *CATEGORIES)


def _named(names: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), F.lit(other))


def document_type(category: Column) -> Column:
    """English type of a category's code or English name; unknown for others and null."""
    return _named(DOCUMENT_TYPES, category, "unknown")


def metadata(classified: DataFrame) -> DataFrame:
    """English type, category, confidence from 0 to 1 in two places, and a reason, for rows with category and confidence."""
    conf = F.when(F.col("confidence") > 0, F.bround(F.col("confidence") / 100, 2)).otherwise(0.42)
    out = classified.select("id", document_type(F.col("category")).alias("document_type"), "category", conf.alias("type_confidence"))
    return out.withColumn("reason", _named(REASONS, F.col("document_type"), ""))


def mixed_texts(d: fx.Dialect) -> str:
    """Rendered documents of all kinds and raw ones, with file names that give clues."""
    names = {0: "/in/HD_{0}.pdf", 1: "/in/vcb_{0}.png", 2: "/in/bang_ke_{0}.xlsx", 3: "/in/Hóa_đơn_{0}.pdf"}
    case = "CASE id % 5 " + " ".join("WHEN {} THEN concat('{}', CAST(id AS string), '{}')".format(k, *v.split("{0}")) for k, v in names.items()) + " ELSE concat('/in/tep_', CAST(id AS string), '.txt') END"
    kinds = (fx.invoice_texts, fx.contract_texts, fx.voucher_texts, fx.transfer_texts)
    parts = [f"SELECT id * 10 + {i} AS id, text FROM ({k(d)}) k" for i, k in enumerate(kinds)]
    parts.append("SELECT doc_id * 10 + 9 AS id, text FROM documents")
    return f"SELECT id, {case} AS file_path, text AS extracted_text FROM ({' UNION ALL '.join(parts)}) u"


def _q(f):
    return lambda spark, sf_dir: f(fx.rows(spark, sf_dir, mixed_texts))


QUERIES = {
    "classify": _q(lambda d: classify(d).select("id", "category", "confidence")),
    "classify_scores": _q(lambda d: scores(d).select("id", *CATEGORIES)),
    "classify_metadata": _q(lambda d: metadata(classify(d))),
}

_PLAIN = "upper(replace(replace(strip_accents(upper({0})), 'Đ', 'D'), 'đ', 'd'))"
_BASE = f"""WITH a AS (SELECT id, substr(coalesce(extracted_text, ''), 1, 800) AS head, string_split(file_path, '/')[-1] AS f FROM {fx.duck(mixed_texts)}),
b AS (SELECT *, list_filter(list_transform(string_split(head, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM a),
c AS (SELECT id, {_PLAIN.format('head')} AS full_text, {_PLAIN.format("CASE WHEN len(ls) > 0 THEN array_to_string(ls[1:20], chr(10)) ELSE head END")} AS header, lower(replace(replace(strip_accents(lower(f)), 'Đ', 'D'), 'đ', 'd')) AS name FROM b),
e AS (SELECT *, regexp_replace(header, '{CITATIONS}', '', 'g') AS cited, regexp_matches(full_text, 'DIEU\\s+[0-9]+') AS has_article FROM c),
s AS (SELECT *, {", ".join(f"{_sum(RULES[c]).replace('endswith', 'ends_with')} AS {c}" for c in CATEGORIES)} FROM e),
r AS (SELECT *, greatest({", ".join(CATEGORIES)}) AS m FROM s),
k AS (SELECT id, CASE WHEN m >= 15 THEN CASE {" ".join(f"WHEN {c} = m THEN '{c}'" for c in CATEGORIES)} END {" ".join(f"WHEN contains(full_text, '{a}') AND contains(full_text, '{b}') THEN '{c}'" for (a, b), c in zip(FALLBACKS, CATEGORIES))} ELSE 'khac' END AS category,
 CASE WHEN m >= 15 THEN least(99.0::DOUBLE, round((50 + m * 0.8)::DOUBLE, 1)) {" ".join(f"WHEN contains(full_text, '{a}') AND contains(full_text, '{b}') THEN 70.0" for a, b in FALLBACKS)} ELSE 0.0 END::DOUBLE AS confidence FROM r)"""
ORACLES = {
    "classify": f"{_BASE} SELECT id, category, confidence FROM k",
    "classify_scores": f"{_BASE} SELECT id, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in CATEGORIES)} FROM s",
    "classify_metadata": f"{_BASE}, t AS (SELECT *, CASE category {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in ENGLISH.items())} ELSE 'unknown' END AS document_type FROM k) SELECT id, document_type, category, CASE WHEN confidence > 0 THEN round_even(confidence / 100, 2) ELSE 0.42 END AS type_confidence, CASE document_type {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in REASONS.items())} END AS reason FROM t",
}
