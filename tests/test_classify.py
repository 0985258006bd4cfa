"""The classifier's rules on texts that its shorter ways treat apart: the words found in one pass, short texts as their own header."""

from __future__ import annotations

import re
import unicodedata

from doclathe.operators import classify as cl

LONG = "\n".join(f"dòng {i}" for i in range(25))
TEXTS = [
    "HỢP ĐỒNG\nBên A: x\nBên B: y\nĐiều 1. Giá", "  hóa đơn  \n\n GTGT\nMã số thuế", LONG + "\nHợp đồng", "\n" * 30 + "Phiếu thu\n" + LONG + "\nPhiếu chi",
    "Ký Luật thuế giá trị gia tăng hiệu", "Ký Luật\n\n thuế giá trị gia tăng hiệu\nvề hóa đơn", "hoa về\nhóa đơn don", "h́óa đơn", "Hoṕ đòng bên a", "straße hóa đơn stt", "ᾳ chứng từ", "chuyển khoản thành công momo\nMB bank mbbank xác nhận bởi mb",
    "số tài khoản nhận\ntên người nhận\nngân hàng nhận", "giao dịch thành công 5 vnd", "hung tu", "", None, " \n ", "x" * 795 + " hóa đơn", "  doanh thu  \nstt", "CHUYEN KHOAN\nTHANH CONG", "vat invoice contract agreement",
]


def _plain(x: str) -> str:
    x = "".join(c for c in x.upper() if unicodedata.category(c) != "Mn")
    table = dict(zip(cl.tx._FROM, cl.tx._TO))
    return "".join(table.get(c, c) for c in x).upper()


def _by_rules(text: str | None, name: str) -> dict[str, int]:
    head = (text or "")[:800]
    lines = [y for x in head.split("\n") if (y := x.strip(cl.tx.SPACES))]
    v = {"full_text": _plain(head), "header": _plain("\n".join(lines[:20]) if lines else head), "name": name.lower()}
    v |= {"cited": re.sub(cl.CITATIONS, "", v["header"], flags=re.A), "has_article": bool(re.search(r"DIEU\s+\d+", v["full_text"], re.A))}
    python = lambda t: re.sub(r"(contains|endswith)\((\w+), ('[^']+')\)", lambda m: f"({m[3]} in {m[2]})" if m[1] == "contains" else f"{m[2]}.endswith({m[3]})", t).replace(" OR ", " or ").replace(" AND ", " and ").replace("NOT ", "not ")
    return {c: sum(n for t, n in rules if eval(python(t), {}, v)) for c, rules in cl.RULES.items()}


def test_scores_equal_the_rules_one_by_one(spark):
    rows = [(i, "/in/so-mb.xlsx" if i % 2 else "/in/tep.txt", t) for i, t in enumerate(TEXTS)]
    got = {r["id"]: r for r in cl.scores(spark.createDataFrame(rows, "id long, file_path string, extracted_text string")).collect()}
    for i, path, t in rows:
        assert {c: got[i][c] for c in cl.CATEGORIES} == _by_rules(t, path.rsplit("/", 1)[1]), t


def test_found_words_tell_of_each_word_whether_it_is_there(spark):
    from pyspark.sql import functions as F

    texts = [*sorted(cl.WORDS), *["X".join(p) for p in zip(sorted(cl.WORDS), sorted(cl.WORDS)[1:])], "".join(sorted(cl.WORDS)), "HOP DON", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", cl.found_words(F.col("t")).alias("f")).collect()
    assert all((w in r["t"]) == (w in r["f"]) for r in got for w in cl.WORDS)
