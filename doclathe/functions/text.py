"""Text functions, Column to Column: normalisation, quality, line types, amounts and dates."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as Python's splitlines knows them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Those of them that aren't LF.
OTHER_END = r"[\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Characters that are white space.
SPACES = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Characters and patterns of Vietnamese documents.
#: Characters that count as readable besides A-Z, a-z and 0-9.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
MARKS = " .,;:!?\"'()[]{}<>-+*/=_@#$%^&*~\n\r\t"
ASCII = "".join(chr(c) for r in (range(97, 123), range(65, 91), range(48, 58)) for c in r)
READABLE = ASCII + VIETNAMESE + VIETNAMESE.upper() + "".join(dict.fromkeys(MARKS))
NOISE = r"(?idU)^(?:priority|battery|signal|\.+)$"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def java(pattern: str, ignore_case: bool = True) -> str:
    """A pattern with the meaning it has in Python: Unicode classes, and only LF ends a line."""
    return ("(?idU)" if ignore_case else "(?dU)") + pattern


def strip(x: Column, more: str = "") -> Column:
    """Without white space, and the characters `more`, at both ends."""
    return F.btrim(x, F.lit(SPACES + more.replace("\\", "")))


def _plain() -> tuple[str, str]:
    pairs = {}
    for cp in range(0xC0, 0x2000):
        base = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn"))
        if len(base) == 1 and base != chr(cp):
            pairs[chr(cp)] = base
    pairs |= {"Đ": "D", "đ": "d"}
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _plain()


def remove_accents(x: Column) -> Column:
    """Letters without accents, Đ and đ as D and d; null is empty."""
    return F.translate(F.regexp_replace(F.coalesce(x, F.lit("")), r"\p{Mn}+", ""), _FROM, _TO)


def _canonical() -> tuple[dict[str, str], dict[str, str], dict[str, str], tuple[str, str]]:
    """Of Latin, Greek and Cyrillic letters: decompositions, compositions, classes of marks, and characters that stand for another."""
    apart, whole, classes, single = {}, {}, {}, {}
    for cp in (*range(0xC0, 0x600), *range(0x1E00, 0x2000), 0x2126, 0x212A, 0x212B):
        c = chr(cp)
        full, now = unicodedata.normalize("NFD", c), unicodedata.normalize("NFC", c)
        if unicodedata.combining(c):
            classes[c] = chr(unicodedata.combining(c))
        if now != c and len(now) == 1:
            single[c] = now
        elif full != c:
            apart[c] = full
        if full != c and now == c:
            first, second = (chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
            whole[first + second] = c
    return apart, whole, classes, ("".join(single), "".join(single.values()))


_APART, _WHOLE, _CLASSES, _SINGLE = _canonical()
_STANDS = "".join(f"\\x{{{ord(c):x}}}" for c in _SINGLE[0])


def _looked_up(table: dict[str, str]) -> Column:
    """A constant map, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def nfc(x: Column) -> Column:
    """Text in Unicode's composed form: Latin, Greek and Cyrillic letters with their marks, and signs that stand for a letter.

    Text without marks and such signs, nearly all, is only looked through. Elsewhere each letter
    with marks is taken apart, its marks are ordered by class, and composed one by one where no
    mark of the same or a higher class stands between.
    """
    apart, whole, classes = _looked_up(_APART), _looked_up(_WHOLE), _looked_up(_CLASSES)

    def composed(token: Column) -> Column:
        full = F.array_join(F.transform(F.split(token, ""), lambda c: F.coalesce(F.try_element_at(apart, c), c)), "")
        chars = F.concat(F.when(F.rlike(full, F.lit(r"^\p{Mn}")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), F.split(full, ""))
        marks = F.transform(F.slice(chars, 2, F.size(chars)), lambda m, i: F.struct(F.ascii(F.coalesce(F.try_element_at(classes, m), F.lit(chr(255)))).alias("c"), i.alias("i"), m.alias("m")))
        start = F.struct(F.get(chars, F.lit(0)).alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

        def step(s: Column, m: Column) -> Column:
            both = F.try_element_at(whole, F.concat(s["base"], m["m"]))
            joins = ((s["rest"] == "") | (s["last"] < m["c"])) & both.isNotNull()
            return F.when(joins, F.struct(both.alias("base"), s["rest"].alias("rest"), s["last"].alias("last"))).otherwise(F.struct(s["base"].alias("base"), F.concat(s["rest"], m["m"]).alias("rest"), m["c"].alias("last")))

        return F.aggregate(F.array_sort(marks), start, step, lambda s: F.concat(s["base"], s["rest"]))

    parts = F.regexp_extract_all(F.translate(x, *_SINGLE), F.lit(r"(?s)\P{Mn}\p{Mn}+|(?:\P{Mn}(?!\p{Mn}))+|\p{Mn}+"), F.lit(0))
    made = F.array_join(F.transform(parts, lambda t: F.when(F.rlike(t, F.lit(r"^\P{Mn}?\p{Mn}")), composed(t)).otherwise(t)), "")
    return F.when(F.rlike(x, F.lit(rf"[\p{{Mn}}{_STANDS}]")), made).otherwise(x)


def clean_noise(line: Column) -> Column:
    """A line without leading bars and slashes; empty if it is a status-bar word or dots."""
    x = strip(F.regexp_replace(line, r"^[|\\/]+", ""))
    return F.when(F.rlike(x, F.lit(NOISE)), "").otherwise(x)


def lines(x: Column) -> Column:
    """Non-blank lines, stripped. Text whose only line ends are LF, nearly all, is split without a pattern."""
    parts = F.when(F.rlike(x, F.lit(OTHER_END)), F.split(x, LINE_END)).otherwise(F.split(x, "\n"))
    return F.filter(F.transform(parts, lambda y: strip(y)), lambda y: y != "")


def normalize_text(x: Column) -> Column:
    """Composed form, lines cleaned, runs of blanks made one, empty lines dropped."""
    clean = F.regexp_replace(nfc(F.coalesce(x, F.lit(""))), CONTROLS, "")
    tidy = F.transform(F.split(clean, LINE_END), lambda y: clean_noise(strip(F.regexp_replace(y, r"[ \t]+", " "))))
    return F.array_join(F.filter(tidy, lambda y: y != ""), "\n")


def usable_text(x: Column, least: int = 20) -> Column:
    """Whether extracted text is good enough: length, font codes, broken and unknown characters, words with letters."""
    t = strip(F.coalesce(x, F.lit("")))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    n = F.size(words)
    codes = F.size(F.regexp_extract_all(t, F.lit(r"\(cid:\d+\)"), F.lit(0)))
    readable = F.length(t) - F.length(F.translate(t, READABLE, ""))
    spoken = F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"\p{L}"))))
    bad = (F.length(t) < least) | (codes > 3) | (codes > 0.2 * F.greatest(n, F.lit(1))) | F.contains(t, F.lit("\x00")) | F.contains(t, F.lit("�"))
    return ~bad & (readable >= 0.7 * F.length(t)) & (n > 0) & (spoken >= 0.3 * n)


HEADINGS = (r"^(ĐIỀU|Đieu|CHƯƠNG|Chương|MỤC|Mục|PHẦN|Phần)\s+\d+", r"^[I|VX]+\.\s+", rf"^\d+\.\s+[A-Z{VIETNAMESE.upper()}]")
ITEMS = (r"^[•\-*+]\s+", r"^\d+\.\d+(\.\d+)?\s+", r"^[a-z]\)\s+")


def line_type(x: Column) -> Column:
    """heading, list or paragraph."""
    t = strip(x)
    loud = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) < 80) & ~F.endswith(t, F.lit("."))
    any_of = lambda ps: F.rlike(t, F.lit(java("|".join(ps), False)))
    return F.when(any_of(HEADINGS) | loud, "heading").when(any_of(ITEMS), "list").otherwise("paragraph")


PAIR = r"^\s*([^:\-=]{2,35})\s*[:\-=]\s*(.+)$"


def key_values(text: Column) -> Column:
    """Pairs (line_index, key, value, raw_line) of lines that read key: value, but for clock times."""
    pair = lambda x, i: F.regexp_extract(x, java(PAIR, False), i)
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line_index"), x.alias("raw_line")))
    paired = F.filter(numbered, lambda p: F.rlike(p["raw_line"], F.lit("[:=-]")) & F.rlike(p["raw_line"], F.lit(java(PAIR, False))))
    at = F.transform(paired, lambda p: F.struct(p["line_index"].alias("line_index"), strip(pair(p["raw_line"], 1)).alias("key"), strip(pair(p["raw_line"], 2)).alias("value"), p["raw_line"].alias("raw_line")))
    return F.filter(at, lambda p: ~(F.rlike(p["key"], F.lit(r"^\d{1,2}$")) & F.rlike(p["value"], F.lit(r"^\d{2}$"))))


#: Of JSON: all up to the next number with an exponent, or such a number. Strings are passed whole.
JSON_PART = r'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\d-]++|-?\d[\d.]*+(?!E-?\d)|-(?!\d))++|-?\d[\d.]*+E-?\d++'


def plain_numbers(json: Column) -> Column:
    """JSON as Spark writes it, its numbers without exponents from 1e-6 up to 1e21, as DuckDB writes them; strings stay as they are.

    Only numbers with exponents are parted from the rest, which mostly is one piece.
    """

    def written(t: Column) -> Column:
        size = F.abs(t.cast("double"))
        digits = F.when((size >= 1e7) & (size < 1e21), t.try_cast("decimal(38,17)").cast("string")).when((size >= 1e-6) & (size < 1), t.try_cast("decimal(38,23)").cast("string"))
        plain = F.when(F.instr(digits, "E") == 0, F.regexp_replace(digits, r"(\.\d+?)0+$", "$1"))
        return F.coalesce(plain, F.replace(F.lower(t), F.lit(".0e"), F.lit("e")))

    parts = F.regexp_extract_all(json, F.lit(JSON_PART), F.lit(0))
    made = F.array_join(F.transform(parts, lambda t: F.when((F.length(t) < 32) & F.rlike(t, F.lit(r"^-?\d[\d.]*E-?\d+$")), written(t)).otherwise(t)), "")
    return F.when(F.rlike(json, F.lit(r"\dE-?\d")), made).otherwise(json)


def error_class(x: Column) -> Column:
    """What a failure's message is about; else its first line, up to 200 characters."""
    has = lambda *ws: F.rlike(x, F.lit("|".join(ws)))
    return F.when(has("429", "RESOURCE_EXHAUSTED", "Quota"), "quota").when(has("401", "403", "API_KEY"), "key").otherwise(F.substring(F.get(F.split(x, "\n"), 0), 1, 200))


def format_line(n: Column, conf: Column, text: Column) -> Column:
    """Number, confidence in one place (halves to even) and text."""
    return F.format_string("[%03d - %.1f%%] %s", n, F.bround(conf, 1), text)


def display_content(x: Column) -> Column:
    """A user message as shown: from its last upload notice on, else its last paragraph."""
    notice = F.regexp_extract(x, "(?s).*(Tải lên và.*)", 1)
    return F.when(~F.contains(x, F.lit("[HỆ THỐNG]:")), x).when(notice != "", notice).otherwise(F.element_at(F.split(x, "\n\n"), -1))


def amount_marks(x: Column) -> Column:
    """The digits, dots and commas of a text."""
    return F.regexp_replace(x, "[^0-9.,]", "")


def amount_of(n: Column) -> Column:
    """The number that digits, dots and commas write in Vietnamese: dots part thousands if all groups after the first have three digits."""
    dot, comma = F.contains(n, F.lit(".")), F.contains(n, F.lit(","))
    groups = lambda m: F.rlike(n, F.lit(rf"^[0-9]*([{m}][0-9]{{3}})+$"))
    drop = lambda y, m: F.replace(y, F.lit(m), F.lit(""))
    point = lambda y: F.replace(y, F.lit(","), F.lit("."))
    out = F.when(dot & comma, point(drop(n, "."))).when(dot, F.when(groups("."), drop(n, ".")).otherwise(n)).when(comma, F.when(groups(","), drop(n, ",")).otherwise(point(n))).otherwise(n)
    return out.try_cast("double")


def clean_amount(x: Column) -> Column:
    """A number as written in Vietnamese. What it needs more than once is made once, as the one element of an array."""
    return F.get(F.transform(F.array(amount_marks(x)), amount_of), F.lit(0))


DAY_FIRST, YEAR_FIRST = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", r"(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})"
LONG_DATE = r"ngày\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})"


def iso_date(x: Column, pattern: str, order: tuple[int, int, int], ignore_case: bool = True) -> Column:
    """Year-month-day from groups of a pattern, null where it doesn't match."""
    y, m, d = (F.regexp_extract(x, java(pattern, ignore_case), i) for i in order)
    return F.when(F.rlike(x, F.lit(java(pattern, ignore_case))), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def clean_date(x: Column) -> Column:
    """The first date as year-month-day, unchecked; without one the input."""
    return F.coalesce(iso_date(x, DAY_FIRST, (3, 2, 1)), iso_date(x, YEAR_FIRST, (1, 2, 3)), iso_date(x, LONG_DATE, (3, 2, 1)), x)


def date_value(x: Column) -> Column:
    """A date as {value, raw_value}, or null where it is empty."""
    value = F.nullif(clean_date(x), F.lit(""))
    return F.when(value.isNotNull(), F.struct(value.alias("value"), strip(x).alias("raw_value")))


def amount_value(x: Column, source: str = "ocr") -> Column:
    """An amount as {value, source}, or null where there is none."""
    value = clean_amount(x)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source")))


def clean_tax_id(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9\-]", "")


def parse_number(cell: Column) -> Column:
    """The first usable line of a table cell as a number: commas go, dots stay."""
    digits = lambda y: F.regexp_replace(y, r"[^\d.,\-]", "")
    value = lambda y: F.replace(digits(y), F.lit(","), F.lit("")).try_cast("double")
    skip = lambda y: F.rlike(y, F.lit(r"^\(\d\)|[=%]"))
    read = F.transform(F.filter(lines(cell), lambda y: ~skip(y)), lambda y: F.struct((F.length(y) <= 3).alias("short"), value(y).alias("v")))
    return F.get(F.filter(read, lambda r: r["v"].isNotNull() & ~(r["short"] & r["v"].isin(1.0, 2.0, 3.0, 4.0, 5.0))), F.lit(0))["v"]


def numbers(cell: Column) -> Column:
    """The numbers of a cell, one for each line that has one (see parse_number). Cells of digits alone and those without any, nearly all, aren't split."""
    few = F.when((F.length(cell) <= 3) & cell.try_cast("double").isin(1.0, 2.0, 3.0, 4.0, 5.0), F.array().cast("array<double>")).otherwise(F.array(cell.try_cast("double")))
    return F.when(~F.rlike(cell, F.lit("[0-9]")), F.array().cast("array<double>")).when(F.rlike(cell, F.lit("^[0-9]+$")) & ~F.endswith(cell, F.lit("\n")), few).otherwise(F.filter(F.transform(lines(cell), parse_number), lambda v: v.isNotNull()))


def clock_repair(x: Column) -> Column:
    return F.regexp_replace(x, r"(\d{2}:\d{2})\s*[~2=]\s*(\d{2}/\d{2}/\d{4})", "$1 - $2")
