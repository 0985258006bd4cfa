"""Queries over documents and events for the text functions, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..plans import fixtures as fx

EXTENSIONS = (".pdf", ".docx", ".xlsx", ".xls", ".png", ".jpg", ".jpeg", ".bmp", ".txt")


def noisy(d: fx.Dialect) -> str:
    return """SELECT doc_id, concat(chr(1), '|priority', chr(10), '  ', chr(10), '...', chr(10), replace(text, ', ', concat(',', chr(9), ' ')),
  CASE WHEN doc_id % 7 = 0 THEN ' (cid:1) (cid:2) (cid:3) (cid:4)' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN '�' ELSE '' END) AS noisy FROM documents"""


def status_lines(d: fx.Dialect) -> str:
    return "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '|priority' WHEN 1 THEN '/|Battery ' WHEN 2 THEN '....' WHEN 3 THEN concat('|| ', replace(text, chr(10), ' '), 'x') ELSE 'signal 4' END AS line FROM documents"


def pages_of(d: fx.Dialect) -> str:
    """Whole texts in pages of 400 characters, with a head and, on all pages but one, a foot."""
    numbered = f"SELECT doc_id, text, source, lang, {d.upto.format('CAST(floor(length(text) / 400) AS int)')} AS p FROM documents"
    return f"SELECT doc_id, CAST(p AS int) AS page, concat('Head ', source, chr(10), replace(substr(text, CAST(1 + 400 * p AS int), 400), chr(10), ' '), '.', chr(10), CASE WHEN doc_id % 3 = p THEN 'odd' ELSE concat('Foot ', lang) END) AS page_text FROM ({numbered}) n"


def amounts(d: fx.Dialect) -> str:
    return """SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat(CAST(user_id AS string), '.000 VNĐ') WHEN 1 THEN concat('1.', CAST(100 + user_id % 900 AS string), '.000,50') WHEN 2 THEN concat('-', CAST(user_id AS string), ',5') WHEN 3 THEN '1.2.3'
  WHEN 4 THEN concat(CAST(event_id AS string), ' đ') WHEN 5 THEN '12,345.67' WHEN 6 THEN '.' ELSE concat('1,', CAST(100 + user_id % 900 AS string)) END AS amount,
  CASE event_id % 5 WHEN 0 THEN concat('Lúc ', CAST(1 + event_id % 28 AS string), '/', CAST(1 + user_id % 12 AS string), '/2024') WHEN 1 THEN concat('2023.', CAST(1 + user_id % 12 AS string), '.', CAST(1 + event_id % 28 AS string)) WHEN 2 THEN concat('Ngày ', CAST(1 + event_id % 28 AS string), ' tháng 3 năm 2022') WHEN 3 THEN 'không rõ' ELSE '99/99/2024' END AS day,
  concat('MST: 01', CAST(user_id AS string), '-', lpad(CAST(event_id % 1000 AS string), 3, '0')) AS tax, concat(CASE WHEN event_id % 3 = 0 THEN '(1)' ELSE 'a = 3' END, chr(10), CASE event_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '10%' ELSE '' END, chr(10), CAST(user_id AS string), ',000.5 đ') AS cell,
  concat('10:', lpad(CAST(user_id % 60 AS string), 2, '0'), CASE event_id % 3 WHEN 0 THEN '~' WHEN 1 THEN ' 2 ' ELSE ' - ' END, '03/04/2024') AS clock FROM events"""


def pairs(d: fx.Dialect) -> str:
    return "SELECT item_id, CASE WHEN item_id % 9 = 0 THEN '' ELSE regexp_replace(text, '[^ -~]', ''{g}) END AS truth, CASE WHEN item_id % 10 = 0 THEN '' ELSE replace(regexp_replace(text, '[^ -~]', ''{g}), 'th', 't') END AS predicted FROM benchmark".replace("{g}", ", 'g'" if d is fx.DUCK else "")


def run(fixture, f):
    return lambda spark, sf_dir: f(fx.rows(spark, sf_dir, fixture))


def raw(table: str, f):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


# Operators on frames


def headers_footers(pages: DataFrame, n: int = 3, share: float = 0.5) -> DataFrame:
    """Lines (doc_id, place, line) among the first or last n of at least `share` of a document's pages, if it has several.

    A line that stands twice on a page counts twice; blank pages count as pages.
    """
    ls = tx.lines(F.col("page_text"))
    count = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages > 1")
    split = pages.select("doc_id", ls.alias("ls")).where(F.size("ls") > 0)
    top = split.select("doc_id", F.lit("header").alias("place"), F.explode(F.slice("ls", 1, n)).alias("line"))
    end = split.select("doc_id", F.lit("footer").alias("place"), F.explode(F.slice("ls", F.greatest(F.lit(1), F.size("ls") - n + 1), F.lit(n))).alias("line"))
    seen = top.unionByName(end).groupBy("doc_id", "place", "line").agg(F.count("*").alias("n"))
    return seen.join(count, "doc_id").where(F.col("n") >= share * F.col("pages")).select("doc_id", "place", "line", "n")


def strip_headers_footers(pages: DataFrame) -> DataFrame:
    """Pages without the lines that headers_footers finds."""
    bad = headers_footers(pages).groupBy("doc_id").agg(F.collect_set("line").alias("bad"))
    kept = pages.join(bad, "doc_id", "left").select("doc_id", "page", F.filter(tx.lines(F.col("page_text")), lambda x: ~F.array_contains(F.coalesce("bad", F.array().cast("array<string>")), x)).alias("ls"))
    return kept.select("doc_id", "page", F.array_join("ls", "\n").alias("page_text"))


def page_method_rollup(pages: DataFrame) -> DataFrame:
    """Source type and method of each document from its pages' methods."""
    n = pages.groupBy("doc_id").agg(F.count_if(F.col("method") == "ocr").alias("ocr"), F.count_if(F.col("method") == "native").alias("native"))
    kind = lambda a, b, c: F.when(F.col("ocr") == 0, a).when(F.col("native") == 0, b).otherwise(c)
    return n.select("doc_id", kind("pdf_text", "pdf_scan", "pdf_mixed").alias("source_type"), kind("native_text", "ocr", "mixed").alias("extraction_method"))


def confidence_stats(boxes: DataFrame) -> DataFrame:
    """Boxes, mean probability in percent, and the share of 0.8 or more."""
    share = F.count_if(F.col("prob") >= 0.8) / F.count("*")
    return boxes.groupBy("doc_id").agg(F.count("*").alias("n_boxes"), F.bround(F.avg("prob") * 100, 1).alias("mean_conf"), F.bround(share * 100, 1).alias("high_share"))


def tokens(x: str) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two sequences of numbers: one row of the table at a time, each in a few vector steps.

    What a cell may take from its left is the least of the cells before it, each one more for
    every step: a running minimum once the steps are subtracted.
    """
    steps = np.arange(len(b) + 1)
    row = steps
    for x in a:
        change = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate([[row[0] + 1], change]) - steps) + steps
    return int(row[-1])


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> int | None:
        if x is None or y is None:
            return None
        if len(x) < len(y):
            x, y = y, x
        codes: dict[str, int] = {}
        return edit_distance(*(np.array([codes.setdefault(w, len(codes)) for w in ws], dtype=np.int64) for ws in (x, y)))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of tokens; memory grows with the shorter one. Null arrays have none."""
    return F.pandas_udf(_distances, T.IntegerType())(a, b)


def error_rate(distance: Column, n_truth: Column, n_predicted: Column) -> Column:
    return F.when(n_truth == 0, F.when(n_predicted == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), distance / n_truth))


def accuracy(df: DataFrame) -> DataFrame:
    """Distances, error rates in percent, accuracies and a band, from truth and predicted."""
    t, p = tokens("truth"), tokens("predicted")
    df = df.select("item_id", "truth", "predicted", t.alias("t"), p.alias("p"))
    df = df.withColumn("char_distance", F.levenshtein("truth", "predicted")).withColumn("token_distance", token_distance(F.col("t"), F.col("p")))
    df = df.withColumn("cer", error_rate(F.col("char_distance"), F.length("truth"), F.length("predicted"))).withColumn("wer", error_rate(F.col("token_distance"), F.size("t"), F.size("p")))
    score = F.bround(100 * (1 - F.col("cer")), 2)
    band = F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 55, "fair").otherwise("poor")
    return df.select("item_id", "truth", "char_distance", "token_distance", "cer", "wer", score.alias("char_accuracy"), F.bround(100 * (1 - F.col("wer")), 2).alias("word_accuracy"), band.alias("band"))


def _methods(docs: DataFrame) -> DataFrame:
    page = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("page")
    pages = docs.select("doc_id", page)
    return pages.select("doc_id", F.when((F.col("doc_id") + F.col("page")) % 4 < F.col("doc_id") % 4, "ocr").otherwise("native").alias("method"))


def _boxes(lines_: DataFrame) -> DataFrame:
    return lines_.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") / 50).alias("prob"))


def supported(path: Column) -> Column:
    """Whether a path's last suffix, in any case, is of a file that can be read."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)


def takes_fallback(n: Column, conf: Column, n2: Column, conf2: Column) -> Column:
    """Whether a second reading is taken: where the first has no lines or a confidence under 35, and the second has more of either."""
    return ((n == 0) | (conf < 35)) & ((n2 > n) | (conf2 > conf))


def _fallback(orders: DataFrame) -> DataFrame:
    n, n2 = F.col("o_orderkey") % 4, F.col("o_custkey") % 5
    use = takes_fallback(n, F.col("o_orderkey") % 90, n2, F.col("o_custkey") % 95)
    return orders.select("o_orderkey", F.when(use, "fallback").otherwise("first").alias("reading"), F.when(use, n2).otherwise(n).alias("n_lines"))


def _error_text(c: str = "doc_id", t: str = "text") -> str:
    return f"CASE {c} % 4 WHEN 0 THEN 'HTTP 429 slow down' WHEN 1 THEN 'bad API_KEY' ELSE {t} END"


def _shown(c: str = "conv_id") -> str:
    return f"CASE WHEN {c} % 3 = 0 THEN concat('[HỆ THỐNG]: x', chr(10), 'Tải lên và đọc ', text) WHEN {c} % 3 = 1 THEN concat('[HỆ THỐNG]: x', chr(10), chr(10), text) ELSE text END"


N, ST, PG, AM, PR = fx.duck(noisy), fx.duck(status_lines), fx.duck(pages_of), fx.duck(amounts), fx.duck(pairs)

QUERIES = {
    "supported_filter": run(fx.ocr_documents, lambda d: d.where(supported(F.col("file_path"))).select("id", "file_path")),
    "page_method_rollup": raw("documents", lambda d: page_method_rollup(_methods(d))),
    "ocr_fallback_pick": raw("orders", _fallback),
    "text_scan": raw("documents", lambda d: d.select("doc_id", F.lit("text").alias("document_type"), F.lit("direct_read").alias("extraction_method"), F.lit(1).alias("total_pages"), F.size(F.filter(F.split("text", "\n"), lambda x: tx.strip(x) != "")).alias("n_lines"))),
    "fast_prefix": raw("documents", lambda d: d.select("doc_id", F.substring("text", 1, 800).alias("value"))),
    "remove_accents": raw("documents", lambda d: d.select("doc_id", tx.remove_accents(F.col("text")).alias("value"))),
    "clean_noise": run(status_lines, lambda d: d.select("doc_id", tx.clean_noise(F.col("line")).alias("value"))),
    "normalize_text": run(noisy, lambda d: d.select("doc_id", tx.normalize_text(F.col("noisy")).alias("value"))),
    "usable_text": run(noisy, lambda d: d.select("doc_id", tx.usable_text(F.col("noisy")).alias("value"))),
    "headers_footers": run(pages_of, headers_footers),
    "strip_headers_footers": run(pages_of, strip_headers_footers),
    "line_types": raw("documents", lambda d: d.select("doc_id", F.explode(tx.lines(F.col("text"))).alias("line")).groupBy("doc_id", tx.line_type(F.col("line")).alias("type")).agg(F.count("*").alias("n"))),
    "key_value_pairs": run(fx.invoice_texts, lambda d: d.select("id", F.explode(tx.key_values(F.col("text"))).alias("p")).select("id", "p.*")),
    "truncate": raw("documents", lambda d: d.select("doc_id", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("value"))),
    "error_class": raw("documents", lambda d: d.select("doc_id", F.expr(_error_text()).alias("e")).select("doc_id", tx.error_class(F.col("e")).alias("value"))),
    "format_line": raw("documents", lambda d: d.select("doc_id", tx.format_line((F.col("doc_id") % 1000).cast("int"), F.col("n_chars") % 1000 / 8.0, F.col("text")).alias("value"))),
    "display_content": raw("conversations", lambda d: d.select("conv_id", "turn", F.expr(_shown()).alias("t")).select("conv_id", "turn", tx.display_content(F.col("t")).alias("value"))),
    "clean_amount": run(amounts, lambda d: d.select("event_id", tx.clean_amount(F.col("amount")).alias("value"))),
    "clean_date": run(amounts, lambda d: d.select("event_id", tx.clean_date(F.col("day")).alias("value"))),
    "clean_tax_id": run(amounts, lambda d: d.select("event_id", tx.clean_tax_id(F.col("tax")).alias("value"))),
    "parse_number": run(amounts, lambda d: d.select("event_id", tx.parse_number(F.col("cell")).alias("value"))),
    "clock_repair": run(amounts, lambda d: d.select("event_id", tx.clock_repair(F.col("clock")).alias("value"))),
    "confidence_stats": raw("lineitem", lambda d: confidence_stats(_boxes(d))),
    "char_distance": run(pairs, lambda d: d.select("item_id", F.levenshtein("truth", "predicted").alias("value"))),
    "token_distance": run(pairs, lambda d: accuracy(d).select("item_id", F.col("token_distance").alias("value"))),
    "cer": run(pairs, lambda d: accuracy(d).select("item_id", F.round("cer", 6).alias("value"))),
    "wer": run(pairs, lambda d: accuracy(d).select("item_id", F.round("wer", 6).alias("value"))),
    "accuracy_metrics": run(pairs, lambda d: accuracy(d).agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("cer"), F.round(F.avg("wer"), 6).alias("wer"))),
    "quality_band": run(pairs, lambda d: accuracy(d).groupBy("band").agg(F.count("*").alias("n"))),
}

_LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"
_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
_NUMBER = "try_cast(replace(regexp_replace({0}, '[^0-9.,-]', '', 'g'), ',', '') AS DOUBLE)"
_AMOUNT_N = "regexp_replace({0}, '[^0-9.,]', '', 'g')"
AMOUNT = """try_cast(CASE WHEN contains({0}, '.') AND contains({0}, ',') THEN replace(replace({0}, '.', ''), ',', '.') WHEN contains({0}, '.') THEN CASE WHEN regexp_full_match({0}, '[0-9]*(\\.[0-9]{{3}})+') THEN replace({0}, '.', '') ELSE {0} END
 WHEN contains({0}, ',') THEN CASE WHEN regexp_full_match({0}, '[0-9]*(,[0-9]{{3}})+') THEN replace({0}, ',', '') ELSE replace({0}, ',', '.') END ELSE {0} END AS DOUBLE)"""


def duck_amount(x: str) -> str:
    return AMOUNT.format(_AMOUNT_N.format(x))


def duck_date(x: str, pattern: str, order: tuple[int, int, int]) -> str:
    y, m, d = (f"regexp_extract({x}, '{pattern}', {i})" for i in order)
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN {y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') END"


def duck_clean_date(x: str) -> str:
    parts = (duck_date(x, tx.DAY_FIRST, (3, 2, 1)), duck_date(x, tx.YEAR_FIRST, (1, 2, 3)), duck_date(x, "(?i)" + tx.LONG_DATE, (3, 2, 1)))
    return f"coalesce({', '.join(parts)}, {x})"


_HEADERS = f"""WITH p AS (SELECT doc_id, page, {_LINES.format('page_text')} AS ls FROM {PG}), c AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY doc_id),
e AS (SELECT doc_id, 'header' AS place, unnest(ls[1:3]) AS line FROM p UNION ALL SELECT doc_id, 'footer', unnest(ls[greatest(1, len(ls) - 2):]) FROM p),
h AS (SELECT doc_id, place, line, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT h.* FROM h JOIN c USING (doc_id) WHERE pages > 1 AND n >= 0.5 * pages)"""
# token distance by dynamic programming over rows of the table, in plain SQL
_TOKENS = f"SELECT item_id, truth, predicted, {_WORDS.format('truth')} AS t, {_WORDS.format('predicted')} AS p FROM {PR}"
_DP = f"""WITH RECURSIVE w AS ({_TOKENS}),
dp AS (SELECT item_id, t, p, 0 AS i, range(0, len(p) + 1) AS v FROM w
  UNION ALL SELECT item_id, t, p, i + 1, list_reduce(list_prepend([i + 1], list_transform(range(1, len(p) + 1), lambda j: [CAST(j AS BIGINT)])), lambda cur, j: list_append(cur, least(v[j[1] + 1] + 1, cur[len(cur)] + 1, v[j[1]] + CASE WHEN p[j[1]] = t[i + 1] THEN 0 ELSE 1 END))) FROM dp WHERE i < len(t)),
d AS (SELECT w.item_id, levenshtein(truth, predicted) AS char_distance, CAST(dp.v[len(dp.v)] AS INTEGER) AS token_distance, length(truth) AS nt, length(predicted) AS np, len(w.t) AS wt, len(w.p) AS wp FROM w JOIN dp ON w.item_id = dp.item_id AND dp.i = len(w.t)),
r AS (SELECT *, CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 0 ELSE 1 END ELSE least(1, char_distance / nt) END AS cer, CASE WHEN wt = 0 THEN CASE WHEN wp = 0 THEN 0 ELSE 1 END ELSE least(1, token_distance / wt) END AS wer FROM d)"""
_RE2 = "|".join(tx.HEADINGS)

ORACLES = {
    "supported_filter": f"SELECT id, file_path FROM {fx.duck(fx.ocr_documents)} WHERE lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) IN {EXTENSIONS}",
    "page_method_rollup": "WITH p AS (SELECT doc_id, CASE WHEN (doc_id + page) % 4 < doc_id % 4 THEN 'ocr' ELSE 'native' END AS method FROM documents, range(3) r(page)), n AS (SELECT doc_id, count(*) FILTER (WHERE method = 'ocr') AS o, count(*) FILTER (WHERE method = 'native') AS t FROM p GROUP BY doc_id) SELECT doc_id, CASE WHEN o = 0 THEN 'pdf_text' WHEN t = 0 THEN 'pdf_scan' ELSE 'pdf_mixed' END AS source_type, CASE WHEN o = 0 THEN 'native_text' WHEN t = 0 THEN 'ocr' ELSE 'mixed' END AS extraction_method FROM n",
    "ocr_fallback_pick": "WITH x AS (SELECT o_orderkey, o_orderkey % 4 AS n, o_orderkey % 90 AS c, o_custkey % 5 AS n2, o_custkey % 95 AS c2 FROM orders), y AS (SELECT *, (n = 0 OR c < 35) AND (n2 > n OR c2 > c) AS u FROM x) SELECT o_orderkey, CASE WHEN u THEN 'fallback' ELSE 'first' END AS reading, CASE WHEN u THEN n2 ELSE n END AS n_lines FROM y",
    "text_scan": f"SELECT doc_id, 'text' AS document_type, 'direct_read' AS extraction_method, 1 AS total_pages, CAST(len({_LINES.format('text')}) AS INTEGER) AS n_lines FROM documents",
    "fast_prefix": "SELECT doc_id, substr(text, 1, 800) AS value FROM documents",
    "remove_accents": "SELECT doc_id, replace(replace(strip_accents(text), 'Đ', 'D'), 'đ', 'd') AS value FROM documents",
    "clean_noise": f"SELECT doc_id, CASE WHEN regexp_full_match(x, '(?i)priority|battery|signal|\\.+') THEN '' ELSE x END AS value FROM (SELECT doc_id, trim(regexp_replace(line, '^[|\\\\/]+', ''), ' ' || chr(10)) AS x FROM {ST})",
    "normalize_text": f"""WITH a AS (SELECT doc_id, list_transform(string_split(replace(noisy, chr(1), ''), chr(10)), lambda x: trim(regexp_replace(trim(regexp_replace(x, '[ \\t]+', ' ', 'g')), '^[|\\\\/]+', ''))) AS ls FROM {N})
SELECT doc_id, array_to_string(list_filter(ls, lambda x: x <> '' AND NOT regexp_full_match(x, '(?i)priority|battery|signal|\\.+')), chr(10)) AS value FROM a""",
    "usable_text": f"""WITH a AS (SELECT doc_id, trim(noisy, ' ' || chr(10) || chr(9)) AS t FROM {N}), b AS (SELECT *, {_WORDS.format('t')} AS w, len(regexp_extract_all(t, '\\(cid:[0-9]+\\)')) AS c, length(t) - length(translate(t, '{tx.READABLE.replace("'", "''")}', '')) AS r FROM a)
SELECT doc_id, NOT (length(t) < 20 OR c > 3 OR c > 0.2 * greatest(len(w), 1) OR contains(t, '�')) AND r >= 0.7 * length(t) AND len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) >= 0.3 * len(w) AS value FROM b""",
    "headers_footers": f"{_HEADERS} SELECT doc_id, place, line, n FROM f",
    "strip_headers_footers": f"{_HEADERS}, b AS (SELECT doc_id, list(line) AS bad FROM f GROUP BY doc_id) SELECT doc_id, page, array_to_string(list_filter(ls, lambda x: NOT list_contains(coalesce(bad, []), x)), chr(10)) AS page_text FROM p LEFT JOIN b USING (doc_id)",
    "line_types": f"""WITH l AS (SELECT doc_id, unnest({_LINES.format('text')}) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '{_RE2}') OR (upper(t) = t AND lower(t) <> t AND length(t) < 80 AND NOT ends_with(t, '.')) THEN 'heading' WHEN regexp_matches(t, '{"|".join(tx.ITEMS)}') THEN 'list' ELSE 'paragraph' END AS type, count(*) AS n FROM l GROUP BY ALL""",
    "key_value_pairs": f"""WITH l AS (SELECT id, {_LINES.format('text')} AS ls FROM {fx.duck(fx.invoice_texts)}), x AS (SELECT id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS t FROM l)
SELECT id, CAST(i AS INTEGER) AS line_index, trim(regexp_extract(t, '{tx.PAIR}', 1)) AS key, trim(regexp_extract(t, '{tx.PAIR}', 2)) AS value, t AS raw_line FROM x WHERE regexp_matches(t, '{tx.PAIR}') AND NOT (regexp_full_match(trim(regexp_extract(t, '{tx.PAIR}', 1)), '[0-9]{{1,2}}') AND regexp_full_match(trim(regexp_extract(t, '{tx.PAIR}', 2)), '[0-9]{{2}}'))""",
    "truncate": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS value FROM documents",
    "error_class": f"SELECT doc_id, CASE WHEN contains(e, '429') OR contains(e, 'RESOURCE_EXHAUSTED') OR contains(e, 'Quota') THEN 'quota' WHEN contains(e, '401') OR contains(e, '403') OR contains(e, 'API_KEY') THEN 'key' ELSE substr(string_split(e, chr(10))[1], 1, 200) END AS value FROM (SELECT doc_id, {_error_text()} AS e FROM documents)",
    "format_line": "SELECT doc_id, printf('[%03d - %.1f%%] %s', doc_id % 1000, round_even(n_chars % 1000 / 8.0, 1), text) AS value FROM documents",
    "display_content": f"SELECT conv_id, turn, CASE WHEN NOT contains(t, '[HỆ THỐNG]:') THEN t WHEN regexp_matches(t, 'Tải lên và') THEN regexp_extract(t, '(?s).*(Tải lên và.*)', 1) ELSE string_split(t, chr(10) || chr(10))[-1] END AS value FROM (SELECT conv_id, turn, {_shown()} AS t FROM conversations)",
    "clean_amount": f"SELECT event_id, {duck_amount('amount')} AS value FROM {AM}",
    "clean_date": f"SELECT event_id, {duck_clean_date('day')} AS value FROM {AM}",
    "clean_tax_id": f"SELECT event_id, regexp_replace(tax, '[^0-9-]', '', 'g') AS value FROM {AM}",
    "parse_number": f"SELECT event_id, list_transform(list_filter({_LINES.format('cell')}, lambda y: NOT regexp_matches(y, '^\\([0-9]\\)|[=%]') AND {_NUMBER.format('y')} IS NOT NULL AND NOT (length(y) <= 3 AND {_NUMBER.format('y')} IN (1, 2, 3, 4, 5))), lambda y: {_NUMBER.format('y')})[1] AS value FROM {AM}",
    "clock_repair": f"SELECT event_id, regexp_replace(clock, '([0-9]{{2}}:[0-9]{{2}})\\s*[~2=]\\s*([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', '\\1 - \\2', 'g') AS value FROM {AM}",
    "confidence_stats": "SELECT l_orderkey AS doc_id, count(*) AS n_boxes, round_even(avg(l_quantity / 50) * 100, 1) AS mean_conf, round_even(count(*) FILTER (WHERE l_quantity / 50 >= 0.8) / count(*) * 100, 1) AS high_share FROM lineitem GROUP BY 1",
    "char_distance": f"SELECT item_id, CAST(levenshtein(truth, predicted) AS INTEGER) AS value FROM {PR}",
    "token_distance": f"{_DP} SELECT item_id, token_distance AS value FROM r",
    "cer": f"{_DP} SELECT item_id, round(cer, 6) AS value FROM r",
    "wer": f"{_DP} SELECT item_id, round(wer, 6) AS value FROM r",
    "accuracy_metrics": f"{_DP} SELECT count(*) AS n, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer FROM r",
    "quality_band": f"{_DP} SELECT CASE WHEN round_even(100 * (1 - cer), 2) >= 90 THEN 'excellent' WHEN round_even(100 * (1 - cer), 2) >= 75 THEN 'good' WHEN round_even(100 * (1 - cer), 2) >= 55 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM r GROUP BY 1",
}
