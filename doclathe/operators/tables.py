"""Tables as matrices: Markdown, items and arithmetic checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.layout import bound, once
from ..plans import fixtures as fx
from .text_queries import duck_amount

HEADER = ("STT", "Tên hàng", "ĐVT", "Chưa thuế", "Thuế", "Thành tiền", "")

#: Order lines, numbered anew so that no two of an order have one number.
LINES = "(SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_linenumber FROM lineitem) l"


def table_rows(d: fx.Dialect) -> str:
    """Rows of a table for each order: number, name, unit, price, tax, sum (wrong in places), and an empty column."""
    return f"""SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_linenumber AS string) AS c1, concat('Hàng ', CAST(l_partkey AS string), CASE WHEN l_linenumber % 4 = 3 THEN concat(chr(10), 'loại 2') ELSE '' END) AS c2,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Cái' ELSE 'Bộ' END AS c3, CAST(1000 + l_partkey AS string) AS c4, CAST(100 + l_suppkey AS string) AS c5,
  CAST(1100 + l_partkey + l_suppkey + CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 2 THEN 50 ELSE 0 END AS string) AS c6, '' AS c7 FROM {LINES}"""


def matrices(rows: DataFrame) -> DataFrame:
    """Rows (id, n, c1..c7) as one matrix for each table, with its header."""
    cells = F.array(*[F.col(f"c{i}") for i in range(1, 8)])
    got = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", cells.alias("cells")))).alias("rs"))
    return got.select("id", F.concat(F.array(F.array(*[F.lit(h) for h in HEADER])), F.transform("rs", lambda r: r["cells"])).alias("matrix"))


def markdown_text(matrix: Column) -> Column:
    """A matrix as a Markdown table: ragged rows filled, empty columns dropped, columns padded. Null without rows."""
    at = lambda r, c: F.coalesce(F.get(r, c), F.lit(""))
    tidy = F.transform(matrix, lambda r: F.transform(r, lambda x: F.replace(tx.strip(x), F.lit("\n"), F.lit(" "))))

    def columns(t: Column) -> Column:
        n = F.array_max(F.transform(t, F.size))
        width = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.array_max(F.transform(t, lambda r: F.length(at(r, c)))))
        return F.filter(F.transform(width, lambda w, c: F.struct(c.alias("c"), F.greatest(w, F.lit(3)).alias("w"), (w > 0).alias("used"))), lambda u: u["used"])

    def written(t: Column, used: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(used, lambda u: F.rpad(at(r, u["c"]), u["w"], F.lit(" "))), " | "), F.lit(" |"))
        bar = F.concat(F.lit("| "), F.array_join(F.transform(used, lambda u: F.repeat(F.lit("-"), u["w"])), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.array(line(F.get(t, F.lit(0)))), F.array(bar), F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), line)), "\n")

    return bound(tidy, lambda t: bound(columns(t), lambda used: written(t, used)))


def markdown(tables: DataFrame, matrix: str = "matrix", out: str = "markdown") -> DataFrame:
    """Adds `out`: a matrix as a Markdown table (see markdown_text)."""
    return tables.withColumn(out, markdown_text(F.col(matrix)))


def without_empty_rows(matrix: Column) -> Column:
    """The rows of a matrix of which a cell isn't blank; null cells are blank."""
    return F.filter(matrix, lambda r: F.exists(r, lambda x: tx.strip(F.coalesce(x, F.lit(""))) != ""))


def items(tables: DataFrame, least: int = 4, strict: bool = False) -> DataFrame:
    """Goods (id, stt, name, unit, quantity, price, amount) in the tables' matrices.

    Empty cells are dropped, so later ones move up. Header and total rows are skipped. With
    `strict`, the Markdown separator counts as a row, as readers of the rendered table see it.
    """
    low = lambda c, words: F.rlike(F.lower(c), F.lit(words))
    rows = tables.select("id", F.posexplode("matrix").alias("pos", "row")).select("id", (F.col("pos") * 2).alias("pos"), F.filter(F.transform("row", lambda x: F.replace(tx.strip(x), F.lit("\n"), F.lit(" "))), lambda x: x != "").alias("cells"))
    if strict:
        dashes = F.transform(F.get("matrix", F.lit(0)), lambda h: F.lit("---"))
        rows = rows.unionByName(tables.select("id", F.lit(1).alias("pos"), dashes.alias("cells")))
    first, name = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    kept = rows.where((F.size("cells") >= least) & ~low(first, "stt|tên|item|cộng") & ~low(name, "tổng|cộng|thuế|vat"))
    last = F.when(F.size("cells") > 5, tx.clean_amount(F.element_at("cells", -1)))
    return kept.select("id", F.col("pos"), name.alias("name"), F.get("cells", F.lit(2)).alias("unit"), tx.clean_amount(F.get("cells", F.lit(3))).alias("quantity"), tx.clean_amount(F.get("cells", F.lit(4))).alias("price"), last.alias("amount"))


def validation(tables: DataFrame, matrix: str = "matrix", out: str = "v") -> DataFrame:
    """Adds `out`, a struct (status, checked, issues): whether the numbers of each row add up.

    Three or more: two of them sum to the greatest within 2, or the first two to the third.
    Two: they are equal within 1. Nothing checked: not_checkable; an issue: warning.
    """
    numbers = lambda r: F.filter(F.flatten(F.transform(r, tx.numbers)), lambda v: v > 0)
    skip = lambda r: F.rlike(F.lower(F.array_join(r, " ")), F.lit(r"\(1\)|\(2\)|\(3\)|stt"))
    body = F.transform(F.slice(matrix, 2, F.greatest(F.size(matrix) - 1, F.lit(0))), lambda r, i: F.struct((i + 1).alias("i"), F.when(skip(r), F.array().cast("array<double>")).otherwise(numbers(r)).alias("v")))

    # numbers are read once, and sorted once
    numbered, ordered = f"_{out}_numbers", f"_{out}_sorted"
    tables = once(tables, **{numbered: body})
    tables = tables.withColumn(ordered, F.transform(numbered, lambda r: F.struct(r["i"].alias("i"), r["v"].alias("v"), F.sort_array(r["v"]).alias("s"))))

    def sums(v: Column, s: Column) -> Column:
        """Two pointers over the sorted numbers below the greatest: each step moves one of them inwards."""
        goal = F.element_at(s, -1)
        begin = F.struct(F.lit(0).alias("i"), (F.size(s) - 2).alias("j"), F.lit(False).alias("met"))

        def step(at: Column, _: Column) -> Column:
            off = F.get(s, at["i"]) + F.get(s, at["j"]) - goal
            met = at["met"] | ((at["i"] < at["j"]) & (F.abs(off) <= 2))
            return F.struct((at["i"] + (off < 0).cast("int")).alias("i"), (at["j"] - (off >= 0).cast("int")).alias("j"), met.alias("met"))

        pair = F.aggregate(F.slice(s, 1, F.size(s) - 2), begin, step, lambda at: at["met"])
        return pair | (F.abs(F.get(v, F.lit(0)) + F.get(v, F.lit(1)) - F.get(v, F.lit(2))) <= 2)

    kind = lambda v, s: F.when((F.size(v) >= 3) & sums(v, s), "ok").when(F.size(v) >= 3, "bad").when((F.size(v) == 2) & (F.abs(F.get(v, F.lit(0)) - F.get(v, F.lit(1))) <= 1), "ok").otherwise("none")
    judgement = f"_{out}_judged"
    tables = once(tables, **{judgement: F.transform(ordered, lambda r: F.struct(r["i"].alias("i"), kind(r["v"], r["s"]).alias("k")))})
    judged = F.col(judgement)
    checked, bad = F.size(F.filter(judged, lambda r: r["k"] == "ok")), F.filter(judged, lambda r: r["k"] == "bad")
    status = F.when(checked == 0, "not_checkable").when(F.size(bad) > 0, "warning").otherwise("pass")
    verdict = F.struct(status.alias("status"), checked.alias("checked"), F.when(checked > 0, F.array_join(F.transform(bad, lambda r: r["i"].cast("string")), ";")).otherwise("").alias("issues"))
    return tables.withColumn(out, verdict).drop(numbered, ordered, judgement)


def _q(fixture, f):
    return lambda spark, sf_dir: f(fx.rows(spark, sf_dir, fixture))


QUERIES = {
    "markdown_table": _q(table_rows, lambda d: markdown(matrices(d), out="value").select("id", "value")),
    "table_items": _q(table_rows, lambda d: items(matrices(d))),
    "table_items_strict": _q(table_rows, lambda d: items(matrices(d), strict=True)),
    "validate_financials": _q(table_rows, lambda d: validation(matrices(d)).select("id", "v.*")),
}

_T = fx.duck(table_rows)
_M = f"SELECT id, list_prepend([{', '.join(f"'{h}'" for h in HEADER)}], list([c1, c2, c3, c4, c5, c6, c7] ORDER BY n)) AS m FROM {_T} GROUP BY id"
_ITEMS = f"""WITH m AS ({_M}), r AS (SELECT id, unnest(range(len(m))) * 2 AS pos, list_filter(list_transform(unnest(m), lambda x: replace(trim(x), chr(10), ' ')), lambda x: x <> '') AS c FROM m@more)
SELECT id, CAST(pos AS INTEGER) AS pos, c[2] AS name, c[3] AS unit, {duck_amount('c[4]')} AS quantity, {duck_amount('c[5]')} AS price, CASE WHEN len(c) > 5 THEN {duck_amount('c[-1]')} END AS amount FROM r WHERE len(c) >= 4 AND NOT regexp_matches(lower(c[1]), 'stt|tên|item|cộng') AND NOT regexp_matches(lower(c[2]), 'tổng|cộng|thuế|vat')"""
ORACLES = {
    "markdown_table": f"""WITH m AS ({_M}), t AS (SELECT id, list_transform(m, lambda r: list_transform(r, lambda x: replace(trim(x), chr(10), ' '))) AS m FROM m),
w AS (SELECT id, m, list_filter(list_transform(range(1, 8), lambda c: [c, list_max(list_transform(m, lambda r: length(r[c])))]), lambda u: u[2] > 0) AS u FROM t)
SELECT id, '| ' || array_to_string(list_transform(u, lambda v: rpad(m[1][v[1]], CAST(greatest(v[2], 3) AS INTEGER), ' ')), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(u, lambda v: repeat('-', greatest(v[2], 3))), ' | ') || ' |' || chr(10)
 || array_to_string(list_transform(m[2:], lambda r: '| ' || array_to_string(list_transform(u, lambda v: rpad(r[v[1]], CAST(greatest(v[2], 3) AS INTEGER), ' ')), ' | ') || ' |'), chr(10)) AS value FROM w""",
    "table_items": _ITEMS.replace("@more", ""),
    "table_items_strict": _ITEMS.replace("@more", " UNION ALL SELECT id, 1, ['---', '---', '---', '---', '---', '---', '---'] FROM m"),
    "validate_financials": f"""WITH r AS (SELECT id, n, CASE WHEN regexp_matches(lower(concat_ws(' ', c1, c2, c3, c4, c5, c6)), 'stt') THEN [] ELSE list_filter([CASE WHEN n > 5 THEN CAST(n AS DOUBLE) END, CAST(regexp_extract(c2, 'Hàng ([0-9]+)', 1) AS DOUBLE), CASE WHEN contains(c2, 'loại 2') THEN 2.0 END, CAST(c4 AS DOUBLE), CAST(c5 AS DOUBLE), CAST(c6 AS DOUBLE)], lambda v: v > 0) END AS v FROM {_T}),
k AS (SELECT id, n, len(list_filter(list_sort(v)[:-2], lambda a, i: len(list_filter(list_sort(v)[i + 1:-2], lambda b: abs(a + b - list_max(v)) <= 2)) > 0)) > 0 OR abs(v[1] + v[2] - v[3]) <= 2 AS ok FROM r)
SELECT id, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'not_checkable' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'warning' ELSE 'pass' END AS status, CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS checked, CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN coalesce(string_agg(CAST(n AS VARCHAR), ';' ORDER BY n) FILTER (WHERE NOT ok), '') ELSE '' END AS issues FROM k GROUP BY id""",
}
