"""Tables from places on a page: worked examples, and plain Python on pages off any grid."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from doclathe.functions.layout import FIRST, LAST, MEAN, nearest, runs, split_where
from doclathe.operators import layout

SPAN = "id long, page int, pos long, x0 double, y0 double, x1 double, y1 double, page_w double, text string"
BOX = "id long, page int, pos long, x_min double, y_min double, x_max double, y_max double, prob double, text string"
CELL = "id long, page int, x double, y double, w double, h double"


def plain_runs(values, near, by):
    out = []
    for v in values:
        ref = {MEAN: lambda r: sum(r) / len(r), FIRST: lambda r: r[0], LAST: lambda r: r[-1]}[by]
        if out and abs(v - ref(out[-1])) <= near:
            out[-1].append(v)
        else:
            out.append([v])
    return out


def test_runs_by_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, [(float(v),) for v in sorted(rng.randint(0, 200) / 2 for _ in range(rng.randint(0, 25)))]) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, xs array<struct<v: double>>")
    for by in (MEAN, FIRST, LAST):
        got = {r.i: [[x.v for x in run] for run in r.r] for r in df.select("i", runs(F.col("xs"), 3.0, by).alias("r")).collect()}
        assert got == {i: plain_runs([x[0] for x in xs], 3.0, by) for i, xs in rows}


def test_parts_and_nearest(spark):
    df = spark.createDataFrame([([1, 5, 2, 7, 9],), ([],)], "xs array<int>")
    assert [r.p for r in df.select(split_where(F.col("xs"), lambda x: x > 4).alias("p")).collect()] == [[[1], [5, 2], [7], [9]], []]
    df = spark.createDataFrame([(5.0, [1.0, 9.0, 5.5]), (5.0, [4.0, 6.0]), (1.0, [])], "v double, ms array<double>")
    assert [r.n for r in df.select(nearest(F.col("v"), F.col("ms")).alias("n")).collect()] == [2, 0, None]


def page(*rows, page_no=1, doc=1):
    return [(doc, page_no, i, float(x), float(y), float(x + w), float(y + 10), 500.0, t) for i, (x, y, w, t) in enumerate(rows)]


def test_native_tables_of_a_page(spark):
    rows = page(
        (50, 20, 200, "HỢP ĐỒNG"), (50, 40, 80, "Căn cứ Luật"), (300, 40, 40, "số 5"), (480, 700, 20, "1/6"), (50, 5, 10, "  "),
        (52, 100, 20, "STT"), (121, 101, 60, "Tên hàng"), (300, 100, 40, "Tiền"),
        (50, 121, 10, "1"), (119, 119, 60, "Bàn gỗ"), (305, 122, 40, "1000"),
        (122, 133, 60, "loại tốt"),
        (51, 150, 10, "2"), (118, 151, 60, "Ghế"), (300, 149, 40, "2,000"),
        (118, 180, 60, "Tổng cộng"), (302, 181, 40, "3,000"),
        (60, 300, 60, "Nội dung"), (250, 302, 60, "Giá trị"), (60, 330, 60, "Hạn"), (255, 331, 60, "12"),
        (60, 450, 60, "Cộng tiền: 7"),
    )
    got = layout.native_tables(spark.createDataFrame(rows + page((10, 10, 40, "only"), (10, 30, 40, "text"), page_no=2), SPAN)).orderBy("table_index").collect()
    assert [(t.page, t.table_index) for t in got] == [(1, 0), (1, 1)]
    assert got[0].matrix == [["STT", "Tên hàng", "Tiền"], ["1", "Bàn gỗ\nloại tốt", "1000"], ["2", "Ghế\nTổng cộng", "2,000\n3,000"]]
    assert got[0].headers == ["STT", "Tên hàng", "Tiền"] and [c.name for c in got[0].columns] == got[0].headers
    assert [(c.x_start, c.x_end) for c in got[0].columns] == [(40.0, 84.0), (84.0, 209.0), (209.0, 500.0)]
    assert got[1].matrix == [["Nội dung", "Giá trị"], ["Hạn", "12"]] or got[1].matrix == [["Nội dung\nHạn", "Giá trị\n12"]]
    assert all(t.confidence == (0.98 if t.validation.status == "pass" else 0.88) for t in got)
    assert got[0].markdown.startswith("| STT | Tên hàng")


def test_no_spans_give_no_tables(spark):
    assert layout.native_tables(spark.createDataFrame([], SPAN)).count() == 0
    assert layout.grid_tables(spark.createDataFrame([], BOX), spark.createDataFrame([], CELL)).count() == 0


def plain_native(rows):
    """Lines, sessions, columns, rows and cells by plain loops; matrices of a page."""
    spans = [dict(pos=r[2], x0=r[3], y0=r[4], x1=r[5], y1=r[6], w=r[7], text=r[8].strip(), v=(r[4] + r[6]) / 2, xc=(r[3] + r[5]) / 2) for r in rows if r[8].strip()]
    lines = []
    for s in sorted(spans, key=lambda s: (s["v"], s["pos"])):
        home = next((ln for ln in lines if abs(s["v"] - sum(t["v"] for t in ln) / len(ln)) <= 6), None)
        home.append(s) if home is not None else lines.append([s])
    lines = [sorted(ln, key=lambda s: (s["x0"], s["v"], s["pos"])) for ln in lines]
    mid = lambda ln: sum(s["v"] for s in ln) / len(ln)
    anchors = [ln for ln in lines if max(abs(s["xc"] - ln[0]["xc"]) for s in ln) > 25 or (len(ln) == 1 and ln[0]["text"] in layout.ALONE)]
    sessions = []
    for ln in anchors:
        if sessions and mid(ln) - mid(sessions[-1][-1]) <= 45:
            sessions[-1].append(ln)
        else:
            sessions.append([ln])
    out = []
    for part in (p for p in sessions if len(p) >= 2):
        top, bottom = min(s["y0"] for ln in part for s in ln) - 5, max(s["y1"] for ln in part for s in ln) + 20
        xs = sorted(s["x0"] for s in spans if top <= s["v"] <= bottom)
        at = [r[0] for r in plain_runs(xs, 22, MEAN)]
        starts = [round(at[0] - 10, 1)] + [round((a + b) / 2, 1) for a, b in zip(at, at[1:])]
        ends = starts[1:] + [round(spans[0]["w"], 1)]
        matrix = []
        for ln in (ln for ln in lines if top <= mid(ln) <= bottom):
            head = " ".join(s["text"] for s in ln if s["xc"] <= ends[0]).strip()
            if not matrix or head.isdigit() or head in layout.ROW_WORDS:
                matrix.append([])
            matrix[-1].append(ln)
        table = []
        for row in matrix:
            cells = [[] for _ in at]
            for _, _, _, _, s in sorted((s["v"], s["x0"], k, i, s) for k, ln in enumerate(row) for i, s in enumerate(ln)):
                cells[next((c for c in range(len(at)) if starts[c] <= s["xc"] <= ends[c]), 0)].append(s["text"])
            table.append(["\n".join(c) for c in cells])
        out.append(table)
    return out


def test_native_tables_by_plain_python(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for doc in range(40):
        mine = []
        y = 20.0
        for _ in range(rng.randint(2, 25)):
            y += rng.choice([9, 14, 20, 30, 60])
            for x in rng.sample([40, 130, 150, 260, 390], rng.randint(1, 4)):
                mine.append((x + rng.randint(0, 40) / 2, y + rng.randint(-6, 6) / 2, rng.randint(8, 60), rng.choice(["1", "22", "STT", "Bàn", "Ghế", "Cộng", "x y", "Nội dung"])))
        made = page(*mine, doc=doc)
        rows += made
        for k, table in enumerate(plain_native(made)):
            want[doc, k] = table
    got = {(r.id, r.table_index): r.matrix for r in layout.native_tables(spark.createDataFrame(rows, SPAN).repartition(3)).collect()}
    assert got == want and len(want) > 20


def test_grid_with_overlapping_cells_and_two_pages(spark):
    cells = [(1, p, x, y + d, w, 30.0) for p in (1, 2) for y in (100.0, 140.0) for x, w, d in ((10.0, 100.0, 0.0), (120.0, 100.0, 4.0), (128.0, 60.0, 8.0))]
    cells += [(1, 1, 10.0, 300.0, 50.0, 30.0), (2, 1, 0.0, 0.0, 9.0, 9.0)]
    boxes = [(1, 1, 1, 20.0, 105.0, 60.0, 115.0, 0.9, " a "), (1, 1, 2, 130.0, 105.0, 170.0, 115.0, 0.81239, "b"), (1, 1, 3, 20.0, 145.0, 60.0, 155.0, 0.1, "unsure"), (1, 1, 4, 190.0, 150.0, 215.0, 160.0, 0.5, "c"), (1, 1, 0, 25.0, 108.0, 40.0, 118.0, 0.5, "first"), (1, 2, 1, 20.0, 105.0, 60.0, 115.0, 0.9, "alone")]
    (t,) = layout.grid_tables(spark.createDataFrame(boxes, BOX), spark.createDataFrame(cells, CELL)).collect()
    assert (t.id, t.page, t.num_rows, t.num_cols, t.table_bbox) == (1, 1, 2, 2, [10, 100, 210, 230])
    assert t.matrix == [["first a", "b b"], ["", "c"]]
    assert [(c.row_index, c.col_index, c.text, len(c.segments)) for c in t.cells] == [(0, 0, "first a", 2), (0, 1, "b", 1), (0, 1, "b b", 1), (1, 1, "c", 1)]
    assert t.cells[1].segments[0].confidence == 0.8124


def test_boxes_are_found_in_cells_of_any_size(spark):
    rng = random.Random(2)
    cells = [(1, 1 + i % 2, float(rng.randint(-200, 900)), float(rng.randint(-200, 900)), float(rng.choice([3, 60, 700])), float(rng.choice([2, 64, 300]))) for i in range(40)]
    boxes = [(1, 1 + i % 2, i, x := float(rng.randint(-250, 1000)), y := float(rng.randint(-250, 1000)), x + 8, y + 6, 0.9, str(i)) for i in range(300)]
    met = layout.boxes_in_cells(layout.read_boxes(spark.createDataFrame(boxes, BOX)), spark.createDataFrame(cells, CELL))
    got = sorted((r.page, r.x, r.y, r.pos) for r in met.collect())
    assert got == sorted((c[1], c[2], c[3], b[2]) for c in cells for b in boxes if c[1] == b[1] and c[2] - 5 <= b[3] + 4 <= c[2] + c[4] + 5 and c[3] - 5 <= b[4] + 3 <= c[3] + c[5] + 5)


def test_first_fit_lines(spark):
    rows = [(1, 1, 10.0, 5.0, 18.0, 0.9, "b"), (1, 1, 0.0, 6.0, 18.0, 0.7, "a"), (1, 1, 0.0, 60.0, 18.0, 0.1, "noise"), (1, 1, 0.0, 90.0, 18.0, 0.5, "10:30~01/02/2024"), (1, 1, 0.0, 200.0, 100.0, 0.5, "tall"), (1, 1, 9.0, 244.0, 100.0, 0.5, "too")]
    df = spark.createDataFrame(rows, "id long, page int, x double, y double, h double, prob double, text string")
    assert [(r.line, r.text) for r in layout.ocr_lines(df).orderBy("line").collect()] == [(1, "a b"), (2, "10:30 - 01/02/2024"), (3, "tall too")]


def test_pages_meet_in_one_shuffle(spark):
    plan = layout.native_tables(spark.createDataFrame([], SPAN))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate ") == 1 and "Join" not in plan and "Window" not in plan


def test_runs_and_nearest_are_folded_once(spark):
    df = spark.createDataFrame([([(1.0,), (9.0,)],)], "xs array<struct<v: double>>")
    tree = lambda c: df.select(c.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    sorted_xs = F.array_sort("xs")
    assert tree(runs(sorted_xs, 3.0)).count("aggregate(") == 1 and tree(runs(sorted_xs, 3.0)).count("array_sort(") == 1
    assert tree(nearest(F.lit(1.0), F.transform(sorted_xs, lambda x: x["v"]))).count("abs(") == 1
    plan = layout.grid_tables(spark.createDataFrame([], BOX), spark.createDataFrame([], CELL))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "aggregate(" in line for line in plan.splitlines())


def shuffles(df) -> int:
    """Shuffles that a frame's plan has besides those its inputs bring, with no table small enough to be sent round."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_spatial_table_needs_no_shuffle_of_its_own(spark):
    boxes = spark.createDataFrame([(1, 1, x, y, t) for y in (10.0, 40.0, 70.0) for x, t in ((0.0, "a"), (100.0, "b"), (104.0, "c"), (300.0, "d"))], "id long, page int, x double, y double, text string")
    got = layout.spatial_table(boxes.repartition(4, "id"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, row, col, t) for row in range(3) for col, t in enumerate(("a", "b c", "d"))]
    assert shuffles(got) == 0


def test_boxes_in_cells_shuffles_arrays_of_pages_alone(spark):
    boxes = spark.createDataFrame([(1, 1, i, float(x), float(y), float(x + 10), float(y + 10), 0.9, "t") for i, (x, y) in enumerate((x, y) for x in range(0, 400, 50) for y in range(0, 400, 50))], BOX)
    cells = spark.createDataFrame([(1, 1, float(x), float(y), 130.0, 90.0) for x in range(0, 300, 70) for y in range(0, 300, 60)], CELL)
    read = layout.read_boxes(boxes)
    near = lambda v, low, size: F.col(v).between(F.col(low) - 5, F.col(low) + F.col(size) + 5)
    want = cells.join(read, layout.PAGE).where(near("xc", "x", "w") & near("yc", "y", "h")).select("x", "y", "pos")
    met = layout.boxes_in_cells(read.repartition(4, "id"), cells.repartition(4, "id"))
    assert sorted(met.select("x", "y", "pos").collect()) == sorted(want.collect())
    # one of each side's pages; what groups the pairs by cell adds none
    assert shuffles(met.groupBy(*layout.PAGE, "x", "y").count()) == 2
