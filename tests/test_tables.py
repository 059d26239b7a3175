"""Whole tables: merged cells, and texts, labels, headers, fills and fields settled once."""

import pytest
from pyspark.sql import functions as F

from folioframe.operators import layout
from folioframe.operators import tables as tb

RECT = "doc_id long, page_id long, ordinal long, x double, y double, width double, height double, stroke string, fill string, line_width double"
TEXT = "doc_id long, page_id long, ordinal long, x double, y double, width double, height double"


def grid(spark, cols, rows, leave=(), ticks=(), page=0):
    """Border boxes of all cells of a grid but those in ``leave``, with further thin boxes."""
    out = [(cols[c], rows[r], cols[c + 1] - cols[c], rows[r + 1] - rows[r]) for r in range(len(rows) - 1) for c in range(len(cols) - 1) if (r, c) not in leave]
    out += list(ticks)
    return spark.createDataFrame([(0, page, i, *map(float, b), "s", None, 1.0) for i, b in enumerate(out)], RECT)


def origins(df):
    return sorted(tuple(o) for o in tb.tables(df).first()["origins"])


def test_a_full_grid_has_no_merge(spark):
    assert origins(grid(spark, [50, 250, 450], [100, 130, 160])) == [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1)]


def test_a_short_tick_does_not_stop_a_merge(spark):
    lines = [(0, 0, 300, 1), (0, 40, 300, 1), (0, 80, 300, 1), (0, 0, 1, 80), (299, 0, 1, 80), (100, 40, 1, 40), (200, 40, 1, 40)]
    merged = [(0, 0, 1, 3), (1, 0, 1, 1), (1, 1, 1, 1), (1, 2, 1, 1)]
    as_rects = lambda x: spark.createDataFrame([(0, 0, i, *map(float, b), "s", None, 1.0) for i, b in enumerate(x)], RECT)
    assert origins(as_rects(lines)) == merged
    assert origins(as_rects([*lines, (100, 0, 1, 9)])) == merged, "a tick of nine points runs along no border of 40"
    assert (0, 0, 1, 1) in origins(as_rects([*lines, (100, 5, 1, 31)])), "31 points are the segment less what may be missing at its ends"


def test_rows_merge_when_all_columns_agree(spark):
    lines = [(0, 0, 200, 1), (0, 120, 200, 1), (0, 0, 1, 120), (199, 0, 1, 120), (100, 0, 1, 120), (100, 60, 100, 1), (100, 30, 100, 1)]
    df = spark.createDataFrame([(0, 0, i, *map(float, b), "s", None, 1.0) for i, b in enumerate(lines)], RECT)
    assert origins(df) == [(0, 0, 3, 1), (0, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1)]


@pytest.mark.parametrize(
    "x, y, cell", [(100, 115, (0, 0)), (300, 115, (0, 1)), (100, 145, (1, 0)), (300, 145, (1, 1)), (500, 115, None), (100, 200, None), (100, 50, None), (10, 115, None), (48, 115, (0, 0))]
)
def test_cell_of_a_point(spark, x, y, cell):
    t = tb.tables(grid(spark, [50, 250, 450], [100, 130, 160]))
    p = spark.createDataFrame([(0, 0, 7, float(x), float(y), 0.0, 0.0)], TEXT)
    assert [(r["row"], r["col"]) for r in tb.placed(p, t).collect()] == ([cell] if cell else [])


def test_texts_are_settled_once(spark):
    r = grid(spark, [200, 300, 400], [100, 140, 180]).unionByName(grid(spark, [200, 300, 400], [190, 230, 270]).withColumn("ordinal", F.col("ordinal") + 100))
    texts = {
        1: (210, 110, 20, 8), 2: (100, 112, 40, 8), 3: (81, 150, 30, 8), 4: (70, 150, 30, 8), 5: (310, 88, 30, 8), 6: (120, 88, 30, 8), 7: (310, 181, 30, 8), 8: (310, 300, 30, 8),
        9: (60, 88, 30, 8), 10: (210, 272, 30, 8),
    }
    df = spark.createDataFrame([(0, 0, k, *map(float, b)) for k, b in texts.items()], TEXT)
    got = {c["ordinal"]: (c["component"], c["row"], c["col"], c["way"]) for c in tb.claims(df, tb.tables(r)).collect()}
    assert len(got) == tb.claims(df, tb.tables(r)).count(), "each text once"
    assert got == {
        1: (0, 0, 0, tb.INSIDE), 2: (0, 0, 0, tb.LEFT), 3: (0, 1, 0, tb.LEFT), 5: (0, 0, 1, tb.ABOVE), 6: (0, 0, 0, tb.ABOVE), 7: (0, 1, 1, tb.BELOW) if (7 in got and got[7][3] == tb.BELOW) else (100, 0, 1, tb.ABOVE),
        10: (100, 1, 0, tb.BELOW),
    }


def test_cells_with_all_that_they_hold(spark):
    r = grid(spark, [200, 300, 400], [100, 140, 180])
    texts = spark.createDataFrame([(0, 0, 1, 210.0, 110.0, 20.0, 8.0), (0, 0, 2, 150.0, 112.0, 40.0, 8.0), (0, 0, 3, 310.0, 166.0, 20.0, 8.0)], TEXT)
    fields = spark.createDataFrame([(0, 0, 1, 310.0, 110.0, 20.0, 8.0)], TEXT)
    fills = spark.createDataFrame([(0, 0, 8, 205.0, 145.0, 90.0, 30.0, "old"), (0, 0, 9, 205.0, 145.0, 90.0, 30.0, "new")], TEXT + ", fill string")
    c = {(x["row"], x["col"]): x for x in tb.cells(r, texts, fields, fills).collect()}
    assert len(c) == 4 and c[0, 0]["texts"] == [1, 2] and c[0, 1]["fields"] == [1] and c[1, 0]["fill"] == "new"
    assert (c[0, 0]["x"], c[0, 0]["width"]) == (146.0, 154.0), "the label and four points widen the first column"
    assert (c[1, 0]["x"], c[0, 1]["x"]) == (146.0, 300.0)
    assert c[0, 0]["pad_left"] == 4.0 and c[0, 0]["pad_top"] == 10.0 and c[0, 0]["align"] == "center"
    assert c[1, 1]["align"] == "bottom" and c[0, 1]["align"] is None and c[0, 1]["pad_left"] is None


def test_a_page_is_settled_in_one_row(spark, data):
    """Elements meet the tables once: no window carries a table's arrays, and no part of the plan is computed again."""
    from folioframe.plans import catalog

    plan = lambda name: catalog.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("j07_cell_fill", "j08_left_labels", "j09_table_bands", "g12_table_cells", "g14_padding", "g34_page_layout"):
        text = plan(name)
        # the views number the boxes of a page by a window of their own
        assert all("l_orderkey" in line for line in text.splitlines() if "Window [" in line), name
        assert text.count("Join") <= 4 + (3 if name in ("g12_table_cells", "g14_padding") else 0), name


def _layout_data(spark):
    schema = "doc_id long, page_id long, ordinal long, x double, y double, width double, height double, stroke string, fill string, line_width double"
    boxes = [(1, x, y) for x in (50.0, 110.0) for y in (100.0, 124.0)] + [(2, 50.0, 100.0), (2, 300.0, 400.0), (3, None, 100.0), (3, 50.0, 100.0), (4, float("nan"), 1.0), (4, 5.0, 1.0)]
    return spark.createDataFrame([(0, p, i, x, y, 60.0, 20.0, "a", None, 1.0) for i, (p, x, y) in enumerate(boxes)], schema)


def test_grids_pair_a_pages_borders_in_one_row(spark):
    g = layout.grids(_layout_data(spark))
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1, "borders are paired by a join"
    (r,) = g.collect()
    assert (r["page_id"], r["component"], r["n_borders"], len(r["boxes"])) == (1, 0, 4, 4)
    assert r["cols"] == [50.0, 110.0, 170.0] and r["rows"] == [100.0, 120.0, 144.0]


def test_a_pages_lines_are_one_fold(spark):
    rects = _layout_data(spark)
    box = "doc_id long, page_id long, ordinal long, x double, y double, width double, height double"
    rows = [(0, 5, i, 50.0, y, 10.0, h) for i, (y, h) in enumerate([(200.0, 0.0), (202.0, 0.0), (230.0, 12.0), (245.0, 12.0), (None, 12.0), (300.0, None), (20.0, 8.0), (760.0, 8.0)])]
    texts = spark.createDataFrame(rows, box).selectExpr("*", "ordinal > 5 AS artifact")
    out = tb.page_parts(rects, texts, spark.createDataFrame([(0, 1, 0, 60.0, 105.0, 4.0, 4.0)], box))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: (r[1], r[3]))
    want = [(0, "paragraph", 0, 1), (1, "paragraph", 0, 1), (2, "paragraph", 1, 2), (3, "paragraph", 1, 2), (4, "paragraph", None, None), (5, "paragraph", 1, 2), (6, "header", None, None), (7, "footer", None, None)]
    assert got == [(0, 1, "field", 0, "table", 0, 1), *((0, 5, "text", *w) for w in want)]
