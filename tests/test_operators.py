"""Operators on small fixtures: vectors, edges, brute force."""

import pytest
from pyspark.sql import functions as F

from folioframe.functions import geometry as g
from folioframe.functions import text as t
from folioframe.operators import elements as e
from folioframe.operators import layout as l
from folioframe.operators import shapes


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def floats(*x):
    return F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")


@pytest.mark.parametrize(
    "values, tolerance, want",
    [([], 3, []), ([50], 3, [50]), ([50, 51, 52, 100, 101, 200], 3, [51, 100.5, 200]), ([10, 20, 30, 40], 3, [10, 20, 30, 40]), ([10, 13], 3, [11.5]), ([10, 14], 3, [10, 14]), ([200, 52, 50, 101, 51, 100], 3, [51, 100.5, 200])],
)
def test_running_means(spark, values, tolerance, want):
    assert one(spark, m=shapes.running_means(floats(*values), tolerance)).m == want


@pytest.mark.parametrize("x, y, want", [(100, 115, (0, 0)), (300, 115, (0, 1)), (100, 145, (1, 0)), (300, 145, (1, 1)), (500, 115, None), (100, 200, None), (100, 50, None), (10, 115, None), (48, 115, (0, 0))])
def test_cell_of(spark, x, y, want):
    cell = one(spark, c=l.cell_of(F.lit(float(x)), F.lit(float(y)), floats(50, 250, 450), floats(100, 130, 160))).c
    assert (cell and tuple(cell)) == want


@pytest.mark.parametrize("values, want", [([1, 2, 3, 4], 3), ([5], 5), ([], None), ([2, 1, 3], 2)])
def test_upper_median(spark, values, want):
    assert one(spark, m=g.upper_median(floats(*values))).m == want


def test_rounding_matrices_colours(spark):
    r = one(
        spark, a=g.round_half_up(F.lit(-2.5)), b=g.round_half_up(F.lit(2.5)), m=g.multiply(floats(2, 0, 0, 2, 0, 0), floats(1, 0, 0, 1, 50, 100)),
        n=g.multiply(floats(1, 0, 0, 1, 10, 20), floats(1, 0, 0, 1, 30, 40)), h=g.rgb_hex(F.lit(1.5), F.lit(-1.0), F.lit(0.5)), k=g.cmyk_rgb(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
        f=g.fit_within(F.lit(2000.0), F.lit(1000.0), F.lit(500.0)), tw=g.twips(F.lit(1.03)),
    )
    assert (r.a, r.b, r.m[4], r.n[4:], r.h, tuple(r.k), tuple(r.f), r.tw) == (-2, 3, 100.0, [40.0, 60.0], "ff0080", (0.0, 0.0, 0.0), (500.0, 250.0), 21)


def test_strings(spark):
    r = one(
        spark, x=t.escape_xml(F.lit("a<&>\"'")), f=t.font_name(F.lit("ABCDEF+ArialMT")), z=t.font_name(F.lit("ZapfDingbats")), n=t.field_label(F.lit("form[0].page[1].address_of_the_customer[12]")),
        d=t.pdf_date(F.lit("D:20240102030405Z")).cast("string"), e=t.pdf_date(F.lit("none")), s=t.file_size(F.lit(1536)), h=t.fnv1a(F.lit("hello")), p=t.page_numbers(F.lit("1-2-3,2-4,9,x,0"), F.lit(5)),
        v=t.valid_ranges(F.lit("3-1"), F.lit(5)), w=t.valid_ranges(F.lit("1,,2"), F.lit(5)), ok=t.valid_ranges(F.lit("1-3,5"), F.lit(5)), u=t.from_utf16_hex(t.utf16_hex(F.lit("é😀"))), m=t.masked_digits(F.lit("1a2345"), "##/##/####"),
        q=t.escape_pdf_string(F.lit("(a\\)")), num=t.plain_number(F.lit(2.5)), mi=t.minify_xml(F.lit("<a> <b/>\n</a>")),
    )
    assert r.x == "a&lt;&amp;&gt;&quot;&apos;" and r.f == "Arial" and r.z == "Wingdings" and r.n == "address_of_the_custo"
    assert r.d == "2024-01-02 03:04:05" and r.e is None and r.s == "1.5 KB" and r.h == "4f9f2cab:5" and r.p == [2, 3, 4]
    assert (r.v, r.w, r.ok, r.u, r.m, r.q, r.num, r.mi) == (False, False, True, "é😀", "12/34/5", "\\(a\\\\\\)", "2.5", "<a><b/></a>")


def test_rect_roles(spark):
    rows = [(400.0, 1.0, "a", None), (1.0, 500.0, "a", None), (200.0, 30.0, "a", None), (200.0, 30.0, "a", "b"), (612.0, 792.0, None, "b"), (150.0, 25.0, None, "b"), (10.0, 10.0, None, None), (-612.0, -792.0, None, "b")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "width double, height double, stroke string, fill string, line_width double")
    assert [r.r for r in df.select(e.rect_role().alias("r")).collect()] == ["separator", "separator", "table-border", "table-border", "page-background", "cell-fill", "decorative", "page-background"]


def test_images(spark):
    rows = [(1.0, 1.0, "DCTDecode", 8, True), (3.0, 3.0, "FlateDecode", 8, False), (50.0, 99.0, "FlateDecode", 1, False), (100.0, 100.0, "FlateDecode", 8, False), (100.0, 101.0, "FlateDecode", 8, True)]
    df = spark.createDataFrame(rows, "width double, height double, filter string, bits int, want boolean")
    assert df.where(e.genuine_image() != F.col("want")).count() == 0


def test_anchor_is_the_first_of_the_group(spark):
    rows = [(0, 0, i, float(y), 0.0) for i, y in enumerate([0, 2, 4, 6])]  # drifts by two: 4 is over 3 from 0
    df = spark.createDataFrame(rows, "doc_id long, page_id long, ordinal long, y double, x double")
    assert [r.line for r in l.baseline_lines(df).orderBy("ordinal").collect()] == [0, 0, 1, 1]


def test_collapse_keeps_the_last_bound(spark):
    assert one(spark, c=l.collapse(floats(0, 5, 30, 38, 40))).c == [0.0, 30.0, 40.0]
    assert one(spark, c=l.collapse(floats(0, 4, 30))).c == [0.0, 30.0]
    assert one(spark, c=l.collapse(floats())).c == []


def test_components_against_a_walk(spark):
    import random

    r = random.Random(5)
    nodes = [(0, p, i) for p in range(3) for i in range(20)]
    edges = [(0, p, a, b) for p in range(3) for a in range(20) for b in range(a) if r.random() < 0.05]
    got = {(x.page_id, x.ordinal): x.component for x in shapes.components(spark.createDataFrame(nodes, "doc_id long, page_id long, ordinal long"), spark.createDataFrame(edges, "doc_id long, page_id long, a long, b long"), ["doc_id", "page_id"], "ordinal", "a", "b").collect()}
    label = {(p, i): i for _, p, i in nodes}
    for _ in range(20):
        for _, p, a, b in edges:
            label[p, a] = label[p, b] = min(label[p, a], label[p, b])
    assert got == label


def test_borders_without_a_grid_are_no_table(spark):
    rows = [(0, 0, 0, 0.0, 0.0, 100.0, 20.0, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_id long, ordinal long, x double, y double, width double, height double, stroke string, fill string, line_width double")
    assert l.bordered_tables(df).count() == 0


def test_search_edges(spark):
    df = spark.createDataFrame([("a.b",), ("A.B c",), ("axb",), (None,)], "text string")
    assert e.search(df, "  ").count() == 0
    assert e.search(df, "a.b").count() == 2
    assert e.search(df, "a.b", regex=True).count() == 3
    assert e.search(df, "(a.b", regex=True).count() == 0  # no pattern, so literal
    assert [tuple(r) for r in e.replace_all(df, "a.b", "$0").orderBy("text").collect()] == [("$0", 1), ("$0 c", 1)]


def test_scores_between_the_caps(spark):
    rows = [(1, 100.0, 50.0, 4, 2, 2, 1, 12.0, 9.0, 72.0, 54.0, 4, 3), (2, 0.0, 0.0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source_chars double, output_chars double, source_colors long, output_colors long, detected_tables long, output_tables long, source_size double, output_size double, source_margin double, output_margin double, source_images long, output_images long")
    a, b = (r.asDict() for r in e.quality_scores(df).orderBy("doc_id").collect())
    assert a == {"doc_id": 1, "text": 50.0, "color": 50.0, "structure": 50.0, "typography": 75.0, "spatial": 75.0, "images": 75.0, "composite": 60.0}
    assert b == {"doc_id": 2, "text": 100.0, "color": 100.0, "structure": None, "typography": None, "spatial": None, "images": None, "composite": 100.0}


def test_page_algebra(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "doc_id long, page_id long")
    order = lambda df: [tuple(r) for r in df.select("doc_id", "from_page").orderBy("doc_id", "page_id").collect()]
    assert order(e.reorder(pages, 0, 2)) == [(1, 1), (1, 2), (1, 0), (2, 0)]
    assert order(e.delete_page(pages, 0)) == [(1, 1), (1, 2), (2, 0)]
    assert order(e.extract(pages, "2-3,1")) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_undo_truncates_the_redo_tail(spark):
    ops = ["click", "click", "error", "click", "view", "error", "error", "error", "view"]
    df = spark.createDataFrame([(1, i, i, o) for i, o in enumerate(ops)], "doc_id long, event_id long, ts long, op string")
    assert tuple(e.undo_log(df).first()) == (1, 2, 1)


def test_field_rows_take_the_first_row_that_fits(spark):
    rows = [(0, 0, i, float(x), float(y), 100.0, 18.0) for i, (x, y) in enumerate([(0, 10), (50, 17), (90, 24), (0, 40), (50, 33)])]
    df = spark.createDataFrame(rows, "doc_id long, page_id long, ordinal long, x double, y double, width double, height double")
    means, want = [], {}
    for _, _, i, x, y, _, _ in sorted(rows, key=lambda r: (r[4], r[3], r[2])):
        k = next((k for k, m in enumerate(means) if abs(y - sum(m) / len(m)) <= 8), None)
        if k is None:
            k = len(means)
            means.append([])
        means[k].append(y)
        want[i] = k
    assert {r.ordinal: r.row for r in l.field_rows(df).collect()} == want


def test_borderless_tables(spark):
    lines = [[0, 100, 200], [2, 110, 195], [0, 90, 214], [0, 100], [0, 100], [0, 300], [5, 300], [0, 299, 400]]
    df = spark.createDataFrame([(0, 0, k, [float(x) for x in s]) for k, s in enumerate(lines)], "doc_id long, page_id long, k long, starts array<double>")
    assert sorted((r.first_line, r.n_rows, r.n_cols) for r in l.borderless_tables(df).collect()) == [(0, 3, 3)]
    assert sorted((r.first_line, r.n_rows, r.n_cols) for r in l.borderless_tables(df, least=2).collect()) == [(0, 3, 3), (3, 2, 2), (5, 2, 2)]


def test_bordered_table_of_four_cells(spark):
    schema = "doc_id long, page_id long, ordinal long, x double, y double, width double, height double, stroke string, fill string, line_width double"
    whole = [(0, 0, i, 50.0 * (i % 2), 20.0 * (i // 2), 50.0, 20.0, "a", None, 1.0) for i in range(4)]
    got = l.bordered_tables(spark.createDataFrame(whole, schema)).collect()
    assert [(r.n_rows, r.n_cols, r.n_backed) for r in got] == [(2, 2, 4)]


def test_alignment(spark):
    rows = [("l", 72.0, 300.0), ("l", 72.0, 410.0), ("r", 100.0, 540.0), ("r", 300.0, 540.0), ("c", 100.0, 500.0), ("c", 200.0, 400.0), ("j", 72.0, 540.0), ("j", 72.0, 540.0), ("one", 72.0, 540.0)]
    got = {r.k: r.align for r in l.alignment(spark.createDataFrame(rows, "k string, x0 double, x1 double"), ["k"]).collect()}
    assert got == {"l": "left", "r": "right", "c": "center", "j": "justify", "one": "left"}


def test_rects_filled_by_a_stream():
    from folioframe.operators import content

    data = b"q 1 0 0 1 5 5 cm 1 0 0 rg 0 0 10 20 re 1 1 -1 2 re f Q 3 3 4 4 re S 0 0 1 1 re f*"
    assert list(content.fills(data)) == [(5.0, 5.0, 10.0, 20.0, "ff0000"), (5.0, 6.0, 1.0, 2.0, "ff0000"), (0.0, 0.0, 1.0, 1.0, "000000")]


def test_checksums_like_zlib(spark):
    import zlib

    assert one(spark, c=F.crc32(F.lit("cold widget"))).c == zlib.crc32(b"cold widget")


def test_edges_in_order(spark):
    # variances of exactly 15 on paper: the lines' order decides on which side of the limit their sum falls
    from itertools import permutations

    def side(xs):
        n, mean, sq = 0, 0.0, 0.0
        for x in xs:
            n, before = n + 1, mean
            mean += (x - mean) / n
            sq += (x - mean) * (x - before)
        return "left" if sq / n < 15 else "other"

    spread = (p for p in ([72 + a / 2 for a in (0, b, c, d, e)] for b in range(24) for c in range(b, 24) for d in range(c, 24) for e in range(d, 24)) if 5 * sum(x * x for x in p) - sum(p) ** 2 == 375)
    orders = next(o for o in (list(permutations(p)) for p in spread) if len(set(map(side, o))) == 2)
    rows = [(k, i, x, 1000.0 * i) for k, o in enumerate(orders) for i, x in enumerate(o)]
    df = spark.createDataFrame(rows[::-1], "k int, ordinal int, x0 double, x1 double").repartition(4)
    got = {r.k: r.v for r in df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ordinal", "x0"))).alias("e")).select("k", (shapes.running_variance(F.col("e.x0")) < 15).alias("v")).collect()}
    assert got == {k: side(o) == "left" for k, o in enumerate(orders)}
    wide = l.alignment(df.withColumn("x1", F.col("x0")).withColumn("x0", 1000.0 * F.col("ordinal")), ["k"], order=["ordinal"])
    assert {r.k: r.align == "right" for r in wide.collect()} == got


def test_stream_rows_in_parts():
    # a task holds a bounded number of rows in Python, whatever a batch of pages holds
    import pyarrow as pa

    from folioframe.operators import content

    class Frame:
        dtypes = [("k", "bigint"), ("content", "binary")]
        
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    page = b"\n".join(b"BT (x) Tj ET" for _ in range(9000))
    parts = list(content.lex(Frame(), ["k"])([pa.RecordBatch.from_pydict({"k": [1, 2, 3], "content": [page, None, page]})]))
    assert max(p.num_rows for p in parts) <= 10_000
    assert [(k, o) for p in parts for k, o in zip(p["k"].to_pylist(), p["ordinal"].to_pylist())] == [(k, o) for k in (1, 3) for o in range(36_000)]


def test_nearest_colour_shuffles_texts_and_marks_once(spark, data):
    """Marks aren't repeated over cells, and pages meet without a second join to bring back the texts."""
    from folioframe.plans import catalog

    plan = catalog.queries()["j04_nearest_color"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert "explode(transform(" not in plan.split("Join")[1]


def test_svg_is_written_where_its_page_lies(spark, data):
    from folioframe.plans import catalog

    plan = catalog.queries()["k07_page_svg"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert "<text" not in plan[plan.index("RepartitionByExpression") :], "markup was shuffled"
