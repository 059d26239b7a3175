"""Whole texts in the views, fonts, documents as XML, field grids, borders, lists and hints on small fixtures."""

import random
import re
import xml.etree.ElementTree as xml

import pytest
from pyspark.sql import functions as F

from folioframe.functions import fonts
from folioframe.functions import geometry as g
from folioframe.functions import text as t
from folioframe.operators import documents as doc
from folioframe.operators import elements as e
from folioframe.operators import layout as l
from folioframe.operators import matches as m
from folioframe.operators import shapes
from folioframe.sources import readers, views
from folioframe.streaming import edits

BOX = "doc_id long, page_id long, ordinal long, x double, y double, width double, height double"


def boxes(spark, rows, more="", extra=()):
    return spark.createDataFrame([(0, 0, i, *map(float, r[:4]), *r[4:]) for i, r in enumerate(rows)], BOX + more)


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_views_keep_every_word(spark, data):
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect():
        words = [w for x in r.text.split("\n") for w in x.split(" ") if w.strip(" ")]
        if words:
            want[r.doc_id] = words
    got = {}
    for r in views.g_text(spark, data).orderBy("doc_id", "page_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == want
    assert max(len(w) for w in want.values()) > 2000


def test_pages_are_bounded(spark, data):
    for view, most in ((views.g_line, 40), (views.g_text, 480), (views.g_field, 60)):
        assert view(spark, data).groupBy("doc_id", "page_id").count().agg(F.max("count")).first()[0] <= most


def test_last_bound_always_stays(spark):
    floats = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, c=l.collapse(floats(0, 30, 38))).c == [0.0, 30.0, 38.0]
    assert one(spark, c=l.collapse(floats(7))).c == [7.0]


RECT = ", stroke string, fill string, line_width double"


def test_grids_want_two_cells_each_way(spark):
    row = [(50 * k, 0, 50, 20, "a", None, 1.0) for k in range(3)]
    assert l.bordered_tables(boxes(spark, row, RECT)).count() == 0
    both = row + [(50 * k, 20, 50, 20, "a", None, 1.0) for k in range(3)]
    assert [(r.n_rows, r.n_cols, r.n_backed) for r in l.bordered_tables(boxes(spark, both, RECT)).collect()] == [(2, 3, 6)]
    turned = [(x + w, y + h, -w, -h, *rest) for x, y, w, h, *rest in both]
    assert [(r.n_rows, r.n_cols) for r in l.bordered_tables(boxes(spark, turned, RECT)).collect()] == [(2, 3)]


def test_underline_is_measured_from_the_middle_of_the_line(spark):
    texts = boxes(spark, [(0, 100, 50, 10)])
    for y, height, want in ((112, 2, True), (112.5, 2, False), (108, 2, True), (107.9, 2, False)):
        r = l.text_decoration(texts, boxes(spark, [(0, y, 50, height)])).first()
        assert r.underline == want, (y, height)
    assert l.text_decoration(texts, boxes(spark, [(0, 104, 50, 2)])).first().strike
    assert not l.text_decoration(texts, boxes(spark, [(0, 104, 39, 2)])).first().strike


def test_headings(spark):
    rows = [(0, 0, 0, 0.0, 14.6, False), (0, 0, 1, 100.0, 10.2, False), (0, 0, 2, 200.0, 9.8, False), (0, 0, 3, 300.0, 11.0, True), (0, 0, 4, 400.0, 10.0, True)]
    rows += [(0, 0, 5 + k, 500.0 + 15 * k, 20.0, False) for k in range(4)]  # four lines are no heading
    df = spark.createDataFrame(rows, "doc_id long, page_id long, ordinal long, y double, font_size double, bold boolean")
    assert {r.ordinal: (r.level, r.body) for r in l.headings(df).collect()} == {0: (2, 10.0), 3: (3, 10.0)}


@pytest.mark.parametrize(
    "text, want",
    [("1. one", ("1.", 2, "one")), ("  (12) x", ("(12)", 2, "x")), ("B) up", ("B)", 2, "up")), ("(a) x", ("(a)", 2, "x")), ("XIV. y", ("XIV.", 2, "y")), ("mm) y", ("mm)", 2, "y")), ("• a", ("•", 1, "a")), (" ▸b", ("▸", 1, "b")), ("⁃  c", ("⁃", 1, "c")), ("- ", None), ("· d", None), ("1.5 m", None), ("text", None)],
)
def test_lists(spark, text, want):
    df = spark.createDataFrame([(0, 0, 0, text, 72.0)], "doc_id long, page_id long, ordinal long, text string, x double")
    r = l.lists(df).first()
    assert (r and (r.mark, r.num_id, r.rest)) == want


def test_hints(spark):
    p = spark.createDataFrame([(0, 0, 0, "A Title here"), (0, 0, 1, "a title"), (0, 0, 2, "page 7"), (0, 0, 3, "oﬁce"), (0, 0, 4, "")], "doc_id long, page_id long, ordinal long, text string")
    h = [(0, 0, 0, "A Title", "H2", "en", None), (0, 0, 1, "Page 7", "Artifact", None, None), (0, 0, 2, "oﬁce", "Span", None, "office"), (0, 0, 3, "Title", "H1", "de", None), (0, 0, 4, "", "H1", None, None)]
    got = {r.ordinal: (r.role, r.lang, r.actual, r.artifact) for r in m.structure_hint(p, spark.createDataFrame(h, "doc_id long, page_id long, ordinal long, text string, role string, lang string, actual string")).collect()}
    assert got == {0: ("H2", "de", None, False), 1: (None, None, None, False), 2: (None, None, None, True), 3: (None, None, "office", False), 4: (None, None, None, False)}


def test_borders_of_cells(spark):
    cells = boxes(spark, [(0, 0, 100, 20)])
    rects = [(0, -1, 100, 1), (0, 21, 100, 1), (-1, 0, 1, 20), (102.9, 0, 1, 20), (0, 24, 100, 1), (0, 0, 20, 1), (0, 0, 100, 90)]
    r = m.cell_borders(cells, boxes(spark, [(*x, "s") for x in rects], ", stroke string")).first()
    assert (r.top, r.bottom, r.left, r.right) == (0, 1, 2, 3)
    assert tuple(m.cell_borders(cells, boxes(spark, [(0, 0, 9, 9, None)], ", stroke string")).first())[3:] == (None,) * 4


def test_banded_joins_against_all_pairs(spark):
    r = random.Random(8)
    texts = [(r.uniform(0, 300), r.uniform(-40, 700), 30, 10, r.choice([6.0, 12.0, 60.0])) for _ in range(60)]
    marks = [(r.uniform(0, 300), r.uniform(-40, 700), 1, 1, f"c{i}") for i in range(40)]
    got = {x.ordinal: x.color for x in l.nearest_color(boxes(spark, texts, ", font_size double"), boxes(spark, marks, ", color string")).collect()}
    for i, (x, y, _, _, size) in enumerate(texts):
        near = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, k, c) for k, (a, b, _, _, c) in enumerate(marks)]
        assert got[i] == (min(near)[2] if min(near)[0] <= 2 * size else "000000")
    paths = [(r.uniform(0, 300), r.uniform(-40, 700), r.uniform(1, 200), r.uniform(1, 300)) for _ in range(40)]
    hits = {x.ordinal: x.n for x in m.in_graphics(boxes(spark, [t[:4] for t in texts]), boxes(spark, paths), 2).collect()}
    for i, (x, y, w, h, _) in enumerate(texts):
        n = sum(x < a + c + 5 and x + w + 5 > a and y < b + d + 5 and y + h + 5 > b for a, b, c, d in paths)
        assert hits.get(i, 0) == (n if n >= 2 else 0)


def test_runs_keep_to_their_line(spark):
    rows = [(0, 0, i, float(x), 30.0, w, 10.0, b, "000000", ln) for i, (x, w, b, ln) in enumerate([(0, "a", False, 0), (40, "b", True, 0), (10, "c", False, 1), (60, "d", False, 1)])]
    df = spark.createDataFrame(rows, "doc_id long, page_id long, ordinal long, x double, width double, text string, font_size double, bold boolean, color string, ln long")
    got = sorted((r.ln, r.run, r.text, r.bold) for r in l.styled_runs(df, ["doc_id", "page_id", "ln"]).collect())
    assert got == [(0, 0, "a", False), (0, 1, " b", True), (1, 0, "c d", False)]


def test_glyph_widths(spark):
    r = one(
        spark, w=fonts.text_width(F.lit("Hi, you"), F.lit(1000)), k=fonts.text_width(F.lit("To AV"), F.lit(1000), kerning=True), o=fonts.text_width(F.lit("中\t"), F.lit(10)), e=fonts.text_width(F.lit(""), F.lit(10)), s=fonts.character_spacing(F.lit("ab"), F.lit(20), F.lit(10)),
        n=fonts.character_spacing(F.lit("ab"), F.lit(11.4), F.lit(10)), a=fonts.advance(F.lit("a b"), F.lit(10), 1.0, 5.0, 0.5), h=fonts.text_height(F.lit(10)), d=fonts.descent_below(F.lit(10)),
    )
    assert r.w == 722 + 222 + 278 + 278 + 500 + 556 + 556 and r.k == 611 + 556 + 278 + 667 + 667 - 120 - 70 and (r.o, r.e) == (10.0, 0.0)
    assert r.s == pytest.approx((20 - 11.12) / 2) and r.n is None and r.a == pytest.approx((5.56 + 2.78 + 5.56 + 3 + 5) / 2) and (r.h, r.d) == (9.25, 2.07)


@pytest.mark.parametrize("name, want", [("ABCDEF+Arial-BoldItalicMT", "Helvetica-BoldOblique"), ("Menlo-Bold", "Courier-Bold"), ("Georgia", "Times-Roman"), ("Open Sans Serif", "Helvetica"), ("Garamond-It", "Times-Italic"), ("Foobd", "Helvetica-Bold")])
def test_standard_fonts(spark, name, want):
    assert one(spark, f=fonts.standard_font(F.lit(name))).f == want


def test_unicode_maps(spark):
    cmap = "2 beginbfchar <01> <0041>\n<0002> <D83DDE00> endbfchar 3 beginbfrange\n<10> <12> <00E9> <20> <21> [<0066> <00660069> <007A>]\n<30> <30> <00410042>\nendbfrange"
    got = {r.code: r.text for r in one(spark, m=fonts.unicode_map(F.lit(cmap))).m}
    assert got == {1: "A", 2: "😀", 16: "é", 17: "ê", 18: "ë", 32: "f", 33: "fi", 48: "AB"}
    assert one(spark, m=fonts.unicode_map(F.lit("nothing"))).m == []


def test_xml_is_well_formed(spark):
    runs = [(1, 0, 0, 'a < b & "c"', True, "ff0000", 12.0), (1, 0, 1, " d", False, "000000", 13.5), (1, 1, 0, "é", False, "000000", 12.0)]
    df = spark.createDataFrame(runs, "doc_id long, ln long, run long, text string, bold boolean, color string, font_size double")
    whole = doc.flow_xml(df, ["doc_id"], "ln", ["run"]).first().xml
    tree = xml.fromstring(f'<d xmlns:w="w">{whole}</d>')
    assert ["".join(p.itertext()) for p in tree] == ['a < b & "c" d', "é"]
    assert len(tree.findall(".//{w}b")) == 1 and [s.get("{w}val") for s in tree.findall(".//{w}sz")] == ["24", "27", "24"]
    cells = [(0, 0, 0, 1, 2, 200.0, "wide"), (0, 0, 2, 2, 1, 100.0, "tall"), (0, 1, 0, 1, 1, 100.0, ""), (0, 1, 1, 1, 1, 100.0, "<x>")]
    table = doc.table_xml(spark.createDataFrame(cells, "doc_id long, row long, col long, row_span long, col_span long, width double, text string"), ["doc_id"]).first().xml
    rows = xml.fromstring(table.replace("<w:tbl>", '<w:tbl xmlns:w="w">'))
    assert [len(r) for r in rows] == [2, 3] and rows.find(".//{w}gridSpan").get("{w}val") == "2"
    assert [v.get("{w}val") for v in rows.findall(".//{w}vMerge")] == ["restart", None] and "".join(rows.itertext()) == "widetall<x>"
    part = boxes(spark, [(1, 2, 3, 4, "text", "<a/>"), (1, 2, 3, 4, "fill", "<b/>")], ", kind string, body string")
    assert re.findall("<([ab])/>", doc.positioned_xml(part).first().xml) == ["b", "a"]


def test_field_grid(spark):
    f = [(0, 0, i, x, y, 80.0, 18.0, r, c) for i, (x, y, r, c) in enumerate([(100.0, 100.0, 0, 0), (200.0, 102.0, 0, 1), (104.0, 140.0, 1, 0), (200.0, 140.0, 1, 1)])]
    fields = spark.createDataFrame(f, BOX + ", row long, col long")
    heads = boxes(spark, [(90, 80, 40, 10), (210, 82, 40, 10)])
    texts = boxes(spark, [(60, 105, 20, 10), (20, 300, 20, 10)])
    r = doc.field_grid(fields, heads, texts).first()
    assert (r.cols, r.rows, r.has_header) == ([58.0, 191.0, 282.0], [78.0, 96.0, 130.0, 160.0], True)
    r = doc.field_grid(fields, heads.limit(0), texts.limit(0)).first()
    assert (r.cols, r.rows, r.has_header) == ([100.0, 191.0, 282.0], [98.0, 130.0, 160.0], False)


def test_saved(spark):
    key = "doc_id long, page_id long, ordinal long, "
    texts = spark.createDataFrame([(1, 0, 0, "old"), (1, 0, 1, "kept"), (1, 1, 0, "gone")], key + "text string")
    edits_ = spark.createDataFrame([(1, 0, 0, "new", 1), (1, 0, 0, "newer", 2)], key + "text string, at long")
    fields = spark.createDataFrame([(1, 2, 0, "n", "v"), (1, 2, 1, "o", "w")], key + "name string, value string")
    values = spark.createDataFrame([(1, "n", "V")], "doc_id long, name string, value string")
    pages = spark.createDataFrame([(1, 0, 1), (1, 2, 0)], "doc_id long, from_page long, page_id long")
    got = sorted(map(tuple, doc.saved(texts, edits_, fields, values, pages).collect()))
    assert got == [(1, 0, "field", 0, "V"), (1, 0, "field", 1, "w"), (1, 1, "text", 0, "newer"), (1, 1, "text", 1, "kept")]


def test_line_splits_and_extents(spark):
    lines = spark.createDataFrame([(0, 0, i, y, 12.0, 10.0) for i, y in enumerate([0.0, 14.0, 41.0, 68.1])], "doc_id long, page_id long, ln long, y double, height double, font_size double")
    assert [r.paragraph for r in l.line_splits(lines).orderBy("ln").collect()] == [0, 0, 0, 1]
    t_ = spark.createDataFrame([(0, 0, 0, [10.0, 30.0, 70.0], [5.0, 25.0, 40.0])], "doc_id long, page_id long, component long, cols array<double>, rows array<double>")
    r = l.extents(t_, F.lit(4.0)).first()
    assert (r.widths, r.heights, r.x, r.y, r.width, r.height) == ([24.0, 40.0], [20.0, 15.0], 6.0, 5.0, 64.0, 35.0)


def test_small_functions(spark):
    r = one(
        spark, m=g.inverse_rotation(F.lit(-90), F.lit(10), F.lit(20)), o=g.inverse_rotation(F.lit(0), F.lit(10), F.lit(20)), gap=g.gap(F.lit(0), F.lit(5), F.lit(9), F.lit(1)), none=g.gap(F.lit(0), F.lit(5), F.lit(4), F.lit(1)), i=t.is_italic_font(F.lit("Arial-Oblique")), c=t.choice_index(F.lit("z"), F.array(F.lit("a"))),
        a=t.appearance(F.lit("0.5 g /He-lv 9.5 Tf")), d=t.shown_date(F.lit("D:20240203")), n=t.shown_date(F.lit("soon")), label=e.annotation_label(F.lit("note"), F.lit(""), F.lit(0), F.lit("")), strokes=e.annotation_label(F.lit("drawing"), F.lit(""), F.lit(1), F.lit("")), shape=e.annotation_label(F.lit("shape"), F.lit(""), F.lit(1), F.lit("arrow")),
    )
    assert r.m == [0, 1, -1, 0, 20, 0] and r.o == [1, 0, 0, 1, 0, 0] and (r.gap, r.none, r.i, r.c) == (4, 0, True, 0)
    assert tuple(r.a) == ("He-lv", 9.5, "0.5 g") and (r.d, r.n) == ("2024-02-03 00:00:00", "soon") and (r.label, r.strokes, r.shape) == ("Empty note", "Drawing (1 stroke)", "Arrow")


def test_classes_and_origins(spark):
    df = boxes(spark, [(0, 0, 1, 1), (5, 5, 1, 1), (0, 0, 1, 1)])
    assert sorted((r.ordinal, r["class"], r.n) for r in m.by_rectangle(df).collect()) == [(0, 0, 2), (1, 1, 1), (2, 0, 2)]
    cells = spark.createDataFrame([(0, 0, 10 * r + c, r, c) for r in range(3) for c in range(3)], "doc_id long, page_id long, ordinal long, row long, col long")
    merged = cells.where("ordinal in (0, 11)").withColumn("down", F.lit(1)).withColumn("across", F.lit(1))
    assert {r.ordinal: r.origin for r in m.merge_origins(cells, merged).collect()} == {0: 0, 1: 0, 2: None, 10: 0, 11: 0, 12: 11, 20: None, 21: 11, 22: 11}


def test_nearest_row(spark):
    a = boxes(spark, [(0, 0, 1, 1), (50, 0, 1, 1)])
    b = spark.createDataFrame([(0, 0, 7, 3.0), (0, 0, 8, 3.0)], "doc_id long, page_id long, o long, at double")
    d = F.abs(F.col("x") - F.col("at"))
    got = shapes.nearest(a, b, ["doc_id", "page_id"], ["doc_id", "page_id", "ordinal"], d, d <= 10, F.col("o"), F.col("o"), "near")
    assert {r.ordinal: r.near for r in got.collect()} == {0: 7, 1: None}


def test_sinks_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, page_id long")
    readers.save(df, f"{tmp_path}/a")
    readers.save_by_page(df, f"{tmp_path}/b")
    readers.save_versioned(df, f"{tmp_path}/c", "v7")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2 and (tmp_path / "b" / "page_id=1").is_dir()
    assert {r.version for r in spark.read.json(f"{tmp_path}/c").collect()} == {"v7"}
    spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("j", None, 1)], "key string, value string, at long").write.parquet(f"{tmp_path}/s")
    assert {r.key: r.value for r in readers.settings(spark, f"{tmp_path}/s").collect()} == {"k": "new", "j": None}


def test_autosave(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00")], "doc_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    q = edits.autosave(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", "1 seconds")
    q.processAllAvailable()
    q.stop()
    saved = spark.read.parquet(f"{tmp_path}/out")
    assert [r.doc_id for r in edits.recoverable(saved, F.expr("timestamp'2024-01-03 12:00:00'")).collect()] == [2]


def test_long_logs_stream_through(spark):
    n = 30_000
    r = random.Random(4)
    ops = [r.choice(["click", "error", "view"]) for _ in range(n)]
    length = at = 0
    for o in ops:
        if o == "error":
            at = max(at - 1, 0)
        elif o == "view":
            at = min(at + 1, length)
        else:
            length = at = at + 1
    df = spark.createDataFrame([(i % 2, i // 2, i // 2, o) for i, o in enumerate(x for o in ops for x in (o, "click"))], "doc_id long, event_id long, ts long, op string").repartition(7)
    got = {r.doc_id: (r.history, r.cursor) for r in e.undo_log(df).collect()}
    assert got == {0: (length, at), 1: (n, n)}


def test_width_by_one_pass(spark):
    df = spark.createDataFrame([("Hi, you 中\U0001F600\t",), ("",), (None,)], "x string").select(fonts.text_width("x", F.lit(1000)).alias("w"))
    table = dict(zip(range(32, 127), fonts.HELVETICA))
    assert [r.w for r in df.collect()] == [sum(table.get(ord(ch), fonts.DEFAULT) for ch in "Hi, you 中\U0001F600\t"), 0, None]
    assert "translate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_elements_of_saved_pages_are_shuffled_once(spark, data):
    from folioframe.plans import catalog

    plan = catalog.queries()["k11_saved"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    words = plan[: plan.index("Union")]
    assert words.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in words and "BroadcastHashJoin" not in words


def test_runs_of_a_document_are_shuffled_once(spark, data):
    from folioframe.plans import catalog

    df = catalog.queries()["k03_runs_xml"](spark, data)
    assert df.count()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
