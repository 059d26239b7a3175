"""Matches, content streams, readers and streaming edits on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import content
from folioframe.operators import elements as e
from folioframe.operators import layout as l
from folioframe.operators import matches as m
from folioframe.sources import readers, views
from folioframe.streaming import edits

BOX = "doc_id long, page_id long, ordinal long, x double, y double, width double, height double"


def boxes(spark, rows, more="", extra=()):
    return spark.createDataFrame([(0, 0, i, *map(float, r[:4]), *r[4:]) for i, r in enumerate(rows)], BOX + more)


def test_tokens():
    got = [(k, v) for k, v, _, _ in content.tokens(b"% note\n/F#31 12 -.5 +3. Tf (a\\(b\\)(c) \\101\\n\\\nx) <48 65 6> [1(x)] << /K true >> ET*")]
    assert got == [("name", "F1"), ("number", "12"), ("number", "-.5"), ("number", "+3."), ("operator", "Tf"), ("string", "a(b)(c) A\nx"), ("hex", "He`"), ("array_start", "["), ("number", "1"), ("string", "x"), ("array_end", "]"), ("dict_start", "<<"), ("name", "K"), ("literal", "true"), ("dict_end", ">>"), ("operator", "ET*")]
    for broken in (b"(never closed", b"<48", b"[1 2", b">", b"\\", b""):
        list(content.operators(broken))


def test_text_runs():
    data = b"q 1 0 0 1 10 20 cm BT /F1 10 Tf 1 0 0 rg 100 200 Td (ab) Tj 0 -12 TD (c) Tj T* [(d) -500 (e)] TJ ET Q BT /F2 8 Tf 2 0 0 2 0 0 Tm <48> Tj ET"
    assert list(content.text_runs(data)) == [
        ("ab", 110.0, 220.0, "F1", 10.0, "ff0000"), ("c", 110.0, 208.0, "F1", 10.0, "ff0000"), ("d", 110.0, 196.0, "F1", 10.0, "ff0000"), ("e", 120.0, 196.0, "F1", 10.0, "ff0000"), ("H", 0.0, 0.0, "F2", 8.0, "000000"),
    ]


def test_streams_in_spark(spark):
    df = spark.createDataFrame([(1, bytearray(b"BT (x) Tj ET")), (2, None)], "doc_id long, content binary")
    assert content.lex(df, ["doc_id"]).count() == 4
    assert [(r.operator, json.loads(r.operands)) for r in content.parse(df, ["doc_id"]).orderBy("ordinal").collect()] == [("BT", []), ("Tj", [["string", "x"]]), ("ET", [])]
    assert content.runs(df, ["doc_id"]).count() == 1


@pytest.mark.parametrize("stream, want", [("(say old) Tj", "(say new) Tj"), ("[(an old one)] TJ", "[(an new one)] TJ"), ("<6F6C64> Tj", "<6E6577> Tj"), ("<006F006C0064> Tj", "<006E00650077> Tj"), ("(nothing) Tj", None)])
def test_replace(spark, stream, want):
    assert spark.createDataFrame([(stream,)], "s string").select(content.replace_text(F.col("s"), "old", "new")).first()[0] == want


def test_blank_keeps_the_length(spark):
    assert spark.createDataFrame([("(an old) Tj <6F6C64> Tj",)], "s string").select(content.blank_text(F.col("s"), "old")).first()[0] == "(an    ) Tj <202020> Tj"


def test_reading_order_of_two_columns(spark):
    left, right = [(0, y, 100, 10) for y in (40, 52, 64)], [(200, y, 100, 10) for y in (40, 52, 64)]
    df = boxes(spark, [(0, 0, 300, 10), *right, *left])
    assert [r.ordinal for r in m.reading_order(df).orderBy("place").collect()] == [0, 4, 5, 6, 1, 2, 3]
    assert m.reading_order(df.limit(0)).count() == 0 and m.reading_order(boxes(spark, [(0, 0, 1, 1)])).count() == 1


def test_merged_cells(spark):
    borders = [{"x": x, "y": y, "width": w, "height": h} for x, y, w, h in [(0, 0, 100, 0), (0, 20, 200, 0), (0, 40, 200, 0), (0, 0, 0, 40), (200, 0, 0, 40), (100, 20, 0, 20), (0, 0, 200, 0)]]
    df = spark.createDataFrame([(0, 0, 0, [0.0, 100.0, 200.0], [0.0, 20.0, 40.0], [{k: float(v) for k, v in b.items()} for b in borders])], "doc_id long, page_id long, component long, cols array<double>, rows array<double>, boxes array<struct<x:double,y:double,width:double,height:double>>")
    assert sorted((r.row, r.col, r.row_span, r.col_span) for r in m.merged_cells(df).collect()) == [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]


def test_image_resources_are_used_once(spark):
    s = "doc_id long, page_id long, ordinal long, name string, width double, height double"
    uses = spark.createDataFrame([(0, 0, 0, "A", 1.0, 1.0), (0, 0, 1, "B", 5.0, 5.0), (0, 0, 2, "C", 9.0, 9.0), (0, 0, 3, "D", 9.0, 9.0)], s)
    res = spark.createDataFrame([(0, 0, 10, "A", 2.0, 2.0), (0, 0, 11, "Y", 7.0, 7.0), (0, 0, 12, "Z", 5.0, 5.0)], s)
    assert [r.resource for r in m.image_resources(uses, res).orderBy("ordinal").collect()] == [10, 12, 11, None]


def test_column_headers(spark):
    fields = boxes(spark, [(0, 100, 80, 18), (100, 100, 80, 18)])
    texts = boxes(spark, [(10, 80, 50, 10, 10.0), (110, 80, 50, 10, 10.0), (50, 80, 50, 10, 20.0), (0, 80, 180, 10, 10.0), (10, 20, 50, 10, 10.0)], ", font_size double")
    assert sorted(r.ordinal for r in m.column_headers(fields, texts).collect()) == [0, 1]
    assert m.column_headers(fields, texts.where("ordinal = 0")).count() == 0


def test_smallest_container_against_all_pairs(spark):
    r = random.Random(2)
    texts = [(r.uniform(0, 200), r.uniform(0, 200), 10, 10) for _ in range(40)]
    rects = [(r.uniform(0, 150), r.uniform(0, 150), r.uniform(5, 90), r.uniform(5, 90), r.choice(["a", "b", None])) for _ in range(25)]
    got = {x.ordinal: x.fill for x in l.smallest_container(boxes(spark, texts), boxes(spark, rects, ", fill string")).collect()}
    for i, t in enumerate(texts):
        cx, cy = t[0] + 5, t[1] + 5
        inside = [(w * h, k, f) for k, (x, y, w, h, f) in enumerate(rects) if f and x - 2 <= cx <= x + w + 2 and y - 2 <= cy <= y + h + 2]
        assert got[i] == (min(inside)[2] if inside else "white")


def test_tree(spark):
    nodes = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, 0), (0, 0, 2, 1), (0, 0, 3, 9)], "doc_id long, page_id long, ordinal long, parent long")
    assert sorted((r.ordinal, r.depth) for r in e.walk_tree(nodes, 10).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.PDF").write_bytes(b"%PDF")
    (tmp_path / "two.pdf").write_bytes(b"%")
    (tmp_path / "three.png").write_bytes(b"png")
    (tmp_path / "form.json").write_text('{"a": 1, "b": null, "c": "x"}')
    assert sorted(r.name for r in readers.documents(spark, str(tmp_path)).collect()) == ["one.PDF", "two.pdf"]
    assert [r.kind for r in readers.images(spark, str(tmp_path)).collect()] == ["png"]
    assert sorted((r.name, r.value) for r in readers.form_data(spark, str(tmp_path / "form.json")).collect()) == [("a", "1"), ("b", None), ("c", "x")]
    files = spark.createDataFrame([("/a/x.pdf", "x.pdf"), ("/b/x.pdf", "x.pdf"), ("/c/y", "y")], "path string, name string")
    assert sorted(r.output for r in readers.output_names(files).collect()) == ["x (1).pdf", "x.pdf", "y"]
    assert sorted(r.status for r in readers.output_names(files, "skip").collect()) == ["converted", "converted", "skipped"]


def test_streams_agree_with_batches(spark, data, tmp_path):
    log = views.g_edit(spark, data)
    log.select("doc_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "op", "item", "value").repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for name, made, mode in (("undone", edits.histories(source), "update"), ("joined", edits.coalesced(source), "complete")):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, spark.table("undone").collect())) == sorted(map(tuple, e.undo_log(log).collect()))
    assert sorted(map(tuple, spark.table("joined").collect())) == sorted(map(tuple, e.coalesced(log).collect()))


def test_debounced_stream(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00.0", "a", 1, 1.0), (1, 2, "2024-01-01 00:00:00.1", "b", 1, 2.0), (1, 3, "2024-01-01 00:00:05", "c", 1, 3.0), (2, 4, "2024-01-02 00:00:00", "d", 1, 4.0)]
    df = spark.createDataFrame(rows, "doc_id long, event_id long, ts string, op string, item long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = edits.debounced(source).writeStream.format("memory").queryName("last").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id for r in spark.table("last").collect()} == {2, 3}  # the last one's session is still open
    assert {r.event_id for r in e.debounced(df, 1).collect()} == {2, 3, 4}


def test_reading_order_takes_pages_by_batches(spark, data):
    from folioframe.plans import catalog

    plan = catalog.queries()["g32_reading_order"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan, "a call for each page"


@pytest.mark.parametrize("name", ["j18_link_match", "j14_label_cell", "j15_paragraph_background", "j16_nearest_underline", "j23_field_beside_line"])
def test_matched_elements_are_shuffled_once(spark, data, name):
    from folioframe.plans import catalog

    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if x in plan]
    assert joins == ["ShuffledHashJoin"] and "Aggregate" not in plan[: plan.index("ShuffledHashJoin")], "pairs were grouped again"


def test_column_headers_look_up_first_rows(spark, data):
    from folioframe.plans import catalog

    plan = catalog.queries()["j13_column_headers"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_hints_make_no_pairs(spark, data):
    from folioframe.plans import catalog

    plan = catalog.queries()["j19_hint_match"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert "Aggregate" not in plan[: plan.index("ShuffledHashJoin")], "pairs were grouped again"


def test_decorated_texts_are_shuffled_once(spark, data):
    from folioframe.plans import catalog

    plan = catalog.queries()["j17_text_decoration"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert "Aggregate" not in plan[: plan.index("ShuffledHashJoin")], "pairs were grouped again"
