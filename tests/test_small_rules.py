"""Field paragraphs split by running means, and colours as text."""

import random

from pyspark.sql import functions as F

from folioframe.functions.text import css_colour
from folioframe.operators import documents as doc

SCHEMA = "doc_id long, paragraph long, kind string, ordinal long, x double, y double, height double"


def bands(items):
    """A plain loop over items (y, kind, ordinal, centre)."""
    if sum(k == "field" for _, k, _, _ in items) < 2 or len(items) < 4:
        return {(k, o): 0 for _, k, o, _ in items}
    out, last, n = {}, [], -1
    for _, k, o, c in sorted(items):
        if not last or abs(c - sum(last) / len(last)) > 8:
            last, n = [], n + 1
        last.append(c)
        out[k, o] = n
    return out


def test_bands_against_a_loop(spark):
    r = random.Random(9)
    rows = [(0, p, r.choice(["text", "field"]), i, float(r.randrange(300)), float(r.randrange(80)), float(r.choice([9, 18]))) for p in range(40) for i in range(r.randrange(1, 12))]
    got = {}
    for x in doc.split_field_paragraphs(spark.createDataFrame(rows, SCHEMA), ["doc_id", "paragraph"]).collect():
        got.setdefault(x["paragraph"], {})[x["kind"], x["ordinal"]] = x["band"]
    assert got == {p: bands([(y, k, o, y + h / 2) for _, q, k, o, _, y, h in rows if q == p]) for p in range(40)}


def test_places_by_x_texts_first(spark):
    rows = [(0, 1, "field", 0, 50.0, 10.0, 18.0), (0, 1, "text", 1, 200.0, 14.0, 9.0), (0, 1, "text", 2, 10.0, 14.0, 9.0), (0, 1, "field", 3, 20.0, 60.0, 18.0), (0, 1, "field", 4, 5.0, 10.0, 18.0)]
    got = {(x["kind"], x["ordinal"]): (x["band"], x["place"]) for x in doc.split_field_paragraphs(spark.createDataFrame(rows, SCHEMA), ["doc_id", "paragraph"]).collect()}
    assert got == {("text", 2): (0, 1), ("text", 1): (0, 2), ("field", 4): (0, 3), ("field", 0): (0, 4), ("field", 3): (1, 1)}


def test_colours(spark):
    cases = {"#ff0080": (1.0, 0.0, 128 / 255, 1.0), "F00": (1.0, 0.0, 0.0, 1.0), " rgba(255, 0, 51, .5) ": (1.0, 0.0, 0.2, 0.5), "RGB(0,0,0)": (0.0, 0.0, 0.0, 1.0), "red": None, "#12345": None, "": None, "rgba(1,2)": None}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r["x"]: r["v"] and tuple(r["v"]) for r in df.select("x", css_colour(F.col("x")).alias("v")).collect()}
    assert got == cases


def test_ids_in_order_shuffle_lines_once(spark, data):
    from folioframe.plans import catalog

    plan = catalog.queries()["v07_sequential_ids"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1
