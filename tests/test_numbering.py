"""Counters of several levels against a plain loop, labels, and parts that are well formed."""

import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from folioframe.operators import numbering as nb


def loop(levels):
    count, out = [0] * nb.LEVELS, []
    for x in levels:
        if x is None:
            out.append(None)
            continue
        x = min(x, nb.LEVELS - 1)
        count[x] += 1
        count[x + 1 :] = [0] * (nb.LEVELS - x - 1)
        out.append([max(c, 1) for c in count[: x + 1]])
    return out


def test_counters_against_a_loop(spark):
    r = random.Random(2)
    docs = [[0, 1, 1, 2, 2, 0, 1, 2], [2, 2, 1, 2], [3, 0, 3], []] + [[r.choice([0, 0, 1, 1, 2, 3, 8, 11, None]) for _ in range(60)] for _ in range(20)]
    df = spark.createDataFrame([(d, i, x) for d, seq in enumerate(docs) for i, x in enumerate(seq)], "doc long, place long, level long")
    got = {(x["doc"], x["place"]): x["numbers"] for x in nb.counters(df, ["doc"], ["place"]).collect()}
    assert got == {(d, i): n for d, seq in enumerate(docs) for i, n in enumerate(loop(seq))}
    assert got[0, 4] == [1, 2, 2] and got[0, 7] == [2, 1, 1]


def test_labels(spark):
    rows = [([4], "4.", "4"), ([2, 27], "aa.", "2.27"), ([1, 3], "c.", "1.3"), ([2, 1, 3], "iii.", "2.1.3"), ([1, 1, 1994], "mcmxciv.", "1.1.1994"), ([1, 1, 1, 9], "9.", "1.1.1.9")]
    df = spark.createDataFrame([(n,) for n, _, _ in rows], "numbers array<long>")
    got = {tuple(r["numbers"]): (r["l"], r["g"]) for r in df.select("numbers", nb.label(F.col("numbers")).alias("l"), nb.legal_label(F.col("numbers")).alias("g")).collect()}
    assert got == {tuple(n): (own, legal) for n, own, legal in rows}


def test_parts_are_well_formed(spark):
    root = ET.fromstring(nb.numbering_xml().encode())
    w = "{" + nb.NAMESPACE + "}"
    assert [len(a.findall(w + "lvl")) for a in root.findall(w + "abstractNum")] == [9, 9] and len(root.findall(w + "num")) == 2
    assert root.findall(w + "abstractNum")[1][2].find(w + "numFmt").get(w + "val") == "lowerRoman"
    lines = spark.createDataFrame([(1, 1, "b < c & d"), (1, 0, "a"), (2, 0, "")], "doc long, line long, text string")
    for part, style in (("hdr", "Header"), ("ftr", "Footer")):
        got = {r["doc"]: ET.fromstring(r["xml"].encode()) for r in nb.edge_xml(lines, ["doc"], ["line"], part).collect()}
        assert ["".join(p.itertext()) for p in got[1]] == ["a", "b < c & d"] and got[1].tag == w + part
        assert got[2][0][0][0].get(w + "val") == style
    item = spark.range(1).select(nb.item_xml(F.lit("x<y"), F.lit(12), F.lit(True)).alias("x"), nb.item_xml(F.lit("p"), F.lit(None).cast("int"), F.lit(True)).alias("y")).first()
    tree = ET.fromstring(f'<r xmlns:w="{nb.NAMESPACE}">{item["x"]}{item["y"]}</r>')
    assert tree[0][0][0][0].get(w + "val") == "8" and tree[1].find(w + "pPr") is None
