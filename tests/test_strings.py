"""Replacement and blanking: only shown strings change, however they are cut."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioframe.operators import strings as st

KEY = ["page_id"]


def pages(spark, *streams):
    return spark.createDataFrame(list(enumerate(streams)), "page_id long, content string")


def one(df):
    return [(r["content"], r["way"]) for r in df.orderBy("page_id").collect()]


def test_tokens_lose_nothing(spark):
    streams = ["BT /F1 12 Tf [(a\\)b) -20 <48 6>]TJ ET\n% (no) Tj\nBI /W 1 ID \x00(x)\x01 EI\n(a(b(c)d)e)' <</K(v)>>BDC", "", "((", "<4", "[[]]"]
    t = st.tokens(pages(spark, *streams), KEY)
    back = {r["page_id"]: r["c"] for r in t.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("c")).collect()}
    assert [back.get(i, "") for i in range(len(streams))] == streams
    s = st.shown(t, KEY).orderBy("page_id", "pos").collect()
    assert [(r["text"], r["operator"]) for r in s] == [("a)b", "TJ"), ("H`", "TJ"), ("a(b(c)d)e", "'")]


@pytest.mark.parametrize("word", ["F1", "BT", "Tf", "12", "ET", "Tj"])
def test_operators_names_and_numbers_stay(spark, word):
    stream = f"BT /F1 12 Tf (page {word} text) Tj ET\n({word}) /Tag BMC % ({word}) Tj\n<</A({word})>> BDC"
    ((out, way),) = one(st.replace_text(pages(spark, stream), KEY, word, "ZZ"))
    assert out == stream.replace(f"page {word} text", "page ZZ text") and way == st.LINE
    ((out, _),) = one(st.blank_text(pages(spark, stream), KEY, word))
    assert out == stream.replace(f"page {word} text", f"page {'  '} text")


def test_ways_in_order(spark):
    cases = [
        ("(that) Tj (is that) Tj", "(THIS ONE) Tj (is that) Tj", st.EXACT),
        ("[(is th) -20 (at) 5 ( so)] TJ", "[(is ) (THIS ONE) 5 ( so)] TJ", st.ARRAY),
        ("[(t)-1(h)-2(a)-3(t)-4(s)] TJ [(that)] TJ", "[(THIS ONE)-4(s)] TJ [(THIS ONE)] TJ", st.ARRAY),
        ("<74686174> Tj (that is) Tj", "<54484953204F4E45> Tj (that is) Tj", st.EXACT_HEX),
        ("<FEFF0069007300200074006800610074> Tj", "<FEFF00690073002000540048004900530020004F004E0045> Tj", st.UTF16),
        ("(is t) Tj 3 0 Td (hat so) Tj\n(that) ' (not that)", "(is THIS ONE) Tj 3 0 Td ( so) Tj\n(THIS ONE) ' (not that)", None),
        ("(is t) Tj (ha) Tj 1 w (t.) Tj\n(not) Tj", "(is THIS ONE) Tj () Tj 1 w (.) Tj\n(not) Tj", st.LINE),
        ("(nothing) Tj", "(nothing) Tj", 0),
    ]
    got = one(st.replace_text(pages(spark, *[c[0] for c in cases]), KEY, "that", "THIS ONE"))
    for (stream, want, way), (out, taken) in zip(cases, got):
        if way is None:  # a whole string comes before a line
            want, way = "(is t) Tj 3 0 Td (hat so) Tj\n(THIS ONE) ' (not that)", st.EXACT
        assert (out, taken) == (want, way), stream


def test_loose_white_space_and_escapes(spark):
    ((out, way),) = one(st.replace_text(pages(spark, "[(see  ) -1 (\\(it\\)) 2 (\\nnow)] TJ"), KEY, "see (it) now", "a (b)"))
    assert (out, way) == ("[(a \\(b\\))] TJ", st.LOOSE)
    ((out, _),) = one(st.replace_text(pages(spark, "(caf\\351) Tj"), KEY, "café", "tea")) 
    assert out == "(tea) Tj"
    ((out, _),) = one(st.replace_text(pages(spark, "(plain) Tj"), KEY, "plain", "日本"))
    assert out == "<FEFF65E5672C> Tj"


def test_codes_of_a_font(spark):
    codes = {i: chr(i + 29) for i in range(3, 98)}
    fonts = spark.createDataFrame([(0, "F2", codes), (1, "F2", codes)], "page_id long, font string, codes map<int,string>")
    enc = lambda t: "".join(f"{ord(c) - 29:04X}" for c in t)
    streams = [f"BT /F2 9 Tf <{enc('is th')}> Tj <{enc('at so')}> Tj ET\n(that) ' /F1 9 Tf", f"/F2 9 Tf <{enc('that')}> Tj"]
    got = one(st.replace_text(pages(spark, streams[0].replace("(that) '", "(no) '"), streams[1]), KEY, "that", "those", fonts))
    assert got[0] == (f"BT /F2 9 Tf <{enc('is those')}> Tj <{enc(' so')}> Tj ET\n(no) ' /F1 9 Tf", st.CODES)
    assert got[1] == (f"/F2 9 Tf <{enc('those')}> Tj", st.CODES)
    got = one(st.replace_text(pages(spark, *streams), KEY, "that", "日", fonts))
    assert got[1] == (streams[1], 0), "what the font can't show stays"
    got = one(st.blank_text(pages(spark, *streams), KEY, "that", fonts))
    assert got[0][0] == f"BT /F2 9 Tf <{enc('is   ')}> Tj <{enc('   so')}> Tj ET\n(    ) ' /F1 9 Tf"


def test_streams_cut_at_random(spark):
    r = random.Random(5)
    esc = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    lines, streams = [], []
    for _ in range(60):
        text = "".join(r.choice(["ab", "that", "(x)", "é", " ", "tha", "\\", "t"]) for _ in range(r.randrange(1, 14)))
        out, at = [], 0
        while at < len(text):
            n = r.randrange(1, 5)
            p, at = text[at : at + n], at + n
            out.append(f"<{p.encode('latin-1').hex()}>" if r.random() < 0.4 else f"({esc(p)})")
        lines.append(text)
        streams.append("/F1 9 Tf [" + "".join(f"{p} {r.randrange(-99, 99)} " for p in out) + "] TJ" if r.random() < 0.5 else "1 0 0 1 2 3 Tm " + " ".join(f"{p} Tj" for p in out))
    df = pages(spark, *streams)
    for new in ("", "q", "longer than it", "(y)\\"):
        out = st.replace_text(df, KEY, "that", new)
        after = {x["page_id"]: x["text"] for x in st.shown_lines(out.select(*KEY, "content"), KEY).collect()}
        made = {x["page_id"]: x["content"] for x in out.collect()}
        for i, (text, stream) in enumerate(zip(lines, streams)):
            whole = [x for x in (st_pieces(stream) if stream.endswith("Tj") else []) if x == "that"]
            if whole:  # whole strings come first, all of them
                continue
            assert after.get(i, "") == text.replace("that", new, 1), (stream, made[i])
            assert [x for x in re.findall(r"(?<=\s)(?:Tf|Tm|Tj|TJ)", made[i])] == re.findall(r"(?<=\s)(?:Tf|Tm|Tj|TJ)", stream)
    blank = {x["page_id"]: x["text"] for x in st.shown_lines(st.blank_text(df, KEY, "that").select(*KEY, "content"), KEY).collect()}
    for i, (text, stream) in enumerate(zip(lines, streams)):
        if stream.endswith("TJ"):
            assert blank.get(i, "") == text.replace("that", "    ")


def st_pieces(stream):
    """Texts of the strings of a stream of single strings."""
    out = []
    for p in re.findall(r"(\((?:\\.|[^\\()])*\)|<[0-9a-f]*>) Tj", stream):
        out.append(bytes.fromhex(p[1:-1]).decode("latin-1") if p[0] == "<" else re.sub(r"\\(.)", r"\1", p[1:-1]))
    return out


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "page_id long, content string")
    assert st.replace_text(df, KEY, "a", "b").collect() == [] and st.blank_text(df, KEY, "a").collect() == []


def test_streams_are_read_where_their_pages_lie(spark):
    fonts = spark.createDataFrame([(0, "F2", {5: "a"})], "page_id long, font string, codes map<int,string>")
    df = pages(spark, "(that) Tj")
    for out in (st.replace_text(df, KEY, "that", "x"), st.blank_text(df, KEY, "that"), st.shown_lines(df, KEY)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Window", "Join", "Generate", "Aggregate")), "a row for each token"
    plan = st.replace_text(df, KEY, "that", "x", fonts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan and "Generate" not in plan


def test_a_page_read_in_order_shows_what_the_rows_show(spark):
    r = random.Random(8)
    bits = ["(a)", "(b\\)\\101\\\nc)", "((d)e)", "<4 1>", "<FEFF0042>", "<414>", " ", "\n", " Tj ", " TJ ", "[", "]", "/F1 9 Tf ", "/F2 ", " Tf\n", "% (x) Tj\n", " -12 ", "12a ", "<<", ">>", "' ", " BI (i) Tj EI ", " w ", "BT ET\r\n"]
    streams = ["".join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(200)] + ["( Tj", ") ( Tj", "<4 Tj", "{(a)} Tj", "1.(a)Tj"]
    fonts = spark.createDataFrame([(i, "F1", {65: "ß"}) for i in range(0, len(streams), 3)], "page_id long, font string, codes map<int,string>")
    rows = st.shown(st.tokens(pages(spark, *streams), KEY), KEY, fonts).orderBy("page_id", "pos").collect()
    want = {}
    for x in rows:
        want.setdefault(x["page_id"], []).append((x["text"], x["array"], x["line"], x["coded"]))
    for i, stream in enumerate(streams):
        got = [(s[3], s[4], s[5], s[2] == "coded") for s in st._shown_in(stream, {"F1": {65: "ß"}} if i % 3 == 0 else {})]
        assert got == want.get(i, []), stream


def test_an_array_whose_font_lacks_a_rest_stays(spark):
    codes = {ord(c): c for c in "seit "} | {1: "日x"}
    fonts = spark.createDataFrame([(0, "F2", codes)], "page_id long, font string, codes map<int,string>")
    stream = "/F2 9 Tf [<736565> -3 <202020> <697401>] TJ"
    ((out, way),) = one(st.replace_text(pages(spark, stream), KEY, "see it", "site", fonts))
    assert (out, way) == (stream, 0), "what the font can't show was dropped"


def test_plain_strings_are_read_as_one_run():
    array = "[" + " ".join(f"(ab) -{i} <6364> 3" for i in range(500)) + "] TJ"
    shows = " ".join("(ab) Tj <FEFF0063> Tj" for _ in range(500))
    for stream, text, n in ((array, "abcd" * 500, 1), (shows, "abc" * 500, 1), (shows + "\n(x\\051y) Tj", "abc" * 500 + "x)y", 2)):
        runs = st._runs_in(stream, {})
        assert "".join(r.text for r in runs) == text and len(runs) == n, "a row or a tuple for each piece"
    assert st._lines(array, {}) == [(0, "abcd" * 500, 1000)]


def test_cut_pages_are_shuffled_once_and_made_once(spark, data):
    from folioframe.plans import catalog

    for name in ("x05_split_arrays", "x05_split_operators", "x06_blank_split",):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Join", "Window")) and plan.count("RepartitionByExpression") == 1, plan
        assert plan.count("1 0 0 1 72") == 1, "streams are made twice"


@pytest.mark.parametrize("name", ["x05_split_arrays", "x05_split_operators", "x06_blank_split"])
def test_pages_of_equal_documents_are_one_page(spark, tmp_path, name):
    from folioframe.plans import catalog

    rows = [(1, "so that is\n\nwhat (that) \\ was"), (1, "é that\nit"), (2, None), (3, ""), (4, "\n" * 50 + "that that")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["page_id"], r["ordinal"], r["text"].replace("those there", "that")) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    shown = lambda text: text.replace("that", "    ") if name == "x06_blank_split" else text
    want = [(1, 0, 0, "so that is"), (1, 0, 2, "what (that) \\ was"), (1, 0, 0, "é that"), (1, 0, 1, "it"), (4, 1, 10, "that that")]
    assert got == sorted((*w[:3], shown(w[3])) for w in want)
