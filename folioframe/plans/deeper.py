"""Queries over shown strings, trees, marked content, whole tables, consumption, numbering, and their statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import fonts
from folioframe.functions.text import css_colour, escape_pdf_string, utf16_hex
from folioframe.operators import documents as doc
from folioframe.operators import elements as e
from folioframe.operators import numbering as nb
from folioframe.operators import strings as st
from folioframe.operators import tables as tb
from folioframe.operators import trees
from folioframe.sources import views as v

from .catalog import _QUERIES, _ROLE, _SQL, KEY, PAGE, register
from .wider import _GRIDS


def _redefine(name: str, sql: str, ctes: str = "", recursive: bool = False):
    """Registers a query that stands already anew."""
    _QUERIES.pop(name, None)
    _SQL.pop(name, None)
    return register(name, sql, ctes, recursive)


# ---- shown strings

_ASCII = r"^[\x00-\x7F]*$"


def _token(piece: Column, hexed: Column) -> Column:
    """A string of a stream: ASCII literally or in hex, the rest as UTF-16."""
    own = F.when(hexed, F.concat(F.lit("<"), F.hex(F.encode(piece, "UTF-8")), F.lit(">"))).otherwise(F.concat(F.lit("("), escape_pdf_string(piece), F.lit(")")))
    return F.when(piece.rlike(_ASCII), own).otherwise(F.concat(F.lit("<FEFF"), utf16_hex(piece), F.lit(">")))


def _page_streams(lines: DataFrame, shows: Column) -> DataFrame:
    """Streams of pages, a line of the stream for each visual line."""
    line = F.concat(F.lit("BT /F1 12 Tf 1 0 0 1 72 "), F.col("ordinal").cast("string"), F.lit(" Tm "), shows, F.lit(" ET % that"))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))


def _whole(s, d) -> DataFrame:
    lines = v.g_line(s, d)
    return _page_streams(lines, F.concat(_token(F.col("text"), F.lit(False)), F.lit(" Tj")))


def _cut_pages(s, d, after, around) -> DataFrame:
    """Streams of pages whose lines are cut into pieces of one to five characters, each third in hex, each with what comes ``after`` it.

    ``places`` are the ordinals of the stream's lines; it has none for a blank one.
    """

    def shows(x: Column) -> Column:
        text, k, last = x["text"], x["k"], x["last"]
        piece = lambda i: F.substr(text, i * k + 1, k)
        each = lambda first, token: F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.concat(token(i), *after(i)))).otherwise(none)
        literal, hexed = [(F.lit(p), F.lit(q)) for p, q in ("()", "<>")]
        plain = lambda i: F.when(i % 3 == 2, F.concat(hexed[0], F.hex(piece(i)), hexed[1])).otherwise(F.concat(literal[0], piece(i), literal[1]))

        def three(at: Column, j: Column) -> Column:
            own = [(literal, F.substr(text, at + 1, k)), (literal, F.substr(text, at + k + 1, k)), (hexed, F.substr(x["hex"], 2 * at + 4 * k + 1, 2 * k))]
            return F.concat(*[c for n, ((p, q), o) in enumerate(own) for c in ([F.lit(" ")] if n else []) + [p, o, q, *after(3 * j + n)]])

        # the tokens of ``_token`` for lines that need no escapes: asked once a line, and made three at a time
        threes = F.when(x["threes"] > 0, F.transform(F.sequence(F.lit(0), 3 * k * (x["threes"] - 1), 3 * k), three)).otherwise(none)
        return around(F.array_join(F.when(x["hex"].isNotNull(), F.concat(threes, each(3 * x["threes"], plain))).otherwise(each(F.lit(0), lambda i: _token(piece(i), i % 3 == 2))), " "))

    none = F.array().cast("array<string>")
    k = lambda x: ((F.col("doc_id") + x["ln"]) % 5 + 1).cast("int")
    whole = lambda n: F.floor(n).cast("int")
    hexed = lambda x: F.when(x["text"].rlike(r"^[\x00-\x27\x2A-\x5B\x5D-\x7F]*\z"), F.hex(x["text"]))
    sized = lambda x: F.struct(x["ordinal"], x["text"], k(x).alias("k"), whole((F.length(x["text"]) - 1) / k(x)).alias("last"), whole(F.length(x["text"]) / (3 * k(x))).alias("threes"), hexed(x).alias("hex"))
    pages = v.g_page(s, d).select(*PAGE, F.transform(F.filter("lines", lambda x: x["text"] != ""), sized).alias("lines"))
    line = lambda x: F.concat(F.lit("BT /F1 12 Tf 1 0 0 1 72 "), x["ordinal"].cast("string"), F.lit(" Tm "), shows(x), F.lit(" ET % that"))
    return pages.select(*PAGE, F.transform("lines", lambda x: x["ordinal"]).alias("places"), F.array_join(F.transform("lines", line), "\n").alias("content"))


def _arrays(s, d) -> DataFrame:
    """Each line is an array of pieces with kerning."""
    return _cut_pages(s, d, lambda i: [F.lit(" -"), i.cast("string")], lambda x: F.concat(F.lit("["), x, F.lit("] TJ")))


def _placed(out: DataFrame) -> DataFrame:
    lines = st.shown_lines(out.select(*PAGE, "places", "content"), [*PAGE, "places"])
    return lines.select(*PAGE, F.get("places", F.col("line").cast("int")).alias("ordinal"), "text", "n_strings").where("ordinal is not null")


def _lines_of(streams: DataFrame) -> DataFrame:
    return st.shown_lines(streams, PAGE).select(*PAGE, F.col("line").cast("long").alias("ordinal"), "text", "n_strings")


_HITS = """hit AS (SELECT *, CASE WHEN text = 'that' THEN 1 WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 2 ELSE 3 END AS way FROM g_line WHERE contains(text, 'that')), best AS (SELECT doc_id, page_id, min(way) AS way FROM hit GROUP BY doc_id, page_id)"""


@_redefine("x04_replace_in_page", "SELECT l.doc_id, l.page_id, l.ordinal, CASE WHEN h.way = b.way THEN regexp_replace(l.text, 'that', 'THAT') ELSE l.text END AS text FROM g_line l JOIN best b ON b.doc_id = l.doc_id AND b.page_id = l.page_id LEFT JOIN hit h ON h.doc_id = l.doc_id AND h.ln = l.ln", _HITS)
def x04(s, d):
    out = st.replace_text(_whole(s, d), PAGE, "that", "THAT").where("way > 0")
    return _lines_of(out).select(*KEY, "text")


@_redefine("x06_blank_text", "SELECT doc_id, page_id, ordinal, replace(text, 'that', '    ') AS text FROM g_line")
def x06(s, d):
    return _lines_of(st.blank_text(_whole(s, d), PAGE, "that")).select(*KEY, "text")


_CUT_SQL = "cut AS (SELECT *, (doc_id + ln) % 5 + 1 AS k, strpos(text, 'that') - 1 AS a FROM g_line WHERE text <> '')"


@register("x05_split_arrays", """SELECT doc_id, page_id, ordinal, CASE WHEN a >= 0 THEN regexp_replace(text, 'that', 'those there') ELSE text END AS text,
 (length(text) + k - 1) // k + CASE WHEN a >= 0 THEN CASE WHEN a % k > 0 THEN 1 ELSE 0 END + CASE WHEN (a + 4) % k > 0 AND a + 4 < length(text) THEN 1 ELSE 0 END - ((a + 3) // k - a // k) ELSE 0 END AS n_strings FROM cut""", _CUT_SQL)
def x05(s, d):
    # only the matched pieces change
    return _placed(st.replace_text(_arrays(s, d), [*PAGE, "places"], "that", "those there"))


_WAYS_SQL = _CUT_SQL + """, piece AS (SELECT *, list_transform(range((length(text) + k - 1) // k), lambda i: {'p': text[i * k + 1 : i * k + k], 'hex': i % 3 = 2, 'wide': regexp_matches(text[i * k + 1 : i * k + k], '[^\\x00-\\x7F]')}) AS ps FROM cut),
 way AS (SELECT *, min(CASE WHEN len(list_filter(ps, lambda x: x.p = 'that' AND NOT x.hex)) > 0 THEN 1 WHEN len(list_filter(ps, lambda x: x.p = 'that')) > 0 THEN 3 WHEN len(list_filter(ps, lambda x: x.wide AND contains(x.p, 'that'))) > 0 THEN 5 WHEN a >= 0 THEN 6 END) OVER (PARTITION BY doc_id, page_id) AS best FROM piece)"""


@register("x05_split_operators", """SELECT doc_id, page_id, ordinal, CASE best WHEN 6 THEN regexp_replace(text, 'that', 'those there') WHEN 1 THEN array_to_string(list_transform(ps, lambda x: CASE WHEN x.p = 'that' AND NOT x.hex THEN 'those there' ELSE x.p END), '')
 WHEN 3 THEN array_to_string(list_transform(ps, lambda x: CASE WHEN x.p = 'that' THEN 'those there' ELSE x.p END), '') WHEN 5 THEN array_to_string(list_transform(ps, lambda x: CASE WHEN x.wide THEN regexp_replace(x.p, 'that', 'those there') ELSE x.p END), '') ELSE text END AS text, len(ps) AS n_strings FROM way""", _WAYS_SQL)
def x05o(s, d):
    # each piece has its own operator
    return _placed(st.replace_text(_cut_pages(s, d, lambda i: [F.lit(" Tj")], lambda x: x), [*PAGE, "places"], "that", "those there"))


@register("x06_blank_split", "SELECT doc_id, page_id, ordinal, replace(text, 'that', '    ') AS text, (length(text) + k - 1) // k AS n_strings FROM cut", _CUT_SQL)
def x06s(s, d):
    return _placed(st.blank_text(_arrays(s, d), [*PAGE, "places"], "that"))


def _split(out: DataFrame, s, d, fonts: DataFrame | None = None) -> DataFrame:
    """Lines by their ordinals; a stream has no line for a blank one."""
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ordinal")) - 1
    places = v.g_line(s, d).where("text <> ''").select(*KEY).withColumn("line", rank.cast("long"))
    lines = st.shown_lines(out.select(*PAGE, "content"), PAGE, fonts).withColumn("line", F.col("line").cast("long"))
    return lines.join(places, [*PAGE, "line"]).select(*KEY, "text", "n_strings")


_FONT = {i: chr(i + 29) for i in range(3, 98)}


@register("x05_font_codes", """SELECT doc_id, page_id, ordinal, CASE WHEN way = min(way) OVER (PARTITION BY doc_id, page_id) THEN regexp_replace(text, 'that', 'THAT') ELSE text END AS text FROM (
 SELECT *, CASE WHEN contains(text, 'that') THEN CASE WHEN regexp_full_match(text, '[\\x20-\\x7E]*') THEN 4 WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 5 ELSE 6 END END AS way FROM g_line WHERE text <> '')""")
def x05c(s, d):
    # the font's codes lie 29 below the characters', four hex digits each; two strings to a line; other lines are shown as they are
    lines = v.g_line(s, d).where("text <> ''")
    code = lambda x: F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.ascii(c) - 29), 4, "0")), "")
    half = F.floor(F.length("text") / 2).cast("int")
    coded = F.concat(F.lit("/F2 9 Tf <"), code(F.substr(F.col("text"), F.lit(1), half)), F.lit("> Tj 2 w <"), code(F.substr(F.col("text"), half + 1)), F.lit("> Tj"))
    streams = _page_streams(lines, F.when(F.col("text").rlike(r"^[\x20-\x7E]+$"), coded).otherwise(F.concat(_token(F.col("text"), F.lit(False)), F.lit(" Tj"))))
    codes = F.create_map(*[F.lit(x) for kv in _FONT.items() for x in kv])
    fonts = streams.select(*PAGE, F.lit("F2").alias("font"), codes.alias("codes"))
    return _split(st.replace_text(streams, PAGE, "that", "THAT", fonts), s, d, fonts).select(*KEY, "text")


# ---- trees

_STACK = f"""tagged AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{v.OPAQUE}', '', 'g'), '<(/?[a-z][a-z0-9]*)', 1) AS u FROM pages),
 stacked AS (SELECT page_id, u, list_reduce(list_concat([['']], list_transform(u, lambda m: [m])), lambda acc, m: list_append(acc, CASE WHEN m[1][1] = '/' THEN regexp_replace(acc[-1], '/[^/]*$', '') WHEN m[1] IN {v.VOID} THEN acc[-1] ELSE acc[-1] || '/' || len(acc) - 1 || ':' || m[1] END)) AS st FROM tagged),
 el AS (SELECT page_id, i - 1 AS ordinal, upper(u[i]) AS role, CASE WHEN u[i] IN {v.VOID} THEN st[i] ELSE regexp_replace(st[i + 1], '/[^/]*$', '') END AS around FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM stacked) WHERE u[i][1] <> '/')"""


def _elements(s, d) -> DataFrame:
    return trees.bracketed(v.g_tag(s, d), PAGE, "ordinal", "kind")


_ELEMENT_NODES = _STACK + """, node AS (SELECT 0::BIGINT AS doc_id, page_id, ordinal, role, nullif(regexp_extract(around, '/([0-9]+):[^/]*$', 1), '')::BIGINT AS parent, len(around) - len(replace(around, '/', '')) AS depth, around FROM el)"""


@_redefine("w12_artifacts", "SELECT page_id, ordinal, role, depth::BIGINT AS depth, role IN ('NAV', 'FOOTER') OR regexp_matches(around, ':(nav|footer)(/|$)') AS artifact FROM node", _ELEMENT_NODES)
def w12(s, d):
    e = trees.within(_elements(s, d), PAGE, "ordinal", "kind", F.col("role").isin("NAV", "FOOTER"))
    return e.where("kind >= 0").select("page_id", "ordinal", "role", F.col("depth").cast("long").alias("depth"), F.col("inside").alias("artifact"))


@register("w12_ancestors", "SELECT page_id, ordinal, parent, list_transform(regexp_extract_all(around, '/([0-9]+):', 1), lambda x: x::BIGINT) || [ordinal] AS path FROM node", _ELEMENT_NODES)
def w12a(s, d):
    e = _elements(s, d).where("kind >= 0")
    return trees.rooted(e.select(*KEY, "parent"), PAGE, "ordinal", "parent").select("page_id", "ordinal", "parent", "path")


_WALK = """, walk AS (SELECT *, ordinal AS root, 0::BIGINT AS level, [ordinal] AS path FROM node WHERE parent IS NULL UNION ALL SELECT n.*, w.root, w.level + 1, list_append(w.path, n.ordinal) FROM walk w JOIN node n ON n.page_id = w.page_id AND n.parent = w.ordinal)"""


@register("w24_tree_walk", "SELECT page_id, ordinal, role, level AS depth FROM walk WHERE role IN ('LI', 'P')", _ELEMENT_NODES + _WALK, recursive=True)
def w24t(s, d):
    nodes = _elements(s, d).where("kind >= 0").drop("depth", "closes", "kind")
    return e.walk_tree(nodes).where(F.col("role").isin("LI", "P")).select("page_id", "ordinal", "role", F.col("depth").cast("long").alias("depth"))


_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@_redefine("r17_structure_tree", f"""SELECT host, w.page_id, w.ordinal, w.role, CASE WHEN w.level = 1 AND r.role = 'HTML' THEN NULL ELSE w.parent END AS parent, w.level + CASE WHEN r.role = 'HTML' THEN 0 ELSE 1 END AS depth, CASE WHEN r.role = 'HTML' THEN w.path[2:] ELSE w.path END AS path
 FROM walk w JOIN node r ON r.page_id = w.page_id AND r.ordinal = w.root JOIN (SELECT page_id, {_HOST} AS host FROM pages) p ON p.page_id = w.page_id WHERE NOT (w.level = 0 AND w.role = 'HTML')""", _ELEMENT_NODES + _WALK, recursive=True)
def r17(s, d):
    hosts = v.table(s, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    nodes = _elements(s, d).where("kind >= 0").select("page_id", "ordinal", "parent", "role").join(hosts, "page_id")
    t = trees.merged(nodes, ["host"], "page_id", "ordinal", "parent", "role", ("HTML",))
    return t.select("host", "page_id", "ordinal", "role", "parent", F.col("depth").cast("long").alias("depth"), "path")


_ITEMS = """, item AS (SELECT n.page_id, n.ordinal, n.parent, n.role, lower(regexp_replace(coalesce(a.title, ''), '[^A-Za-z]', '', 'g')) AS name FROM node n LEFT JOIN (
 SELECT page_id, unnest(regexp_extract_all(html, '<a href=[^>]*>([^<]*)', 1)) AS title, generate_subscripts(regexp_extract_all(html, '<a href=[^>]*>([^<]*)', 1), 1) AS k FROM pages) a
 ON n.role = 'A' AND a.page_id = n.page_id AND a.k = (SELECT count(*) FROM node o WHERE o.page_id = n.page_id AND o.role = 'A' AND o.ordinal <= n.ordinal) WHERE n.role IN ('A', 'LI', 'UL', 'NAV') AND (n.role = 'NAV' OR regexp_matches(n.around, ':nav(/|$)'))),
 up AS (SELECT page_id, ordinal, ordinal AS item, 0::BIGINT AS depth FROM item i WHERE NOT EXISTS (SELECT 1 FROM item o WHERE o.page_id = i.page_id AND o.ordinal = i.parent) UNION ALL SELECT i.page_id, i.ordinal, i.ordinal, u.depth + 1 FROM up u JOIN item i ON i.page_id = u.page_id AND i.parent = u.item),
 dest AS (SELECT lower(regexp_extract(html, '<h1>([A-Za-z]+)', 1)) AS name, min(page_id) AS page FROM pages GROUP BY 1)"""


@register("r18_outline", "SELECT i.page_id, i.ordinal, i.role, i.name, u.depth, coalesce(d.page, 0) + 1 AS page FROM item i JOIN up u ON u.page_id = i.page_id AND u.ordinal = i.ordinal LEFT JOIN dest d ON d.name = i.name AND i.name <> ''", _ELEMENT_NODES + _ITEMS, recursive=True)
def r18(s, d):
    # the navigation's lists as an outline: a link leads to the first page whose heading starts with its text
    pages = v.table(s, d, "pages")
    e = trees.within(_elements(s, d), PAGE, "ordinal", "kind", F.col("role") == "NAV").where("kind >= 0")
    k = F.row_number().over(Window.partitionBy(*PAGE, "role").orderBy("ordinal"))
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<a href=[^>]*>([^<]*)"), 1)).alias("k", "title"))
    e = e.withColumn("k", F.when(F.col("role") == "A", k - 1)).where("inside and role in ('A', 'LI', 'UL', 'NAV')")
    items = e.join(links, ["page_id", "k"], "left")
    items = items.select("page_id", "ordinal", "parent", "role", F.lower(F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z]", "")).alias("name"))
    named = pages.select(F.lower(F.regexp_extract("html", "<h1>([A-Za-z]+)", 1)).alias("name"), "page_id").where("name <> ''").groupBy("name").agg(F.min("page_id").alias("page"))
    t = trees.outline(items, named, ["page_id"], "ordinal", "parent", "name")
    return t.select("page_id", "ordinal", "role", "name", F.col("depth").cast("long").alias("depth"), "page")


# ---- whole tables

#: Texts in, left of, above and below the boxes, one for each box and kind; fields in the boxes.
_STUFF_SQL = """tx AS (SELECT doc_id, page_id, ordinal * 4 + k AS ordinal, CASE k WHEN 0 THEN x + 3 + ordinal % 3 * 7 WHEN 1 THEN x - 30 - ordinal * 11 WHEN 2 THEN x + 10 ELSE x + 40 END AS x,
 CASE k WHEN 0 THEN y + 2 + ordinal % 4 * 2 WHEN 1 THEN y + ordinal % 5 * 3 WHEN 2 THEN y - 12 - ordinal * 3 ELSE y + height + ordinal * 4 END AS y, 16.0::DOUBLE AS width, 7.0::DOUBLE AS height FROM g_rect, (SELECT unnest(range(4)) AS k)),
 fd AS (SELECT doc_id, page_id, ordinal, x + 20 + ordinal % 4 * 9 AS x, y + 4 AS y, 10.0::DOUBLE AS width, 6.0::DOUBLE AS height FROM g_rect),
 fl AS (SELECT * FROM (SELECT *, """ + _ROLE + """ AS role FROM g_rect) WHERE role = 'cell-fill')"""


def _stuff(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    r = v.g_rect(s, d)
    o, x, y = F.col("ordinal"), F.col("x"), F.col("y")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), a.cast("double").alias("tx"), b.cast("double").alias("ty")) for k, a, b in (
        (0, x + 3 + o % 3 * 7, y + 2 + o % 4 * 2), (1, x - 30 - o * 11, y + o % 5 * 3), (2, x + 10, y - 12 - o * 3), (3, x + 40, y + F.col("height") + o * 4))])
    texts = r.select(*KEY, F.explode(kinds).alias("t")).select(*PAGE, (o * 4 + F.col("t.k")).alias("ordinal"), F.col("t.tx").alias("x"), F.col("t.ty").alias("y"), F.lit(16.0).alias("width"), F.lit(7.0).alias("height"))
    fields = r.select(*KEY, (x + 20 + o % 4 * 9).alias("x"), (y + 4).alias("y"), F.lit(10.0).alias("width"), F.lit(6.0).alias("height"))
    return r, texts, fields, r.where(e.rect_role() == "cell-fill")


_RUNS_ALONG = "len(list_filter(boxes, lambda b: (abs(b.{at} - {line}) <= 12 OR abs(b.{at} + b.{size} - {line}) <= 12) AND b.{across} <= {start} + 12 AND b.{across} + b.{length} >= {end} - 12)) > 0"
_TABLES = (
    _GRIDS
    + """, tg AS (SELECT g.* FROM grids g JOIN bt USING (doc_id, page_id, component)), gc AS (SELECT *, len(rws) - 1 AS n, len(cols) - 1 AS m FROM tg), gr AS (SELECT *, unnest(range(n)) AS r FROM gc), gx AS (SELECT *, unnest(range(m)) AS c FROM gr),
 gb AS (SELECT *, c = m - 1 OR """ + _RUNS_ALONG.format(at="x", size="w", line="cols[c + 2]", across="y", length="h", start="rws[r + 1]", end="rws[r + 2]") + """ AS rt, r = n - 1 OR """ + _RUNS_ALONG.format(at="y", size="h", line="rws[r + 2]", across="x", length="w", start="cols[c + 1]", end="cols[c + 2]") + """ AS bl FROM gx),
 ga AS (SELECT a.*, (SELECT min(z.c) FROM gb z WHERE z.doc_id = a.doc_id AND z.page_id = a.page_id AND z.component = a.component AND z.r = a.r AND z.c >= a.c AND z.rt) - c + 1 AS ac FROM gb a),
 gd AS (SELECT a.*, (SELECT min(z.r) FROM gb z WHERE z.doc_id = a.doc_id AND z.page_id = a.page_id AND z.component = a.component AND z.c BETWEEN a.c AND a.c + a.ac - 1 AND z.r >= a.r AND z.bl) - r + 1 AS dn FROM ga a),
 oc AS (SELECT doc_id, page_id, component, any_value(cols) AS cols, any_value(rws) AS rws, list_reduce(list_transform(list({'r': r, 'c': c, 'd': dn, 'a': ac} ORDER BY r, c), lambda x: [x]), lambda acc, q: CASE WHEN len(list_filter(acc, lambda o: o.r <= q[1].r AND q[1].r < o.r + o.d AND o.c <= q[1].c AND q[1].c < o.c + o.a)) > 0 THEN acc ELSE list_concat(acc, q) END) AS os FROM gd GROUP BY doc_id, page_id, component),
 cel AS (SELECT *, cols[o.c + 1] AS x, rws[o.r + 1] AS y, cols[o.c + o.a + 1] - cols[o.c + 1] AS w, rws[o.r + o.d + 1] - rws[o.r + 1] AS h FROM (SELECT *, unnest(os) AS o FROM oc))"""
)
_SPOT = "list_filter(range(len({b}) - 1), lambda i: {v} >= {b}[i + 1] - 2 AND {v} <= {b}[i + 2] + 2)[1]"
_COVER = "list_filter(os, lambda o: o.r <= {r} AND {r} < o.r + o.d AND o.c <= {c} AND {c} < o.c + o.a)[1]"
_CLAIMS = (
    _TABLES
    + ", " + _STUFF_SQL
    + f""", pr AS (SELECT t.*, q.component, cols, rws, os, t.x + t.width / 2 AS cx, {_SPOT.format(b='rws', v='(t.y + t.height / 2)')} AS sr, {_SPOT.format(b='cols', v='(t.x + t.width / 2)')} AS sc FROM tx t JOIN oc q USING (doc_id, page_id)),
 p1 AS (SELECT *, {_COVER.format(r='sr', c='sc')} AS ins, CASE WHEN cx < cols[1] AND x >= cols[1] - 120 THEN {_COVER.format(r='sr', c='0')} END AS lab FROM pr),
 p2 AS (SELECT *, min(CASE WHEN ins IS NOT NULL THEN 0 + component / 1e6 WHEN lab IS NOT NULL THEN 1000000 + component / 1e6 END) OVER (PARTITION BY doc_id, page_id, ordinal) AS one FROM p1),
 p3 AS (SELECT *, CASE WHEN ins IS NOT NULL THEN 0 WHEN lab IS NOT NULL THEN 1 END AS way1, min(CASE WHEN ins IS NOT NULL THEN 0 WHEN lab IS NOT NULL THEN 1 END) OVER (PARTITION BY doc_id, page_id, ordinal) AS w FROM p2),
 p4 AS (SELECT *, min(component) FILTER (way1 = w) OVER (PARTITION BY doc_id, page_id, ordinal) AS k FROM p3),
 p5 AS (SELECT *, max(cols[1] - x + 4) FILTER (w = 1 AND k = component) OVER (PARTITION BY doc_id, page_id, component) AS ext FROM p4),
 p6 AS (SELECT *, coalesce(sc, CASE WHEN cx >= cols[1] - ext AND cx <= cols[2] + 2 THEN 0 END) AS hc FROM p5),
 p7 AS (SELECT *, CASE WHEN w IS NULL AND y + height BETWEEN rws[1] - 20 AND rws[1] + 2 AND {_COVER.format(r='0', c='hc')} IS NOT NULL THEN 2 WHEN w IS NULL AND y BETWEEN rws[-1] - 2 AND rws[-1] + 20 AND {_COVER.format(r='(len(rws) - 2)', c='hc')} IS NOT NULL THEN 3 END AS way2 FROM p6),
 p8 AS (SELECT *, min(way2) OVER (PARTITION BY doc_id, page_id, ordinal) AS w2 FROM p7), p9 AS (SELECT *, min(component) FILTER (way2 = w2) OVER (PARTITION BY doc_id, page_id, ordinal) AS k2 FROM p8),
 claim AS (SELECT doc_id, page_id, ordinal, component, x, y, x + width AS x1, y + height AS y1, coalesce(ext, 0) AS ext, coalesce(w, w2) AS way, CASE coalesce(w, w2) WHEN 0 THEN ins WHEN 1 THEN lab WHEN 2 THEN {_COVER.format(r='0', c='hc')} ELSE {_COVER.format(r='(len(rws) - 2)', c='hc')} END AS cell FROM p9 WHERE component = coalesce(k, k2))"""
)


def _grid_parts(s, d):
    r, texts, fields, fills = _stuff(s, d)
    return tb.tables(r), texts, fields, fills


@_redefine("g13_merged_cells", "SELECT doc_id, page_id, component, o.r AS \"row\", o.c AS col, o.d AS row_span, o.a AS col_span FROM cel", _TABLES, True)
def g13(s, d):
    o = tb.tables(v.g_rect(s, d)).select(*PAGE, "component", F.explode("origins").alias("o"))
    return o.select(*PAGE, "component", *[F.col(f"o.{c}").cast("long").alias(c) for c in ("row", "col", "row_span", "col_span")])


@_redefine("j07_cell_fill", f"""SELECT doc_id, page_id, component, o.r AS "row", o.c AS col, arg_max(fill, ordinal) AS fill FROM (SELECT *, {_COVER.format(r='sr', c='sc')} AS o, min(CASE WHEN {_COVER.format(r='sr', c='sc')} IS NOT NULL THEN component END) OVER (PARTITION BY doc_id, page_id, ordinal) AS k FROM (
 SELECT f.*, component, os, {_SPOT.format(b='rws', v='(f.y + f.height / 2)')} AS sr, {_SPOT.format(b='cols', v='(f.x + f.width / 2)')} AS sc FROM fl f JOIN oc USING (doc_id, page_id))) WHERE o IS NOT NULL AND component = k GROUP BY ALL""", _TABLES + ", " + _STUFF_SQL, True)
def j07(s, d):
    t, _, _, fills = _grid_parts(s, d)
    return tb.placed(fills, t).groupBy(*PAGE, "component", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.max_by("fill", "ordinal").alias("fill"))


@_redefine("j08_left_labels", 'SELECT doc_id, page_id, ordinal, component, cell.r AS "row", cell.c AS col, round(ext, 6) AS extension FROM claim WHERE way = 1', _CLAIMS, True)
def j08(s, d):
    t, texts, _, _ = _grid_parts(s, d)
    c = tb.claims(texts, t).where(F.col("way") == tb.LEFT)
    return c.select(*PAGE, "ordinal", "component", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("extension", 6).alias("extension"))


@_redefine("j09_table_bands", "SELECT doc_id, page_id, ordinal, component, cell.r AS \"row\", cell.c AS col, CASE way WHEN 2 THEN 'above' ELSE 'below' END AS place FROM claim WHERE way >= 2", _CLAIMS, True)
def j09(s, d):
    t, texts, _, _ = _grid_parts(s, d)
    c = tb.claims(texts, t).where(F.col("way") >= tb.ABOVE)
    return c.select(*PAGE, "ordinal", "component", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.when(F.col("way") == tb.ABOVE, "above").otherwise("below").alias("place"))


_CELLS = (
    _CLAIMS
    + f""", hold AS (SELECT doc_id, page_id, component, cell.r AS r, cell.c AS c, list(ordinal ORDER BY ordinal) AS texts, min(x) AS a0, min(y) AS b0, max(x1) AS a1, max(y1) AS b1 FROM claim GROUP BY ALL), exts AS (SELECT doc_id, page_id, component, max(ext) AS ext FROM claim GROUP BY ALL),
 pl AS (SELECT *, {_COVER.format(r='sr', c='sc')} AS o, min(CASE WHEN {_COVER.format(r='sr', c='sc')} IS NOT NULL THEN component END) OVER (PARTITION BY kind, doc_id, page_id, ordinal) AS k FROM (SELECT f.*, component, os, {_SPOT.format(b='rws', v='(f.y + f.height / 2)')} AS sr, {_SPOT.format(b='cols', v='(f.x + f.width / 2)')} AS sc
 FROM (SELECT 'field' AS kind, doc_id, page_id, ordinal, x, y, width, height, NULL AS fill FROM fd UNION ALL SELECT 'fill', doc_id, page_id, ordinal, x, y, width, height, fill FROM fl) f JOIN oc USING (doc_id, page_id))),
 inn AS (SELECT doc_id, page_id, component, o.r AS r, o.c AS c, list(ordinal ORDER BY ordinal) FILTER (kind = 'field') AS fields, arg_max(fill, ordinal) FILTER (kind = 'fill') AS fill FROM pl WHERE o IS NOT NULL AND component = k GROUP BY ALL),
 box AS (SELECT cel.doc_id, cel.page_id, cel.component, o.r AS r, o.c AS c, o.d AS d, o.a AS a, x - CASE WHEN o.c = 0 THEN coalesce(ext, 0) ELSE 0 END AS x, y, w + CASE WHEN o.c = 0 THEN coalesce(ext, 0) ELSE 0 END AS w, h FROM cel LEFT JOIN exts USING (doc_id, page_id, component)),
 full_ AS (SELECT box.*, inn.fill, coalesce(texts, []) AS texts, coalesce(fields, []) AS fields, a0 - x AS pl, b0 - y AS pt, x + w - a1 AS pr, y + h - b1 AS pb, h - (b1 - b0) AS free FROM box LEFT JOIN hold USING (doc_id, page_id, component, r, c) LEFT JOIN inn USING (doc_id, page_id, component, r, c))"""
)


@register("g12_table_cells", """SELECT doc_id, page_id, component, r AS "row", c AS col, d AS row_span, a AS col_span, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS width, round(h, 6) AS height, fill, texts, fields FROM full_""", _CELLS, True)
def g12c(s, d):
    c = tb.cells(*_stuff(s, d))
    return c.select(*PAGE, "component", *[F.col(x).cast("long").alias(x) for x in ("row", "col", "row_span", "col_span")], *[F.round(x, 6).alias(x) for x in ("x", "y", "width", "height")], "fill", "texts", "fields")


@_redefine("g14_padding", """SELECT doc_id, page_id, component, r AS "row", c AS col, CASE WHEN pl > 2 THEN round(pl, 6) END AS pad_left, CASE WHEN pt > 2 THEN round(pt, 6) END AS pad_top, CASE WHEN pr > 2 THEN round(pr, 6) END AS pad_right, CASE WHEN pb > 2 THEN round(pb, 6) END AS pad_bottom,
 CASE WHEN free > 6 THEN CASE WHEN pt / (pt + pb) < 0.3 THEN 'top' WHEN pt / (pt + pb) > 0.7 THEN 'bottom' ELSE 'center' END END AS align FROM full_ WHERE len(texts) > 0""", _CELLS, True)
def g14(s, d):
    c = tb.cells(*_stuff(s, d)).where(F.size("texts") > 0)
    return c.select(*PAGE, "component", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.round(x, 6).alias(x) for x in ("pad_left", "pad_top", "pad_right", "pad_bottom")], "align")


# ---- pages as a whole

_LAYOUT = (
    _CELLS
    + """, el AS (SELECT 'text' AS kind, doc_id, page_id, ordinal, y, height AS size, ordinal % 4 = 2 AS artifact FROM tx UNION ALL SELECT 'field', doc_id, page_id, ordinal, y, height, false FROM fd),
 part AS (SELECT el.*, CASE WHEN c.component IS NOT NULL OR p.component IS NOT NULL THEN 'table' WHEN artifact AND el.y < 118.8 THEN 'header' WHEN artifact AND el.y > 673.2 THEN 'footer' ELSE 'paragraph' END AS part, coalesce(c.component, p.component) AS ref FROM el
 LEFT JOIN claim c ON el.kind = 'text' AND c.doc_id = el.doc_id AND c.page_id = el.page_id AND c.ordinal = el.ordinal LEFT JOIN pl p ON el.kind = 'field' AND p.kind = 'field' AND p.o IS NOT NULL AND p.component = p.k AND p.doc_id = el.doc_id AND p.page_id = el.page_id AND p.ordinal = el.ordinal),
 fold AS (SELECT doc_id, page_id, unnest(list_reduce(list_transform(list_sort(list(DISTINCT y)), lambda q: [{'y': q, 'a': q, 'l': 0}]), lambda acc, b: list_append(acc, CASE WHEN abs(b[1].y - acc[-1].a) > 3 THEN {'y': b[1].y, 'a': b[1].y, 'l': acc[-1].l + 1} ELSE {'y': b[1].y, 'a': acc[-1].a, 'l': acc[-1].l} END))) AS f FROM part WHERE part = 'paragraph' GROUP BY doc_id, page_id),
 lined AS (SELECT p.*, f.l AS line FROM part p JOIN fold ON fold.doc_id = p.doc_id AND fold.page_id = p.page_id AND fold.f.y = p.y WHERE part = 'paragraph'),
 prg AS (SELECT *, sum(CASE WHEN y - (py + 1.2 * ps) > 1.5 * (size + ps) / 2 OR greatest(size, ps) / least(size, ps) > 1.15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id ORDER BY line)::BIGINT AS paragraph FROM (SELECT *, lag(y) OVER w AS py, lag(size) OVER w AS ps FROM (
 SELECT doc_id, page_id, line, min(y) AS y, max(size) AS size FROM lined GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY line))),
 whole AS (SELECT p.doc_id, p.page_id, p.kind, p.ordinal, p.part, coalesce(g.paragraph, p.ref) AS ref, p.y FROM part p LEFT JOIN lined l ON l.doc_id = p.doc_id AND l.page_id = p.page_id AND l.kind = p.kind AND l.ordinal = p.ordinal LEFT JOIN prg g ON g.doc_id = l.doc_id AND g.page_id = l.page_id AND g.line = l.line),
 tops AS (SELECT doc_id, page_id, part, ref, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY top, part, ref) AS place FROM (SELECT doc_id, page_id, part, ref, min(y) AS top FROM whole WHERE part = 'paragraph' GROUP BY ALL UNION ALL SELECT doc_id, page_id, 'table', component, rws[1] FROM oc))"""
)


@_redefine("g34_page_layout", "SELECT w.doc_id, w.page_id, w.kind, w.ordinal, w.part, w.ref, t.place FROM whole w LEFT JOIN tops t ON t.doc_id = w.doc_id AND t.page_id = w.page_id AND t.part = w.part AND t.ref = w.ref", _LAYOUT, True)
def g34(s, d):
    r, texts, fields, _ = _stuff(s, d)
    return tb.page_parts(r, texts.withColumn("artifact", F.col("ordinal") % 4 == 2), fields)


@register("g34_parts", "SELECT part, count(*) AS n, count(DISTINCT (doc_id, page_id, ref)) AS n_parts FROM whole GROUP BY part", _LAYOUT, True)
def g34p(s, d):
    return g34(s, d).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id", "page_id", F.coalesce("ref", F.lit(-1))).alias("n_parts"))


# ---- numbering

_ITEMS_SQL = """it AS (SELECT conv_id, turn, text, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE (turn * 3 + length(text)) % 4 END AS level FROM conversations),
 nr AS (SELECT i.conv_id, i.turn, list(greatest((SELECT count(*) FROM it j WHERE j.conv_id = i.conv_id AND j.turn <= i.turn AND j.level = k AND NOT EXISTS (SELECT 1 FROM it m WHERE m.conv_id = i.conv_id AND m.turn <= i.turn AND m.turn > j.turn AND m.level < k)), 1) ORDER BY k) AS numbers
 FROM it i, (SELECT unnest(range(9)) AS k) WHERE k <= i.level GROUP BY i.conv_id, i.turn)"""


def _list_items(s, d) -> DataFrame:
    c = v.table(s, d, "conversations")
    n = F.length("text")
    return c.select("conv_id", "turn", "text", F.when(n % 7 != 0, (F.col("turn") * 3 + n) % 4).alias("level"))


@register("k03_numbering", """SELECT i.conv_id, i.turn, i.level, numbers, array_to_string(numbers, '.') AS legal, CASE (len(numbers) - 1) % 3 WHEN 0 THEN numbers[-1]::VARCHAR WHEN 1 THEN repeat(chr((97 + (numbers[-1] - 1) % 26)::INT), (numbers[-1] - 1) // 26 + 1)
 ELSE ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii', 'xiii', 'xiv', 'xv', 'xvi', 'xvii', 'xviii', 'xix', 'xx'][numbers[-1]] END || '.' AS label FROM it i LEFT JOIN nr n ON n.conv_id = i.conv_id AND n.turn = i.turn""", _ITEMS_SQL)
def k03n(s, d):
    t = nb.counters(_list_items(s, d), ["conv_id"], ["turn"])
    return t.select("conv_id", "turn", "level", "numbers", nb.legal_label(F.col("numbers")).alias("legal"), nb.label(F.col("numbers")).alias("label"))


@register("k03_list_items", """SELECT conv_id, string_agg('<w:p>' || CASE WHEN level IS NOT NULL THEN '<w:pPr><w:numPr><w:ilvl w:val="' || level || '"/><w:numId w:val="' || CASE WHEN level < 3 THEN 2 ELSE 1 END || '"/></w:numPr></w:pPr>' ELSE '' END || '<w:r><w:t xml:space="preserve">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</w:t></w:r></w:p>', '' ORDER BY turn) AS xml FROM it GROUP BY conv_id""", _ITEMS_SQL)
def k03l(s, d):
    one = nb.item_xml(F.col("text"), F.col("level"), F.col("level") < 3)
    return _list_items(s, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda r: r["x"]), "").alias("xml"))


# ---- field paragraphs, glyphs, colours

_SPLIT_SQL = """im AS (SELECT doc_id, page_id, ordinal // 12 AS paragraph, 'field' AS kind, ordinal, x, y, height FROM g_field UNION ALL SELECT doc_id, page_id, ordinal // 12, 'text', ordinal, x - 50, y + ordinal % 3 * 5, 9.0 FROM g_field),
 bn AS (SELECT doc_id, page_id, paragraph, list({'y': y, 'kind': kind, 'ordinal': ordinal, 'x': x, 'c': y + height / 2} ORDER BY y, kind, ordinal) AS r, count(*) FILTER (kind = 'field') AS f FROM im GROUP BY ALL),
 bz AS (SELECT *, CASE WHEN f < 2 OR len(r) < 4 THEN list_transform(r, lambda q: 0) ELSE list_transform(list_reduce(list_transform(r, lambda q: [{'s': q.c, 'n': 1, 'b': 0}]), lambda a, q: list_append(a, CASE WHEN abs(q[1].s - a[-1].s / a[-1].n) <= 8 THEN {'s': a[-1].s + q[1].s, 'n': a[-1].n + 1, 'b': a[-1].b} ELSE {'s': q[1].s, 'n': 1, 'b': a[-1].b + 1} END)), lambda z: z.b) END AS b FROM bn),
 bx AS (SELECT doc_id, page_id, paragraph, unnest(r) AS q, unnest(b) AS band FROM bz)"""


@register("g07_split_paragraphs", "SELECT doc_id, page_id, paragraph, q.kind AS kind, q.ordinal AS ordinal, band, row_number() OVER (PARTITION BY doc_id, page_id, paragraph, band ORDER BY CASE q.kind WHEN 'text' THEN 0 ELSE 1 END, q.x, q.ordinal) AS place FROM bx", _SPLIT_SQL)
def g07s(s, d):
    f = v.g_field(s, d).withColumn("paragraph", F.expr("ordinal div 12"))
    own = [*PAGE, "paragraph"]
    fields = f.select(*own, F.lit("field").alias("kind"), "ordinal", "x", "y", "height")
    labels = f.select(*own, F.lit("text").alias("kind"), "ordinal", (F.col("x") - 50).alias("x"), (F.col("y") + F.col("ordinal") % 3 * 5).alias("y"), F.lit(9.0).alias("height"))
    return doc.split_field_paragraphs(fields.unionByName(labels), own)


@_redefine("j30_glyph_widths", f"SELECT ordinal, coalesce(list_sum(list_transform(string_split(content, ''), lambda h: coalesce({list(fonts.HELVETICA)}[unicode(h) - 31], 500))), 0)::DOUBLE AS width FROM g_image")
def j30(s, d):
    return v.g_image(s, d).select("ordinal", fonts.text_width("content", F.lit(1000)).cast("double").alias("width"))


@register("f06_css_colour", """SELECT ordinal, ordinal % 256 / 255 AS r, (ordinal * 7) % 256 / 255 AS g, (ordinal * 13) % 256 / 255 AS b, CASE WHEN ordinal % 3 = 0 THEN round(ordinal % 11 / 10, 6) ELSE 1 END AS a FROM g_image""")
def f06c(s, d):
    # written in turn as rgba(), as #rrggbb and as rgb()
    k = F.col("ordinal")
    n = [k % 256, k * 7 % 256, k * 13 % 256]
    text = F.concat_ws(", ", *[x.cast("string") for x in n])
    code = F.concat(*[F.lpad(F.hex(x), 2, "0") for x in n])
    css = F.when(k % 3 == 0, F.concat(F.lit("rgba("), text, F.lit(", "), (k % 11 / 10).cast("string"), F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("#"), code)).otherwise(F.concat(F.lit("rgb( "), text, F.lit(" )")))
    return v.g_image(s, d).select("ordinal", css_colour(css).alias("v")).select("ordinal", "v.r", "v.g", "v.b", F.round("v.a", 6).alias("a"))
