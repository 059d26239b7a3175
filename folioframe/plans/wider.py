"""Queries over fonts, documents as XML, field tables, applied edits and small predicates, and statements for the folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.functions import fonts
from folioframe.functions import geometry as g
from folioframe.operators import documents as doc
from folioframe.operators import elements as e
from folioframe.operators import layout as l
from folioframe.operators import shapes
from folioframe.sources import views as v

from .catalog import _BORDER, _GAP, _QUERIES, _SQL, KEY, PAGE, register

# ---- glyphs and codes

_WIDTH = f"coalesce(list_sum(list_transform(string_split({{x}}, ''), lambda h: coalesce({list(fonts.HELVETICA)}[unicode(h) - 31], 500))), 0)"


@register("f12_text_width", f"SELECT doc_id, ln, {_WIDTH.format(x='text')} * font_size / 1000 AS width, round(925 * font_size / 1000, 6)::DOUBLE AS height, round(207 * font_size / 1000, 6)::DOUBLE AS below FROM g_line WHERE length(text) > 0")
def f12(s, d):
    line = v.g_line(s, d).where(F.length("text") > 0)
    return line.select("doc_id", "ln", fonts.text_width("text", "font_size").alias("width"), F.round(fonts.text_height("font_size"), 6).alias("height"), F.round(fonts.descent_below("font_size"), 6).alias("below"))


@register("f12_kerning", f"SELECT ordinal, ({_WIDTH.format(x='t')} + {' + '.join(f'{k} * (length(t) - length(replace(t, {p!r}, {p[0]!r})))' for p, k in fonts.KERNING.items())}) * 10 / 1000 AS width FROM (SELECT ordinal, 'AWAY To ' || content AS t FROM g_image)")
def f12k(s, d):
    return v.g_image(s, d).select("ordinal", fonts.text_width(F.concat(F.lit("AWAY To "), "content"), F.lit(10), kerning=True).alias("width"))


@register("f12_character_spacing", f"SELECT doc_id, page_id, ordinal, CASE WHEN abs(width - w) >= 0.5 THEN round((width - w) / length(text), 6) END AS spacing FROM (SELECT *, {_WIDTH.format(x='text')} * font_size / 1000 AS w FROM g_text)")
def f12c(s, d):
    return v.g_text(s, d).select(*KEY, F.round(fonts.character_spacing("text", "width", "font_size"), 6).alias("spacing"))


@register("v08_text_advance", f"SELECT doc_id, page_id, ordinal, round(coalesce(sum(a) OVER (PARTITION BY doc_id, page_id, ln ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 6) AS x FROM (SELECT *, ({_WIDTH.format(x='text')} * font_size / 1000 + length(text) * 0.25 + 0.25 + 278 * font_size / 1000 + 2) * 0.5 AS a FROM g_text)")
def v08(s, d):
    a = fonts.advance(F.concat("text", F.lit(" ")), "font_size", 0.25, 2.0, 0.5)
    w = Window.partitionBy(*PAGE, "ln").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return v.g_text(s, d).withColumn("a", a).select(*KEY, F.round(F.coalesce(F.sum("a").over(w), F.lit(0.0)), 6).alias("x"))


@register("f03_standard_font", """SELECT ordinal, ['Helvetica', 'Helvetica-Bold', 'Courier-Oblique', 'Times-BoldItalic', 'Times-Roman', 'Helvetica-Oblique', 'Courier-Bold'][ordinal % 7 + 1] AS font FROM g_image""")
def f03(s, d):
    names = ("ABCDEF+Calibri", "Arial-Bd", "Consolas-Italic", "TimesNewRomanPS-BoldItalicMT", "Noto Serif", "Sans-Serif Oblique", "DejaVu Mono Bold")
    return v.g_image(s, d).select("ordinal", fonts.standard_font(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("ordinal") % 7 + 1).cast("int"))).alias("font"))


@register("r22_unicode_maps", """SELECT ordinal, code, text FROM (SELECT ordinal, unnest([1, 2, ordinal % 90 + 10, ordinal % 90 + 11, ordinal % 90 + 12, 200, 201]) AS code, unnest([chr(65 + (ordinal % 26)::INT), 'fi', chr(97 + (ordinal % 20)::INT), chr(98 + (ordinal % 20)::INT), chr(99 + (ordinal % 20)::INT), 'x', 'y' || chr(8364)]) AS text FROM g_image)""")
def r22(s, d):
    hex4 = lambda x: F.lpad(F.hex(x), 4, "0")
    k = F.col("ordinal")
    low = k % 90 + 10
    cmap = F.concat(
        F.lit("begincmap 2 beginbfchar\n<01> <"), hex4(k % 26 + 65), F.lit(">\n<02> <00660069>\nendbfchar\n1 beginbfrange\n<"), hex4(low), F.lit("> <"), hex4(low + 2), F.lit("> <"), hex4(k % 20 + 97),
        F.lit(">\nendbfrange 1 beginbfrange <00C8> <00C9> [<0078> <007920AC>] endbfrange endcmap"),
    )
    return v.g_image(s, d).select("ordinal", F.explode(fonts.unicode_map(cmap)).alias("m")).select("ordinal", "m.code", "m.text")


# ---- documents

_RUNS = """runs AS (SELECT doc_id, page_id, ln, run, any_value(bold) AS bold, any_value(color) AS color, any_value(font_size) AS font_size, string_agg(CASE WHEN gap > 0.3 * font_size THEN ' ' ELSE '' END || text, '' ORDER BY x, ordinal) AS text FROM (
 SELECT *, sum(CASE WHEN color <> pc THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal)::BIGINT AS run FROM (SELECT *, x - lag(x + width) OVER w AS gap, lag(color) OVER w AS pc FROM (
 SELECT * REPLACE (CASE WHEN ordinal % 12 % 5 = 4 THEN '00ff00' ELSE color END AS color) FROM g_text) WINDOW w AS (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal))) GROUP BY doc_id, page_id, ln, run)"""
_ESC = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def _run_rows(s, d, *by):
    text = v.g_text(s, d).select(*KEY, "ln", "x", "width", "font_size", "bold", "color", "text")
    text = (text.repartition(*by) if by else text).withColumn("color", F.when(F.col("ordinal") % 12 % 5 == 4, "00ff00").otherwise(F.col("color")))
    return l.styled_runs(text, [*PAGE, "ln"])


@register("k03_runs_xml", f"""SELECT doc_id, string_agg('<w:p>' || p || '</w:p>', '' ORDER BY ln) AS xml FROM (SELECT doc_id, ln, string_agg('<w:r><w:rPr>' || CASE WHEN bold THEN '<w:b/>' ELSE '' END || CASE WHEN color <> '000000' THEN '<w:color w:val="' || color || '"/>' ELSE '' END ||
 '<w:sz w:val="' || floor(font_size * 2 + 0.5)::BIGINT || '"/></w:rPr><w:t xml:space="preserve">' || {_ESC.format(x='text')} || '</w:t></w:r>', '' ORDER BY run) AS p FROM runs GROUP BY doc_id, ln) GROUP BY doc_id""", _RUNS)
def k03(s, d):
    # words are shuffled once, by document: lines, runs, paragraphs and documents are all made where they lie
    return doc.flow_xml(_run_rows(s, d, "doc_id"), ["doc_id"], "ln", ["run"])


@register("k04_positioned_xml", """SELECT doc_id, page_id, string_agg('<wp:anchor x="' || floor(x * 12700 + 0.5)::BIGINT || '" y="' || floor(y * 12700 + 0.5)::BIGINT || '" cx="' || floor(width * 12700 + 0.5)::BIGINT || '" cy="' || floor(height * 12700 + 0.5)::BIGINT || '" relativeHeight="' || z || '">' || body || '</wp:anchor>', '' ORDER BY z, kind, ordinal) AS xml FROM (
 SELECT *, CASE kind WHEN 'fill' THEN 1 ELSE 3000 END + ordinal % 1000 AS z FROM (SELECT doc_id, page_id, ordinal, x, y, width, height, 'fill' AS kind, '<a:fill/>' AS body FROM g_rect WHERE fill IS NOT NULL UNION ALL SELECT doc_id, page_id, ordinal, x, y, width, height, 'field', '<w:t>' || name || '</w:t>' FROM g_field)) GROUP BY doc_id, page_id""")
def k04(s, d):
    own = ["ordinal", "x", "y", "width", "height"]
    fills = v.g_rect(s, d).where("fill is not null").select(*PAGE, *own, F.lit("fill").alias("kind"), F.lit("<a:fill/>").alias("body"))
    names = v.g_field(s, d).select(*PAGE, *own, F.lit("field").alias("kind"), F.concat(F.lit("<w:t>"), "name", F.lit("</w:t>")).alias("body"))
    return doc.positioned_xml(fills.unionByName(names))


@register("k05_table_xml", f"""SELECT doc_id, page_id, '<w:tbl>' || string_agg('<w:tr>' || x || '</w:tr>', '' ORDER BY r) || '</w:tbl>' AS xml FROM (SELECT doc_id, page_id, r, string_agg('<w:tc><w:tcPr><w:tcW w:w="' || 2400 * cs || '" w:type="dxa"/>' || CASE WHEN cs > 1 THEN '<w:gridSpan w:val="' || cs || '"/>' ELSE '' END ||
 CASE WHEN r > row0 THEN '<w:vMerge/>' WHEN rs > 1 THEN '<w:vMerge w:val="restart"/>' ELSE '' END || '</w:tcPr>' || CASE WHEN r > row0 OR value = '' THEN '<w:p/>' ELSE '<w:p><w:r><w:t>' || {_ESC.format(x='value')} || '</w:t></w:r></w:p>' END || '</w:tc>', '' ORDER BY c) AS x FROM (
 SELECT *, unnest(range(row0, row0 + rs)) AS r FROM (SELECT doc_id, page_id, value, ordinal // 3 AS row0, ordinal % 3 AS c, CASE WHEN ordinal % 12 = 0 THEN 2 ELSE 1 END AS cs, CASE WHEN ordinal % 12 = 5 THEN 2 ELSE 1 END AS rs FROM g_field WHERE ordinal % 12 NOT IN (1, 8))) GROUP BY doc_id, page_id, r) GROUP BY doc_id, page_id""")
def k05(s, d):
    k = F.col("ordinal") % 12
    # the first cell of four rows spans two columns, the last of the second row two rows; what they cover is no cell
    f = v.g_field(s, d).where(~k.isin(1, 8))
    across, down = F.when(k == 0, 2).otherwise(1), F.when(k == 5, 2).otherwise(1)
    cells = f.select(*PAGE, F.floor(F.col("ordinal") / 3).cast("long").alias("row"), (F.col("ordinal") % 3).alias("col"), down.cast("long").alias("row_span"), across.alias("col_span"), (across * 120.0).alias("width"), F.col("value").alias("text"))
    return doc.table_xml(cells, PAGE)


@register("k11_saved", """SELECT p.doc_id, p.page_id, kind, ordinal, text FROM (SELECT t.doc_id, t.page_id, 'text' AS kind, t.ordinal, coalesce(n.new, t.text) AS text FROM g_text t LEFT JOIN (SELECT doc_id, item, arg_max(op || ' ' || event_id, (ts, event_id)) AS new FROM g_edit GROUP BY doc_id, item) n ON n.doc_id = t.doc_id AND t.page_id = 0 AND t.ordinal = n.item
 UNION ALL SELECT f.doc_id, f.page_id, 'field', f.ordinal, coalesce(m.v, f.value) FROM g_field f LEFT JOIN (SELECT doc_id, name, max(ordinal)::VARCHAR AS v FROM g_field WHERE ordinal % 2 = 0 GROUP BY doc_id, name) m ON m.doc_id = f.doc_id AND m.name = f.name) x
 JOIN (SELECT doc_id, page_id AS old, row_number() OVER (PARTITION BY doc_id ORDER BY page_id) - 1 AS page_id FROM (SELECT DISTINCT doc_id, page_id FROM g_line) WHERE page_id <> 1) p ON p.doc_id = x.doc_id AND p.old = x.page_id""")
def k11(s, d):
    edits = v.g_edit(s, d).select("doc_id", F.lit(0).cast("long").alias("page_id"), F.col("item").alias("ordinal"), F.concat_ws(" ", "op", "event_id").alias("text"), F.struct("ts", "event_id").alias("at"))
    fields = v.g_field(s, d).select(*KEY, "name", "value")
    values = fields.where("ordinal % 2 = 0").groupBy("doc_id", "name").agg(F.max("ordinal").cast("string").alias("value"))
    pages = e.delete_page(v.g_line(s, d).select(*PAGE).distinct(), 1)
    return doc.saved(v.g_text(s, d).select(*KEY, "text"), edits, fields, values, pages.where("from_page <> 1"))


# ---- tables

_MEANS = "list_transform(list_reduce(list_transform(list_sort({x}), lambda q: [{{'s': q::DOUBLE, 'n': 1}}]), lambda a, b: CASE WHEN abs(b[1].s - a[-1].s / a[-1].n) <= {t} THEN list_append(a[:-2], {{'s': a[-1].s + b[1].s, 'n': a[-1].n + 1}}) ELSE list_concat(a, b) END), lambda z: z.s / z.n)"
_COLLAPSE = "CASE WHEN len({x}) < 2 THEN {x} ELSE list_append(list_reduce(list_transform({x}[:-2], lambda q: [q]), lambda a, b: CASE WHEN b[1] - a[-1] >= {t} THEN list_concat(a, b) ELSE a END), {x}[-1]) END"
_GRIDS = (
    _BORDER
    + f""", cm AS (SELECT doc_id, page_id, a AS ordinal, min(b) AS component FROM reach GROUP BY doc_id, page_id, a), eg AS (SELECT r.doc_id, r.page_id, component, list(least(x, x + width)) || list(greatest(x, x + width)) AS xs, list(least(y, y + height)) || list(greatest(y, y + height)) AS ys, list({{'x': r.x, 'y': r.y, 'w': r.width, 'h': r.height}}) AS boxes, count(*) AS n_borders FROM br r JOIN cm USING (doc_id, page_id, ordinal) GROUP BY r.doc_id, r.page_id, component),
 em AS (SELECT *, {_MEANS.format(x='xs', t=2)} AS mx, {_MEANS.format(x='ys', t=2)} AS my FROM eg), grids AS (SELECT * FROM (SELECT doc_id, page_id, component, boxes, n_borders, {_COLLAPSE.format(x='mx', t=10)} AS cols, {_COLLAPSE.format(x='my', t=10)} AS rws FROM em) WHERE len(cols) > 2 AND len(rws) > 2),
 gcell AS (SELECT *, len(list_filter(boxes, lambda b: b.x < x1 + 2 AND b.x + b.w > x0 - 2 AND b.y < y1 + 2 AND b.y + b.h > y0 - 2)) > 0 AS backed FROM (SELECT *, cols[c] AS x0, cols[c + 1] AS x1, rws[r] AS y0, rws[r + 1] AS y1 FROM (SELECT *, unnest(range(1, len(rws))) AS r FROM (SELECT *, unnest(range(1, len(cols))) AS c FROM grids)))),
 bt AS (SELECT doc_id, page_id, component, any_value(len(rws) - 1) AS n_rows, any_value(len(cols) - 1) AS n_cols, any_value(n_borders) AS n_borders, count(*) FILTER (backed) AS n_backed, min(x0) AS x, min(y0) AS y, max(x1) AS x1, max(y1) AS y1 FROM gcell GROUP BY doc_id, page_id, component HAVING count(*) FILTER (backed) >= 0.5 * count(*))"""
)


def _state(name: str, sql: str, ctes: str = "", recursive: bool = False) -> None:
    """Gives a query that is registered a statement."""
    assert name in _QUERIES and name not in _SQL
    register(name, sql, ctes, recursive)(_QUERIES[name])


def statements() -> None:
    """Statements for folds, whose lists DuckDB reduces in place."""
    _state("g12_bordered_tables", "SELECT * FROM bt", _GRIDS, True)
    _state("j08_left_labels", """SELECT b.doc_id, b.page_id, b.component, t.ordinal FROM bt b JOIN (SELECT doc_id, page_id, ordinal, x + width / 2 - 90 AS cx, y + ordinal % 5 * 6 AS cy FROM g_rect) t ON t.doc_id = b.doc_id AND t.page_id = b.page_id AND t.cx < b.x AND t.cx >= b.x - 120 AND t.cy BETWEEN b.y - 2 AND b.y1 + 2""", _GRIDS, True)
    _state("g02_collapse_bounds", f"SELECT doc_id, page_id, {_COLLAPSE.format(x='ys', t=20)} AS kept FROM (SELECT doc_id, page_id, list(y ORDER BY y) AS ys FROM g_line GROUP BY doc_id, page_id)")
    _state("g07_field_bands", f"SELECT doc_id, page_id, len({_MEANS.format(x='ys', t=8)})::INT AS n_bands FROM (SELECT doc_id, page_id, list(y + height / 2) AS ys FROM g_field GROUP BY doc_id, page_id)")
    _state("g17_borderless_tables", """SELECT doc_id, page_id, t.k AS first_line, t.n AS n_rows, len(t.starts) AS n_cols FROM (SELECT doc_id, page_id, unnest(list_reduce(list_transform(list({'k': ln, 'starts': starts} ORDER BY ln), lambda r: [{'k': r.k, 'n': 1, 'starts': r.starts}]),
 lambda a, b: CASE WHEN len(a[-1].starts) = len(b[1].starts) AND len(list_filter(list_zip(a[-1].starts, b[1].starts), lambda q: abs(q[1] - q[2]) > 15)) = 0 THEN list_append(a[:-2], {'k': a[-1].k, 'n': a[-1].n + 1, 'starts': a[-1].starts}) ELSE list_concat(a, b) END)) AS t FROM st GROUP BY doc_id, page_id) WHERE t.n >= 3 AND len(t.starts) >= 2""",
           _GAP + ", st AS (SELECT doc_id, page_id, ln, list(x ORDER BY x) AS starts FROM gp WHERE gap IS NULL OR gap > 2 * font_size GROUP BY doc_id, page_id, ln)")
    _state("j13_column_headers", """SELECT doc_id, page_id, ordinal FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY doc_id, page_id) AS k FROM (SELECT *, abs(font_size - m) / m < 0.2 AS near FROM (SELECT *, list_sort(list(font_size) OVER w)[count(*) OVER w // 2 + 1] AS m, count(*) OVER w AS n FROM (
 SELECT t.* FROM g_text t JOIN (SELECT doc_id, page_id, arg_min(y, x) AS top, avg(width) AS w, list(x) AS xs FROM (SELECT *, min(y) OVER (PARTITION BY doc_id, page_id) AS t FROM g_field) WHERE y - t <= 8 GROUP BY doc_id, page_id) f ON f.doc_id = t.doc_id AND f.page_id = t.page_id
 AND f.top + 24 - (t.y + t.height) BETWEEN -2 AND 30 AND t.width <= 1.5 * f.w AND len(list_filter(f.xs, lambda q: t.x + t.width / 2 BETWEEN q - 15 AND q + 135)) > 0) WINDOW w AS (PARTITION BY doc_id, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))) WHERE n >= 2 AND (near OR k < 2)""")


@register("a19_table_extents", """SELECT doc_id, page_id, component, list_transform(range(1, len(cols)), lambda i: round(cols[i + 1] - cols[i] + CASE WHEN i = 1 THEN 12 ELSE 0 END, 6)) AS widths, list_transform(range(1, len(rws)), lambda i: round(rws[i + 1] - rws[i], 6)) AS heights, round(cols[1] - 12, 6) AS x, round(rws[1], 6) AS y, round(cols[-1] - cols[1] + 12, 6) AS width, round(rws[-1] - rws[1], 6) AS height FROM grids""", _GRIDS, recursive=True)
def a19(s, d):
    sizes = l.extents(l.grids(v.g_rect(s, d)), F.lit(12.0))
    six = lambda x: F.round(x, 6)
    return sizes.select(*PAGE, "component", F.transform("widths", six).alias("widths"), F.transform("heights", six).alias("heights"), *[six(F.col(c)).alias(c) for c in ("x", "y", "width", "height")])


@register("g11_field_grid", """SELECT doc_id, page_id, list_transform([lft] || inr || [rgt], lambda q: round(q, 6)) AS cols, list_transform(CASE WHEN h_top IS NULL THEN [top - 2] ELSE [h_top - 2, (h_bottom + top) / 2] END || btw || [below], lambda q: round(q, 6)) AS "rows", h_top IS NOT NULL AS has_header FROM (
 SELECT c.doc_id, c.page_id, least(c.first, h.h_x, (SELECT min(t.x) FROM txt t WHERE t.doc_id = c.doc_id AND t.page_id = c.page_id AND t.x < c.first AND t.y + t.height / 2 BETWEEN r.top - 5 AND r.y1)) - 2 AS lft, c.inr, c.rgt, r.btw, r.top, r.below, h.h_top, h.h_bottom
 FROM (SELECT doc_id, page_id, arg_min(st, col) AS first, max_by(en, col) + 2 AS rgt, coalesce(list((bf + st) / 2 ORDER BY col) FILTER (bf IS NOT NULL), []) AS inr FROM (SELECT *, lag(en) OVER (PARTITION BY doc_id, page_id ORDER BY col) AS bf FROM (SELECT doc_id, page_id, ordinal % 3 AS col, avg(x) AS st, avg(x + width) AS en FROM fd GROUP BY doc_id, page_id, ordinal % 3)) GROUP BY doc_id, page_id HAVING count(*) >= 2) c
 JOIN (SELECT doc_id, page_id, arg_min(lead, rw) AS top, arg_max(bottom, rw) + 2 AS below, arg_max(lead + 18, rw) + 5 AS y1, coalesce(list((bf + tp) / 2 ORDER BY rw) FILTER (bf IS NOT NULL), []) AS btw FROM (SELECT *, lag(bottom) OVER (PARTITION BY doc_id, page_id ORDER BY rw) AS bf FROM (
 SELECT doc_id, page_id, ordinal // 3 % 16 AS rw, min(y) AS tp, max(y + height) AS bottom, arg_min(y, x) AS lead FROM fd GROUP BY doc_id, page_id, ordinal // 3 % 16)) GROUP BY doc_id, page_id) r ON r.doc_id = c.doc_id AND r.page_id = c.page_id
 LEFT JOIN (SELECT doc_id, page_id, min(x) AS h_x, min(y) AS h_top, max(y + height) AS h_bottom FROM txt WHERE y < 84 GROUP BY doc_id, page_id) h ON h.doc_id = c.doc_id AND h.page_id = c.page_id)""",
          "fd AS (SELECT * FROM g_field), txt AS (SELECT doc_id, page_id, ordinal, 60 - ordinal % 7 * 6 AS x, (70 + ordinal % 9 * 40)::DOUBLE AS y, 20.0::DOUBLE AS width, 9.0::DOUBLE AS height FROM g_field WHERE ordinal % 5 = 0 AND ordinal % 60 > 20)")
def g11(s, d):
    f = v.g_field(s, d)
    fields = f.withColumn("row", F.floor(F.col("ordinal") / 3).cast("long") % 16).withColumn("col", F.col("ordinal") % 3)
    texts = f.where("ordinal % 5 = 0 and ordinal % 60 > 20").select(*KEY, (60 - F.col("ordinal") % 7 * 6).cast("double").alias("x"), (F.lit(70.0) + F.col("ordinal") % 9 * 40).alias("y"), F.lit(20.0).alias("width"), F.lit(9.0).alias("height"))
    t = doc.field_grid(fields, texts.where("y < 84"), texts)
    return t.select(*PAGE, *[F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("cols", "rows")], "has_header")


@register("g22_line_splits", """SELECT doc_id, page_id, ln, sum(CASE WHEN y - py - ph > 1.5 * (fs + pf) / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id ORDER BY ln)::BIGINT AS paragraph FROM (SELECT *, lag(y) OVER w AS py, lag(h) OVER w AS ph, lag(fs) OVER w AS pf FROM (
 SELECT doc_id, page_id, ln, arg_min(y, ordinal) AS y, avg(height) AS h, avg(font_size) AS fs FROM g_text GROUP BY doc_id, page_id, ln) WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY ln))""")
def g22(s, d):
    lines = v.g_text(s, d).groupBy(*PAGE, "ln").agg(F.min_by("y", "ordinal").alias("y"), F.avg("height").alias("height"), F.avg("font_size").alias("font_size"))
    return l.line_splits(lines).select(*PAGE, "ln", "paragraph")


# ---- small predicates and accessors


@register("w04_bounds_overlap", "SELECT a.page_id, count(*) AS n FROM g_rect a JOIN g_rect b ON a.page_id = b.page_id AND a.ordinal < b.ordinal AND a.x + a.width + 3 >= b.x AND b.x + b.width + 3 >= a.x AND a.y + a.height + 3 >= b.y AND b.y + b.height + 3 >= a.y GROUP BY a.page_id")
def w04(s, d):
    own = ["ordinal", "x", "y", "width", "height"]
    side = lambda p: v.g_rect(s, d).select("page_id", *[F.col(c).alias(p + c) for c in own])
    return side("a_").join(side("b_"), "page_id").where((F.col("a_ordinal") < F.col("b_ordinal")) & g.touches("a_", "b_", 3.0)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@register("w08_kept_fills", "SELECT page_id, ordinal FROM g_rect WHERE fill IS NOT NULL AND width > 5 AND height > 5")
def w08(s, d):
    return v.g_rect(s, d).where("fill is not null and width > 5 and height > 5").select("page_id", "ordinal")


@register("w11_faux_bold", "SELECT doc_id, ln, bold OR ln % 8 = 2 AS heavy FROM g_line")
def w11(s, d):
    return v.g_line(s, d).select("doc_id", "ln", (F.col("bold") | (F.col("ln") % 8 == 2)).alias("heavy"))


@register("w12_artifacts", "SELECT page_id, ordinal, role IN ('NAV', 'FOOTER') OR parent IN ('NAV', 'FOOTER') AS artifact FROM (SELECT *, lag(role) OVER (PARTITION BY page_id ORDER BY ordinal) AS parent FROM g_node)")
def w12(s, d):
    before = F.lag("role").over(Window.partitionBy("page_id").orderBy("ordinal"))
    stack = F.array_compact(F.array(before, F.col("role")))  # the tags around an element
    return v.g_node(s, d).withColumn("stack", stack).select("page_id", "ordinal", F.exists("stack", lambda r: r.isin("NAV", "FOOTER")).alias("artifact"))


@register("w22_open_guard", "SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id < p.page_id)")
def w22(s, d):
    p = v.table(s, d, "pages").select("page_id", "url")
    first = p.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return p.join(first, ["url", "page_id"], "left_semi").select("page_id")


@register("w23_encrypted", "SELECT page_id, contains(html, '/Encrypt') OR contains(html, 'track(1') AS encrypted FROM pages")
def w23(s, d):
    return v.table(s, d, "pages").select("page_id", (F.contains("html", F.lit("/Encrypt")) | F.contains("html", F.lit("track(1"))).alias("encrypted"))


@register("f23_inverse_rotation", "SELECT ordinal, CASE ordinal % 4 WHEN 0 THEN [1, 0, 0, 1, 0, 0] WHEN 1 THEN [0, -1, 1, 0, 0, width] WHEN 2 THEN [-1, 0, 0, -1, width, height] ELSE [0, 1, -1, 0, height, 0] END::DOUBLE[] AS m FROM g_image")
def f23(s, d):
    return v.g_image(s, d).select("ordinal", g.inverse_rotation(F.col("ordinal") % 4 * 90 + 360, "width", "height").alias("m"))


@register("f25_annotation_label", "SELECT ordinal, CASE type WHEN 'Tx' THEN coalesce(nullif(left(value, 30), ''), 'Text') WHEN 'Btn' THEN 'Drawing (' || ordinal % 3 || CASE WHEN ordinal % 3 = 1 THEN ' stroke)' ELSE ' strokes)' END WHEN 'Ch' THEN 'Circle' ELSE 'Annotation' END AS label FROM g_field")
def f25(s, d):
    kind = F.create_map(*[F.lit(x) for x in ("Tx", "text", "Btn", "drawing", "Ch", "shape", "Push", "other")])[F.col("type")]
    return v.g_field(s, d).select("ordinal", e.annotation_label(kind, F.col("value"), F.col("ordinal") % 3, F.lit("circle")).alias("label"))


@register("n05_element_edges", "SELECT 'text' AS kind, doc_id, page_id, min(x) AS x, min(y) AS y, max(y + height) AS bottom FROM g_text GROUP BY doc_id, page_id UNION ALL SELECT 'image', doc_id, page_id, min(50.0), min(ordinal::DOUBLE), max(ordinal + height) FROM g_image GROUP BY doc_id, page_id")
def n05(s, d):
    texts = v.g_text(s, d).groupBy(*PAGE).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("y") + F.col("height")).alias("bottom"))
    images = v.g_image(s, d).groupBy(*PAGE).agg(F.lit(50.0).alias("x"), F.min("ordinal").cast("double").alias("y"), F.max(F.col("ordinal") + F.col("height")).alias("bottom"))
    return texts.select(F.lit("text").alias("kind"), "*").unionByName(images.select(F.lit("image").alias("kind"), "*"))


@register("n09_annotations", "SELECT doc_id, page_id + 1 AS page, ordinal, name FROM g_field")
def n09(s, d):
    pages = v.g_field(s, d).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("annotations"))
    return pages.select("doc_id", (F.col("page_id") + 1).alias("page"), F.explode("annotations").alias("a")).select("doc_id", "page", "a.ordinal", "a.name")


@register("j28_page_of_annotation", "SELECT DISTINCT doc_id, page_id FROM g_line l WHERE EXISTS (SELECT 1 FROM g_field f WHERE f.doc_id = l.doc_id AND f.page_id = l.page_id AND f.ordinal % 50 = 7)")
def j28(s, d):
    pages = v.g_line(s, d).select(*PAGE).distinct()
    return pages.join(v.g_field(s, d).where("ordinal % 50 = 7"), PAGE, "left_semi")


@register("r19_metadata", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([^\"]*)\"', 1) AS lang, strlen(html) AS size FROM pages")
def r19(s, d):
    x = lambda p: F.regexp_extract("html", p, 1)
    return v.table(s, d, "pages").select("page_id", x("<title>([^<]*)</title>").alias("title"), x('lang="([^"]*)"').alias("lang"), F.octet_length("html").cast("long").alias("size"))


statements()
