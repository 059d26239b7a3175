"""All queries over the operators, with the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import geometry as g
from folioframe.functions import text as t
from folioframe.operators import content
from folioframe.operators import elements as e
from folioframe.operators import layout as l
from folioframe.operators import matches as m
from folioframe.operators import shapes
from folioframe.sources import views as v

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

PAGE = ["doc_id", "page_id"]
KEY = [*PAGE, "ordinal"]


def register(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Registers a query; ``sql`` is its SELECT over the views and further ``ctes``."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{v.SQL}{', ' + ctes if ctes else ''} {sql}"
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more, wider, deeper  # noqa: F401, I001  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more, wider, deeper  # noqa: F401, I001

    return dict(_SQL)


# ---- search


@register("x01_search_literal", "SELECT doc_id, page_id, ordinal, text FROM g_line WHERE contains(lower(text), 'the or')")
def x01(s, d):
    return e.search(v.g_line(s, d), "The or").select(*KEY, "text")


@register("x01_search_regex", "SELECT doc_id, page_id, ordinal FROM g_line WHERE regexp_matches(lower(text), '(and|der) .?en')")
def x01r(s, d):
    return e.search(v.g_line(s, d), "(and|der) .?en", regex=True).select(*KEY)


@register("x02_search_whole_word", "SELECT doc_id, page_id, ordinal FROM g_line WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9_])that(?:$|[^A-Za-z0-9_])')")
def x02(s, d):
    return v.g_line(s, d).where(F.col("text").rlike(e.whole_word("that", case=True))).select(*KEY)


@register("x03_replace_all", "SELECT doc_id, page_id, ordinal, len(regexp_extract_all(text, '(?i)tion'))::BIGINT AS n, regexp_replace(text, '(?i)tion', 'TION', 'g') AS text FROM g_line WHERE contains(lower(text), 'tion')")
def x03(s, d):
    return e.replace_all(v.g_line(s, d), "tion", "TION").select(*KEY, "n", "text")


@register("x01_hits_per_document", "SELECT doc_id, count(*) AS n, sum(len(regexp_extract_all(lower(text), 'the')))::BIGINT AS hits FROM g_line WHERE contains(lower(text), 'the') GROUP BY doc_id")
def x01n(s, d):
    return e.search(v.g_line(s, d), "the").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.regexp_count(F.lower("text"), F.lit("the"))).cast("long").alias("hits"))


# ---- classifiers and forms

_ROLE = """CASE WHEN abs(width) * abs(height) > 0.9 * 612 * 792 THEN 'page-background' WHEN (abs(height) < 2 OR abs(width) < 2) AND (abs(width) > 306 OR abs(height) > 396) THEN 'separator'
 WHEN stroke IS NOT NULL AND line_width > 0 THEN 'table-border' WHEN fill IS NOT NULL AND stroke IS NULL THEN 'cell-fill' ELSE 'decorative' END"""
_FILLED = "CASE WHEN type = 'Btn' THEN value NOT IN ('', 'Off', 'false') ELSE trim(value) <> '' END"


@register("w01_rect_roles", f"SELECT doc_id, page_id, ordinal, {_ROLE} AS role FROM g_rect")
def w01(s, d):
    return v.g_rect(s, d).select(*KEY, e.rect_role().alias("role"))


@register("w01_role_counts", f"SELECT {_ROLE} AS role, count(*) AS n FROM g_rect GROUP BY 1")
def w01n(s, d):
    return v.g_rect(s, d).groupBy(e.rect_role().alias("role")).agg(F.count(F.lit(1)).alias("n"))


@register("w02_image_class", "SELECT doc_id, page_id, ordinal, filter = 'DCTDecode' OR CASE WHEN width * height < 16 THEN false WHEN bits = 1 AND width * height < 5000 THEN false ELSE width * height > 10000 END AS genuine FROM g_image")
def w02(s, d):
    return v.g_image(s, d).select(*KEY, e.genuine_image().alias("genuine"))


@register("w14_roles", "SELECT doc_id, page_id, ordinal, role, CASE WHEN regexp_matches(role, '^[Hh][1-6]$') THEN substr(role, 2, 1)::INT END AS level, role IN ('LI', 'UL') AS is_list FROM g_node")
def w14(s, d):
    return v.g_node(s, d).select(*KEY, "role", e.heading_level_of_role("role").alias("level"), F.col("role").isin("LI", "UL").alias("is_list"))


@register("w15_field_filled", f"SELECT doc_id, page_id, ordinal, {_FILLED} AS filled FROM g_field")
def w15(s, d):
    return v.g_field(s, d).select(*KEY, e.filled().alias("filled"))


@register("w16_empty_required", f"SELECT doc_id, page_id, ordinal, coalesce(nullif(name, ''), '(unnamed ' || ordinal || ')') AS field FROM g_field WHERE type <> 'Push' AND required AND NOT ({_FILLED})")
def w16(s, d):
    return e.empty_required(v.g_field(s, d))


@register("w17_validate", "SELECT doc_id, page_id, ordinal, 'required' AS error FROM g_field WHERE required AND trim(value) = '' UNION ALL SELECT doc_id, page_id, ordinal, 'too_long' FROM g_field WHERE type = 'Tx' AND length(value) > max_length")
def w17(s, d):
    return e.validate(v.g_field(s, d))


@register("w20_page_range", "SELECT doc_id, n, list_sort(list_distinct(list_filter([1, 2, 3, 5], lambda p: (p <= 3 AND n >= 3) OR (p = 5 AND n >= 5)))) AS pages, n >= 5 AS valid FROM (SELECT doc_id, max(page_id) + 1 AS n FROM g_line GROUP BY doc_id)")
def w20(s, d):
    p = v.g_line(s, d).groupBy("doc_id").agg((F.max("page_id") + 1).alias("n"))
    return p.select("doc_id", "n", t.page_numbers(F.lit("1-3, 5,5"), F.col("n").cast("int")).alias("pages"), t.valid_ranges(F.lit("1-3, 5,5"), F.col("n").cast("int")).alias("valid"))


@register("a06_form_stats", f"""SELECT doc_id, count(*) AS total, count(*) FILTER (f) AS filled, count(*) FILTER (required) AS required, count(*) FILTER (required AND f) AS required_filled,
 floor(count(*) FILTER (f) * 100 / count(*) + 0.5)::BIGINT AS percent FROM (SELECT *, {_FILLED} AS f FROM g_field WHERE type <> 'Push') GROUP BY doc_id""")
def a06(s, d):
    return e.form_stats(v.g_field(s, d))


@register("j01_value_mapping", "SELECT o_orderkey AS value_id, f.doc_id, f.name, o_orderpriority AS value FROM orders JOIN g_field f ON f.ordinal = o_custkey")
def j01(s, d):
    o = v.table(s, d, "orders").select(F.col("o_orderkey").alias("value_id"), F.col("o_custkey").alias("ordinal"), F.col("o_orderpriority").alias("value"))
    return o.join(v.g_field(s, d).select("ordinal", "doc_id", "name"), "ordinal").select("value_id", "doc_id", "name", "value")


@register("j02_first_mapping", "SELECT n.name, f.ordinal, n.n FROM (SELECT name, count(*) AS n, min(ordinal) AS o FROM g_field GROUP BY name) n JOIN g_field f ON f.name = n.name AND f.ordinal = n.o")
def j02(s, d):
    return v.g_field(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("ordinal")).select("name", "ordinal", "n")


@register("o03_field_order", "SELECT doc_id, page_id, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, y DESC, ordinal) AS place FROM g_field")
def o03(s, d):
    w = Window.partitionBy("doc_id").orderBy("page_id", F.col("y").desc(), "ordinal")
    return v.g_field(s, d).select(*KEY, F.row_number().over(w).cast("long").alias("place"))


@register("k09_form_json", """SELECT doc_id, '{' || string_agg('"' || name || '":"' || value || '"', ',' ORDER BY name) || '}' AS json FROM (SELECT doc_id, name, arg_max(value, ordinal) AS value FROM g_field GROUP BY ALL) GROUP BY doc_id""".replace("GROUP BY ALL", "GROUP BY doc_id, name"))
def k09(s, d):
    last = v.g_field(s, d).groupBy("doc_id", "name").agg(F.max_by("value", "ordinal").alias("value"))
    return last.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("json"))


# ---- metrics


@register("a01_source_metrics", """SELECT doc_id, count(*) AS n_texts, sum(length(text))::BIGINT AS n_chars, count(DISTINCT upper(color)) AS n_colors, min(font_size) AS min_size, max(font_size) AS max_size,
 count(DISTINCT font_size) AS n_sizes, round(sum(length(text) * font_size) / sum(length(text)), 6) AS avg_size, count(DISTINCT page_id) AS n_pages FROM g_text GROUP BY doc_id""")
def a01(s, d):
    return e.source_metrics(v.g_text(s, d))


def _measured(s, d) -> DataFrame:
    """Source and output figures of each document: the output keeps headings apart and drops every seventh line."""
    text = v.g_text(s, d)
    kept = F.col("ln") % 7 != 6
    n = F.length("text")
    return text.groupBy("doc_id").agg(
        F.sum(n).alias("source_chars"), F.sum(F.when(kept, n).otherwise(0)).alias("output_chars"),
        F.count_distinct("color").alias("source_colors"), F.count_distinct(F.when(kept, F.col("color"))).alias("output_colors"),
        F.count_if((F.col("ln") % 40 == 0) & (F.col("ordinal") == 0)).alias("detected_tables"), F.count_if((F.col("ln") % 80 == 0) & (F.col("ordinal") == 0)).alias("output_tables"),
        F.sum(n * F.col("font_size")).alias("a"), F.max("font_size").alias("output_size"), F.min("x").alias("source_margin"), F.min(F.when(kept, F.col("x") + F.col("ln") % 2)).alias("output_margin"),
        F.count_distinct("page_id").alias("source_images"), F.count_distinct(F.when(F.col("page_id") % 3 != 2, F.col("page_id"))).alias("output_images"),
    ).withColumn("source_size", F.col("a") / F.col("source_chars"))


_MEASURED = """m AS (
  SELECT doc_id, sum(length(text))::DOUBLE AS source_chars, sum(CASE WHEN ln % 7 <> 6 THEN length(text) ELSE 0 END)::DOUBLE AS output_chars, count(DISTINCT color) AS source_colors,
    count(DISTINCT color) FILTER (ln % 7 <> 6) AS output_colors, count(*) FILTER (ln % 40 = 0 AND ordinal = 0) AS detected_tables, count(*) FILTER (ln % 80 = 0 AND ordinal = 0) AS output_tables,
    sum(length(text) * font_size) / sum(length(text)) AS source_size, max(font_size) AS output_size, min(x) AS source_margin, min(x + ln % 2) FILTER (ln % 7 <> 6) AS output_margin,
    count(DISTINCT page_id) AS source_images, count(DISTINCT page_id) FILTER (page_id % 3 <> 2) AS output_images
  FROM g_text GROUP BY doc_id
), q AS (
  SELECT doc_id, least(100, floor(100 * output_chars / source_chars + 0.5))::DOUBLE AS text, least(100, floor(100 * output_colors / source_colors + 0.5))::DOUBLE AS color,
    CASE WHEN detected_tables > 0 THEN least(100, floor(100 * output_tables / detected_tables + 0.5))::DOUBLE END AS structure,
    greatest(0, floor(100 * (1 - abs(output_size - source_size) / source_size) + 0.5))::DOUBLE AS typography,
    greatest(0, floor(100 * (1 - abs(output_margin - source_margin) / source_margin) + 0.5))::DOUBLE AS spatial,
    CASE WHEN source_images > 0 THEN least(100, floor(100 * output_images / source_images + 0.5))::DOUBLE END AS images FROM m
), scored AS (
  SELECT *, floor(round((text * 0.3 + color * 0.1 + coalesce(structure * 0.2, 0) + typography * 0.15 + spatial * 0.15 + coalesce(images * 0.1, 0))
    / (0.7 + CASE WHEN structure IS NULL THEN 0 ELSE 0.2 END + CASE WHEN images IS NULL THEN 0 ELSE 0.1 END)::DOUBLE, 6) + 0.5)::DOUBLE AS composite FROM q
)"""


@register("a04_quality_score", "SELECT * FROM scored", _MEASURED)
def a04(s, d):
    return e.quality_scores(_measured(s, d))


@register("a05_axis_average", """SELECT axis, score, pos = first_value(pos) OVER (ORDER BY score, pos) AS weakest FROM (SELECT unnest(['text', 'color', 'structure', 'typography', 'spatial', 'images']) AS axis, unnest([0, 1, 2, 3, 4, 5]) AS pos,
 unnest([round(avg(text), 6), round(avg(color), 6), round(avg(structure), 6), round(avg(typography), 6), round(avg(spatial), 6), round(avg(images), 6)]) AS score FROM scored)""", _MEASURED)
def a05(s, d):
    return e.axis_averages(e.quality_scores(_measured(s, d)))


@register("a07_doc_statistics", "SELECT doc_id, count(DISTINCT page_id) AS n_pages, count(*) AS n_runs, sum(length(text))::BIGINT AS n_chars FROM g_text GROUP BY doc_id")
def a07(s, d):
    return v.g_text(s, d).groupBy("doc_id").agg(F.count_distinct("page_id").alias("n_pages"), F.count(F.lit(1)).alias("n_runs"), F.sum(F.length("text")).alias("n_chars"))


@register("a08_operator_histogram", "SELECT op, count(*) AS n FROM g_edit GROUP BY op")
def a08(s, d):
    return v.g_edit(s, d).groupBy("op").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "op")


_BOUNDS = "b AS (SELECT doc_id, page_id, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM g_text GROUP BY doc_id, page_id), bounds AS (SELECT *, greatest(36, least(108, x0))::DOUBLE AS \"left\", greatest(36, least(108, y0))::DOUBLE AS top, greatest(36, least(108, 612 - x1))::DOUBLE AS \"right\", greatest(36, least(108, 792 - y1))::DOUBLE AS bottom FROM b)"


@register("a09_content_bounds", "SELECT * FROM bounds", _BOUNDS)
def a09(s, d):
    return e.content_bounds(v.g_text(s, d))


@register("a10_median_border", f"SELECT doc_id, page_id, list_sort(list(width))[len(list(width)) // 2 + 1] AS width, list_sort(list(stroke))[len(list(stroke)) // 2 + 1] AS stroke, count(*) AS n FROM (SELECT *, {_ROLE} AS role FROM g_rect) WHERE role = 'table-border' GROUP BY doc_id, page_id")
def a10(s, d):
    return e.median_border(v.g_rect(s, d))


@register("a11_doc_margins", 'SELECT doc_id, floor(avg("left") * 20 + 0.5)::BIGINT AS "left", floor(avg(top) * 20 + 0.5)::BIGINT AS top, floor(avg("right") * 20 + 0.5)::BIGINT AS "right", floor(avg(bottom) * 20 + 0.5)::BIGINT AS bottom FROM bounds GROUP BY doc_id', _BOUNDS)
def a11(s, d):
    b = e.content_bounds(v.g_text(s, d))
    return b.groupBy("doc_id").agg(*[g.twips(F.avg(c)).alias(c) for c in ("left", "top", "right", "bottom")])


_USED = "u AS (SELECT doc_id, font_size, bold, color, count(*) AS n, min(page_id * 100000 + ordinal) AS first FROM g_text GROUP BY doc_id, font_size, bold, color)"


@register("a12_normal_style", "SELECT doc_id, font_size, bold, color, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM u) WHERE r = 1", _USED)
def a12(s, d):
    return e.normal_style(v.g_text(s, d))


@register("g33_styles", "SELECT doc_id, font_size, bold, color, n, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS style_id FROM u", _USED)
def g33(s, d):
    return e.styles(v.g_text(s, d))


@register("a13_batch_tallies", "SELECT doc_id, count(*) FILTER (op = 'purchase') AS converted, count(*) FILTER (op = 'view') AS skipped, count(*) FILTER (op = 'error') AS failed FROM g_edit GROUP BY doc_id")
def a13(s, d):
    return v.g_edit(s, d).groupBy("doc_id").agg(*[F.count_if(F.col("op") == o).alias(n) for o, n in (("purchase", "converted"), ("view", "skipped"), ("error", "failed"))])


@register("a15_image_totals", "SELECT doc_id, count(*) AS n, count(*) FILTER (filter = 'DCTDecode' OR CASE WHEN width * height < 16 THEN false WHEN bits = 1 AND width * height < 5000 THEN false ELSE width * height > 10000 END) AS genuine, count(DISTINCT content) AS distinct_images FROM g_image GROUP BY doc_id")
def a15(s, d):
    return v.g_image(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(e.genuine_image()).alias("genuine"), F.count_distinct("content").alias("distinct_images"))


@register("d01_image_dedup", "SELECT doc_id, page_id, name, ordinal, min(ordinal) OVER (PARTITION BY doc_id, content) AS stored_as FROM (SELECT doc_id, page_id, name, min(ordinal) AS ordinal, arg_min(content, ordinal) AS content FROM g_image GROUP BY doc_id, page_id, name)")
def d01(s, d):
    return e.image_duplicates(v.g_image(s, d)).drop("hash")


@register("d02_link_dedup", "SELECT doc_id, page_id, uri, n, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY first) AS rel_id FROM (SELECT doc_id, page_id, uri, count(*) AS n, min(ordinal) AS first FROM g_link GROUP BY doc_id, page_id, uri)")
def d02(s, d):
    return e.link_ids(v.g_link(s, d))


@register("o04_recent_topk", "SELECT item, max(ts) AS last FROM g_edit GROUP BY item ORDER BY last DESC, item LIMIT 10")
def o04(s, d):
    return v.g_edit(s, d).groupBy("item").agg(F.max("ts").alias("last")).orderBy(F.col("last").desc(), "item").limit(10)


# ---- pages


def _pages(s, d):
    return v.g_line(s, d).select(*PAGE).distinct()


_PAGES = "p AS (SELECT DISTINCT doc_id, page_id FROM g_line), pn AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p)"


@register("u01_merge", "SELECT doc_id // 10 AS merged_id, doc_id, page_id AS from_page, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id, page_id) - 1 AS page_id FROM p", _PAGES)
def u01(s, d):
    return e.merge(_pages(s, d), F.floor(F.col("doc_id") / 10).cast("long"))


@register("u03_extract_pages", "SELECT doc_id, page_id AS from_page, row_number() OVER (PARTITION BY doc_id ORDER BY page_id) - 1 AS page_id FROM pn WHERE (page_id = 0) OR (page_id IN (1, 2) AND n >= 3)", _PAGES)
def u03(s, d):
    return e.extract(_pages(s, d), "1,2-3")


@register("u04_delete_page", "SELECT doc_id, page_id AS from_page, row_number() OVER (PARTITION BY doc_id ORDER BY page_id) - 1 AS page_id FROM pn WHERE page_id <> 0 OR n = 1", _PAGES)
def u04(s, d):
    return e.delete_page(_pages(s, d), 0)


@register("u05_reorder", "SELECT doc_id, page_id AS from_page, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page_id = 0 THEN 2.5 ELSE page_id END) - 1 AS page_id FROM p", _PAGES)
def u05(s, d):
    return e.reorder(_pages(s, d), 0, 2)


@register("u06_insert_blank", "SELECT doc_id, from_page, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS page_id FROM (SELECT doc_id, page_id AS from_page, page_id::DOUBLE AS k FROM p UNION ALL SELECT doc_id, NULL, 0.5 FROM p WHERE page_id = 0)", _PAGES)
def u06(s, d):
    return e.insert_blank(_pages(s, d), 0)


# ---- scalar functions


@register("f01_escape_xml", "SELECT doc_id, page_id, ordinal, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM g_line WHERE regexp_matches(text, '[&<>\"'']')")
def f01(s, d):
    return v.g_line(s, d).where(F.col("text").rlike("[&<>\"']")).select(*KEY, t.escape_xml("text").alias("xml"))


@register("f02_font_map", """SELECT ordinal, CASE k WHEN 0 THEN 'Arial' WHEN 1 THEN 'Arial' WHEN 2 THEN 'Times New Roman' WHEN 3 THEN 'Wingdings' ELSE 'Folio' || doc_id % 7 END AS font, k = 1 AS subset, k IN (2, 4) AS bold FROM (SELECT *, ordinal % 5 AS k FROM g_image)""")
def f02(s, d):
    k = F.col("ordinal") % 5
    name = F.when(k == 0, "Helvetica").when(k == 1, "ABCDEF+ArialMT").when(k == 2, "Times-Bold").when(k == 3, "ZapfDingbats").otherwise(F.concat(F.lit("Folio"), (F.col("doc_id") % 7).cast("string"), F.lit("-Bold")))
    i = v.g_image(s, d).withColumn("f", name)
    return i.select("ordinal", t.font_name("f").alias("font"), t.is_subset_font("f").alias("subset"), t.is_bold_font("f").alias("bold"))


@register("f04_rgb_hex", "SELECT ordinal, printf('%02x%02x%02x', floor(least(1, width / 200) * 255 + 0.5)::INT, floor(least(1, height / 200) * 255 + 0.5)::INT, 0) AS hex FROM g_image")
def f04(s, d):
    return v.g_image(s, d).select("ordinal", g.rgb_hex(F.col("width") / 200, F.col("height") / 200, F.lit(-0.5)).alias("hex"))


@register("f05_cmyk_rgb", "SELECT ordinal, round(1 - least(1, width / 200 + 0.25), 6) AS r, round(1 - least(1, height / 250 + 0.25), 6) AS g, 0.75::DOUBLE AS b FROM g_image")
def f05(s, d):
    c = g.cmyk_rgb(F.col("width") / 200, F.col("height") / 250, F.lit(0.0), F.lit(0.25))
    return v.g_image(s, d).select("ordinal", *[F.round(c[x], 6).alias(x) for x in "rgb"])


@register("f07_field_name", "SELECT ordinal, left(regexp_replace(list_last(string_split(name, '.')), '\\[[0-9]+\\]', '', 'g'), 20) AS label FROM g_field")
def f07(s, d):
    return v.g_field(s, d).select("ordinal", t.field_label("name").alias("label"))


@register("f09_file_size", "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n * 10 / 1024 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n * 10 / 1048576 + 0.5) / 10) || ' MB' END AS size FROM (SELECT doc_id, n_chars * 64 AS n FROM documents)")
def f09(s, d):
    return v.table(s, d, "documents").select("doc_id", t.file_size(F.col("n_chars") * 64).alias("size"))


@register("f10_pdf_date", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'no date ' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM g_edit")
def f10(s, d):
    raw = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("no date "), "event_id")).otherwise(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+00'00'")))
    return v.g_edit(s, d).select("event_id", t.shown_date(raw).alias("shown"))


@register("f16_fnv1a", """SELECT DISTINCT content, lower(printf('%08x', h)) || ':' || strlen(content) AS hash FROM (SELECT content, list_reduce(list_transform(range(strlen(content)), lambda i: ascii(content[i + 1])::BIGINT), lambda a, b: (xor(a, b) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM g_image)""")
def f16(s, d):
    return v.g_image(s, d).select("content").distinct().select("content", t.fnv1a("content").alias("hash"))


@register("f21_number_format", "SELECT ordinal, rtrim(rtrim(printf('%.6f', x / 7), '0'), '.') AS text FROM (SELECT ordinal, width AS x FROM g_image)")
def f21(s, d):
    return v.g_image(s, d).select("ordinal", t.plain_number(F.col("width") / 7).alias("text"))


# ---- spatial joins


def _marks(s, d):
    """Coloured marks: every third word of a page, moved a little."""
    return v.g_text(s, d).where("ordinal % 3 = 0").select(*KEY, (F.col("x") + 5).alias("x"), "y", "color", "font_size")


@register("j04_nearest_color", """SELECT t.doc_id, t.page_id, t.ordinal, coalesce(arg_min(m.color, (d, m.ordinal)) FILTER (d <= 2 * t.font_size), '000000') AS color FROM (
 SELECT t, m, sqrt(power(t.x - (m.x + 5), 2) + power(t.y - m.y, 2)) AS d FROM g_text t LEFT JOIN g_text m ON t.doc_id = m.doc_id AND t.page_id = m.page_id AND m.ordinal % 3 = 0 AND abs(t.y - m.y) <= 2 * t.font_size) GROUP BY t.doc_id, t.page_id, t.ordinal""")
def j04(s, d):
    return l.nearest_color(v.g_text(s, d), _marks(s, d))


def _texts_on_rects(s, d):
    """Texts on the pages of the boxes: one at the middle of each box, moved by its number."""
    return v.g_rect(s, d).select(*KEY, (F.col("x") + F.col("width") / 2 - 10).alias("x"), (F.col("y") + F.col("ordinal") % 5 * 6 - 4).alias("y"), F.lit(20.0).alias("width"), F.lit(8.0).alias("height"))


@register("j05_smallest_container", """SELECT t.doc_id, t.page_id, t.ordinal, coalesce(arg_min(r.fill, (r.width * r.height, r.ordinal)), 'white') AS fill FROM (SELECT *, x + width / 2 AS cx, y + ordinal % 5 * 6 AS cy FROM g_rect) t
 LEFT JOIN g_rect r ON r.doc_id = t.doc_id AND r.page_id = t.page_id AND r.fill IS NOT NULL AND cx BETWEEN r.x - 2 AND r.x + r.width + 2 AND cy BETWEEN r.y - 2 AND r.y + r.height + 2 GROUP BY t.doc_id, t.page_id, t.ordinal""")
def j05(s, d):
    return l.smallest_container(_texts_on_rects(s, d), v.g_rect(s, d))


_CELL = "CASE WHEN {v} BETWEEN {a} - 2 AND {b} + 2 THEN 0 WHEN {v} BETWEEN {b} - 2 AND {c} + 2 THEN 1 WHEN {v} BETWEEN {c} - 2 AND {d} + 2 THEN 2 END"


@register("j06_point_in_cell", f"SELECT doc_id, page_id, ordinal, r AS \"row\", c AS col FROM (SELECT doc_id, page_id, ordinal, {_CELL.format(v='y + height / 2', a=100, b=180, c=260, d=300)} AS r, {_CELL.format(v='x + width / 2', a=60, b=160, c=300, d=420)} AS c FROM g_text) WHERE r IS NOT NULL AND c IS NOT NULL")
def j06(s, d):
    bounds = lambda *b: F.array(*[F.lit(float(x)) for x in b])
    cell = l.cell_of(F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2, bounds(60, 160, 300, 420), bounds(100, 180, 260, 300))
    return v.g_text(s, d).select(*KEY, cell.alias("cell")).where("cell is not null").select(*KEY, "cell.row", "cell.col")


@register("j12_field_line", """SELECT f.doc_id, f.page_id, f.ordinal, arg_min(l.ordinal, (abs(f.y + 9 - (l.y + l.font_size / 2)), l.ordinal)) FILTER (abs(f.y + 9 - (l.y + l.font_size / 2)) <= 25) AS line FROM g_field f LEFT JOIN g_line l ON f.doc_id = l.doc_id AND f.page_id = l.page_id GROUP BY f.doc_id, f.page_id, f.ordinal""")
def j12(s, d):
    return l.field_line(v.g_field(s, d), v.g_line(s, d))


def _rules(s, d):
    """Thin lines under or through the first words of lines."""
    w = v.g_text(s, d).where("ordinal % 12 = 0")
    return w.select(*KEY, "x", (F.col("y") + F.when(F.col("ln") % 2 == 0, F.col("height") + 1).otherwise(F.col("height") / 2)).alias("y"), (F.col("width") * (F.col("ln") % 3 + 1) / 2).alias("width"), F.lit(0.5).alias("height"))


_RULES = "rules AS (SELECT doc_id, page_id, ordinal, x, y + CASE WHEN ln % 2 = 0 THEN height + 1 ELSE height / 2 END AS y, width * (ln % 3 + 1) / 2 AS width, 0.5::DOUBLE AS height FROM g_text WHERE ordinal % 12 = 0)"


@register("j17_text_decoration", """SELECT t.doc_id, t.page_id, t.ordinal, coalesce(bool_or(wide AND under), false) AS underline, coalesce(bool_or(wide AND NOT under AND through), false) AS strike FROM (
 SELECT t.doc_id, t.page_id, t.ordinal, least(t.x + t.width, r.x + r.width) - greatest(t.x, r.x) >= 0.8 * t.width AS wide, r.y + r.height / 2 - (t.y + t.height) BETWEEN -1 AND 3 AS under,
 abs(r.y + r.height / 2 - (t.y + t.height / 2)) <= 0.2 * t.height AS through FROM g_text t LEFT JOIN rules r ON t.doc_id = r.doc_id AND t.page_id = r.page_id) t GROUP BY t.doc_id, t.page_id, t.ordinal""", _RULES)
def j17(s, d):
    return l.text_decoration(v.g_text(s, d), _rules(s, d))


_BORDER = f"br AS (SELECT * FROM (SELECT *, {_ROLE} AS role FROM g_rect) WHERE role = 'table-border'), ov AS (SELECT a.doc_id, a.page_id, a.ordinal AS a, b.ordinal AS b FROM br a JOIN br b ON a.doc_id = b.doc_id AND a.page_id = b.page_id AND a.x < b.x + b.width + 8 AND a.x + a.width + 8 > b.x AND a.y < b.y + b.height + 8 AND a.y + a.height + 8 > b.y), reach AS (SELECT DISTINCT doc_id, page_id, a, b FROM ov UNION SELECT r.doc_id, r.page_id, r.a, o.b FROM reach r JOIN ov o ON r.doc_id = o.doc_id AND r.page_id = o.page_id AND r.b = o.a)"


@register("j20_components", "SELECT doc_id, page_id, a AS ordinal, min(b) AS component FROM reach GROUP BY doc_id, page_id, a", _BORDER, recursive=True)
def j20(s, d):
    return l.border_groups(v.g_rect(s, d))


@register("j20_overlap_pairs", "SELECT doc_id, page_id, a, b FROM ov WHERE a < b", _BORDER, recursive=True)
def j20p(s, d):
    return l.overlapping_borders(v.g_rect(s, d))[1]


@register("g12_bordered_tables")
def g12(s, d):
    return l.bordered_tables(v.g_rect(s, d))


@register("j26_anti_consumed", "SELECT t.doc_id, t.page_id, t.ordinal FROM g_text t WHERE NOT EXISTS (SELECT 1 FROM bounds b WHERE b.doc_id = t.doc_id AND b.page_id = t.page_id AND t.x + t.width / 2 BETWEEN b.x0 - 2 AND b.x0 + (b.x1 - b.x0) / 2 + 2 AND t.y + t.height / 2 BETWEEN b.y0 - 2 AND b.y0 + (b.y1 - b.y0) / 2 + 2)", _BOUNDS)
def j26(s, d):
    texts = v.g_text(s, d)
    b = e.content_bounds(texts)
    tables = b.select(*PAGE, F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x0") + (F.col("x1") - F.col("x0")) / 2).alias("x1"), (F.col("y0") + (F.col("y1") - F.col("y0")) / 2).alias("y1"))
    return l.text_in_tables(texts, tables).select(*KEY)


# ---- grouping

_LINEKEY = "doc_id, page_id, ln"


@register("g01_cluster_values", """SELECT doc_id, page_id, list(round(s / n, 6) ORDER BY s / n) AS means FROM (SELECT doc_id, page_id, c, sum(y)::DOUBLE AS s, count(*) AS n FROM clustered GROUP BY doc_id, page_id, c) GROUP BY doc_id, page_id""",
"""o AS (SELECT doc_id, page_id, y, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY y) AS i FROM g_field), clustered AS (
 SELECT doc_id, page_id, y, i, y::DOUBLE AS s, 1::BIGINT AS n, 0::BIGINT AS c FROM o WHERE i = 1 UNION ALL
 SELECT o.doc_id, o.page_id, o.y, o.i, CASE WHEN abs(o.y - p.s / p.n) <= 2 THEN p.s + o.y ELSE o.y END, CASE WHEN abs(o.y - p.s / p.n) <= 2 THEN p.n + 1 ELSE 1 END, CASE WHEN abs(o.y - p.s / p.n) <= 2 THEN p.c ELSE p.c + 1 END
 FROM clustered p JOIN o ON o.doc_id = p.doc_id AND o.page_id = p.page_id AND o.i = p.i + 1)""", recursive=True)
def g01(s, d):
    return v.g_field(s, d).groupBy(*PAGE).agg(F.transform(shapes.running_means(F.collect_list("y"), 2.0), lambda m: F.round(m, 6)).alias("means"))


@register("g03_baseline_lines", "SELECT doc_id, page_id, ordinal, x, y, line FROM f",
"""o AS (SELECT doc_id, page_id, ordinal, x, y, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY y, x, ordinal) AS i FROM g_text), f AS (
 SELECT *, y AS anchor, 0::BIGINT AS line FROM o WHERE i = 1 UNION ALL
 SELECT o.*, CASE WHEN abs(o.y - p.anchor) > 3 THEN o.y ELSE p.anchor END, CASE WHEN abs(o.y - p.anchor) > 3 THEN p.line + 1 ELSE p.line END FROM f p JOIN o ON o.doc_id = p.doc_id AND o.page_id = p.page_id AND o.i = p.i + 1)""", recursive=True)
def g03(s, d):
    return l.baseline_lines(v.g_text(s, d))


_GAP = "gp AS (SELECT *, x - lag(x + width) OVER (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal) AS gap FROM g_text)"


@register("g04_split_gap", "SELECT doc_id, page_id, ordinal, sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal)::BIGINT AS piece FROM gp", _GAP)
def g04(s, d):
    return l.split_gaps(v.g_text(s, d), [*PAGE, "ln"]).select(*KEY, "piece")


_PARA = """lg AS (SELECT *, lag(y) OVER w AS py, lag(font_size) OVER w AS ps FROM g_line WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY y, ordinal)), pa AS (SELECT *, sum(CASE WHEN y - (py + 1.2 * ps) > 1.5 * (font_size + ps) / 2 OR greatest(font_size, ps) / least(font_size, ps) > 1.15 THEN 1 ELSE 0 END)
 OVER (PARTITION BY doc_id, page_id ORDER BY y, ordinal)::BIGINT AS paragraph FROM lg), pd AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page_id, paragraph ORDER BY y, ordinal) AS dy FROM pa),
 pr AS (SELECT doc_id, page_id, paragraph, min(y) AS y, count(*) AS n_lines, round(avg(dy), 6) AS leading, max(y) AS last_y, max(font_size) AS font_size, string_agg(text, chr(10) ORDER BY y, ordinal) AS text FROM pd GROUP BY doc_id, page_id, paragraph)"""


@register("g05_paragraphs", "SELECT doc_id, page_id, ordinal, paragraph FROM pa", _PARA)
def g05(s, d):
    return l.paragraphs(v.g_line(s, d)).select(*KEY, "paragraph")


@register("g06_paragraph_rows", "SELECT * FROM pr", _PARA)
def g06(s, d):
    return l.paragraph_rows(v.g_line(s, d))


@register("v01_spacing", """SELECT doc_id, page_id, paragraph, round(CASE WHEN b > 2 THEN b ELSE 0 END, 6)::DOUBLE AS before, round(CASE WHEN a > 2 THEN a ELSE 0 END, 6)::DOUBLE AS after FROM (
 SELECT *, y - lag(last_y + 1.2::DOUBLE * font_size) OVER w AS b, lead(y) OVER w - (last_y + 1.2::DOUBLE * font_size) AS a FROM pr WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY y, paragraph))""", _PARA)
def v01(s, d):
    return l.spacing(l.paragraph_rows(v.g_line(s, d)))


@register("v02_running_x", "SELECT doc_id, page_id, ordinal, coalesce(sum(width) OVER (PARTITION BY doc_id, page_id, ln ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS run_x FROM g_text")
def v02(s, d):
    w = Window.partitionBy(*PAGE, "ln").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return v.g_text(s, d).select(*KEY, F.coalesce(F.sum("width").over(w), F.lit(0.0)).alias("run_x"))


@register("g08_field_rows")
def g08(s, d):
    return l.field_rows(v.g_field(s, d))


@register("g16_column_starts", "SELECT doc_id, page_id, ln, list(x ORDER BY x) AS starts FROM gp WHERE gap IS NULL OR gap > 2 * font_size GROUP BY doc_id, page_id, ln", _GAP)
def g16(s, d):
    return l.column_starts(v.g_text(s, d), [*PAGE, "ln"])


@register("g17_borderless_tables")
def g17(s, d):
    starts = l.column_starts(v.g_text(s, d), [*PAGE, "ln"]).withColumn("k", F.col("ln"))
    return l.borderless_tables(starts)


_BANDS = "bd AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_id ORDER BY y, ordinal)::BIGINT AS band FROM (SELECT *, CASE WHEN y - max(y + height) OVER (PARTITION BY doc_id, page_id ORDER BY y, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 20 THEN 1 ELSE 0 END AS brk FROM g_text))"


def _bands(s, d):
    return shapes.interval_union(v.g_text(s, d).withColumn("bottom", F.col("y") + F.col("height")), PAGE, "y", "bottom", ["ordinal"], 20.0, "band")


@register("g18_y_bands", "SELECT doc_id, page_id, ordinal, band FROM bd", _BANDS)
def g18(s, d):
    return _bands(s, d).select(*KEY, "band")


@register("g19_two_column", """SELECT doc_id, page_id, band, -g AS gap, (x + reach) / 2 AS split_x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, band ORDER BY g, x, ordinal) AS r FROM (
 SELECT *, -(x - reach) AS g FROM (SELECT *, max(x + width) OVER (PARTITION BY doc_id, page_id, band ORDER BY x, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bd) WHERE x - reach >= 10)) WHERE r = 1""", _BANDS)
def g19(s, d):
    return l.two_columns(_bands(s, d), 10.0)


_MARKS = ("1. ", "x", "- ", "  ▸", "(a) ", "XIV) ", "·", " ⁃  ", "B. ", "(12) ", "1.5 ", "mm. ")


@register("g20_lists", rf"""SELECT doc_id, page_id, ordinal, mark, CASE WHEN bullet <> '' THEN 1 ELSE 2 END AS num_id, floor((x - min(x) OVER (PARTITION BY doc_id, page_id)) / 18)::BIGINT AS level, regexp_replace(substr(regexp_replace(t, '^[ \t\n\v\f\r]+', ''), length(mark) + 1), '^[ \t\n\v\f\r]+', '') AS rest FROM (
 SELECT *, CASE WHEN bullet <> '' THEN bullet ELSE regexp_extract(t, '^[ \t\n\v\f\r]*([0-9]+[.)]|\([0-9]+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxlcdmIVXLCDM]+[.)])[ \t\n\v\f\r]', 1) END AS mark FROM (
 SELECT doc_id, page_id, ordinal, x, t, regexp_extract(t, '^[ \t\n\v\f\r]*([{l.BULLETS.replace('-', '')}-])[ \t\n\v\f\r]*[^ \t\n\v\f\r]', 1) AS bullet FROM (
 SELECT doc_id, page_id, ordinal, {list(_MARKS)}[ln % {len(_MARKS)} + 1] || text AS t, 72.0::DOUBLE + ln % 3 * 12 AS x FROM g_line))) WHERE mark <> ''""")
def g20(s, d):
    mark = F.element_at(F.array(*[F.lit(x) for x in _MARKS]), (F.col("ln") % len(_MARKS) + 1).cast("int"))
    return l.lists(v.g_line(s, d).withColumn("text", F.concat(mark, "text")).withColumn("x", F.lit(72.0) + F.col("ln") % 3 * 12))


@register("g21_headings", """SELECT l.doc_id, l.page_id, l.ordinal, CASE WHEN font_size / body >= 1.5 THEN 1 WHEN font_size / body >= 1.25 THEN 2 ELSE 3 END AS level, body, n_lines FROM ph l JOIN (
 SELECT doc_id, page_id, arg_min(r, (-n, f)) AS body FROM (SELECT doc_id, page_id, floor(font_size * 2 + 0.5) / 2 AS r, count(*) AS n, min((y, ordinal)) AS f FROM ph GROUP BY doc_id, page_id, floor(font_size * 2 + 0.5) / 2) GROUP BY doc_id, page_id) b
 ON l.doc_id = b.doc_id AND l.page_id = b.page_id WHERE n_lines <= 3 AND (font_size / body >= 1.25 OR (font_size / body >= 1.1 AND bold))""",
_PARA + """, ph AS (SELECT doc_id, page_id, paragraph, arg_min(ordinal, (y, ordinal)) AS ordinal, min(y) AS y, arg_min(font_size, (y, ordinal)) AS font_size, arg_min(bold, (y, ordinal)) AS bold, count(DISTINCT floor(y + 0.5)) AS n_lines FROM pa GROUP BY doc_id, page_id, paragraph)""")
def g21(s, d):
    return l.headings(v.g_line(s, d))


@register("g23_alignment", """SELECT doc_id, page_id, blk, n_lines, CASE WHEN l < 15 AND r < 15 AND n_lines > 1 THEN 'justify' WHEN l < 15 THEN 'left' WHEN r < 15 THEN 'right' WHEN c < 15 THEN 'center' ELSE 'left' END AS align FROM (
 SELECT doc_id, page_id, ordinal // 5 AS blk, count(*) AS n_lines, var_pop(x0) AS l, var_pop(x1) AS r, var_pop((x0 + x1) / 2) AS c FROM (SELECT doc_id, page_id, ordinal, x0, CASE WHEN ordinal // 5 % 3 = 0 THEN 540 ELSE x0 + length(text) END::DOUBLE AS x1 FROM (SELECT *, 72 + CASE WHEN ordinal // 5 % 2 = 0 THEN 0 ELSE ordinal % 5 * 9 END::DOUBLE AS x0 FROM g_line)) GROUP BY doc_id, page_id, ordinal // 5)""")
def g23(s, d):
    blk = F.floor(F.col("ordinal") / 5).cast("long")
    x0 = F.lit(72.0) + F.when(blk % 2 == 0, 0).otherwise(F.col("ordinal") % 5 * 9)
    line = v.g_line(s, d).withColumn("blk", blk).withColumn("x0", x0).withColumn("x1", F.when(blk % 3 == 0, 540.0).otherwise(F.col("x0") + F.length("text")))
    return l.alignment(line, [*PAGE, "blk"], order=["ordinal"])


@register("g24_text_boxes", "SELECT doc_id, page_id, ln, box, min(x) AS x, max(x + width) AS x1, count(*) AS n, string_agg(text, ' ' ORDER BY x, ordinal) AS text FROM (SELECT *, sum(CASE WHEN gap >= 0.9 * font_size THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal)::BIGINT AS box FROM gp) GROUP BY doc_id, page_id, ln, box", _GAP)
def g24(s, d):
    return l.text_boxes(v.g_text(s, d), [*PAGE, "ln"])


@register("g25_runs", """SELECT doc_id, page_id, ln, run, count(*) AS n, string_agg(CASE WHEN gap > 0.3 * font_size THEN ' ' ELSE '' END || text, '' ORDER BY x, ordinal) AS text FROM (
 SELECT *, sum(CASE WHEN f <> pf THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal)::BIGINT AS run FROM (
 SELECT *, x - lag(x + width) OVER w AS gap, (font_size || '|' || bold || '|' || color) AS f, lag(font_size || '|' || bold || '|' || color) OVER w AS pf FROM (SELECT * REPLACE (CASE WHEN w % 5 = 4 THEN '00ff00' ELSE color END AS color) FROM g_styled) WINDOW w AS (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal))) GROUP BY doc_id, page_id, ln, run""",
"g_styled AS (SELECT *, ordinal % 12 AS w FROM g_text)")
def g25(s, d):
    # every fifth word of a line has a colour of its own
    text = v.g_text(s, d).withColumn("color", F.when(F.col("ordinal") % 12 % 5 == 4, "00ff00").otherwise(F.col("color")))
    return l.runs(text, [*PAGE, "ln"])


@register("g26_words", "SELECT doc_id, page_id, ordinal, sum(CASE WHEN gap > 0.3 * font_size OR abs(y - py) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal)::BIGINT AS word FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page_id, ln ORDER BY x, ordinal) AS py FROM gp)", _GAP)
def g26(s, d):
    w = Window.partitionBy(*PAGE, "ln").orderBy("x", "ordinal")
    d_ = v.g_text(s, d).withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)).withColumn("py", F.lag("y").over(w))
    return shapes.chain_groups(d_, [*PAGE, "ln"], ["x", "ordinal"], (F.col("gap") > 0.3 * F.col("font_size")) | (F.abs(F.col("y") - F.col("py")) > 3), "word").select(*KEY, "word")


@register("g28_columns", "SELECT doc_id, page_id, ordinal, sum(brk) OVER (PARTITION BY doc_id, page_id ORDER BY x, ordinal)::BIGINT AS col FROM (SELECT *, CASE WHEN x - max(x + width) OVER (PARTITION BY doc_id, page_id ORDER BY x, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 5 THEN 1 ELSE 0 END AS brk FROM g_text)")
def g28(s, d):
    t_ = v.g_text(s, d).withColumn("x1", F.col("x") + F.col("width"))
    return shapes.interval_union(t_, PAGE, "x", "x1", ["ordinal"], 5.0, "col").select(*KEY, "col")


@register("g30_table_rows", """SELECT doc_id, page_id, bucket, n, n_rows FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page_id) AS n_rows FROM (SELECT doc_id, page_id, bucket, count(*) AS n, coalesce(min(gap), 0) AS lst FROM (
 SELECT *, x - lag(x + width) OVER (PARTITION BY doc_id, page_id, bucket ORDER BY x, ordinal) AS gap FROM (SELECT *, (floor(y / 10 + 0.5) * 10)::BIGINT AS bucket FROM g_text)) GROUP BY doc_id, page_id, bucket) WHERE n >= 2 AND lst >= 15) WHERE n_rows >= 2""")
def g30(s, d):
    return l.table_rows(v.g_text(s, d))


def _number(x: str) -> str:
    return f"rtrim(rtrim(printf('%.6f', {x}), '0'), '.')"


_ELEMENTS = f"""el AS (
 SELECT doc_id, page_id, ordinal, 0 AS layer, '<rect x="' || {_number('x')} || '" y="' || {_number('y')} || '" width="' || {_number('width')} || '" height="' || {_number('height')} || '"/>' AS x FROM g_rect UNION ALL
 SELECT doc_id, page_id, ordinal, 3, '<text x="' || {_number('x')} || '" y="' || {_number('y')} || '" font-size="' || {_number('font_size')} || '">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</text>' FROM g_text)"""


@register("k07_page_svg", """SELECT doc_id, page_id, '<svg xmlns="http://www.w3.org/2000/svg" width="612" height="792">' || string_agg(x, '' ORDER BY layer, ordinal) || '</svg>' AS svg FROM el GROUP BY doc_id, page_id""", _ELEMENTS)
def k07(s, d):
    return l.page_svg(v.g_rect(s, d), v.g_text(s, d))


# ---- edit logs


@register("t01_undo_log", "SELECT doc_id, arg_max(n, i) AS history, arg_max(pos, i) AS cursor FROM f GROUP BY doc_id",
"""o AS (SELECT doc_id, op, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS i FROM g_edit), f AS (
 SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS pos FROM (SELECT DISTINCT doc_id FROM o) UNION ALL
 SELECT o.doc_id, o.i, CASE WHEN op IN ('error', 'view') THEN n ELSE pos + 1 END, CASE op WHEN 'error' THEN greatest(pos - 1, 0) WHEN 'view' THEN least(pos + 1, n) ELSE pos + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)""", recursive=True)
def t01(s, d):
    return e.undo_log(v.g_edit(s, d))


@register("t02_debounce", "SELECT doc_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS nx FROM g_edit) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 3600000000")
def t02(s, d):
    return e.debounced(v.g_edit(s, d), 3600).select("doc_id", "event_id")


@register("t06_edit_coalesce", "SELECT doc_id, item, arg_min(value, (ts, event_id)) AS original, arg_max(value, (ts, event_id)) AS latest, count(*) AS n FROM g_edit GROUP BY doc_id, item")
def t06(s, d):
    return e.coalesced(v.g_edit(s, d))


# ---- further matches


def _link_boxes(s, d):
    """Links of documents' pages: a box over every ninth word."""
    return v.g_text(s, d).where("ordinal % 9 = 4").select(*KEY, "x", "y", (F.col("width") * 2).alias("width"), "height", F.concat(F.lit("http://example.org/"), "text").alias("uri"))


@register("j18_link_match", """SELECT t.doc_id, t.page_id, t.ordinal, arg_min('http://example.org/' || l.text, l.ordinal) AS uri FROM g_text t LEFT JOIN g_text l ON t.doc_id = l.doc_id AND t.page_id = l.page_id AND l.ordinal % 9 = 4
 AND t.x + t.width / 2 BETWEEN l.x - 2 AND l.x + l.width * 2 + 2 AND t.y + t.height / 2 BETWEEN l.y - 2 AND l.y + l.height + 2 GROUP BY t.doc_id, t.page_id, t.ordinal""")
def j18(s, d):
    return m.linked(v.g_text(s, d), _link_boxes(s, d))


@register("j15_paragraph_background", """SELECT t.doc_id, t.page_id, t.ordinal, arg_min(r.fill, r.ordinal) AS fill FROM (SELECT *, y + ordinal % 5 * 6 - 4 AS ty FROM g_rect) t
 LEFT JOIN g_rect r ON r.doc_id = t.doc_id AND r.page_id = t.page_id AND r.fill IS NOT NULL AND r.height >= 5 AND ty + 6 BETWEEN r.y - 2 AND r.y + r.height + 2 AND t.x + t.width / 2 - 10 BETWEEN r.x - 5 AND r.x + r.width + 5 GROUP BY t.doc_id, t.page_id, t.ordinal""")
def j15(s, d):
    lines = _texts_on_rects(s, d).withColumn("font_size", F.lit(12.0))
    return m.background(lines, v.g_rect(s, d).where("fill is not null"))


@register("j16_nearest_underline", """SELECT l.doc_id, l.page_id, l.ordinal, arg_min(r.ordinal, (abs(r.y - (l.y + 12)), r.ordinal)) AS rule FROM g_line l LEFT JOIN rules r ON r.doc_id = l.doc_id AND r.page_id = l.page_id AND r.y - (l.y + 12) BETWEEN -2 AND 15 AND r.width <= 550.8 AND r.x <= 277 AND r.x + r.width >= 67 GROUP BY l.doc_id, l.page_id, l.ordinal""", _RULES)
def j16(s, d):
    lines = v.g_line(s, d).select(*KEY, F.lit(72.0).alias("x"), "y", F.lit(200.0).alias("width"), F.lit(12.0).alias("height"))
    return m.underline_rule(lines, _rules(s, d))


@register("j14_label_cell", """SELECT t.doc_id, t.page_id, t.ordinal, arg_min(c.ordinal, (abs(t.x + t.width / 2 - (c.x + 60)) + abs(t.y + t.height / 2 - (c.y + 9)), c.ordinal)) AS cell FROM g_text t LEFT JOIN g_field c ON t.doc_id = c.doc_id AND t.page_id = c.page_id
 AND t.x + t.width / 2 BETWEEN c.x - 10 AND c.x + 130 AND t.y + t.height / 2 BETWEEN c.y - 15 AND c.y + 33 GROUP BY t.doc_id, t.page_id, t.ordinal""")
def j14(s, d):
    return m.nearest_cell(v.g_text(s, d), v.g_field(s, d))


@register("j19_hint_match", """SELECT doc_id, page_id, ordinal, arg_min(role, o) FILTER (role = 'H1' AND same) AS role, arg_max(lang, o) FILTER (same AND lang IS NOT NULL) AS lang, arg_min(actual, o) FILTER (actual IS NOT NULL AND text = h_text) AS actual, coalesce(bool_or(role = 'Artifact' AND loose), false) AS artifact FROM (
 SELECT l.doc_id, l.page_id, l.ordinal, l.text, h.o, h.role, h.lang, h.actual, h.text AS h_text, contains(trim(l.text), h.text) OR contains(h.text, trim(l.text)) AS same, contains(lower(trim(l.text)), lower(h.text)) OR contains(lower(h.text), lower(trim(l.text))) AS loose
 FROM g_line l LEFT JOIN (SELECT doc_id, page_id, ordinal AS o, CASE ordinal % 3 WHEN 0 THEN 'H1' WHEN 1 THEN 'P' ELSE 'Artifact' END AS role, CASE WHEN ordinal % 8 = 1 THEN 'en' END AS lang, CASE WHEN ordinal % 12 = 5 THEN 'fi' END AS actual,
 CASE WHEN ordinal % 8 = 5 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS text FROM g_line WHERE ordinal % 4 = 1) h ON h.doc_id = l.doc_id AND h.page_id = l.page_id AND length(h.text) > 0 AND length(trim(l.text)) > 0) GROUP BY doc_id, page_id, ordinal""")
def j19(s, d):
    lines = v.g_line(s, d)
    k = F.col("ordinal") % 3
    text = F.when(F.col("ordinal") % 8 == 5, F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("text"))
    role = F.when(k == 0, "H1").when(k == 1, "P").otherwise("Artifact")
    hints = lines.where("ordinal % 4 = 1").select(*KEY, text.alias("text"), role.alias("role"), F.when(F.col("ordinal") % 8 == 1, "en").alias("lang"), F.when(F.col("ordinal") % 12 == 5, "fi").alias("actual"))
    return m.structure_hint(lines.select(*KEY, "text"), hints)


@register("j22_graphic_region", """SELECT t.doc_id, t.page_id, t.ordinal, count(*) AS n FROM g_text t JOIN rules p ON t.doc_id = p.doc_id AND t.page_id = p.page_id AND t.x < p.x + p.width * 2 + 5 AND t.x + t.width + 5 > p.x AND t.y < p.y + 40 + 5 AND t.y + t.height + 5 > p.y GROUP BY t.doc_id, t.page_id, t.ordinal HAVING count(*) >= 4""", _RULES)
def j22(s, d):
    paths = _rules(s, d).withColumn("width", F.col("width") * 2).withColumn("height", F.lit(40.0))
    return m.in_graphics(v.g_text(s, d), paths)


@register("j23_field_beside_line", """SELECT doc_id, page_id, ordinal, b.line AS line, CASE WHEN b.bf THEN 'before' WHEN b IS NOT NULL THEN 'after' END AS place FROM (SELECT f.doc_id, f.page_id, f.ordinal, arg_min({'line': l.ordinal, 'bf': f.x < 150}, (abs(f.y - l.y), l.ordinal)) FILTER (l.ordinal IS NOT NULL) AS b
 FROM g_field f LEFT JOIN g_line l ON f.doc_id = l.doc_id AND f.page_id = l.page_id AND abs(f.y - l.y) <= 9 GROUP BY f.doc_id, f.page_id, f.ordinal)""")
def j23(s, d):
    return m.beside_line(v.g_field(s, d), v.g_line(s, d).withColumn("x", F.lit(150.0)))


@register("j29_field_by_rectangle", 'SELECT a.doc_id, a.page_id, a.ordinal, min(b.ordinal) AS "class", count(*) AS n FROM g_field a JOIN g_field b ON a.doc_id = b.doc_id AND a.page_id = b.page_id AND a.x = b.x AND a.y = b.y AND a.width = b.width AND a.height = b.height GROUP BY a.doc_id, a.page_id, a.ordinal')
def j29(s, d):
    return m.by_rectangle(v.g_field(s, d))


@register("j13_column_headers")
def j13(s, d):
    f = v.g_field(s, d)
    first = F.min("y").over(Window.partitionBy(*PAGE))
    row = f.withColumn("top", first).where("y - top <= 8").drop("top")
    return m.column_headers(row.withColumn("y", F.col("y") + 24), v.g_text(s, d))


@register("j08_left_labels")
def j08(s, d):
    return m.left_label(l.bordered_tables(v.g_rect(s, d)), _texts_on_rects(s, d).withColumn("x", F.col("x") - 90))


@register("j21_image_resources")
def j21(s, d):
    i = v.g_image(s, d)
    return m.image_resources(i.select(*KEY, "name", "width", "height"), i.where("ordinal % 3 <> 0").select(*KEY, F.concat(F.lit("X"), "name").alias("name"), "width", "height"))


@register("g10_field_tables")
def g10(s, d):
    f = v.g_field(s, d)
    return m.field_tables(f, l.field_rows(f))


@register("g13_merged_cells")
def g13(s, d):
    return m.merged_cells(l.grids(v.g_rect(s, d)))


@register("g32_reading_order")
def g32(s, d):
    return m.reading_order(v.g_text(s, d))


@register("g29_column_paragraphs", """SELECT doc_id, page_id, ordinal, sum(CASE WHEN ordinal % 2 = pc AND y - py < 2 * 34 THEN 0 WHEN py IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_id, ordinal % 2 ORDER BY y, ordinal)::BIGINT AS paragraph FROM (
 SELECT *, lag(y) OVER w AS py, lag(ordinal % 2) OVER w AS pc FROM g_line WINDOW w AS (PARTITION BY doc_id, page_id, ordinal % 2 ORDER BY y, ordinal))""")
def g29(s, d):
    line = v.g_line(s, d).withColumn("col", F.col("ordinal") % 2)
    w = Window.partitionBy(*PAGE, "col").orderBy("y", "ordinal")
    line = line.withColumn("py", F.lag("y").over(w))
    return shapes.chain_groups(line, [*PAGE, "col"], ["y", "ordinal"], F.col("y") - F.col("py") >= 2 * 34, "paragraph").select(*KEY, "paragraph")


@register("w24_node_tree", """SELECT doc_id, page_id, ordinal, role, depth FROM tree WHERE role IN ('LI', 'P')""", """n AS (SELECT *, CASE WHEN ordinal = 0 THEN NULL ELSE (ordinal - 1) // 3 END AS parent FROM g_node), tree AS (
 SELECT doc_id, page_id, ordinal, role, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.page_id, n.ordinal, n.role, t.depth + 1 FROM tree t JOIN n ON n.doc_id = t.doc_id AND n.page_id = t.page_id AND n.parent = t.ordinal WHERE t.depth < 10)""", recursive=True)
def w24(s, d):
    nodes = v.g_node(s, d).withColumn("parent", F.when(F.col("ordinal") > 0, F.floor((F.col("ordinal") - 1) / 3).cast("long")))
    return e.walk_tree(nodes, 10).where(F.col("role").isin("LI", "P")).select(*KEY, "role", "depth")


# ---- content streams


def _streams(s, d):
    """A content stream for each page, with its lines as strings."""
    line = v.g_line(s, d).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.lit(72.0).alias("x"), (F.lit(792.0) - F.col("y")).alias("y"), F.col("font_size").alias("size"), "text"))).alias("r"))
    return line.select(*PAGE, content.stream_of(F.col("r")).alias("text"))


@register("x07_lex", "SELECT doc_id, page_id, 'operator' AS type, 5 * count(*) AS n FROM g_line GROUP BY doc_id, page_id UNION ALL SELECT doc_id, page_id, 'number', 7 * count(*) FROM g_line GROUP BY doc_id, page_id UNION ALL SELECT doc_id, page_id, 'name', count(*) FROM g_line GROUP BY doc_id, page_id UNION ALL SELECT doc_id, page_id, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'hex' ELSE 'string' END, count(*) FROM g_line GROUP BY ALL")
def x07(s, d):
    t_ = content.lex(_streams(s, d).withColumn("content", F.encode("text", "ISO-8859-1")), PAGE)
    return t_.groupBy(*PAGE, "type").agg(F.count(F.lit(1)).alias("n"))


@register("x08_parse", "SELECT doc_id, page_id, unnest(['BT', 'Tf', 'Tm', 'Tj', 'ET']) AS operator, n FROM (SELECT doc_id, page_id, count(*) AS n FROM g_line GROUP BY doc_id, page_id)")
def x08(s, d):
    o = content.parse(_streams(s, d).withColumn("content", F.encode("text", "ISO-8859-1")), PAGE)
    return o.groupBy(*PAGE, "operator").agg(F.count(F.lit(1)).alias("n"))


@register("x09_text_runs", "SELECT doc_id, page_id, ordinal, text, 72.0::DOUBLE AS x, round(792 - y, 6) AS y, font_size AS size FROM g_line")
def x09(s, d):
    r = content.runs(_streams(s, d).withColumn("content", F.encode("text", "ISO-8859-1")), PAGE)
    return r.select(*KEY, "text", "x", F.round("y", 6).alias("y"), "size")


def _texts(pages: DataFrame) -> DataFrame:
    """Texts that the streams of a column ``new`` show."""
    return content.runs(pages.withColumn("content", F.encode("new", "ISO-8859-1")), PAGE).select(*KEY, "text")


@register("x04_replace_in_page", """SELECT l.doc_id, l.page_id, l.ordinal, CASE WHEN l.ordinal = o THEN regexp_replace(text, 'that', 'THAT') ELSE text END AS text FROM g_line l JOIN (
 SELECT doc_id, page_id, coalesce(min(ordinal) FILTER (NOT regexp_matches(text, '[^\\x00-\\x7F]')), min(ordinal)) AS o FROM g_line WHERE contains(text, 'that') GROUP BY doc_id, page_id) h ON h.doc_id = l.doc_id AND h.page_id = l.page_id""")
def x04(s, d):
    return _texts(_streams(s, d).withColumn("new", content.replace_text(F.col("text"), "that", "THAT")).where("new is not null"))


@register("x06_blank_text", "SELECT doc_id, page_id, ordinal, replace(text, 'that', '    ') AS text FROM g_line")
def x06(s, d):
    return _texts(_streams(s, d).withColumn("new", content.blank_text(F.col("text"), "that")))


@register("r16_words", "SELECT doc_id, ln, count(*) AS n, sum(length(text))::BIGINT AS chars FROM g_word WHERE trim(text) <> '' GROUP BY doc_id, ln")
def r16(s, d):
    return v.g_text(s, d).groupBy("doc_id", "ln").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@register("n03_image_placement", "SELECT ordinal, sqrt(width * width + 9) AS display, round(p_w / sqrt(width * width + 9) * 72, 6) AS dpi FROM (SELECT ordinal, width, width * 2 AS p_w FROM g_image)")
def n03(s, d):
    size = F.hypot(F.col("width"), F.lit(3.0))
    return v.g_image(s, d).select("ordinal", size.alias("display"), F.round(F.col("width") * 2 / size * 72, 6).alias("dpi"))


@register("n07_units", "SELECT doc_id, page_id, ordinal, floor(x * 20 + 0.5)::BIGINT AS twips, floor(x * 12700 + 0.5)::BIGINT AS emu FROM g_text")
def n07(s, d):
    return v.g_text(s, d).select(*KEY, g.twips("x").alias("twips"), g.emu("x").alias("emu"))


@register("w05_text_in_region", "SELECT doc_id, page_id, ordinal FROM g_text WHERE x <= 300 AND x + width >= 100 AND y <= 200 AND y + height >= 120")
def w05(s, d):
    return v.g_text(s, d).where("x <= 300 and x + width >= 100 and y <= 200 and y + height >= 120").select(*KEY)


@register("u08_union_fonts", "SELECT doc_id, list_sort(list_distinct(list_append(list('F' || font_size::INT), 'Calibri'))) AS fonts FROM g_text GROUP BY doc_id")
def u08(s, d):
    return v.g_text(s, d).groupBy("doc_id").agg(F.array_sort(F.array_union(F.collect_set(F.concat(F.lit("F"), F.round("font_size").cast("int").cast("string"))), F.array(F.lit("Calibri")))).alias("fonts"))


@register("j27_new_files", "SELECT DISTINCT uri FROM g_link WHERE uri NOT IN (SELECT uri FROM g_link WHERE page_id % 2 = 0)")
def j27(s, d):
    links = v.g_link(s, d)
    return links.select("uri").join(links.where("page_id % 2 = 0").select("uri"), "uri", "left_anti").distinct()


@register("f17_crc32")
def f17(s, d):
    return v.g_image(s, d).select("ordinal", F.crc32("content").alias("crc"), F.base64(F.encode("content", "UTF-8")).alias("base64"))
