"""Page elements derived from the plain tables by closed formulas.

The tables hold no positions, so lines, words, boxes, fields, images, edits, links and
structure nodes are computed from them, the same in Spark and in SQL (``SQL``).
All have the keys doc_id, page_id and ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces of a visual line.
WRAP = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _visual_lines(text: Column) -> Column:
    """A text's lines, laid out over visual lines of at most twelve blank-separated pieces. Every piece is kept."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.split(x, " "))
    starts = lambda p: F.sequence(F.lit(0), F.floor((F.size(p) - 1) / WRAP).cast("int"))
    return F.flatten(F.transform(lines, lambda p: F.transform(starts(p), lambda i: F.array_join(F.slice(p, i * WRAP + 1, F.lit(WRAP)), " "))))


def g_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual lines of documents, forty to a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(_visual_lines(F.col("text"))).alias("ln", "text"))
    k = F.col("ln") % 40
    return d.select(
        "doc_id", F.floor(F.col("ln") / 40).cast("long").alias("page_id"), k.cast("long").alias("ordinal"), F.col("ln").cast("long").alias("ln"), "text",
        (F.lit(72.0) + k * 14 + F.floor(k / 5) * 20).cast("double").alias("y"),
        F.when(k == 0, 18.0).when(F.col("ln") % 13 == 0, 15.0).when(F.col("ln") % 17 == 0, 13.5).otherwise(12.0).alias("font_size"),
        (F.col("ln") % 17 == 0).alias("bold"),
    )


def g_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their visual lines as an array (ordinal, ln, text). Documents are shuffled, once, before their text is taken apart."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null").repartition("doc_id").select("doc_id", _visual_lines(F.col("text")).alias("v"))
    d = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 40).cast("int")), lambda i: F.slice("v", i * 40 + 1, F.lit(40)))).alias("page_id", "v"))
    line = lambda text, i: F.struct(i.cast("long").alias("ordinal"), (F.col("page_id") * 40 + i).cast("long").alias("ln"), text.alias("text"))
    d = d.select("doc_id", F.col("page_id").cast("long").alias("page_id"), F.transform("v", line).alias("lines"))
    return d.groupBy("doc_id", "page_id").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))


def g_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of visual lines, without blanks. No shuffle: a word's place follows from the line before it."""
    line = g_line(spark, sf_dir).withColumnRenamed("text", "line").withColumnRenamed("ordinal", "k")
    word = line.select("doc_id", "page_id", "ln", "k", "y", "font_size", "bold", "line", F.posexplode(F.split("line", " ")).alias("w", "text")).where("text <> ''")
    before = F.expr("substring_index(line, ' ', w)")
    # each word before takes its length and two more; runs of blanks leave empty pieces, which take nothing
    empty = F.when(F.concat(F.lit(" "), before).contains("  "), F.col("w") - F.regexp_count(before, F.lit("[^ ]+"))).otherwise(0)
    taken = F.when(F.col("w") > 0, F.length(before) + 1 + F.col("w") - 2 * empty).otherwise(0)
    return word.select(
        "doc_id", "page_id", (F.col("k") * WRAP + F.col("w")).cast("long").alias("ordinal"), "ln", "text",
        (F.lit(72.0) + F.floor(F.col("w") / 6) * 60 + taken * F.col("font_size") / 2).alias("x"), (F.col("y") + F.col("w") % 3).alias("y"),
        (F.length("text") * F.col("font_size") / 2).alias("width"), F.col("font_size").alias("height"), "font_size", "bold",
        F.element_at(F.array(F.lit("000000"), F.lit("ff0000"), F.lit("0000ff")), (F.pmod(F.col("doc_id") + F.col("ln"), F.lit(3)) + 1).cast("int")).alias("color"),
    )


def g_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    # line numbers repeat within an order, so an ordinal is counted from all that a box depends on
    own = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", *own)
    r = r.withColumn("ordinal", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*own)).cast("long"))
    m = F.col("l_partkey") % 10
    return r.select(
        F.lit(0).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page_id"), "ordinal",
        (F.lit(50.0) + F.col("l_partkey") % 4 * 70).alias("x"), (F.lit(100.0) + F.col("l_linenumber") * 24).alias("y"),
        F.when(m == 0, 600.0).when(m == 1, 400.0).otherwise(F.lit(60.0) + F.col("l_suppkey") % 5 * 10).alias("width"),
        F.when(m == 0, 780.0).when(m == 1, 1.0).otherwise(20.0).alias("height"),
        F.when(F.col("l_returnflag") != "N", F.lower("l_returnflag")).alias("stroke"),
        F.when(F.col("l_linestatus") != "O", (F.col("l_suppkey") % 3).cast("string")).alias("fill"), F.lit(1.0).alias("line_width"),
    )


def g_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sixty fields to a page, whatever the table's size
    k = F.col("c_custkey")
    page = F.floor(k / 60 % 5).cast("long")
    kind = F.create_map(*[F.lit(v) for p in {"AUTOMOBILE": "Tx", "BUILDING": "Btn", "FURNITURE": "Ch", "HOUSEHOLD": "Tx", "MACHINERY": "Push"}.items() for v in p])
    return table(spark, sf_dir, "customer").select(
        F.floor(k / 300).cast("long").alias("doc_id"), page.alias("page_id"), k.alias("ordinal"),
        F.concat(F.lit("form[0].page["), page.cast("string"), F.lit("]."), F.lower("c_mktsegment"), F.lit("["), (k % 7).cast("string"), F.lit("]")).alias("name"),
        kind[F.col("c_mktsegment")].alias("type"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("value"),
        (k % 2 == 0).alias("required"), (k % 15 + 10).alias("max_length"),
        (F.lit(60.0) + k % 3 * 160).alias("x"), (F.lit(90.0) + F.floor(k / 3) % 16 * 40 + k % 4).cast("double").alias("y"), F.lit(120.0).alias("width"), F.lit(18.0).alias("height"),
    )


def g_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 20).cast("long").alias("doc_id"), (k % 4).alias("page_id"), k.alias("ordinal"), F.concat(F.lit("Im"), (k % 5).cast("string")).alias("name"),
        (F.col("p_size") * 4).cast("double").alias("width"), (F.col("p_size") * 5).cast("double").alias("height"),
        F.element_at(F.array(F.lit("FlateDecode"), F.lit("DCTDecode"), F.lit("CCITTFaxDecode")), (F.length("p_type") % 3 + 1).cast("int")).alias("filter"),
        F.when(F.endswith("p_brand", F.lit("1")), 1).otherwise(8).alias("bits"), F.col("p_name").alias("content"),
    )


def g_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), "event_id", "ts", F.col("event_type").alias("op"), F.get_json_object("props", "$.k").cast("long").alias("item"), "value"
    )


def g_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ordinal", "uri"))
    return p.select(F.lit(0).cast("long").alias("doc_id"), "page_id", F.col("ordinal").cast("long").alias("ordinal"), "uri")


def g_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h1|p|li|nav|ul|article|footer|table|img)[ >]"), 1)).alias("ordinal", "tag"))
    return p.select(F.lit(0).cast("long").alias("doc_id"), "page_id", F.col("ordinal").cast("long").alias("ordinal"), F.upper("tag").alias("role"))


#: Tags without content, and what holds no tags.
VOID = ("br", "meta", "img", "hr", "input", "link")
OPAQUE = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"


def g_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of pages in order: kind is 1 where one opens, -1 where one closes, 0 for one without content."""
    bare = F.regexp_replace("html", OPAQUE, "")
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(bare, F.lit("<(/?[a-z][a-z0-9]*)"), 1)).alias("ordinal", "m"))
    kind = F.when(F.startswith("m", F.lit("/")), -1).when(F.col("m").isin(*VOID), 0).otherwise(1)
    return p.select(F.lit(0).cast("long").alias("doc_id"), "page_id", F.col("ordinal").cast("long").alias("ordinal"), F.upper(F.replace("m", F.lit("/"), F.lit(""))).alias("role"), kind.alias("kind"))


#: The same views for DuckDB, as common table expressions.
SQL = r"""
g_line AS (
  SELECT doc_id, ln // 40 AS page_id, ln % 40 AS ordinal, ln, text, (72 + 14 * (ln % 40) + 20 * ((ln % 40) // 5))::DOUBLE AS y,
    (CASE WHEN ln % 40 = 0 THEN 18 WHEN ln % 13 = 0 THEN 15 WHEN ln % 17 = 0 THEN 13.5 ELSE 12 END)::DOUBLE AS font_size, ln % 17 = 0 AS bold
  FROM (SELECT doc_id, unnest(v) AS text, unnest(range(len(v)))::BIGINT AS ln FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)),
    lambda x: list_transform(range((len(string_split(x, ' ')) + 11) // 12), lambda i: array_to_string(string_split(x, ' ')[i * 12 + 1 : i * 12 + 12], ' ')))) AS v FROM documents))
), g_word AS (
  SELECT doc_id, page_id, ln, ordinal AS k, y, font_size, bold, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' '))))::BIGINT AS w FROM g_line
), g_text AS (
  SELECT doc_id, page_id, k * 12 + w AS ordinal, ln, text,
    72 + 60 * (w // 6) + coalesce(sum((length(text) + 1) * font_size / 2 + font_size / 2) OVER (PARTITION BY doc_id, ln ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x,
    y + w % 3 AS y, length(text) * font_size / 2 AS width, font_size AS height, font_size, bold, ['000000', 'ff0000', '0000ff'][(doc_id + ln) % 3 + 1] AS color
  FROM g_word WHERE trim(text) <> ''
), g_rect AS (
  SELECT 0::BIGINT AS doc_id, l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS ordinal, (50 + 70 * (l_partkey % 4))::DOUBLE AS x, (100 + 24 * l_linenumber)::DOUBLE AS y,
    (CASE l_partkey % 10 WHEN 0 THEN 600 WHEN 1 THEN 400 ELSE 60 + 10 * (l_suppkey % 5) END)::DOUBLE AS width, (CASE l_partkey % 10 WHEN 0 THEN 780 WHEN 1 THEN 1 ELSE 20 END)::DOUBLE AS height,
    CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END AS stroke, CASE WHEN l_linestatus <> 'O' THEN (l_suppkey % 3)::VARCHAR END AS fill, 1.0::DOUBLE AS line_width
  FROM lineitem
), g_field AS (
  SELECT c_custkey // 300 AS doc_id, c_custkey // 60 % 5 AS page_id, c_custkey AS ordinal,
    'form[0].page[' || (c_custkey // 60 % 5) || '].' || lower(c_mktsegment) || '[' || (c_custkey % 7) || ']' AS name,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Btn' WHEN 'FURNITURE' THEN 'Ch' WHEN 'MACHINERY' THEN 'Push' ELSE 'Tx' END AS type,
    CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS value, c_custkey % 2 = 0 AS required, c_custkey % 15 + 10 AS max_length,
    (60 + 160 * (c_custkey % 3))::DOUBLE AS x, (90 + 40 * (c_custkey // 3 % 16) + c_custkey % 4)::DOUBLE AS y, 120.0::DOUBLE AS width, 18.0::DOUBLE AS height
  FROM customer
), g_image AS (
  SELECT p_partkey // 20 AS doc_id, p_partkey % 4 AS page_id, p_partkey AS ordinal, 'Im' || (p_partkey % 5) AS name, (p_size * 4)::DOUBLE AS width, (p_size * 5)::DOUBLE AS height,
    ['FlateDecode', 'DCTDecode', 'CCITTFaxDecode'][length(p_type) % 3 + 1] AS filter, CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 8 END AS bits, p_name AS content
  FROM part
), g_edit AS (
  SELECT user_id AS doc_id, event_id, ts, event_type AS op, (props->>'$.k')::BIGINT AS item, value FROM events
), g_link AS (
  SELECT 0::BIGINT AS doc_id, page_id, unnest(range(len(u)))::BIGINT AS ordinal, unnest(u) AS uri FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages)
), g_node AS (
  SELECT 0::BIGINT AS doc_id, page_id, unnest(range(len(u)))::BIGINT AS ordinal, upper(unnest(u)) AS role FROM (SELECT page_id, regexp_extract_all(html, '<(h1|p|li|nav|ul|article|footer|table|img)[ >]', 1) AS u FROM pages)
)
"""
