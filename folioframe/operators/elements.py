"""Classifiers, forms, search, metrics, page algebra and edit logs over element tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import geometry as g
from folioframe.functions import text as t

PAGE = ["doc_id", "page_id"]


# ---- classifiers


def rect_role(page_width: float = 612.0, page_height: float = 792.0) -> Column:
    w, h = F.abs("width"), F.abs("height")
    return (
        F.when(w * h > 0.9 * page_width * page_height, "page-background")
        .when(((h < 2) | (w < 2)) & ((w > 0.5 * page_width) | (h > 0.5 * page_height)), "separator")
        .when(F.col("stroke").isNotNull() & (F.col("line_width") > 0), "table-border")
        .when(F.col("fill").isNotNull() & F.col("stroke").isNull(), "cell-fill")
        .otherwise("decorative")
    )


def genuine_image() -> Column:
    area = F.col("width") * F.col("height")
    return (F.col("filter") == "DCTDecode") | F.when(area < 16, False).when((F.col("bits") == 1) & (area < 5000), False).otherwise(area > 10000)


def heading_level_of_role(role) -> Column:
    """Level 1 to 6 of roles like H2, null for others."""
    return F.nullif(F.regexp_extract(g.c(role), "^[Hh]([1-6])$", 1), F.lit("")).cast("int")


def filled() -> Column:
    return F.when(F.col("type") == "Btn", ~F.coalesce(F.col("value"), F.lit("")).isin("", "Off", "false")).otherwise(F.trim(F.coalesce("value", F.lit(""))) != "")


def empty_required(fields: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("(unnamed "), F.col("ordinal").cast("string"), F.lit(")")))
    return fields.where((F.col("type") != "Push") & F.col("required") & ~filled()).select(*PAGE, "ordinal", name.alias("field"))


def validate(fields: DataFrame) -> DataFrame:
    """One row for each error: required but empty, too long."""
    errors = F.array_compact(F.array(F.when(F.col("required") & (F.trim("value") == ""), "required"), F.when((F.col("type") == "Tx") & (F.length("value") > F.col("max_length")), "too_long")))
    return fields.select(*PAGE, "ordinal", F.explode(errors).alias("error"))


def form_stats(fields: DataFrame) -> DataFrame:
    f = fields.where("type <> 'Push'").withColumn("f", filled())
    out = f.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("f").alias("filled"), F.count_if("required").alias("required"), F.count_if(F.col("required") & F.col("f")).alias("required_filled")
    )
    return out.withColumn("percent", g.round_half_up(F.col("filled") * 100 / F.col("total")).cast("long"))


def annotation_label(kind: Column, content: Column, n_paths: Column, shape: Column) -> Column:
    """What a list of annotations shows for one."""
    strokes = F.concat(F.lit("Drawing ("), n_paths.cast("string"), F.when(n_paths == 1, " stroke)").otherwise(" strokes)"))
    start = F.nullif(F.left(content, F.lit(30)), F.lit(""))
    named = F.concat(F.upper(F.left(shape, F.lit(1))), F.substring(shape, F.lit(2), F.length(shape)))
    return (
        F.when(kind == "text", F.coalesce(start, F.lit("Text"))).when(kind == "image", "Image").when(kind == "highlight", "Highlight").when(kind == "drawing", strokes)
        .when(kind == "shape", named).when(kind == "note", F.coalesce(start, F.lit("Empty note"))).when(kind == "stamp", content).otherwise("Annotation")
    )


# ---- search


def search(texts: DataFrame, query: str, regex: bool = False, column: str = "text") -> DataFrame:
    """Rows whose text holds the query, whatever the case; a bad pattern is taken literally."""
    if not query.strip():
        return texts.limit(0)
    if regex:
        try:
            re.compile(query)
            return texts.where(F.col(column).rlike("(?i)" + query))
        except re.error:
            pass
    return texts.where(F.contains(F.lower(column), F.lit(query.lower())))


def whole_word(query: str, case: bool = False) -> str:
    return ("" if case else "(?i)") + r"(?:^|[^A-Za-z0-9_])" + re.escape(query) + r"(?:$|[^A-Za-z0-9_])"


def replace_all(texts: DataFrame, query: str, new: str, column: str = "text") -> DataFrame:
    """Changed rows with the number of replacements."""
    pattern = "(?i)" + re.escape(query)
    hit = texts.where(F.contains(F.lower(column), F.lit(query.lower())))
    return hit.withColumn("n", F.regexp_count(column, F.lit(pattern)).cast("long")).withColumn(column, F.regexp_replace(column, pattern, new.replace("\\", r"\\").replace("$", r"\$")))


# ---- metrics


def source_metrics(texts: DataFrame) -> DataFrame:
    n = F.length("text")
    return texts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(n).alias("n_chars"), F.count_distinct(F.upper("color")).alias("n_colors"),
        F.min("font_size").alias("min_size"), F.max("font_size").alias("max_size"), F.count_distinct("font_size").alias("n_sizes"),
        F.round(F.sum(n * F.col("font_size")) / F.sum(n), 6).alias("avg_size"), F.count_distinct("page_id").alias("n_pages"),
    )


AXES = {"text": 0.3, "color": 0.1, "structure": 0.2, "typography": 0.15, "spatial": 0.15, "images": 0.1}


def quality_scores(m: DataFrame) -> DataFrame:
    """Axis scores from 0 to 100 (null: nothing to judge) and their weighted mean.

    m: doc_id, source_chars, output_chars, source_colors, output_colors, detected_tables,
    output_tables, source_size, output_size, source_margin, output_margin, source_images, output_images.
    """
    ratio = lambda a, b: F.least(F.lit(100.0), g.round_half_up(100 * F.col(a) / F.col(b)).cast("double"))
    closeness = lambda a, b: F.greatest(F.lit(0.0), g.round_half_up(100 * (1 - F.abs(F.col(a) - F.col(b)) / F.col(b))).cast("double"))
    out = m.select(
        "doc_id",
        F.when(F.col("source_chars") > 0, ratio("output_chars", "source_chars")).otherwise(100.0).alias("text"),
        F.when(F.col("source_colors") > 0, ratio("output_colors", "source_colors")).otherwise(100.0).alias("color"),
        F.when(F.col("detected_tables") > 0, ratio("output_tables", "detected_tables")).alias("structure"),
        F.when(F.col("source_size") > 0, closeness("output_size", "source_size")).alias("typography"),
        F.when(F.col("source_margin") > 0, closeness("output_margin", "source_margin")).alias("spatial"),
        F.when(F.col("source_images") > 0, ratio("output_images", "source_images")).alias("images"),
    )
    total = sum((F.when(F.col(a).isNotNull(), F.col(a) * w).otherwise(0.0) for a, w in AXES.items()), F.lit(0.0))
    weight = sum((F.when(F.col(a).isNotNull(), F.lit(w)).otherwise(0.0) for a, w in AXES.items()), F.lit(0.0))
    return out.withColumn("composite", g.round_half_up(F.round(total / weight, 6)).cast("double"))


def axis_averages(scores: DataFrame) -> DataFrame:
    """Mean of each axis over documents (0 if there is none) and whether it is the weakest."""
    avg = scores.agg(*[F.coalesce(F.round(F.avg(a), 6), F.lit(0.0)).alias(a) for a in AXES])
    rows = avg.select(F.posexplode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("score")) for a in AXES])).alias("pos", "s")).select("pos", "s.axis", "s.score")
    first = F.min(F.struct("score", "pos")).over(Window.partitionBy())["pos"]
    return rows.select("axis", "score", (F.col("pos") == first).alias("weakest"))


def content_bounds(texts: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Box of the content of each page and its margins, from 36 to 108 points."""
    b = texts.groupBy(*PAGE).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))
    keep = lambda v: g.clamp(v, F.lit(36.0), F.lit(108.0))
    return b.select("*", keep(F.col("x0")).alias("left"), keep(F.col("y0")).alias("top"), keep(page_width - F.col("x1")).alias("right"), keep(page_height - F.col("y1")).alias("bottom"))


def median_border(rects: DataFrame) -> DataFrame:
    borders = rects.where(rect_role() == "table-border")
    return borders.groupBy(*PAGE).agg(g.upper_median(F.collect_list("width")).alias("width"), g.upper_median(F.collect_list("stroke")).alias("stroke"), F.count(F.lit(1)).alias("n"))


def normal_style(texts: DataFrame) -> DataFrame:
    """Most used style of each document; ties go to the first seen."""
    key = ["font_size", "bold", "color"]
    used = texts.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "ordinal")).alias("first"))
    best = F.min_by(F.struct(*key, "n"), F.struct(-F.col("n"), "first")).alias("s")
    return used.groupBy("doc_id").agg(best).select("doc_id", *[f"s.{k}" for k in key], "s.n")


def styles(texts: DataFrame) -> DataFrame:
    """Styles of each document with ids from 1 in the order of first use."""
    key = ["font_size", "bold", "color"]
    used = texts.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "ordinal")).alias("first"))
    return used.select("doc_id", *key, "n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("long").alias("style_id"))


def image_duplicates(images: DataFrame) -> DataFrame:
    """Images by page and name once, then numbered by content: equal contents share the first one's ordinal."""
    once = images.groupBy("doc_id", "page_id", "name").agg(F.min_by(F.struct("ordinal", "content"), "ordinal").alias("i")).select("doc_id", "page_id", "name", "i.*")
    of = Window.partitionBy("doc_id", F.sha2("content", 256), "content")
    return once.select("doc_id", "page_id", "name", "ordinal", F.min("ordinal").over(of).alias("stored_as"), t.fnv1a("content").alias("hash"))


def link_ids(links: DataFrame) -> DataFrame:
    """Distinct targets of a page with ids from 1 in the order of first use."""
    first = links.groupBy(*PAGE, "uri").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
    return first.select(*PAGE, "uri", "n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("first")).cast("long").alias("rel_id"))


# ---- pages


def renumber(pages: DataFrame, keys: list[str], order: list) -> DataFrame:
    return pages.withColumn("page_id", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def merge(pages: DataFrame, into: Column) -> DataFrame:
    """Ordered union: pages of documents with equal ``into`` become one document."""
    m = pages.withColumn("merged_id", into)
    return m.select("merged_id", "doc_id", F.col("page_id").alias("from_page"), (F.row_number().over(Window.partitionBy("merged_id").orderBy("doc_id", "page_id")) - 1).cast("long").alias("page_id"))


def extract(pages: DataFrame, ranges: str) -> DataFrame:
    """Pages in 1-based ranges, numbered anew."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    hit = pages.withColumn("__n", n).where(F.array_contains(t.page_numbers(F.lit(ranges), F.col("__n").cast("int")), (F.col("page_id") + 1).cast("int"))).drop("__n")
    return renumber(hit.withColumn("from_page", F.col("page_id")), ["doc_id"], ["from_page"])


def delete_page(pages: DataFrame, page: int) -> DataFrame:
    """Without one page; a document's only page stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    hit = pages.withColumn("__n", n).where((F.col("page_id") != page) | (F.col("__n") == 1)).drop("__n")
    return renumber(hit.withColumn("from_page", F.col("page_id")), ["doc_id"], ["from_page"])


def reorder(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Moves page ``start`` to place ``end``."""
    p = F.col("page_id")
    key = F.when(p == start, F.lit(end + (0.5 if end > start else -0.5))).otherwise(p.cast("double"))
    return renumber(pages.withColumn("from_page", p).withColumn("__k", key), ["doc_id"], ["__k"]).drop("__k")


def insert_blank(pages: DataFrame, after: int) -> DataFrame:
    blank = pages.where(F.col("page_id") == after).select("doc_id", F.lit(after + 0.5).alias("__k"), F.lit(None).cast("long").alias("from_page"))
    own = pages.select("doc_id", F.col("page_id").cast("double").alias("__k"), F.col("page_id").alias("from_page"))
    return renumber(own.unionByName(blank), ["doc_id"], ["__k"]).drop("__k")


def rotate(pages: DataFrame, angle: int, column: str = "rotation") -> DataFrame:
    return pages.withColumn(column, F.pmod(F.col(column) + angle, F.lit(360)))


def walk_tree(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes with their depth from the roots of their page, down to ``most`` levels.

    Nodes on cycles, below them or below a parent that isn't there are not met.
    """
    from .trees import rooted

    r = rooted(nodes, PAGE, "ordinal", "parent", paths=False).where("not cyclic")
    stray = r.where("depth = 0 and parent is not null").select(*PAGE, F.col("ordinal").alias("root"))
    r = r.join(stray, [*PAGE, "root"], "left_anti").select(*nodes.columns, "depth")
    return r if most is None else r.where(F.col("depth") <= most)


# ---- edit logs


def undo_log(edits: DataFrame, undo: str = "error", redo: str = "view") -> DataFrame:
    """Length and cursor of each document's history: an edit drops what was undone and appends; undo and redo move the cursor.

    A fold that streams over each document's sorted log and holds two numbers, however long the log is.
    """
    kind = F.when(F.col("op") == undo, -1).when(F.col("op") == redo, 1).otherwise(0).alias("kind")
    rows = edits.select("doc_id", "ts", "event_id", kind).repartition("doc_id").sortWithinPartitions("doc_id", "ts", "event_id").select("doc_id", "kind")

    def run(batches):
        import pyarrow as pa

        doc, seen, n, at = None, False, 0, 0
        for b in batches:
            out = []
            for d, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not seen or d != doc:
                    if seen:
                        out.append((doc, n, at))
                    doc, seen, n, at = d, True, 0, 0
                if k < 0:
                    at = max(at - 1, 0)
                elif k > 0:
                    at = min(at + 1, n)
                else:
                    n = at = at + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["doc_id", "history", "cursor"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (doc, n, at)], names=["doc_id", "history", "cursor"])

    return rows.mapInArrow(run, "doc_id long, history long, cursor long")


def coalesced(edits: DataFrame) -> DataFrame:
    """One row for each item: the first original value and the last new one."""
    at = F.struct("ts", "event_id")
    return edits.groupBy("doc_id", "item").agg(F.min_by("value", at).alias("original"), F.max_by("value", at).alias("latest"), F.count(F.lit(1)).alias("n"))


def debounced(edits: DataFrame, gap_seconds: int) -> DataFrame:
    """Last edit of each run of edits that follow one another within the gap."""
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    after = F.lead("ts").over(w)
    return edits.withColumn("__after", after).where(F.col("__after").isNull() | (F.unix_micros(F.col("__after").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > gap_seconds * 1_000_000)).drop("__after")
