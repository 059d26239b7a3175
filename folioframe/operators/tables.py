"""Bordered tables as a whole: merged cells and what stands in each of them.

Everything about a table's grid is a function of its row (bounds and border boxes), so
spans, origins and places of points are array expressions without a shuffle. Texts, fields and
fills meet the tables of their page in one row; each of them is settled once, in the first table and by the first rule that claims it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout

PAGE = ["doc_id", "page_id"]
#: Points that an edge may be off its bound: when points are placed, and after narrow cells have been merged away.
EDGE, SPAN = 2.0, 12.0
#: How far left of a table labels are taken in, and how far above and below it headers and footers; what a label adds to the column.
LABEL, HEADER, PAD = 120.0, 20.0, 4.0

INSIDE, LEFT, ABOVE, BELOW = range(4)


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _let(value: Column, f) -> Column:
    """f(value) with the value made once: named columns are copied into each place that reads them, also within loops."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _at(a: str | Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def tables(rects: DataFrame) -> DataFrame:
    """(component, cols, rows, boxes, origins) of border groups that are tables.

    ``origins`` are the cells (row, col, row_span, col_span) that remain after merging, in row order:
    a cell grows right, then down, while no border runs along the whole segment within ``SPAN`` points;
    a cell that an earlier one covers is none. At least half the cells of the grid have a border on them.
    """
    t = layout.grids(rects).withColumn("n", F.size("rows") - 1).withColumn("m", F.size("cols") - 1)

    def cell(test) -> Column:
        return F.transform(_upto(F.col("n")), lambda r: F.transform(_upto(F.col("m")), lambda c: test(r, c)))

    def ends(c: Column, r: Column) -> tuple[Column, ...]:
        return _at("cols", c), _at("cols", c + 1), _at("rows", r), _at("rows", r + 1)

    def backed(r: Column, c: Column) -> Column:
        x0, x1, y0, y1 = ends(c, r)
        return F.exists("boxes", lambda b: (b["x"] < x1 + EDGE) & (b["x"] + b["width"] > x0 - EDGE) & (b["y"] < y1 + EDGE) & (b["y"] + b["height"] > y0 - EDGE))

    def along(at: str, size: str, line: Column, across: str, length: str, start: Column, end: Column) -> Column:
        near = lambda v: F.abs(v - line) <= SPAN
        return F.exists("boxes", lambda b: (near(b[at]) | near(b[at] + b[size])) & (b[across] <= start + SPAN) & (b[across] + b[length] >= end - SPAN))

    def right(r: Column, c: Column) -> Column:
        _, x1, y0, y1 = ends(c, r)
        return (c == F.col("m") - 1) | along("x", "width", x1, "y", "height", y0, y1)

    def below(r: Column, c: Column) -> Column:
        x0, x1, _, y1 = ends(c, r)
        return (r == F.col("n") - 1) | along("y", "height", y1, "x", "width", x0, x1)

    def across(rights: Column, r: Column, c: Column) -> Column:
        return F.array_min(F.filter(F.sequence(c, F.col("m") - 1), lambda k: _at(_at(rights, r), k))) - c + 1

    def down(belows: Column, r: Column, c: Column, wide: Column) -> Column:
        return F.array_min(F.filter(F.sequence(r, F.col("n") - 1), lambda k: F.exists(F.slice(_at(belows, k), c + 1, wide), lambda x: x))) - r + 1

    def sized(rights: Column, belows: Column) -> Column:
        own = lambda r, c: _let(across(rights, r, c), lambda w: F.struct(r.alias("row"), c.alias("col"), down(belows, r, c, w).alias("row_span"), w.alias("col_span")))
        return F.flatten(cell(own))

    t = t.withColumn("backed", F.size(F.filter(F.flatten(cell(backed)), lambda x: x))).where(F.col("backed") >= 0.5 * F.col("n") * F.col("m"))
    none = F.expr("cast(array() as array<struct<row:int,col:int,row_span:int,col_span:int>>)")
    covers = lambda o, x: (o["row"] <= x["row"]) & (x["row"] < o["row"] + o["row_span"]) & (o["col"] <= x["col"]) & (x["col"] < o["col"] + o["col_span"])
    kept = lambda cells: F.aggregate(cells, none, lambda acc, x: F.when(F.exists(acc, lambda o: covers(o, x)), acc).otherwise(F.concat(acc, F.array(x))))
    origins = kept(_let(cell(right), lambda rights: _let(cell(below), lambda belows: sized(rights, belows))))
    return t.select(*PAGE, "component", "cols", "rows", "boxes", origins.alias("origins"))


def _band(bounds: Column, v: Column) -> Column:
    """Place of the first interval between bounds that holds v, ``EDGE`` more on both sides; null without one."""
    hits = F.filter(_upto(F.size(bounds) - 1), lambda i: (v >= _at(bounds, i) - EDGE) & (v <= _at(bounds, i + 1) + EDGE))
    return F.get(hits, F.lit(0))


def _origin(grid: Column, row: Column, col: Column) -> Column:
    """The first remaining cell that covers a place of the grid."""
    return F.get(F.filter(grid["origins"], lambda o: (o["row"] <= row) & (row < o["row"] + o["row_span"]) & (o["col"] <= col) & (col < o["col"] + o["col_span"])), F.lit(0))


def _spot(p: Column, grid: Column, f) -> Column:
    """f(row, col) of the place of the grid where a point's centre is."""
    return _let(_band(grid["rows"], p["y"] + p["height"] / 2), lambda r: _let(_band(grid["cols"], p["x"] + p["width"] / 2), lambda c: f(r, c)))


def _by_page(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row for each page with its rows as an array: what follows is array expressions of one row, without windows or joins."""
    return df.groupBy(*PAGE).agg(F.collect_list(F.struct(*columns)).alias(name))


def _with_grids(pages: DataFrame, grids: DataFrame, how: str = "inner") -> DataFrame:
    return pages.join(_by_page(grids, "grids", ["component", "cols", "rows", "origins"]), PAGE, how)


def _home(p: Column, grids: Column) -> Column:
    """(component, cell) of the first of a page's tables that holds a point's centre."""
    own = lambda g: _let(_spot(p, g, lambda r, c: _origin(g, r, c)), lambda cell: F.when(cell.isNotNull(), F.struct(g["component"].alias("component"), cell.alias("cell"))))
    return F.array_min(F.transform(grids, own))


def _placed(points: str, grids: str = "grids") -> Column:
    """The points of a page that a table holds, as (p, at)."""
    return F.filter(F.transform(points, lambda p: F.struct(p.alias("p"), _home(p, F.col(grids)).alias("at"))), lambda x: x["at"].isNotNull())


def placed(points: DataFrame, grids: DataFrame) -> DataFrame:
    """points with the table and cell that holds their centre; the first table where several do. Others are left out."""
    rest = [c for c in points.columns if c not in PAGE]
    p = _with_grids(_by_page(points, "points", rest), grids).select(*PAGE, F.explode(_placed("points")).alias("z"))
    return p.select(*PAGE, *[F.col(f"z.p.{c}").alias(c) for c in rest], F.col("z.at.component").alias("component"), F.col("z.at.cell.row").alias("row"), F.col("z.at.cell.col").alias("col")).select(*points.columns, "component", "row", "col")


def _claims(texts: Column, grids: Column, f) -> Column:
    """f(taken) of an array with (component, cell, way, extension) for each text of a page, null where no table takes it. The rules are those of ``claims``."""
    x0 = lambda g: _at(g["cols"], F.lit(0))
    claim = lambda way, g, cell: F.when(cell.isNotNull(), F.struct(F.lit(way).alias("way"), g["component"].alias("component"), cell.alias("cell")))

    def first(t: Column, g: Column) -> Column:
        label = (t["x"] + t["width"] / 2 < x0(g)) & (t["x"] >= x0(g) - LABEL)
        return _spot(t, g, lambda r, c: F.coalesce(_let(_origin(g, r, c), lambda o: claim(INSIDE, g, o)), F.when(label, _let(_origin(g, r, F.lit(0)), lambda o: claim(LEFT, g, o)))))

    def second(t: Column, g: Column, extension: Column) -> Column:
        cx, bottom = t["x"] + t["width"] / 2, t["y"] + t["height"]
        wide = F.when((cx >= x0(g) - extension) & (cx <= _at(g["cols"], F.lit(1)) + EDGE), F.lit(0))
        above = bottom.between(_at(g["rows"], F.lit(0)) - HEADER, _at(g["rows"], F.lit(0)) + EDGE)
        below = t["y"].between(F.element_at(g["rows"], -1) - EDGE, F.element_at(g["rows"], -1) + HEADER)
        found = lambda c: F.coalesce(F.when(above, _let(_origin(g, F.lit(0), c), lambda o: claim(ABOVE, g, o))), F.when(below, _let(_origin(g, F.size(g["rows"]) - 2, c), lambda o: claim(BELOW, g, o))))
        return F.when(above | below, _let(F.coalesce(_band(g["cols"], cx), wide), found))

    def extension(g: Column, firsts: Column) -> Column:
        return F.array_max(F.zip_with(texts, firsts, lambda t, c: F.when((c["component"] == g["component"]) & (c["way"] == LEFT), x0(g) - t["x"] + PAD)))

    def settled(firsts: Column, extensions: Column) -> Column:
        late = lambda t: F.array_min(F.transform(grids, lambda g, i: second(t, g, F.get(extensions, i))))
        wider = lambda c: F.get(extensions, (F.array_position(F.transform(grids, lambda g: g["component"]), c["component"]) - 1).cast("int"))
        taken = lambda c: F.when(c.isNotNull(), F.struct(c["component"].alias("component"), c["cell"].alias("cell"), c["way"].alias("way"), F.coalesce(wider(c), F.lit(0.0)).alias("extension")))
        return F.zip_with(texts, firsts, lambda t, c: _let(F.when(c.isNotNull(), c).otherwise(late(t)), taken))

    firsts = F.transform(texts, lambda t: F.array_min(F.transform(grids, lambda g: first(t, g))))
    return _let(firsts, lambda a: _let(F.transform(grids, lambda g: extension(g, a)), lambda e: _let(settled(a, e), f)))


def _taken(texts: str, grids: str = "grids") -> Column:
    """The texts of a page that a table takes in, as (p, at)."""
    both = lambda taken: F.filter(F.zip_with(texts, taken, lambda t, c: F.struct(t.alias("p"), c.alias("at"))), lambda x: x["at"].isNotNull())
    return _claims(F.col(texts), F.col(grids), both)


def claims(texts: DataFrame, grids: DataFrame) -> DataFrame:
    """(keys, ordinal, component, row, col, way, extension): each text that a table takes in, once.

    A text belongs to the cell that holds its centre; else as a label to the first cell of its row, where it
    starts up to ``LABEL`` points left of the table and its centre is left of it; else, within ``HEADER``
    points above the table or below, to the cell of its column in the first or last row. A table
    with labels is wider by ``extension``, also for its headers. Of several tables the first one takes a text.
    """
    t = _with_grids(_by_page(texts, "texts", layout.BOX), grids).select(*PAGE, F.explode(_taken("texts")).alias("z"))
    return t.select(*PAGE, F.col("z.p.ordinal").alias("ordinal"), F.col("z.at.component").alias("component"), F.col("z.at.cell.row").alias("row"), F.col("z.at.cell.col").alias("col"), F.col("z.at.way").alias("way"), F.col("z.at.extension").alias("extension"))


def cells(rects: DataFrame, texts: DataFrame, fields: DataFrame, fills: DataFrame) -> DataFrame:
    """One row for each cell of each table, with its box, fill, texts, fields, paddings and vertical alignment.

    A label widens the first column to the left. The last fill whose centre a cell holds colours it.
    Paddings over 2 points count; texts align to the top, centre or bottom where over 6 points are free.
    """
    pages = _by_page(tables(rects), "grids", ["component", "cols", "rows", "origins"])
    for name, df, columns in (("texts", texts, layout.BOX), ("fields", fields, layout.BOX), ("fills", fills, [*layout.BOX, "fill"])):
        pages = pages.join(_by_page(df, name, columns), PAGE, "left")
    pages = pages.select(*PAGE, "grids", _taken("texts").alias("texts"), _placed("fields").alias("fields"), _placed("fills").alias("fills"))

    def cell(g: Column, o: Column) -> Column:
        table = lambda x: x["at"]["component"] == g["component"]
        own = lambda name: F.filter(name, lambda x: table(x) & (x["at"]["cell"]["row"] == o["row"]) & (x["at"]["cell"]["col"] == o["col"]))
        wider = F.when(o["col"] == 0, F.coalesce(F.array_max(F.transform(F.filter("texts", table), lambda x: x["at"]["extension"])), F.lit(0.0))).otherwise(0.0)
        x, y = _at(g["cols"], o["col"]), _at(g["rows"], o["row"])
        return F.struct(
            g["component"].alias("component"), *[o[c].alias(c) for c in ("row", "col", "row_span", "col_span")], x.alias("x"), y.alias("y"), wider.alias("wider"),
            (_at(g["cols"], o["col"] + o["col_span"]) - x).alias("width"), (_at(g["rows"], o["row"] + o["row_span"]) - y).alias("height"),
            own("texts").alias("texts"), own("fields").alias("fields"), own("fills").alias("fills"),
        )

    o = pages.select(*PAGE, F.explode(F.flatten(F.transform("grids", lambda g: F.transform(g["origins"], lambda o: cell(g, o))))).alias("o")).select(*PAGE, "o.*")
    of = lambda name, f: F.transform(name, lambda x: f(x["p"]))
    ordinals = lambda name: F.coalesce(F.array_sort(of(name, lambda p: p["ordinal"])), F.array().cast("array<long>"))
    c = o.select(
        *PAGE, "component", "row", "col", "row_span", "col_span", (F.col("x") - F.col("wider")).alias("x"), "y", (F.col("width") + F.col("wider")).alias("width"), "height",
        F.array_max(of("fills", lambda p: F.struct(p["ordinal"], p["fill"].alias("fill"))))["fill"].alias("fill"), ordinals("texts").alias("texts"), ordinals("fields").alias("fields"),
        F.array_min(of("texts", lambda p: p["x"])).alias("t_x"), F.array_min(of("texts", lambda p: p["y"])).alias("t_y"),
        F.array_max(of("texts", lambda p: p["x"] + p["width"])).alias("t_x1"), F.array_max(of("texts", lambda p: p["y"] + p["height"])).alias("t_y1"),
    )
    pad = lambda v: F.when(v > 2, v)
    top, bottom = F.col("t_y") - F.col("y"), F.col("y") + F.col("height") - F.col("t_y1")
    free = F.col("height") - (F.col("t_y1") - F.col("t_y"))
    ratio = top / F.nullif(top + bottom, F.lit(0.0))
    return c.select(
        *PAGE, "component", "row", "col", "row_span", "col_span", "x", "y", "width", "height", "fill", "texts", "fields",
        pad(F.col("t_x") - F.col("x")).alias("pad_left"), pad(top).alias("pad_top"), pad(F.col("x") + F.col("width") - F.col("t_x1")).alias("pad_right"), pad(bottom).alias("pad_bottom"),
        F.when(free > 6, F.when(ratio < 0.3, "top").when(ratio > 0.7, "bottom").otherwise("center")).alias("align"),
    )


# ---- a page as a whole

#: Parts by the order in which they take elements.
PARTS = ("table", "header", "footer", "paragraph")


def _places(elements: list[tuple], tables: list[tuple]) -> tuple[list, list]:
    """(refs, places) of a page's elements (y, size, rank, ref), given its tables (top, component).

    What no table or margin takes is grouped into lines, from their first y on, and lines into paragraphs; the breaks are those of ``layout.paragraphs``.
    """
    sizes: dict[float, list] = {}
    for y, size, rank, _ in elements:
        if rank == 3 and y is not None:
            own = sizes.setdefault(y, [])
            if size is not None:
                own.append(size)
    lines: list[list] = []  # y, size
    paragraph, number, tops = {}, 0, []
    starts = []
    for y in sorted(sizes):
        if not lines or abs(y - lines[-1][0]) > 3.0:
            lines.append([y, None])
            starts.append([])
        starts[-1].append(y)
        lines[-1][1] = max([*sizes[y], *([] if lines[-1][1] is None else [lines[-1][1]])], default=None)
    for k, (y, size) in enumerate(lines):
        last = lines[k - 1][1] if k else None  # the line before the first is null, so the first starts none
        if size is not None and last is not None:
            low, high = min(size, last), max(size, last)
            number += y - (lines[k - 1][0] + 1.2 * last) > 1.5 * (size + last) / 2 or (high / low > 1.15 if low else high > 0)
        if len(tops) <= number:
            tops.append((y, "paragraph", number))
        for v in starts[k]:
            paragraph[v] = number
    order = {t[1:]: i for i, t in reversed([*enumerate(sorted([*tops, *((top, "table", component) for top, component in tables)]), 1)])}
    refs = [paragraph.get(y) if rank == 3 else ref for y, _, rank, ref in elements]
    return refs, [order.get((PARTS[e[2]], ref)) for e, ref in zip(elements, refs)]


def page_parts(rects: DataFrame, texts: DataFrame, fields: DataFrame, page_height: float = 792.0) -> DataFrame:
    """(keys, kind, ordinal, part, ref, place): each text and field of a page in exactly one part.

    Tables take what they claim; artifacts in the top and bottom 15% of the page go to header and footer; what is left
    is grouped into lines and paragraphs. A page is one row with its elements and tables: claims are array
    expressions of that row, lines and paragraphs one fold over it; nothing is shuffled but the elements, once. ``ref`` is the table's component or
    the paragraph's number; ``place`` the order of tables and paragraphs by y. texts have ``artifact``.
    """
    own = lambda df, kind, artifact: df.select(*PAGE, *layout.BOX, F.lit(kind).alias("kind"), artifact.alias("artifact"))
    elements = own(texts, "text", F.coalesce(F.col("artifact"), F.lit(False))).unionByName(own(fields, "field", F.lit(False)))
    pages = _with_grids(_by_page(elements, "elements", [*layout.BOX, "kind", "artifact"]), tables(rects), "left")
    of = lambda kind: F.filter("elements", lambda e: e["kind"] == kind)
    none = F.expr("cast(array() as array<struct<component:bigint,cols:array<double>,rows:array<double>,origins:array<struct<row:int,col:int,row_span:int,col_span:int>>>>)")
    pages = pages.select(*PAGE, of("text").alias("texts"), of("field").alias("fields"), F.coalesce("grids", none).alias("grids"))

    def part(e: Column, component: Column) -> Column:
        by_place = F.when(e["artifact"] & (e["y"] < 0.15 * page_height), 1).when(e["artifact"] & (e["y"] > 0.85 * page_height), 2).otherwise(3)
        rank = F.when(component.isNotNull(), 0).otherwise(by_place)
        return F.struct(e["kind"].alias("kind"), e["ordinal"].alias("ordinal"), e["y"].alias("y"), e["height"].alias("size"), rank.alias("rank"), component.alias("ref"))

    of_texts = _claims(F.col("texts"), F.col("grids"), lambda taken: F.zip_with("texts", taken, lambda t, c: part(t, c["component"])))
    of_fields = F.transform("fields", lambda f: part(f, _home(f, F.col("grids"))["component"]))
    pages = pages.select(*PAGE, "grids", F.concat(of_texts, of_fields).alias("elements"))

    tops = F.transform("grids", lambda g: F.struct(_at(g["rows"], F.lit(0)).alias("top"), g["component"].alias("component")))
    pages = pages.select(*PAGE, "elements", tops.alias("tables"))
    kinds = dict(pages.select(*PAGE, F.get("elements", F.lit(0))["ordinal"].alias("ordinal")).dtypes)

    def run(batches):
        for batch in batches:
            held, tables = [batch.column(c) for c in ("elements", "tables")]
            own, grids = held.flatten(), tables.flatten()
            cuts, ends = [(np.asarray(x.offsets) - x.offsets[0].as_py()).tolist() for x in (held, tables)]
            elements = list(zip(*(own.field(c).to_pylist() for c in ("y", "size", "rank", "ref"))))
            tops = list(zip(*(grids.field(c).to_pylist() for c in ("top", "component"))))
            refs, places = [], []
            for k in range(len(held)):
                ref, place = _places(elements[cuts[k] : cuts[k + 1]], tops[ends[k] : ends[k + 1]])
                refs += ref
                places += place
            at = pa.array(np.repeat(np.arange(len(held)), np.diff(cuts)))
            parts = pa.array(PARTS).take(own.field("rank"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in PAGE), own.field("kind"), own.field("ordinal"), parts, pa.array(refs, pa.int64()), pa.array(places, pa.int64())], names=[*PAGE, "kind", "ordinal", "part", "ref", "place"])

    return pages.mapInArrow(run, f"{', '.join(f'{c} {kinds[c]}' for c in PAGE)}, kind string, ordinal {kinds['ordinal']}, part string, ref long, place long")
