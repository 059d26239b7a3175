"""Numbered lists of several levels: counters by windows, labels, and the numbering, header and footer parts of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import escape_xml

LEVELS = 9
# Marks and number formats of the levels, indents in twips, the parts' namespace.
BULLETS = "•◦▪•◦▪•◦▪"
FORMATS = ("decimal", "lowerLetter", "lowerRoman") * 3
INDENT, STEP, HANGING = 720, 360, 360
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
ROMAN = (("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))


def counters(items: DataFrame, keys: list[str], order: list[str], level: str = "level") -> DataFrame:
    """items with ``numbers``: the counters of their level and of those above, outermost first; null where level is null.

    A level counts on until an item of a shallower one; a level that no item has
    opened shows its start, 1. Running counts of all levels and what they were at the last reset
    come from one sort of each document.
    """
    up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(level).isNotNull(), F.least(F.col(level), F.lit(LEVELS - 1)))
    run = items.withColumns({f"__c{k}": F.sum(F.when(at == k, 1).otherwise(0)).over(up) for k in range(LEVELS)})
    # what a level's count was at the last item above it
    run = run.withColumns({f"__r{k}": F.coalesce(F.last(F.when(at < k, F.col(f"__c{k}")), ignorenulls=True).over(up), F.lit(0)) for k in range(1, LEVELS)})
    own = [F.col("__c0"), *[F.col(f"__c{k}") - F.col(f"__r{k}") for k in range(1, LEVELS)]]
    numbers = F.transform(F.slice(F.array(*own), 1, at.cast("int") + 1), lambda n: F.greatest(n, F.lit(1)))
    return run.select(*items.columns, F.when(F.col(level).isNotNull(), numbers).alias("numbers"))


def letters(n: Column) -> Column:
    """a to z, then aa to zz and so on."""
    return F.repeat(F.char(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def roman(n: Column) -> Column:
    out, rest = F.lit(""), n
    for sign, value in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def label(numbers: Column) -> Column:
    """What stands before an item: the number of its own level in that level's format, and a point."""
    own = F.element_at(numbers, -1)
    kind = (F.size(numbers) - 1) % 3
    return F.concat(F.when(kind == 0, own.cast("string")).when(kind == 1, letters(own)).otherwise(roman(own)), F.lit("."))


def legal_label(numbers: Column) -> Column:
    """All numbers with points between, such as 2.1.3."""
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), ".")


def item_xml(text: Column, level: Column, numbered: Column) -> Column:
    """A paragraph of a list: its level and the list it belongs to, 2 for numbers and 1 for bullets."""
    mark = F.concat(F.lit('<w:numPr><w:ilvl w:val="'), F.least(level, F.lit(LEVELS - 1)).cast("string"), F.lit('"/><w:numId w:val="'), F.when(numbered, "2").otherwise("1"), F.lit('"/></w:numPr>'))
    body = F.concat(F.lit('<w:r><w:t xml:space="preserve">'), escape_xml(text), F.lit("</w:t></w:r></w:p>"))
    return F.concat(F.lit("<w:p>"), F.when(level.isNotNull(), F.concat(F.lit("<w:pPr>"), mark, F.lit("</w:pPr>"))).otherwise(""), body)


def numbering_xml() -> str:
    """The numbering part: bullets and numbers of nine levels, and a list of each."""
    out = [f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:numbering xmlns:w="{NAMESPACE}">']
    for kind in (0, 1):
        out.append(f'<w:abstractNum w:abstractNumId="{kind}">')
        for k in range(LEVELS):
            form, text = (FORMATS[k], f"%{k + 1}.") if kind else ("bullet", BULLETS[k])
            font = "" if kind else '<w:rPr><w:rFonts w:ascii="Symbol" w:hAnsi="Symbol" w:hint="default"/></w:rPr>'
            out.append(
                f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{form}"/><w:lvlText w:val="{text}"/><w:lvlJc w:val="left"/>'
                f'<w:pPr><w:ind w:left="{INDENT + k * STEP}" w:hanging="{HANGING}"/></w:pPr>{font}</w:lvl>'
            )
        out.append("</w:abstractNum>")
    return "".join([*out, *(f'<w:num w:numId="{k + 1}"><w:abstractNumId w:val="{k}"/></w:num>' for k in (0, 1)), "</w:numbering>"])


def edge_xml(lines: DataFrame, keys: list[str], order: list[str], part: str) -> DataFrame:
    """(keys, xml): the header (``hdr``) or footer (``ftr``) part out of lines of text, one paragraph each."""
    style = {"hdr": "Header", "ftr": "Footer"}[part]
    one = F.concat(F.lit(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">'), escape_xml("text"), F.lit("</w:t></w:r></w:p>"))
    rows = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, one.alias("x")))), lambda r: r["x"]), "").alias("x"))
    return rows.select(*keys, F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:{part} xmlns:w="{NAMESPACE}">'), "x", F.lit(f"</w:{part}>")).alias("xml"))
