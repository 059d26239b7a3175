"""Column expressions over glyph tables of fonts, and maps from codes to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import c

# Widths of the characters from space to ~ in Helvetica, in thousandths of the size.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
DEFAULT = 500
# Some of its kerning pairs, and its ascender and descender.
KERNING = {"AT": -120, "AV": -70, "AW": -50, "AY": -100, "LT": -110, "LV": -110, "LY": -140, "PA": -120, "TA": -120, "To": -120, "VA": -80, "WA": -50, "Ya": -140, "Yo": -140}
ASCENDER, DESCENDER = 718, -207


def text_width(x, size, kerning: bool = False) -> Column:
    """Width of a text by its glyphs, with the adjustments of pairs if asked for.

    One pass over the characters looks each one up in the table by its code.
    """
    x = c(x)
    n = F.length(x)
    widths = F.lit(list(HELVETICA))
    glyph = lambda ch: F.coalesce(F.get(widths, F.ascii(ch) - 32), F.lit(DEFAULT))
    total = F.aggregate(F.split(x, ""), F.lit(0).cast("long"), lambda a, ch: a + F.when(ch == "", 0).otherwise(glyph(ch)))
    if kerning:
        for pair, more in KERNING.items():
            total = total + (n - F.length(F.replace(x, F.lit(pair), F.lit(pair[0])))) * more
    return total * c(size) / 1000


def text_height(size) -> Column:
    return F.lit(ASCENDER - DESCENDER) * c(size) / 1000


def descent_below(size) -> Column:
    return F.lit(-DESCENDER) * c(size) / 1000


def character_spacing(x, target, size) -> Column:
    """Spacing that brings a text to a width; null if it fits within half a point or is empty."""
    gap = c(target) - text_width(x, size)
    spread = lambda v: F.when((F.length(c(x)) > 0) & (F.abs(v) >= 0.5), v / F.length(c(x)))
    return F.get(F.transform(F.array(gap), spread), F.lit(0))  # the gap is made once


def advance(x, size, char: float = 0.0, word: float = 0.0, scale: float = 1.0) -> Column:
    """How far showing a text moves on: its glyphs, character spacing, word spacing at blanks, horizontal scale."""
    blanks = F.length(c(x)) - F.length(F.replace(c(x), F.lit(" "), F.lit("")))
    return (text_width(x, size) + F.length(c(x)) * char + blanks * word) * scale


def standard_font(x) -> Column:
    """One of the standard fonts for a font's name, by family and style."""
    low = F.lower(F.regexp_replace(c(x), r"^[A-Z]{6}\+", ""))
    has = lambda *w: low.rlike("|".join(w))
    bold, italic = has("bold", "-bd", "bd$"), has("italic", "oblique", "-it")

    def styled(plain: str, b: str, i: str, bi: str) -> Column:
        return F.when(bold & italic, bi).when(bold, b).when(italic, i).otherwise(plain)

    mono = has("courier", "mono", "consolas", "menlo", "monaco")
    serif = has("times", "georgia", "garamond", "palatino") | (has("serif") & ~has("sans"))
    return (
        F.when(mono, styled("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"))
        .when(serif, styled("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic"))
        .otherwise(styled("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"))
    )


def unicode_map(cmap) -> Column:
    """Entries (code, text) of a ToUnicode map: single characters, ranges and ranges with a list of texts."""
    blocks = lambda kind: F.regexp_extract_all(c(cmap), F.lit(rf"(?s)begin{kind}(.*?)end{kind}"), F.lit(1))
    number = lambda h: F.conv(h, 16, 10).cast("int")
    text = lambda h: F.decode(F.unhex(h), "UTF-16BE")
    cell = r"<([0-9A-Fa-f]+)>"

    def entry(code: Column, shown: Column) -> Column:
        return F.struct(code.alias("code"), shown.alias("text"))

    rows = lambda x, pattern, n: F.arrays_zip(*[F.regexp_extract_all(x, F.lit(pattern), F.lit(i + 1)).alias(f"c{i}") for i in range(n)])
    chars = F.flatten(F.transform(blocks("bfchar"), lambda b: F.transform(rows(b, rf"{cell}\s*{cell}", 2), lambda r: entry(number(r["c0"]), text(r["c1"])))))
    spans = F.flatten(F.transform(blocks("bfrange"), lambda b: rows(b, rf"{cell}\s*{cell}\s*(?:{cell}|\[([^\]]*)\])", 4)))

    def span(r: Column) -> Column:
        low = number(r["c0"])
        codes = F.sequence(low, number(r["c1"]))
        listed = F.regexp_extract_all(r["c3"], F.lit(cell), F.lit(1))
        last = F.conv(F.right(r["c2"], F.lit(4)), 16, 10).cast("int")
        head = F.left(r["c2"], F.length(r["c2"]) - 4)
        step = lambda k: text(F.concat(head, F.lpad(F.hex(last + k - low), 4, "0")))
        return F.when(F.length(r["c3"]) > 0, F.transform(F.slice(listed, 1, F.size(codes)), lambda h, i: entry(low + i, text(h)))).otherwise(F.transform(codes, lambda k: entry(k, step(k))))

    return F.concat(chars, F.flatten(F.transform(spans, span)))
