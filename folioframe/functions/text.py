"""Column expressions for strings of document content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import c, round_half_up

#: Font names by the name that a document gives.
FONTS = {
    "Helvetica": "Arial", "ArialMT": "Arial", "Arial": "Arial", "TimesNewRomanPSMT": "Times New Roman", "TimesNewRomanPS": "Times New Roman",
    "TimesNewRoman": "Times New Roman", "Times": "Times New Roman", "Times-Roman": "Times New Roman", "Courier": "Courier New",
    "CourierNew": "Courier New", "CourierNewPSMT": "Courier New", "Symbol": "Symbol", "ZapfDingbats": "Wingdings",
}


def escape_xml(x) -> Column:
    x = c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def font_name(x) -> Column:
    """Name without subset prefix and style, by the table of fonts where it is known."""
    plain = F.regexp_replace(c(x), r"^[A-Z]{6}\+", "")
    base = F.regexp_replace(plain, r"[-,](?:Bold|Italic|Oblique|Regular|Light|Medium|BoldItalic|BoldOblique)+$", "")
    known = F.create_map(*[F.lit(v) for pair in FONTS.items() for v in pair])
    return F.coalesce(known[plain], known[base], F.regexp_replace(base, "(?:PSMT|PS|MT)$", ""))


def is_subset_font(x) -> Column:
    return c(x).rlike(r"^[A-Z]{6}\+")


def is_bold_font(x) -> Column:
    low = F.lower(c(x))
    return low.contains("bold") | low.contains("black") | low.contains("heavy") | F.endswith(low, F.lit("-bd"))


def is_italic_font(x) -> Column:
    low = F.lower(c(x))
    return low.contains("italic") | low.contains("oblique")


def field_label(x) -> Column:
    """Last dotted part without indices, at most 20 characters."""
    return F.substring(F.regexp_replace(F.element_at(F.split(c(x), r"\."), -1), r"\[[0-9]+\]", ""), 1, 20)


def file_name(x) -> Column:
    return F.regexp_extract(c(x), r"([^/\\]*)$", 1)


def extension(x) -> Column:
    return F.lower(F.regexp_extract(file_name(x), r"\.([^.]*)$", 1))


def file_size(x) -> Column:
    n = c(x).cast("double")
    return (
        F.when(n < 1024, F.concat(c(x).cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))
    )


def pdf_date(x) -> Column:
    """Timestamp of D:YYYYMMDD[HHmmSS]; null where it is none."""
    digits = F.regexp_extract(c(x), r"^(?:D:)?([0-9]{8}(?:[0-9]{6})?)", 1)
    return F.try_to_timestamp(F.rpad(F.nullif(digits, F.lit("")), 14, "0"), F.lit("yyyyMMddHHmmss"))


def shown_date(x) -> Column:
    """A date as ``yyyy-MM-dd HH:mm:ss``; what is none stays as it is."""
    return F.coalesce(F.date_format(pdf_date(x), "yyyy-MM-dd HH:mm:ss"), c(x))


def fnv1a(x) -> Column:
    """32-bit FNV-1a over UTF-8 bytes, and the length: eight hex digits, a colon, the length."""
    bytes_ = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(c(x)) - 1, F.lit(0))), lambda i: F.conv(F.hex(F.substring(F.encode(c(x), "UTF-8"), i + 1, F.lit(1))), 16, 10).cast("long"))
    h = F.aggregate(bytes_, F.lit(2166136261).cast("long"), lambda a, b: (a.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    h = F.when(F.octet_length(c(x)) == 0, F.lit(2166136261).cast("long")).otherwise(h)
    return F.concat(F.lpad(F.lower(F.hex(h)), 8, "0"), F.lit(":"), F.octet_length(c(x)).cast("string"))


def plain_number(x) -> Column:
    """At most six decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c(x).cast("double")), "0+$", ""), r"\.$", "")


def escape_pdf_string(x) -> Column:
    x = F.replace(c(x), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(x, F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))


def utf16_hex(x) -> Column:
    return F.hex(F.encode(c(x), "UTF-16BE"))


def from_utf16_hex(x) -> Column:
    return F.decode(F.unhex(c(x)), "UTF-16BE")


def minify_xml(x) -> Column:
    return F.regexp_replace(c(x), r">\s+<", "><")


def truncated_tail(x, most: int = 50) -> Column:
    return F.when(F.length(c(x)) > most, F.concat(F.lit("..."), F.right(c(x), F.lit(most - 3)))).otherwise(c(x))


def estimated_width(x, size) -> Column:
    return F.length(c(x)) * c(size) * 0.5


def choice_index(value, options: Column) -> Column:
    """Place of a value among the options from 0; the first place where it is none of them."""
    return F.greatest(F.array_position(options, c(value)) - 1, F.lit(0)).cast("int")


def appearance(da) -> Column:
    """(font, size, color) of a default appearance string; null where a part is missing."""
    font = r"/(\S+)\s+([0-9.]+)\s+Tf"
    color = F.regexp_extract(c(da), r"((?:[0-9.]+\s+){1,4}(?:g|rg|k))(?:\s|$)", 1)
    part = lambda i: F.nullif(F.regexp_extract(c(da), font, i), F.lit(""))
    return F.struct(part(1).alias("font"), part(2).cast("double").alias("size"), F.nullif(color, F.lit("")).alias("color"))


def page_numbers(ranges, n_pages) -> Column:
    """Sorted page numbers of "1-3,5"; parts that are no range within the pages are left out."""
    part = F.transform(F.split(c(ranges), ","), lambda p: F.trim(p))
    ends = F.transform(
        F.filter(part, lambda p: p.rlike("^[0-9]+(-[0-9]+)?$")),
        lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("int").alias("a"), F.element_at(F.split(p, "-"), -1).cast("int").alias("b")),
    )
    kept = F.filter(ends, lambda e: (e["a"] >= 1) & (e["b"] <= c(n_pages)) & (e["a"] <= e["b"]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda e: F.sequence(e["a"], e["b"])))))


def valid_ranges(ranges, n_pages) -> Column:
    part = F.transform(F.split(c(ranges), ","), lambda p: F.trim(p))
    a = lambda p: F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int")
    b = lambda p: F.element_at(F.split(p, "-"), -1).try_cast("int")
    return F.forall(part, lambda p: F.coalesce(p.rlike("^[0-9]+(-[0-9]+)?$") & (a(p) >= 1) & (b(p) <= c(n_pages)) & (a(p) <= b(p)), F.lit(False)))


def masked_digits(raw, mask: str) -> Column:
    """Digits of raw put into the places of # in a mask, as far as they go."""
    digits = F.regexp_replace(c(raw), "[^0-9]", "")
    places = [i for i, m in enumerate(mask) if m == "#"]
    out = F.lit("")
    for i, m in enumerate(mask):
        before = sum(p < i for p in places)
        out = F.concat(out, F.when(F.length(digits) > before, F.substring(digits, before + 1, 1) if m == "#" else F.lit(m)).otherwise(F.lit("")))
    return out


def page_geometry(width, height) -> Column:
    """Size of a page in inches and millimetres."""
    return F.format_string("%.2f x %.2f in (%d x %d mm)", c(width) / 72, c(height) / 72, round_half_up(c(width) / 72 * 25.4), round_half_up(c(height) / 72 * 25.4))


def css_colour(x) -> Column:
    """(r, g, b, a) from 0 to 1 of #rgb, #rrggbb, rgb() or rgba(); a is 1 where none is given, null where it is no colour."""
    v = F.lower(F.trim(c(x)))
    short = F.regexp_extract(v, r"^#?([0-9a-f]{3})$", 1)
    six = F.coalesce(F.nullif(F.regexp_extract(v, r"^#?([0-9a-f]{6})$", 1), F.lit("")), F.when(short != "", F.regexp_replace(short, "(.)", "$1$1")))
    hexed = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("double") / 255
    call = r"^rgba?\(\s*([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)\s*(?:,\s*([0-9.]+)\s*)?\)$"
    part = lambda i: F.nullif(F.regexp_extract(v, call, i), F.lit("")).try_cast("double")
    r, g, b = (F.coalesce(hexed(1 + 2 * i), part(i + 1) / 255) for i in range(3))
    return F.when(r.isNotNull(), F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.coalesce(part(4), F.lit(1.0)).alias("a")))
