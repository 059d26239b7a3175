"""Page content streams: tokens, operators and text runs, and replacement in streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    rb"""[\0\t\n\f\r ]+|%[^\r\n]*
    |(?P<number>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?=[\0\t\n\f\r ()<>\[\]{}/%]|$))
    |(?P<name>/[^\0\t\n\f\r ()<>\[\]{}/%]*)
    |(?P<dict_start><<)|(?P<dict_end>>>)|(?P<hex><[^>]*>?)|(?P<array_start>\[)|(?P<array_end>\])
    |(?P<string>\()|(?P<operator>[^\0\t\n\f\r ()<>\[\]{}/%]+)|(?P<other>.)""",
    re.X | re.S,
)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))", re.S)
# Escapes in strings.
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(raw: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else _ESCAPED.get(m[3], m[3]), raw)


def tokens(data: bytes) -> Iterator[tuple[str, str, int, int]]:
    """(type, value, start, end); strings are Latin-1, numbers as written."""
    at = 0
    while at < len(data):
        m = _TOKEN.match(data, at)
        kind, at = m.lastgroup, m.end()
        if kind is None:
            continue
        raw = m.group()
        if kind == "string":
            depth = 1
            while at < len(data) and depth:
                c = data[at]
                at += 2 if c == 92 else 1
                depth += (c == 40) - (c == 41)
            at = min(at, len(data))
            raw = _unescaped(data[m.start() + 1 : at - (depth == 0)])
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw[1:])
        elif kind == "operator" and raw in (b"true", b"false", b"null"):
            kind = "literal"
        yield kind, raw.decode("latin-1"), m.start(), at


def operators(data: bytes) -> Iterator[tuple[str, list, int, int]]:
    """(operator, operands, start, end). Operands: numbers, (type, text), lists."""
    stack: list[list] = [[]]
    start = None
    for kind, value, s, e in tokens(data):
        start = s if start is None else start
        if kind in ("array_start", "dict_start"):
            stack.append([])
        elif kind in ("array_end", "dict_end"):
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
        elif kind == "operator":
            while len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
            yield value, stack[0], start, e
            stack, start = [[]], None
        else:
            stack[-1].append(float(value) if kind == "number" else (kind, value))


def _times(a: tuple, b: tuple) -> tuple:
    """b after a, as row vectors: a x b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _shown(raw: str) -> str:
    """Text of a string's bytes: UTF-16 after its mark, else Latin-1."""
    return raw[2:].encode("latin-1").decode("utf-16-be", "replace") if raw.startswith("\xfe\xff") else raw


def text_runs(data: bytes) -> Iterator[tuple[str, float, float, str, float, str]]:
    """(text, x, y, font, size, colour) of the strings a stream shows; widths are half the size for each character."""
    g = {"ctm": ONE, "font": "", "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "fill": "000000"}
    saved: list[dict] = []
    tm = line = ONE
    channel = lambda v: f"{int(max(0.0, min(1.0, v)) * 255 + 0.5):02x}"

    def move(x: float, y: float) -> None:
        nonlocal tm, line
        tm = line = _times((1.0, 0.0, 0.0, 1.0, x, y), line)

    def show(text: str):
        nonlocal tm
        m = _times((1.0, 0.0, 0.0, 1.0, 0.0, g["rise"]), _times(tm, g["ctm"]))
        run = (text, m[4], m[5], g["font"], g["size"], g["fill"])
        ahead = sum((g["size"] * 0.5 + g["char"] + (g["word"] if c == " " else 0.0)) * g["scale"] for c in text)
        tm = _times((1.0, 0.0, 0.0, 1.0, ahead, 0.0), tm)
        return run

    for op, args, _, _ in operators(data):
        numbers = [a for a in args if isinstance(a, float)]
        strings = [_shown(a[1]) for a in args if isinstance(a, tuple) and a[0] in ("string", "hex")]
        if op == "q":
            saved.append(dict(g))
        elif op == "Q" and saved:
            g = saved.pop()
        elif op == "cm" and len(numbers) == 6:
            g["ctm"] = _times(tuple(numbers), g["ctm"])
        elif op == "BT":
            tm = line = ONE
        elif op == "Tf" and numbers:
            g["font"], g["size"] = next((a[1] for a in args if isinstance(a, tuple)), ""), numbers[-1]
        elif op in ("Tc", "Tw", "TL", "Ts", "Tz") and numbers:
            g[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tz": "scale"}[op]] = numbers[0] / (100 if op == "Tz" else 1)
        elif op == "Tm" and len(numbers) == 6:
            tm = line = tuple(numbers)
        elif op in ("Td", "TD") and len(numbers) == 2:
            if op == "TD":
                g["lead"] = -numbers[1]
            move(*numbers)
        elif op == "T*":
            move(0.0, -g["lead"])
        elif op == "g" and numbers:
            g["fill"] = channel(numbers[0]) * 3
        elif op == "rg" and len(numbers) == 3:
            g["fill"] = "".join(map(channel, numbers))
        elif op == "k" and len(numbers) == 4:
            g["fill"] = "".join(channel(1 - min(1.0, v + numbers[3])) for v in numbers[:3])
        elif op in ("Tj", "'", '"') and strings:
            if op == '"' and len(numbers) == 2:
                g["word"], g["char"] = numbers
            if op != "Tj":
                move(0.0, -g["lead"])
            yield show(strings[-1])
        elif op == "TJ" and args and isinstance(args[-1], list):
            for a in args[-1]:
                if isinstance(a, float):
                    tm = _times((1.0, 0.0, 0.0, 1.0, -a / 1000 * g["size"] * g["scale"], 0.0), tm)
                elif isinstance(a, tuple):
                    yield show(_shown(a[1]))


def fills(data: bytes) -> Iterator[tuple[float, float, float, float, str]]:
    """(x, y, width, height, colour) of rectangles that a stream fills."""
    ctm, fill, saved, held = ONE, "000000", [], []
    channel = lambda v: f"{int(max(0.0, min(1.0, v)) * 255 + 0.5):02x}"
    for op, args, _, _ in operators(data):
        n = [a for a in args if isinstance(a, float)]
        if op == "q":
            saved.append((ctm, fill))
        elif op == "Q" and saved:
            ctm, fill = saved.pop()
        elif op == "cm" and len(n) == 6:
            ctm = _times(tuple(n), ctm)
        elif op == "g" and n:
            fill = channel(n[0]) * 3
        elif op == "rg" and len(n) == 3:
            fill = "".join(map(channel, n))
        elif op == "k" and len(n) == 4:
            fill = "".join(channel(1 - min(1.0, v + n[3])) for v in n[:3])
        elif op == "re" and len(n) == 4:
            at = [_times((1.0, 0.0, 0.0, 1.0, x, y), ctm)[4:] for x, y in ((n[0], n[1]), (n[0] + n[2], n[1] + n[3]))]
            xs, ys = sorted(p[0] for p in at), sorted(p[1] for p in at)
            held.append((xs[0], ys[0], xs[1] - xs[0], ys[1] - ys[0]))
        elif op in ("f", "F", "f*", "B", "B*", "b", "b*"):
            yield from ((*box, fill) for box in held)
            held = []
        elif op in ("S", "s", "n"):
            held = []


# Operators of content streams by kind.
KINDS = {
    "text": "BT ET Tc Tw Tz TL Tf Tr Ts Td TD Tm T* Tj TJ ' \"".split(),
    "path": "m l c v y h re S s f F f* B B* b b* n W W*".split(),
    "state": "q Q cm w J j M d ri i gs".split(),
    "colour": "CS cs SC SCN sc scn G g RG rg K k".split(),
    "object": "Do BI ID EI sh MP DP BMC BDC EMC BX EX d0 d1".split(),
}


def operator_kind(operator) -> Column:
    kind = F.lit("other")
    for name, ops in KINDS.items():
        kind = F.when(F.col(operator).isin(ops), name).otherwise(kind)
    return kind


# ---- in Spark: rows of (keys, content)

#: Rows that a task holds in Python before it gives them back, whatever the number of pages in a batch and of rows on a page.
PART = 8192


def _flat(df: DataFrame, keys: list[str], column: str, make, schema: str, types: list) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = dict(df.dtypes)
    whole = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "ordinal long", schema])

    def part(own, at, rows):
        picked = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(picked) for c in own), *(pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64(), *types]))], names=[*keys, "ordinal", *names])

    def run(batches):
        for b in batches:
            own = [b.column(k) for k in keys]
            at, rows = [], []
            for i, data in enumerate(b.column(column)):
                for n, r in enumerate(make(data.as_py() or b"")):
                    at.append(i)
                    rows.append((n, *r))
                    if len(rows) == PART:
                        yield part(own, at, rows)
                        at, rows = [], []
            if rows:
                yield part(own, at, rows)

    return df.select(*keys, column).mapInArrow(run, whole)


def lex(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return _flat(df, keys, column, tokens, "type string, value string, start long, end long", [pa.string(), pa.string(), pa.int64(), pa.int64()])


def parse(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    """Operators with their operands as JSON."""
    import json

    def make(data):
        return ((op, json.dumps(args), s, e) for op, args, s, e in operators(data))

    return _flat(df, keys, column, make, "operator string, operands string, start long, end long", [pa.string(), pa.string(), pa.int64(), pa.int64()])


def runs(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return _flat(df, keys, column, text_runs, "text string, x double, y double, font string, size double, color string", [pa.string(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.string()])


def filled_rects(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return _flat(df, keys, column, fills, "x double, y double, width double, height double, color string", [*[pa.float64()] * 4, pa.string()])


def stream_of(lines: Column) -> Column:
    """A content stream that shows an array of structs (x, y, size, text): ASCII as it is, other text as UTF-16 in hex."""
    from folioframe.functions.text import escape_pdf_string, plain_number, utf16_hex

    string = lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("<FEFF"), utf16_hex(x), F.lit(">"))).otherwise(F.concat(F.lit("("), escape_pdf_string(x), F.lit(")")))
    one = lambda r: F.concat(F.lit("BT /F1 "), plain_number(r["size"]), F.lit(" Tf 1 0 0 1 "), plain_number(r["x"]), F.lit(" "), plain_number(r["y"]), F.lit(" Tm "), string(r["text"]), F.lit(" Tj ET"))
    return F.array_join(F.transform(lines, one), "\n")


def replace_text(content: Column, old: str, new: str) -> Column:
    """The stream with the first shown ``old`` replaced: as a string, in hex, or as UTF-16 in hex; null if it is in none."""
    from folioframe.functions import text as t

    esc = lambda s: s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    hexed = lambda s: s.encode("latin-1", "replace").hex().upper()
    wide = lambda s: s.encode("utf-16-be").hex().upper()

    def first(a: str, b: str, hit: Column) -> Column:
        place = F.locate(a, content)
        return F.when(hit & (place > 0), F.concat(F.substring(content, F.lit(1), place - 1), F.lit(b), F.substring(content, place + len(a), F.length(content))))

    shown = content.rlike(r"\([^\n]*" + re.escape(esc(old)) + r"[^\n]*\)\s*(?:Tj|'|\")|\[[^\n]*" + re.escape(esc(old)) + r"[^\n]*\]\s*TJ")
    spaced = r"\s+".join(map(re.escape, esc(old).split()))
    loose = F.when(content.rlike(r"\([^\n]*" + spaced), F.regexp_replace(content, spaced, esc(new).replace("\\", r"\\").replace("$", r"\$")))
    up = content.rlike(r"<[0-9A-Fa-f\s]+>\s*Tj")
    return F.coalesce(first(esc(old), esc(new), shown), first(hexed(old), hexed(new), up), first(wide(old), wide(new), up), loose if spaced else F.lit(None))


def blank_text(content: Column, old: str) -> Column:
    """The stream with every shown ``old`` replaced by as many spaces: literal, in hex, as UTF-16 in hex."""
    esc = old.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    out = F.replace(content, F.lit(esc), F.lit(" " * len(old)))
    out = F.replace(out, F.lit(old.encode("latin-1", "replace").hex().upper()), F.lit("20" * len(old)))
    return F.replace(out, F.lit(old.encode("utf-16-be").hex().upper()), F.lit("0020" * len(old)))
