"""Search, replacement and blanking in the strings that content streams show.

The operator that shows a string, its array, its line and its font follow from what stands before it in the stream, so a page's
stream is read once, in order, where the page lies: no row for each token, no join, no sort. Strings are decoded and joined by
unit (a string, a ``TJ`` array, a line); a match in the joined text goes back to the strings it covers by their
running offsets, and only those are written anew: names, operators, numbers, comments,
inline images and strings that no operator shows stay as they are, byte for byte.
Plain strings that are shown one after another on a line, or by one array, are read as one run; its text is
joined as a whole, and it is taken apart only where that text may hold a match.
``tokens`` and ``shown`` give the same as rows, for those who look at single tokens.
"""

from __future__ import annotations

import re
from itertools import groupby
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import from_utf16_hex

_IN = r"[^\\()]*+"
_DEEP = rf"\({_IN}(?:\\.{_IN})*+\)"
_INNER = rf"\({_IN}(?:(?:\\.|{_DEEP}){_IN})*+\)"
#: White space, inline images, comments, strings (parentheses nested up to three deep), hex strings, brackets, names, the rest. Nothing is left out.
TOKEN = (
    r"(?s)\s++|(?<!\S)BI(?=\s).*?\sEI(?!\S)|%[^\r\n]*+"
    rf"|\({_IN}(?:(?:\\.|{_INNER}){_IN})*+\)"
    r"|<<|>>|<[0-9A-Fa-f\s]*+>|[\[\]]|/[^\s()<>\[\]{}/%]*+|[^\s()<>\[\]{}/%]++|."
)
SHOWS = ("Tj", "TJ", "'", '"')

#: Strategies of replacement in order; the first with a hit on a page is taken.
EXACT, ARRAY, EXACT_HEX, CODES, UTF16, LINE, LOOSE = range(1, 8)


def _kind() -> Column:
    x = F.col("token")
    return (
        F.when(x.rlike(r"^\s"), "white").when(x.startswith("("), "string").when(x.startswith("%") | x.startswith("BI") & x.endswith("EI") & (F.length(x) > 4), "opaque").when(x.isin("<<", ">>"), "mark")
        .when(x.startswith("<"), "hex").when(x.isin("[", "]"), x).when(x.startswith("/"), "name").when(x.rlike(r"^[+-]?[0-9.]+$"), "number").otherwise("operator")
    )


def unescaped(inner: Column) -> Column:
    """What the inside of a literal string stands for: escapes of one letter, octal codes, lines that go on."""
    octal = lambda p: F.char(F.conv(F.substring(p, 2, 3), 8, 10).cast("int") % 256)
    letters = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}

    def plain(p: Column) -> Column:
        out = F.when(~p.startswith("\\"), p).when(p.rlike(r"^\\[0-7]"), octal(p)).when(p.rlike(r"^\\[\r\n]"), "")
        for k, v in letters.items():
            out = out.when(p == "\\" + k, v)
        return out.otherwise(F.substring(p, 2, 1))

    parts = F.regexp_extract_all(inner, F.lit(r"(?s)(\\[0-7]{1,3}|\\\r?\n|\\.|[^\\]+)"), F.lit(1))
    return F.when(inner.contains("\\"), F.array_join(F.transform(parts, plain), "")).otherwise(inner)


def _hex_digits() -> Column:
    h = F.upper(F.regexp_replace("token", r"[<>\s]", ""))
    return F.when(F.length(h) % 2 == 1, F.concat(h, F.lit("0"))).otherwise(h)


def _from_codes(digits: Column, width: Column, codes: Column) -> Column:
    """Text of hex codes by a font's map from codes to texts; codes that it lacks show nothing."""
    n = F.floor(F.length(digits) / width).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_join(F.transform(at, lambda i: F.coalesce(F.try_element_at(codes, F.conv(F.substr(digits, i * width + 1, width), 16, 10).cast("int")), F.lit(""))), "")


def tokens(pages: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, pos, token, kind, operator, line, array, font): all tokens of the streams; joined they give the stream."""
    t = pages.select(*keys, F.posexplode(F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))).alias("pos", "token")).withColumn("kind", _kind())
    ahead = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("operator", F.last(F.when(F.col("kind") == "operator", F.col("token")), ignorenulls=True).over(back))
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).over(ahead)
    breaks = F.when(F.col("kind").isin("white", "opaque"), F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))).otherwise(0)
    named = F.when((F.col("kind") == "name") & (F.col("operator") == "Tf"), F.substring("token", 2, 1 << 20))
    return t.select("*", n("[").alias("opened"), n("]").alias("closed"), F.sum(breaks).over(ahead).alias("line"), F.last(named, ignorenulls=True).over(ahead).alias("font")).select(
        *keys, "pos", "token", "kind", "operator", "line", F.when(F.col("opened") > F.col("closed"), F.col("opened")).alias("array"), "font"
    )


def shown(toks: DataFrame, keys: list[str], fonts: DataFrame | None = None) -> DataFrame:
    """The strings that an operator shows, with ``text``; ``coded`` where a font's map gives it.

    ``fonts`` has (keys, font, codes): a map from codes to texts for each font that has one.
    """
    s = toks.where(F.col("kind").isin("string", "hex") & F.col("operator").isin(*SHOWS))
    s = s.join(fonts.select(*keys, "font", "codes"), [*keys, "font"], "left") if fonts is not None else s.withColumn("codes", F.lit(None).cast("map<int,string>"))
    s = s.withColumn("digits", F.when(F.col("kind") == "hex", _hex_digits()))
    s = s.withColumn("width", F.when((F.length("digits") >= 4) & (F.length("digits") % 4 == 0), 4).otherwise(2))
    coded = F.col("digits").isNotNull() & F.col("codes").isNotNull()
    wide = F.col("digits").startswith("FEFF")
    text = (
        F.when(F.col("kind") == "string", unescaped(F.substr(F.col("token"), F.lit(2), F.length("token") - 2)))
        .when(coded, _from_codes(F.col("digits"), F.col("width"), F.col("codes")))
        .when(wide, from_utf16_hex(F.substr(F.col("digits"), F.lit(5))))
        .otherwise(F.decode(F.unhex("digits"), "ISO-8859-1"))
    )
    return s.withColumn("coded", F.coalesce(coded, F.lit(False))).withColumn("utf16", F.coalesce(wide & ~coded, F.lit(False))).withColumn("text", text)


# ---- a page's stream, read in order

_ENDS = r"(?=[\s()<>\[\]{}/%]|\Z)"
_NUMBER = rf"[+-]?[0-9.]++{_ENDS}"
_GAP = rf"(?:\s++|{_NUMBER})"
#: Strings without escapes and parentheses, gaps without a line's end, and what shows strings.
_PLAIN = r"(?:\([^\\()]*+\)|<[0-9A-Fa-f]*+>)"
_BLANK = r"[ \t\r\f\v]*+"
_ASIDE = rf"{_BLANK}(?:{_NUMBER}{_BLANK})?+"
_MORE = rf"(?:{_BLANK}{_NUMBER})*+{_BLANK}"
_SHOW = rf"(?:T[jJ]|['\"]){_ENDS}"
#: The same tokens by group: runs of plain strings that are shown (by an array, by an operator each), strings and hex strings
#: with the gap after them, gaps (white space and numbers), opaque, names, brackets, marks, operators; names and operators with the gap on their line.
_SCAN = re.compile(
    rf"(?s)(\[{_ASIDE}(?:{_PLAIN}{_ASIDE})++\]{_ASIDE}{_SHOW})|((?:{_PLAIN}{_BLANK}{_SHOW}{_BLANK})++)"
    rf"|(?:(\({_IN}(?:(?:\\.|{_INNER}){_IN})*+\))|(<[0-9A-Fa-f\s]*+>)){_GAP}*+|({_GAP}++)|((?<!\S)BI(?=\s).*?\sEI(?!\S)|%[^\r\n]*+)"
    rf"|(/[^\s()<>\[\]{{}}/%]*+){_MORE}|(\[)|(\])|(<<|>>)|([^\s()<>\[\]{{}}/%]++){_MORE}|(.)",
    re.A,
)
_ARRAY_RUN, _RUN, _STRING, _HEX, _SPACE, _OPAQUE, _NAME, _OPEN, _CLOSE, _MARK = range(1, 11)
_PIECE = re.compile(r"\(([^()]*+)\)|<([0-9A-Fa-f]*+)>")
_ESCAPE = re.compile(r"(?s)\\([0-7]{1,3})|\\(\r?\n|\r)|\\(.)|\\\Z")
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _plain(m: re.Match) -> str:
    return chr(int(m[1], 8) % 256) if m[1] else _LETTERS.get(m[3], m[3]) if m[3] else ""


def _decoded(token: str, codes: dict | None) -> tuple[str, str, tuple | None]:
    """(kind, text, (codes, width)) of a string token: literal, hex, utf16, or coded by its font's map."""
    inner = token[1:-1]
    if token[0] == "(":
        return "literal", _ESCAPE.sub(_plain, inner) if "\\" in inner else inner, None
    digits = "".join(inner.split()).upper()
    digits += "0" * (len(digits) % 2)
    if codes is not None:
        width = 4 if digits and len(digits) % 4 == 0 else 2
        return "coded", "".join([codes.get(int(digits[i : i + width], 16)) or "" for i in range(0, len(digits), width)]), (codes, width)
    if digits.startswith("FEFF"):
        return "utf16", bytes.fromhex(digits[4:]).decode("utf-16-be", "replace"), None
    return "hex", bytes.fromhex(digits).decode("latin-1"), None


class _Run:
    """Strings that stand together in an array or on a line: plain ones as they are in the stream, or (``own``) each for itself."""

    __slots__ = ("start", "chunk", "array", "line", "own", "text", "n")

    def __init__(self, start: int, chunk: str, array: int | None, line: int, own: tuple | None = None):
        self.start, self.chunk, self.array, self.line, self.own = start, chunk, array, line, own
        self.text, self.n = (own[3], 1) if own else (None, 0)

    @property
    def strings(self) -> list[tuple]:
        if self.own:
            return [self.own]
        out = []
        for m in _PIECE.finditer(self.chunk):
            kind, text, _ = ("literal", m[1], None) if m[1] is not None else _decoded(m[0], None)
            out.append((self.start + m.start(), self.start + m.end(), kind, text, self.array, self.line, None))
        return out


_DIGITS = np.zeros(256, np.uint16)
_DIGITS[[ord(x) for x in "0123456789ABCDEFabcdef"]] = [int(x, 16) for x in "0123456789ABCDEFabcdef"]


def _read(runs: list[_Run]) -> None:
    """Texts and numbers of strings of plain runs, all at once by the places of their brackets."""
    plain = [r for r in runs if r.text is None and r.chunk.isascii()]
    if plain:
        ends = np.cumsum([len(r.chunk) for r in plain])
        a = np.frombuffer("".join([r.chunk for r in plain]).encode("ascii"), np.uint8)
        opens = a == 40
        literal = (opens.view(np.int8) - (a == 41).view(np.int8)).cumsum(dtype=np.int8).view(bool)  # what stands within, with what opens it
        start, end = np.flatnonzero((a == 60) > literal), np.flatnonzero((a == 62) > literal)
        literal[opens] = False
        size = end - start - 1
        digit = lambda at, i: _DIGITS[a[np.minimum(at + i, len(a) - 1)]]
        head = start[size >= 4]
        wide = np.isin(start, head[(digit(head, 1) == 15) & (digit(head, 2) == 14) & (digit(head, 3) == 15) & (digit(head, 4) == 15)])
        bad = np.where(wide, size % 4, size % 2) != 0
        skip, step = np.where(wide, 4, 0), np.where(wide, 4, 2)
        chars = (size - skip) // step
        at = np.repeat(start + 1 + skip - step * (np.cumsum(chars) - chars), chars) + np.repeat(step, chars) * np.arange(chars.sum())  # first digits of characters
        value, by = a.astype("<u2"), np.repeat(wide, chars)
        code = digit(at, 0) * 16 + digit(at, 1)
        value[at] = np.where(by, code * 256 + digit(at, 2) * 16 + digit(at, 3), code)
        literal[at] = True  # what gives a character
        halves = at[by & (value[at] >= 0xD800) & (value[at] < 0xE000)]
        odd = {*np.searchsorted(ends, np.concatenate([start[bad], halves]), "right").tolist()}  # those are read one by one
        shown = np.flatnonzero(literal)
        upto = (2 * np.searchsorted(shown, ends)).tolist()
        counts = np.diff(np.searchsorted(np.flatnonzero(opens), ends) + np.searchsorted(start, ends), prepend=0).tolist()
        shown, upto = value[shown].tobytes(), [0, *upto]
        for i, r in enumerate(plain):
            if i not in odd:
                r.text, r.n = shown[upto[i] : upto[i + 1]].decode("utf-16-le"), counts[i]
    for r in runs:
        if r.text is None:
            own = r.strings
            r.text, r.n = "".join([s[3] for s in own]), len(own)


def _runs_in(stream: str, fonts: dict) -> list[_Run]:
    """The strings that an operator of the stream shows, in order, by runs."""
    out, held = [], []
    line = opened = closed = 0
    font = named = None

    def show(codes):
        for start, end, x, array, at in held:
            kind, text, own = _decoded(x, codes)
            out.append(_Run(start, x, array, at, (start, end, kind, text, array, at, own)))

    for m in _SCAN.finditer(stream):
        k = m.lastindex
        if k <= _RUN:
            codes, chunk = fonts.get(font), m[k]
            show(codes)
            opened += k == _ARRAY_RUN
            array = opened if opened > closed else None
            if codes is None:
                run = _Run(m.start(), chunk, array, line)
                if k == _RUN and chunk[0] == "(" and chunk.rfind("(") == 0 and chunk.rfind("<") < (end := chunk.index(")")):
                    run.text, run.n = chunk[1:end], 1
                out.append(run)
            else:
                held = [(m.start() + p.start(), m.start() + p.end(), p[0], array, line) for p in _PIECE.finditer(chunk)]
                show(codes)
            closed += k == _ARRAY_RUN
            held, named = [], None
            continue
        if k <= _HEX:
            start, end = m.span(k)
            held.append((start, end, m[k], opened if opened > closed else None, line))
            line += stream.count("\n", end, m.end())
            continue
        token = m[k]
        if k <= _OPAQUE:
            line += token.count("\n")
        elif k == _NAME:
            named = token[1:]
        elif k == _OPEN:
            opened += 1
        elif k == _CLOSE:
            closed += 1
        elif k == _MARK:
            pass
        elif token in "(<":  # nothing closes it
            held.append((*m.span(), token, opened if opened > closed else None, line))
        else:
            if token in SHOWS:
                show(fonts.get(font))
            elif token == "Tf" and named is not None:
                font = named
            held, named = [], None
    _read(out)
    return out


def _shown_in(stream: str, fonts: dict) -> list[tuple]:
    """(start, end, kind, text, array, line, codes) of the strings that an operator of the stream shows, in order."""
    return [s for run in _runs_in(stream, fonts) for s in run.strings]


def _written(string: tuple, text: str) -> str | None:
    """A token for a text, of the kind that the string has; null if its font can't show it."""
    kind, codes = string[2], string[6]
    if kind == "coded":
        own = {v: c for c, v in codes[0].items()}
        made = [own.get(ch, ord(ch) if ord(ch) < 256 else None) for ch in text]
        if any(c is None or c >= 16 ** codes[1] for c in made):
            return None
        return "<" + "".join(f"{c:0{codes[1]}X}" for c in made) + ">"
    beyond = any(ch > "\xff" for ch in text)
    if kind == "utf16" or beyond:
        return "<FEFF" + text.encode("utf-16-be", "replace").hex().upper() + ">"
    if kind == "hex":
        return "<" + text.encode("latin-1").hex().upper() + ">"
    return "(" + text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"


def _grouped(runs: list[_Run], place: str) -> list[list[_Run]]:
    # lines and arrays are counted up, so those of one stand together
    return [list(unit) for _, unit in groupby(runs, attrgetter(place))]


def _units(runs: list[_Run], way: int, may) -> list[list[tuple]]:
    """Strings by unit of a way to look at them; plain ones only of units whose text ``may`` hold a match."""
    if way == CODES:  # plain runs have none
        runs = [r for r in runs if r.own and r.own[2] == "coded"]
        return [[r.own for r in unit] for unit in _grouped(runs, "line")]
    if way in (ARRAY, LINE, LOOSE):
        units = _grouped(runs, "line") if way == LINE else _grouped([r for r in runs if r.array is not None and (way == LOOSE or not r.own or r.own[2] != "coded")], "array")
        return [[s for r in unit for s in r.strings] for unit in units if may("".join([r.text for r in unit]))]
    kind = {EXACT: "literal", EXACT_HEX: "hex", UTF16: "utf16"}[way]
    strings = [s for r in runs if r.array is None and may(r.text) for s in r.strings]
    # a whole hex string may be UTF-16 too
    return [[s] for s in strings if s[2] == kind or way == EXACT_HEX and s[2] == "utf16"]


def _edited(stream: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, token in sorted(edits):
        out += [stream[at:start], token]
        at = end
    return "".join([*out, stream[at:]])


def _replaced(stream: str, fonts: dict, old: str, new: str, loose: re.Pattern) -> tuple[str, int]:
    """The stream with ``old`` replaced and the way taken."""
    runs = _runs_in(stream, fonts)
    for way in range(EXACT, LOOSE + 1):
        hits = []
        for unit in _units(runs, way, loose.search if way == LOOSE else lambda text: old in text):
            joined = "".join([s[3] for s in unit])
            if way in (EXACT, EXACT_HEX):
                at, n = (0 if joined == old and old else -1), len(old)
            elif way == LOOSE:
                m = loose.search(joined)
                at, n = (m.start(), m.end() - m.start()) if m and m[0] else (-1, 0)
            else:
                at, n = (joined.find(old) if old else -1), len(old)
            if at >= 0:
                hits.append((unit, at, at + n))
        if hits:
            made = [x for h in hits for x in _cut(*h, new, way in (ARRAY, LOOSE))]
            return _edited(stream, made), way if made else 0
    return stream, 0


def _cut(unit: list[tuple], first: int, last: int, new: str, in_array: bool) -> list[tuple[int, int, str]]:
    """Edits that put ``new`` in the place of the unit's characters from first to last; none if a font can't show what is left."""
    cuts, offset = [], 0
    for s in unit:
        size = len(s[3])
        if first < offset + size and last > offset:
            cuts.append((s, s[3][: max(first - offset, 0)], s[3][min(last - offset, size) :]))
        offset += size
    made = []
    for i, (s, head, tail) in enumerate(cuts):
        if in_array:
            made.append([_written(s, x) for x in ([head] if head else []) + ([new] if i == 0 else []) + ([tail] if tail else [])])
        else:
            made.append([_written(s, head + (new if i == 0 else "") + tail)])
    if any(x is None for m in made for x in m):
        return []
    if in_array:  # what lies between the pieces goes
        return [(cuts[0][0][0], cuts[-1][0][1], "".join(" ".join(m) for m in made))]
    return [(s[0], s[1], m[0]) for (s, _, _), m in zip(cuts, made)]


def _blanked(stream: str, fonts: dict, old: str) -> tuple[str, int]:
    runs, may = _runs_in(stream, fonts), lambda text: old in text
    alone = [[s] for r in runs if r.array is None and may(r.text) for s in r.strings if s[2] != "coded"]
    edits, taken = [], 0
    for way, units in ((EXACT, alone), (ARRAY, _units(runs, ARRAY, may)), (CODES, _units(runs, CODES, may))):
        for unit in units:
            joined = "".join([s[3] for s in unit])
            blank, at = joined.replace(old, " " * len(old)), 0
            if blank == joined:
                continue
            for s in unit:
                own = blank[at : at + len(s[3])]
                at += len(s[3])
                token = _written(s, own) if own != s[3] else None
                if token is not None:
                    edits.append((s[0], s[1], token))
                    taken = way
    return _edited(stream, edits), taken


def _lines(stream: str, fonts: dict) -> list[tuple[int, str, int]]:
    return [(unit[0].line, "".join([r.text for r in unit]), sum(r.n for r in unit)) for unit in _grouped(_runs_in(stream, fonts), "line")]


#: Rows and characters that a task holds in Python before it gives them back.
PART, CHARS = 8192, 1 << 23


def _by_page(pages: DataFrame, keys: list[str], fonts: DataFrame | None, content: str, make, names: list[str], types: list) -> DataFrame:
    """(keys, names): the rows that ``make`` gives for each page's stream and its fonts' maps."""
    p = pages.select(*keys, F.col(content).alias("__stream"))  # no filter here: it would make a computed stream twice
    mapped = fonts is not None
    if mapped:
        maps = fonts.groupBy(*keys).agg(F.collect_list(F.struct("font", "codes")).alias("__fonts"))
        p = p.join(maps, keys, "left")
    kinds = dict(p.dtypes)
    sql = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} {sql[t]}" for n, t in zip(names, types))])

    def part(own, at, rows):
        picked = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(picked) for c in own), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names=[*keys, *names])

    def run(batches):
        for b in batches:
            own = [b.column(k) for k in keys]
            streams = b.column("__stream")
            maps = b.column("__fonts") if mapped else None
            at, rows, chars = [], [], 0
            for i, stream in enumerate(streams.to_pylist()):
                if not stream:
                    continue
                by_font = {f["font"]: dict(f["codes"]) for f in maps[i].as_py() or () if f["codes"] is not None} if mapped else {}
                for r in make(stream, by_font):
                    at.append(i)
                    rows.append(r)
                    chars += sum(len(x) for x in r if isinstance(x, str))
                    if len(rows) == PART or chars > CHARS:
                        yield part(own, at, rows)
                        at, rows, chars = [], [], 0
            if rows:
                yield part(own, at, rows)

    return p.mapInArrow(run, schema)


def replace_text(pages: DataFrame, keys: list[str], old: str, new: str, fonts: DataFrame | None = None, content: str = "content") -> DataFrame:
    """(keys, content, way): streams with ``old`` replaced in shown strings; way is the strategy taken, 0 without a hit.

    The ways are tried by page: whole literal strings; the first place in each array; whole hex strings;
    the first place in the coded strings of each line; in each UTF-16 string; in each line, over
    several operators; in each array with any white space for white space. In an array, what
    lies between the matched pieces goes; kerning before and after stays. Elsewhere every
    operator stays, and strings that the match covers whole become empty.
    ``fonts`` has (keys, font, codes): a map from codes to texts for each font that has one.
    """
    loose = re.compile(r"\s+".join(re.escape(x) for x in old.split()), re.A)
    return _by_page(pages, keys, fonts, content, lambda stream, own: [_replaced(stream, own, old, new, loose)], ["content", "way"], [pa.string(), pa.int32()])


def blank_text(pages: DataFrame, keys: list[str], old: str, fonts: DataFrame | None = None, content: str = "content") -> DataFrame:
    """(keys, content, way): streams with every shown ``old`` replaced by as many spaces, in strings, arrays and coded lines.

    Each string keeps its length and arrays their kerning.
    """
    return _by_page(pages, keys, fonts, content, lambda stream, own: [_blanked(stream, own, old)], ["content", "way"], [pa.string(), pa.int32()])


def shown_lines(pages: DataFrame, keys: list[str], fonts: DataFrame | None = None, content: str = "content") -> DataFrame:
    """(keys, line, text, n_strings): what each line of the streams shows."""
    return _by_page(pages, keys, fonts, content, _lines, ["line", "text", "n_strings"], [pa.int64(), pa.string(), pa.int64()])
