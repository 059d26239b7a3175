"""URL filter by a bit-parallel wildcard automaton.

Glob rules are compiled into one Shift-And machine: each pattern character is a bit
of a row of 64-bit words, and one step over a URL's character moves all rules at once.
``?`` is any character, ``*`` any run without a slash, ``**`` any run. Stars are no
positions of their own: they let the state before them stay alive (a self-loop mask),
so a step is ``((D << 1 | start) & table[c]) | (D & loops[c])``, with the carry between words.
A batch of URLs is simulated at once, one character column after the other.

A rule ``host/path`` fits its host and all subdomains and the paths that start with
its path. As globs over the canonical URL (lower-cased host, then path) it is
``host/path**`` and ``**.host/path**`` with a star that can't leave the host. The longest
rule that fits decides; where none does, the longest of the deny globs; else the URL
is allowed.

Defined results: a null url or one without ``://`` has an empty host and path, fits no
rule and is allowed; repeated rows are judged each on its own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Verdict by rule.
RULES: dict[str, str] = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: The method's own rules over host and path, for URLs that no rule decides.
DENY: tuple[str, ...] = ("ads.**", "**.ads.**", "**/ads/**", "**/track/**", "**/tracker/**", "doubleclick.*/**", "**.doubleclick.*/**", "**/login", "**/login/**", "**/cart/**", "**.exe", "**.zip")
#: Characters that one call of the simulation takes: URLs times length.
CELLS = 4_000_000


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:stop]


def globs(rule: str) -> tuple[str, str]:
    """The two patterns of a host/path rule: the host itself, its subdomains."""
    plain = "".join("[" + c + "]" if c in "*?[" else c for c in rule)
    return plain + "**", "*." + plain + "**"


@dataclass
class _Atom:
    char: str | None  # None: any
    loop: int = 0  # what may follow any number of times: 1 without slash, 2 anything


def _parse(glob: str) -> tuple[int, list[_Atom]]:
    """(loop before the first character, the characters with the loops after them)."""
    first, atoms, i = 0, [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            kind = 2 if glob[i : i + 2] == "**" else 1
            i += kind
            if atoms:
                atoms[-1].loop = max(atoms[-1].loop, kind)
            else:
                first = max(first, kind)
            continue
        if c == "[":  # [c] stands for the character itself
            c, i = glob[i + 1], i + 2
            atoms.append(_Atom(c))
        else:
            atoms.append(_Atom(None if c == "?" else c))
        i += 1
    return first, atoms


class Automaton:
    """All globs as one machine; a glob must match a whole string."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        parsed = [_parse(p) for p in patterns]
        # bit 0 of a pattern is "nothing read yet", so that a leading star can loop there
        size = sum(len(a) + 1 for _, a in parsed)
        self.words = -(-size // 64)
        chars = sorted({x.char for _, a in parsed for x in a if x.char is not None} | {"/"})
        self.code = {c: i for i, c in enumerate(chars)}
        n = len(chars) + 1  # the last class is any other character
        table = np.zeros((n, self.words), np.uint64)
        loops = np.zeros((n, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends = []
        slash = self.code["/"]

        def put(row: np.ndarray, bit: int) -> None:
            row[bit // 64] |= np.uint64(1 << bit % 64)

        bit = 0
        for first, atoms in parsed:
            put(self.start, bit)
            for k, (char, loop) in enumerate([(None, first), *((x.char, x.loop) for x in atoms)]):
                for c in range(n):
                    if k and (char is None or self.code[char] == c):
                        put(table[c], bit)
                    if loop == 2 or loop == 1 and c != slash:
                        put(loops[c], bit)
                bit += 1
            self.ends.append(bit - 1)
        self.table, self.loops = table, loops
        points = np.full(0x110000, n - 1, np.uint16 if n > 255 else np.uint8)
        for c, i in self.code.items():
            points[ord(c)] = i
        self.points = points

    def run(self, strings: list[str]) -> np.ndarray:
        """Whether each pattern matches each string: strings x patterns."""
        out = np.zeros((len(strings), len(self.patterns)), bool)
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))  # those still running stand first
        at = 0
        while at < len(order):
            step = max(1, CELLS // max(1, len(strings[order[at]])))
            mine = order[at : at + step]
            out[mine] = self._run([strings[i] for i in mine])
            at += step
        return out

    def _run(self, strings: list[str]) -> np.ndarray:
        size = np.array([len(s) for s in strings])
        flat = self.points[np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)]
        offset = np.r_[0, np.cumsum(size)[:-1]]
        state = np.tile(self.start, (len(strings), 1))
        running = np.searchsorted(-size, -np.arange(size.max() if len(size) else 0), side="left")
        for k, n in enumerate(running):
            c = flat[offset[:n] + k]
            d = state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.table[c]) | (d & self.loops[c])
        ends = np.array(self.ends)
        return (state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1) == 1


class Judge:
    def __init__(self, rules: dict[str, str] = RULES, deny: tuple[str, ...] = DENY):
        self.rules, self.names = rules, sorted(rules, key=lambda r: (-len(r), r))
        pairs = [globs(r) for r in self.names]
        self.deny = sorted(deny, key=lambda p: (-len(p), p))
        # subdomains are any run that doesn't leave the host
        self.machine = Automaton([p for pair in pairs for p in pair] + self.deny)

    def __call__(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str, str | None]]:
        """(host, path, rule, verdict, deny glob) of each url."""
        parts = [canonical(u) for u in urls]
        hit = self.machine.run([h + p for h, p in parts])
        n = len(self.names)
        by_rule = hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2]
        by_deny = hit[:, 2 * n :]
        out = []
        for (host, path), r, d in zip(parts, by_rule, by_deny):
            rule = self.names[int(r.argmax())] if r.any() else None
            glob = self.deny[int(d.argmax())] if rule is None and host and d.any() else None
            out.append((host, path, rule, self.rules[rule] if rule else "block" if glob else "allow", glob))
        return out


def digest(pages: DataFrame, rules: dict[str, str] = RULES, deny: tuple[str, ...] = DENY) -> DataFrame:
    """The rows of op8."""

    def make():
        judge = Judge(rules, deny)
        return lambda rows: [(i, *x) for (i, _), x in zip(rows, judge([u for _, u in rows]))]

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    found = map_rows(rows, make, "page_id long, host string, path string, rule string, verdict string, glob string")
    return found.drop("glob")


ORACLE = r"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM b
)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' ELSE
    CASE WHEN host <> '' AND regexp_matches(host || path, '(^|\.)ads\.|/(ads|track|tracker|login|cart)/|(^|\.)doubleclick\.[^/]*/|/login$|\.(exe|zip)$') THEN 'block' ELSE 'allow' END END AS verdict
FROM c
"""
