"""Personal data by a semi-Markov conditional random field.

Two layers. The base layer is four patterns with checks (email, ip, card, phone).
The field then looks at lines that hold digits or ``@`` and labels whole
segments: a segment of up to ``LONGEST`` tokens gets features of its entire text
(shape, digit count, checksum, separators, the words before it), a weight for each
feature and kind, and a transition weight from the kind of the entity before it on
the line to its own. Dynamic programming over (end, length, kind before, kind) finds
the best segmentation, so boundaries and kinds are chosen together. Its segments that
touch no base span are added; base spans stay.

An entity of the field holds a digit or ``@`` and has ``LEAST_CHARS`` to ``MOST_CHARS``
characters; that bounds the candidates of each token, whatever the text.

Weights are fitted here by gradient ascent on the conditional log-likelihood over
sentences made from templates with a fixed seed (``N_TRAIN``); forward and backward
sums run over segments and kinds. No document takes part in the fit.

Defined results: a null text is empty; an empty table gives an empty result; rows
that repeat are judged each on its own; other columns are ignored. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the field finds follow the base kinds.
KINDS = (*BASE, "secret", "account")
LONGEST = 18
LEAST_CHARS, MOST_CHARS = 6, 200
N_TRAIN = 400
SEED = 7

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\W_]+|[ \t]+|\s|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the four patterns, by kind, then start."""
    out = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):  # the local part ends at @, so it is read leftwards
            at = i = m.start()
            while i > end and text[i - 1] in _LOCAL:
                i -= 1
            if i < at:
                out.append((0, i, m.end()))
                end = m.end()
    if _HIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m.group().split("."))):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


# ---- features of a whole segment


_KEYS = (
    (re.compile(r"(?:token|key|secret|passw(?:or)?d|bearer|apikey)\W{0,6}$", re.I), "ctx_secret"),
    (re.compile(r"(?:iban|account|konto|compte|cuenta)\W{0,6}$", re.I), "ctx_account"),
    (re.compile(r"(?:phone|tel|call|fax|mobile|tél|teléfono|telefon)\W{0,6}$", re.I), "ctx_phone"),
    (re.compile(r"(?:e-?mail|contact|write to)\W{0,6}$", re.I), "ctx_email"),
    (re.compile(r"(?:card|visa|carte|tarjeta|karte)\W{0,6}$", re.I), "ctx_card"),
    (re.compile(r"(?:ip|host|address|server)\W{0,6}$", re.I), "ctx_ip"),
)
_SHAPES = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "is_email"),
    (re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]?@[\])]? ?[A-Za-z0-9-]+ ?(?:[\[(]?(?:\.|dot)[\])]? ?[A-Za-z0-9-]+)+"), "is_spaced_email"),
    (re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), "is_ip"),
    (re.compile(r"[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7}"), "is_ip6"),
    (re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){2,3}[ -]?[0-9]{0,4}"), "is_card"),
    (re.compile(r"\+[0-9][0-9 ().-]+[0-9]"), "is_phone"),
    (re.compile(r"(?:\([0-9]{2,4}\)|0[0-9]{1,4})[ -/]?[0-9]{3,4}[ -]?[0-9]{3,5}"), "is_local_phone"),
    (re.compile(r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}"), "is_local_phone"),
    (re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})"), "is_hex"),
    (re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"), "is_iban"),
    (re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"), "is_date"),
    (re.compile(r"[0-9]+(?:[.,][0-9]+)?"), "is_number"),
)


def features(segment: str, before: str, after: str) -> list[str]:
    """Of a whole candidate: its text, what stands before it and the next character."""
    out = ["bias"]
    out += dict.fromkeys(name for shape, name in _SHAPES if shape.fullmatch(segment))
    digits = sum(c.isdigit() for c in segment)
    out.append(f"digits_{min(digits, 20) // 4}")
    letters = sum(c.isalpha() for c in segment)
    if not letters:
        out.append("no_letters")
    elif digits and digits + letters == len(segment) >= 20:
        out.append("long_mixed")
    if 13 <= digits <= 19 and not letters:
        out.append("checksum" if luhn("".join(c for c in segment if "0" <= c <= "9")) else "no_checksum")
    if segment[0] == "+":
        out.append("plus")
    if "@" in segment:
        out.append("has_at")
    if len(out) > 3:
        out += [name for key, name in _KEYS if key.search(before)]
    if (before[-1:].isalnum() and segment[0].isalnum()) or (after[:1].isalnum() and segment[-1].isalnum()) or before[-1:] in tuple("+.@_-"):
        out.append("cut")
    if after[:1] in tuple("@_") or (after[:1] in tuple("-.") and after[1:2].isalnum()):
        out.append("cut")
    return out


def _tokens(text: str, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, low, len(text) if high is None else high)]


def _candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """Features of each segment of tokens that may be an entity: it holds a digit or ``@``, no blank at its ends and no line feed."""
    solid = [not text[s:e].isspace() for s, e in tokens]
    hits = [1 if _HIT.search(text, s, e) else 0 for s, e in tokens]
    total = [0]
    for h in hits:
        total.append(total[-1] + h)
    for i, (s, _) in enumerate(tokens):
        if total[min(i + LONGEST, len(tokens))] == total[i] or not solid[i] or not (text[s].isalnum() or text[s] in "+("):
            continue
        before = text[max(0, s - 24) : s]
        for j in range(i, min(i + LONGEST, len(tokens))):
            e = tokens[j][1]
            if text[e - 1] == "\n" or e - s > MOST_CHARS:
                break
            if total[j + 1] > total[i] and text[e - 1].isalnum() and e - s >= LEAST_CHARS:
                yield (i, j + 1), features(text[s:e], before, text[e : e + 2])


# ---- the field: kind 0 is no entity (single tokens), kind k is KINDS[k - 1]


def _sum(xs: list[float]) -> float:
    m = max(xs)
    return m if m == -math.inf else m + math.log(sum(math.exp(x - m) for x in xs))


def _scores(found: Iterable, weights: dict) -> Iterator[tuple[int, int, list[float]]]:
    return ((i, j, [sum(weights.get((f, k), 0.0) for f in feats) for k in range(1, len(KINDS) + 1)]) for (i, j), feats in found)


def _transitions(weights: dict) -> list[list[float]]:
    """Weight of each kind (column) after each kind of the entity before it (row); row 0: it is the line's first."""
    return [[weights.get(("after", a, b), 0.0) for b in range(1, len(KINDS) + 1)] for a in range(len(KINDS) + 1)]


def _forward(n: int, scored: list, steps: list[list[float]], join) -> tuple[list[list[float]], list]:
    """Sums (or maxima) over segmentations up to each token, by the kind of the last entity; and the segments by end."""
    ends: list[list] = [[] for _ in range(n + 1)]
    for i, j, s in scored:
        ends[j].append((i, s))
    a = [[0.0] + [-math.inf] * len(KINDS)]
    for t in range(1, n + 1):
        row = a[t - 1]  # an outside token leaves the kind before it as it is
        if ends[t]:
            row = list(row)
            for b in range(len(KINDS)):
                row[b + 1] = join([row[b + 1]] + [join([x + y[b] for x, y in zip(a[i], steps)]) + s[b] for i, s in ends[t]])
        a.append(row)
    return a, ends


def _backward(n: int, scored: list, steps: list[list[float]]) -> list[list[float]]:
    """Sums over what may follow each token, by the kind of the last entity before."""
    starts: list[list] = [[] for _ in range(n + 1)]
    for i, j, s in scored:
        starts[i].append((j, s))
    b = [[0.0] * (len(KINDS) + 1)]
    for t in range(n - 1, -1, -1):
        row = b[-1]
        if starts[t]:
            later = [[s[k] + b[n - j][k + 1] for k in range(len(KINDS))] for j, s in starts[t]]
            row = [_sum([row[a]] + [steps[a][k] + x[k] for x in later for k in range(len(KINDS))]) for a in range(len(KINDS) + 1)]
        b.append(row)
    return b[::-1]


def segment(text: str, weights: dict, low: int = 0, high: int | None = None) -> list[tuple[int, int, int]]:
    """Best segmentation of the text from low to high: (kind number from 0, start, end) of its entities."""
    tokens = _tokens(text, low, high)
    steps = _transitions(weights)
    most = max(0.0, max(map(max, steps)))
    # a segment worth less than all that its two transitions can give loses to outside tokens
    scored = [x for x in _scores(_candidates(text, tokens), weights) if max(x[2]) > -3 * most]
    if not scored:
        return []
    a, ends = _forward(len(tokens), scored, steps, max)
    out = []
    t = len(tokens)
    kind = max(range(len(KINDS) + 1), key=lambda k: a[t][k])
    while t > 0 and kind:
        if a[t][kind] == a[t - 1][kind]:
            t -= 1
            continue
        value, i, before = max(((a[i][k] + steps[k][kind - 1] + s[kind - 1], i, k) for i, s in ends[t] for k in range(len(KINDS) + 1)), key=lambda c: c[0])
        out.append((kind - 1, tokens[i][0], tokens[t - 1][1]))
        t, kind = i, before
    return out[::-1]


def _gradient(tokens: list, found: dict, gold: set[tuple[int, int, int]], weights: dict, grad: dict) -> None:
    """Adds observed less expected counts of features and transitions of one sentence."""
    n, steps = len(tokens), _transitions(weights)
    scored = list(_scores(found.items(), weights))
    a, _ = _forward(n, scored, steps, _sum)
    b = _backward(n, scored, steps)
    z = _sum(a[n])
    for i, j, s in scored:
        for k, x in enumerate(s):
            ways = [a[i][q] + steps[q][k] + x + b[j][k + 1] - z for q in range(len(KINDS) + 1)]
            p = 0.0
            for q, w in enumerate(ways):
                if w > -14:
                    w = math.exp(min(0.0, w))
                    p += w
                    grad["after", q, k + 1] = grad.get(("after", q, k + 1), 0.0) - w
            y = (k, tokens[i][0], tokens[j - 1][1]) in gold
            if y or p > 1e-6:
                for f in found[i, j]:
                    grad[f, k + 1] = grad.get((f, k + 1), 0.0) + y - p
    before = 0
    for k, _, _ in sorted(gold, key=lambda g: g[1]):
        grad["after", before, k + 1] = grad.get(("after", before, k + 1), 0.0) + 1
        before = k + 1


_FILL = "the and of to in is that for with are reou thing ander le la de et que der die und mit el los por con note see page item value order room about".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    d = r.choice("3456") + _digits(r, 14)
    return d + next(x for x in "0123456789" if luhn(d + x))


def _made(r: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    """A sentence from templates and its entities."""
    text, gold = "", set()

    def say(x: str, kind: int | None = None) -> None:
        nonlocal text
        if kind is not None:
            gold.add((kind, len(text), len(text) + len(x)))
        text += x

    def fill(n: int) -> None:
        for _ in range(n):
            say(r.choice(_FILL) + r.choice([" "] * 8 + [", ", ". "]))

    fill(r.randint(0, 4))
    for _ in range(r.randint(1, 3)):
        word = r.choice(_FILL)
        kind = r.randrange(16)
        if kind == 0:
            say(r.choice(["", "", "mail: ", "contact "]))
            say(f"{word}{r.choice(['.', '', '_', '-'])}{_digits(r, 2)}@{r.choice(['mail', 'host', ''])}{r.randint(0, 9)}.example.{r.choice(['com', 'org'])}", 0)
        elif kind == 1:
            say(f"{word}{_digits(r, 2)} {r.choice(['@', '(@)', '[@]'])} mail{r.randint(0, 9)}.example.com", 0)
        elif kind == 2:
            say(".".join(str(r.randint(0, 255)) for _ in range(4)), 1)
        elif kind == 3:
            c = _card(r)
            say(r.choice(["", "card "]))
            say(r.choice([c, " ".join(c[i : i + 4] for i in (0, 4, 8, 12)), "-".join(c[i : i + 4] for i in (0, 4, 8, 12))]), 2)
        elif kind == 4:
            say(r.choice(["", "tel ", "phone: "]))
            say(f"+{r.randint(1, 99)} ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", 3)
        elif kind == 5:
            say(r.choice(["tel. ", "call ", "phone: "]))
            say(r.choice([f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}"]), 3)
        elif kind == 6:
            say(r.choice(['token = "', "key: ", "secret=", 'token = "']))
            say("".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 64]))), 4)
            say(r.choice(['"', ""]))
        elif kind == 7:
            say(r.choice(["iban ", "IBAN: ", ""]))
            x = r.choice(["DE", "FR", "ES"]) + _digits(r, 20)
            say(r.choice([x, " ".join(x[i : i + 4] for i in range(0, 22, 4))]), 5)
        elif kind == 8:
            say(f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}")
        elif kind == 9:
            say(r.choice([_digits(r, r.randint(1, 9)), f"{_digits(r, 3)}.{_digits(r, 2)}", f"{_digits(r, 2)},{_digits(r, 3)},{_digits(r, 3)}"]))
        elif kind == 10:
            say(f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}")
        elif kind == 11:
            say(f"{_digits(r, 4)} {_digits(r, 2)} {_digits(r, 5)} {_digits(r, 3)}")
        elif kind == 12:
            say(_digits(r, r.choice([10, 12, 14, 20, 24])))
        elif kind == 13:  # a bare number of a phone's shape is one only after an address
            say(f"{word}.{r.choice(_FILL)}{_digits(r, 1)}@mail{r.randint(0, 9)}.example.com", 0)
            say(r.choice([", ", " ", "; "]))
            say(f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}", 3)
        elif kind == 14:
            say(f"{r.choice(['part', 'order', 'page', 'item', 'lot'])} {_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}")
        else:
            say(f"{word}{_digits(r, 2)}-{_digits(r, 3)}/{_digits(r, 2)} ISBN {_digits(r, 3)}-{_digits(r, 1)}-{_digits(r, 4)}")
        say(r.choice([" ", ", ", ". ", "\n", ") "]))
        fill(r.randint(0, 3))
    return text, gold


@lru_cache(maxsize=1)
def fitted(n: int = N_TRAIN, rounds: int = 4, rate: float = 0.5, decay: float = 1e-4) -> dict:
    """Weights by (feature, kind) and by ("after", kind before, kind), the same in every run."""
    r = random.Random(SEED)
    made = [(tokens, dict(_candidates(text, tokens)), gold) for text, gold in (_made(r) for _ in range(n)) for tokens in [_tokens(text)]]
    weights: dict = {("bias", k): -2.0 for k in range(1, len(KINDS) + 1)}
    squares: dict = {}
    for _ in range(rounds):
        for at in range(0, n, 20):
            grad: dict = {}
            for tokens, found, gold in made[at : at + 20]:
                if found:
                    _gradient(tokens, found, gold, weights, grad)
            for f, g in sorted(grad.items(), key=str):
                squares[f] = squares.get(f, 1.0) + g * g
                weights[f] = weights.get(f, 0.0) * (1 - decay) + rate * g / math.sqrt(squares[f])
    return weights


def field_spans(text: str, weights: dict) -> list[tuple[int, int, int]]:
    """Spans of the field in a whole text.

    Segments hold no line feed, so each line with a hit is segmented on its own and
    as a whole; the result is that of the whole text at once.
    """
    out = []
    at = 0
    while hit := _HIT.search(text, at):
        low = text.rfind("\n", 0, hit.start()) + 1
        high = text.find("\n", hit.end())
        high = len(text) if high < 0 else high
        out += segment(text, weights, low, high)
        at = high
    return out


def spans(text: str | None, weights: dict) -> tuple[list, list]:
    """(base spans, all spans), each by kind, then start."""
    text = text or ""
    base = base_spans(text)
    taken = [(s, e) for _, s, e in base]
    extra = []
    if _HIT.search(text):
        for k, s, e in field_spans(text, weights):
            if not any(s < y and x < e for x, y in taken):
                taken.append((s, e))
                extra.append((k, s, e))
    return base, sorted(base + extra) if extra else base


def _written(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def masked(text: str | None, found: list) -> str | None:
    """The text with each span replaced by its kind in brackets; overlaps are joined."""
    if not text or not found:
        return text
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in found):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op2."""
    weights = fitted()

    def make():
        def one(i, text):
            base, found = spans(text, weights)
            n = [sum(k == x for x, _, _ in base) for k in range(len(BASE))]
            return (i, *n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(found))

        return lambda rows: [one(*r) for r in rows]

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(rows, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data masked in its text; n_chars follows if it is there."""
    weights = fitted()

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: masked(t, spans(t, weights)[1]) if t else t)

    out = docs.withColumn(text, clean(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
