"""Byte-level BPE encoding and decoding by batched merge rounds.

Texts are split at special tokens and then by the vocabulary's pattern. Pieces not
seen before are encoded together: the symbols of all of them lie in one flat array
with the number of their word. A round looks up every adjacent pair by binary search
in the sorted pair keys, finds each word's lowest rank, and merges that pair
wherever it stands in the word, left to right. A word leaves when no pair of it is
known; very long words take their merges from a heap instead, in the same order. Merging all places of a word's lowest pair at once gives the same as one
after the other, since a new pair holds the new symbol and so has a higher rank.

The ids of a piece are kept as little-endian bytes in a bounded table in each
worker, and so are those of units: a run without blanks and the single space before
it, or a line feed. Cuts never cross from a unit to the next, so a text's ids are a
concatenation of its units'. Texts with other blanks between runs, or with special
tokens, are cut as a whole. Decoding maps ids to their bytes and
reads UTF-8, with replacement characters where it is broken.

Defined results: a null or empty text has no ids and decodes to an empty text; an
empty table gives an empty result; rows that repeat are encoded each on its own;
other columns are ignored. The vocabulary file is a parameter; it must lie at the
same path on all machines and is never copied.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Fixed by the file format: how pieces are cut.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern's white space is the White_Space property, without the four information separators.
_SPACE = r"\t\n\x0B\f\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Bytes of pieces and ids in each of the two generations of a worker's tables, and symbols that one batch of rounds takes.
KEPT = 48_000_000
FLAT = 1_000_000
#: Bytes of a word from which its merges are taken from a heap: rounds go over the whole word for each rank.
LONG = 2_000
#: Rough bytes of an entry beside its text and ids.
ENTRY = 150


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: itself if printable, else from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Table(dict):
    """A table in two generations: when the younger one is full it becomes the older, which goes; what is asked for again moves up.

    Keys in neither are noted and stand for empty bytes.
    """

    def __init__(self):
        self.old: dict = {}
        self.held = 0
        self.missing: list = []

    def __missing__(self, key):
        found = self.old.get(key, b"")
        if found == b"":
            self.missing.append(key)
        else:
            self.put(key, found)
        return found

    def has(self, key) -> bool:
        if key in self:
            return True
        if key in self.old:
            self.put(key, self.old[key])
            return True
        return False

    def put(self, key, value) -> None:
        self[key] = value
        self.held += len(key) + len(value or b"") + ENTRY

    def age(self) -> None:
        if self.held > KEPT:
            self.old = dict(self)
            self.clear()
            self.held = 0


def _odd(unit: str) -> bool:
    """Whether a unit's cuts may depend on what stands beside it: empty, a lone space, blanks at its ends."""
    return unit != "\n" and (unit in ("", " ") or unit[-1].isspace() or unit[0] != " " and unit[0].isspace() or unit[1:2].isspace())


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.bytes_of = [bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        self.id_of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.id_of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[p[0] + p[1]] for p in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order][1:] != key[order][:-1]]
        self.keys, self.rank, self.made = key[order][first], order[first], made[order][first]
        pattern = PATTERN.replace(r"\s", f"[{_SPACE}]").replace(f"[^[{_SPACE}]", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]")
        self.cut = regex.compile(pattern).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known, self.units = _Table(), _Table()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; the highest integer where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], np.iinfo(np.int64).max), self.made[at]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (none is empty), by rounds over all of them."""
        size = np.array([len(w) for w in words])
        sym = self.id_of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        none = np.iinfo(np.int64).max
        done_sym, done_word = [], []
        while len(sym):
            rank, made = self.ranks(sym[:-1], sym[1:])
            rank[word[:-1] != word[1:]] = none
            low = np.full(len(words), none)
            np.minimum.at(low, word[:-1], rank)
            over = low[word] == none  # the whole word is ready
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                rank = np.append(rank, none)[keep][:-1] if keep.any() else rank[:0]
                made = np.append(made, 0)[keep][:-1] if keep.any() else made[:0]
                sym, word = sym[keep], word[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low[word[:-1]])
            # of overlapping places (a pair of equal symbols) every second one, from the left
            run = np.r_[True, np.diff(hit) != 1]
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            sym[hit] = made[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat = sym[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one long word: the lowest rank, leftmost first, from a heap over a linked list of symbols."""
        sym = self.id_of_byte[np.frombuffer(word, np.uint8)]
        rank, made = self.ranks(sym[:-1], sym[1:])
        none = np.iinfo(np.int64).max
        sym, before, after = sym.tolist(), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap = [(r, i, m, sym[i], sym[i + 1]) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist())) if r != none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int, j: int) -> None:
            pair = sym[i], sym[j]
            if pair not in known:
                r, m = self.ranks(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(r[0]), int(m[0])
            r, m = known[pair]
            if r != none:
                heapq.heappush(heap, (r, i, m, *pair))

        while heap:
            _, i, m, x, y = heapq.heappop(heap)
            j = after[i]
            if sym[i] != x or j < 0 or sym[j] != y:  # one of the two has been merged since
                continue
            sym[i], sym[j], after[i] = m, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in sym if x >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Adds pieces to the table of known ones."""
        self.known.age()
        fresh = [p for p in pieces if not self.known.has(p)]
        for p in [p for p in fresh if len(p) >= LONG]:
            self.known.put(p, self.merge_long(p.encode("utf-8", "surrogatepass")))
        fresh = [p for p in fresh if len(p) < LONG]
        at = 0
        while at < len(fresh):
            some, held = [], 0
            while at < len(fresh) and (not some or held < FLAT):
                some.append(fresh[at])
                held += len(fresh[at])
                at += 1
            for p, ids in zip(some, self.merge([p.encode("utf-8", "surrogatepass") for p in some])):
                self.known.put(p, ids)

    def _whole(self, text: str) -> bytes:
        """Ids of a text that is cut as a whole."""
        out = []
        for part in self.parts(text) if self.parts else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                pieces = self.cut(part)
                self.learn(set(pieces))
                out += map(self.known.__getitem__, pieces)
        return b"".join(out)

    def _learn_units(self, units: set[str]) -> None:
        self.units.age()
        cuts = {u: self.cut(u) for u in units if not _odd(u)}
        self.learn({p for c in cuts.values() for p in c})
        get = self.known.__getitem__
        for u in units:
            self.units.put(u, b"".join(map(get, cuts[u])) if u in cuts else None)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut: list[list[str] | None] = []
        for t in texts:
            t = t or ""
            whole = "\0" in t or any(s in t for s in self.special)
            cut.append(None if whole else t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))
        missing = self.units.missing = []
        get = self.units.__getitem__
        found = []  # by text: the ids of each unit; empty bytes where it is new, None where it is odd
        for units in cut:
            found.append(list(map(get, units)) if units else None)
        if missing:
            self._learn_units(set(missing))
            self.units.missing = []
        out = []
        for t, units, ids in zip(texts, cut, found):
            if ids is not None and b"" in ids:
                ids = [x if x != b"" else get(u) for x, u in zip(ids, units)]
            if ids is None or None in ids or b"" in ids:
                out.append(self._whole(t) if t else b"")
            else:
                out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def opened(path: str) -> Bpe:
    """One coder for each file and worker process."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as bytes of little-endian unsigned 32-bit integers."""

    def make():
        coder = opened(path)

        def work(rows):
            return [(i, len(b) // 4, b) for (i, _), b in zip(rows, coder.encode([t for _, t in rows]))]

        return work

    return map_rows(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")), make, "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text)."""

    def make():
        coder = opened(path)
        return lambda rows: [(*r, coder.decode(r[2] or b"")) for r in rows]

    return map_rows(coded.select("doc_id", "n_tokens", "ids"), make, "doc_id long, n_tokens long, ids binary, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of op6: encoded, then decoded from the ids."""
    path = path or default_path()

    def make():
        coder = opened(path)

        def work(rows):
            sha = hashlib.sha256
            return [(i, len(b) // 4, sha(b).hexdigest(), sha(coder.decode(b).encode()).hexdigest()) for (i, _), b in zip(rows, coder.encode([t for _, t in rows]))]

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
