"""Language-model scores from a log-frequency Bloom filter.

The filter holds words and pairs of words with quantised counts: a count of level q
(levels grow by a factor of ``BASE``) is stored as q entries, the n-gram with 1, ..., q. A look-up
asks for 1, 2, ... until one is missing; the level found stands for the mean of its counts. Stored
n-grams never get too low a level, others get level 1 with a chance of about 2^-``PROBES`` and
more with powers of that. The probability of a word after another one is

    P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU),   P(w) = (c(w) + s / (V + 1)) / (N + s)

where c are the filter's counts (a pair's never above its words'), N all training tokens, V
the distinct ones and s the number of those seen once. A text is its words and one end, and starts
after an end. ``base_score`` uses exact counts of words and add-one smoothing instead.

Plan. Tasks count the n-grams of pieces of text and send sorted arrays of (hash, count) to
segments, ranges of the hash; one shuffle. A segment merges them exactly, keeps the words' counts and
the pairs' levels (checkpointed) and makes its own part of the filter, sized by its entries.
So the filter follows the corpus; its parts are collected and broadcast, with the words' counts,
while they stay within ``FILTER_MOST`` bytes and ``WORDS_MOST`` words, which is known from
merged statistics before anything is sent. Beyond that, only n-grams of at least some level are sent
(frequent ones: as many as fit the bound; their first level is stored with ``FIRM`` times the probes, so
that a rare one passes for them once in 16 million), and the rest, which are rare and so have
no hot key, are looked up by a shuffle. Texts are dealt into buckets by a hash, of about ``ASK_BYTES`` each; a bucket sends its distinct rare
n-grams, sorted, to ranges of ``SHARE`` segments, whose own filters answer with a level for each in the same order.
The bucket finds the same n-grams again when it is scored, so the answer needs no keys.

Words are told apart by 64-bit hashes: in a million million pairs of words one pair in 18 million
would share one.

Defined results: null texts are empty; an empty text has one token, its end; rows that
repeat are counted and scored each; a row without id is not learned from and not held out; without
anything learned all scores are 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, tidied

BASE = 1.5
LEVELS = 100
PROBES = 6
#: Bits for each entry of the filter.
BITS = 9
#: Where a filter starts at a higher level, its first entries have so many times the probes and bits.
FIRM = 4
MU = 100.0
#: Bytes of text that a task counts and scores at once, and that a segment stands for.
PIECE_BYTES = 8 << 20
SCORE_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 20
#: Bytes of text of a bucket whose rare n-grams are looked up at once, and segments that answer together.
ASK_BYTES = 4 << 20
SHARE = 16
#: Bounds of what is broadcast.
FILTER_MOST = 192 << 20
WORDS_MOST = 8_000_000
#: Parts of the broadcast filter at most; beyond, several segments share one.
PARTS_MOST = 4096

END = b""
#: Least count of each level; a level's value is the mean of the counts that it holds.
LEAST = np.unique(np.ceil(BASE ** np.arange(LEVELS) - 1e-9).astype(np.int64))
MEAN = np.concatenate([[0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2, [float(LEAST[-1])]])
_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 7 == 2


def words(text: str | None) -> list[bytes]:
    """What stands between white space (exactly that of ASCII), with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, side="right").astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each number spread over all 64."""
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(s))) * _U(m)
    return x ^ (x >> _U(31))


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _U(0x9E3779B97F4A7C15) + second)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Ranges of the hash, so that sorted hashes are sorted by segment. Numbers of segments are powers of two: fewer ones hold whole ranges of more."""
    return ((hashes >> _U(32)) * _U(segments)) >> _U(32)


class Piece:
    """Words of some texts as numbers: each text is an end, its words and an end."""

    def __init__(self, texts: list[str | None]):
        lower = pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string()))
        split = pc.ascii_split_whitespace(lower)  # white space of ASCII, as in words()
        parts = split.flatten()
        real = pc.greater(pc.binary_length(parts), 0)
        of = np.asarray(pc.list_parent_indices(split).filter(real))
        coded = parts.filter(real).dictionary_encode()
        end = len(coded.dictionary)
        sizes = np.bincount(of, minlength=len(texts)) + 1
        at = np.full(len(of) + 2 * len(texts), end, np.int64)  # an end on both sides of each text
        at[np.arange(len(of)) + 2 * of + 1] = np.asarray(coded.indices)
        self.word = np.fromiter((xxh64_intdigest(w) for w in [*coded.dictionary.cast(pa.large_binary()).to_pylist(), END]), np.uint64, end + 1)
        self.sizes = sizes.astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        keep = np.ones(len(at), bool)
        keep[starts] = False
        here = np.flatnonzero(keep)
        self.token, self.before = at[here], at[here - 1]
        self.first = starts - np.arange(len(starts))  # of each text among the tokens
        self.pair = pair(self.word[self.before], self.word[self.token])


def pieces(texts: Iterator[list], most: int | None = None) -> Iterator[list]:
    """Lists of rows (text last) of about PIECE_BYTES of text."""
    held, size = [], 0
    for row in texts:
        held.append(row)
        size += len(row[-1] or "") + 64
        if size >= (most or PIECE_BYTES):
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(lo, 256).columns))


def counted(docs: DataFrame, segments: int) -> DataFrame:
    """(segment, size, hashes, counts): sorted n-grams of one piece, by segment; size 1 for words, 2 for pairs."""
    names = ["segment", "size", "hashes", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(_rows(batches)):
            p = Piece([r[0] for r in rows])
            n = np.bincount(p.token, minlength=len(p.word))
            order = np.argsort(p.word)
            order = order[n[order] > 0]
            out = []
            for size, (h, c) in ((1, (p.word[order], n[order])), (2, np.unique(p.pair, return_counts=True))):
                cuts = np.searchsorted(segment_of(h, segments), np.arange(segments + 1, dtype=np.uint64))
                out += [(s, size, h[a:b].tobytes(), c[a:b].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=names)

    return docs.mapInArrow(tidied(run), "segment int, size int, hashes binary, counts binary")


def _sum(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.concatenate([np.frombuffer(a, np.uint64) for a, _ in parts])
    c = np.concatenate([np.frombuffer(b, np.uint32) for _, b in parts]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[new], np.add.reduceat(c, new)


def merged(parts: DataFrame) -> DataFrame:
    """(segment, tokens, distinct, once, words, word_counts, pairs, levels, by_level, words_by_level): a row for each segment."""
    schema = "segment int, tokens long, distinct long, once long, words binary, word_counts binary, pairs binary, levels binary, by_level array<long>, words_by_level array<long>"
    types = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]
    names = [x.split()[0] for x in schema.split(", ")]

    def end(segment: int, held: dict[int, list]) -> pa.RecordBatch:
        w, n = _sum(held[1])
        g, m = _sum(held[2])
        lw, lg = level(n), level(m)
        by = [np.bincount(x, minlength=LEVELS + 1)[: LEVELS + 1].tolist() for x in (np.concatenate([lw, lg]), lw)]
        row = (segment, int(n.sum()), len(w), int((n == 1).sum()), w.tobytes(), n.tobytes(), g.tobytes(), lg.tobytes(), *by)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {1: [], 2: []}
        for b in batches:
            for segment, size, h, c in zip(*(x.to_pylist() for x in b.columns)):
                if segment != at:
                    if at is not None:
                        yield end(at, held)
                    at, held = segment, {1: [], 2: []}
                held[size].append((h, c))
        if at is not None:
            yield end(at, held)

    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(tidied(run), schema)


def _probe(hashes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the probes for n-grams with level q."""
    x = mixed(hashes + _U((q * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
    return x >> _U(32), (x & _LOW) | _U(1)


def _place(start: np.ndarray, step: np.ndarray, i: int, m) -> np.ndarray:
    """The i-th probe among m bits (fewer than 2^32), without a division."""
    return ((((start + _U(i) * step) & _LOW) * m) >> _U(32)).astype(np.int64)


def probes(q: int, least: int) -> int:
    """A rare n-gram must not pass for one of those that a filter from a higher level on holds."""
    return FIRM * PROBES if q == least > 1 else PROBES


def fill(hashes: np.ndarray, levels: np.ndarray, least: int = 1) -> tuple[int, bytes]:
    """(bits, filter) of n-grams with their levels, from level ``least`` on."""
    n = int(np.maximum(levels.astype(np.int64) - least + 1, 0).sum()) + (least > 1) * (FIRM - 1) * int((levels >= least).sum())
    m = max(64, -(-n * BITS // 8) * 8)
    flags = np.zeros(m, np.uint8)
    for q in range(least, int(levels.max(initial=0)) + 1):
        start, step = _probe(hashes[levels >= q], q)
        for i in range(probes(q, least)):
            flags[_place(start, step, i, _U(m))] = 1
    return m, np.packbits(flags, bitorder="little").tobytes()


def found_levels(hashes: np.ndarray, m: np.ndarray, base: np.ndarray, data: np.ndarray, least: int) -> np.ndarray:
    """Levels of n-grams, 0 for those that are not in the filter: each looks at m bits from byte ``base`` of data on."""
    out = np.zeros(len(hashes), np.uint8)
    rest, h = np.arange(len(hashes)), hashes
    q = least
    while len(rest) and q <= LEVELS:
        start, step = _probe(h, q)
        alive = np.arange(len(h))
        for i in range(probes(q, least)):
            p = _place(start[alive], step[alive], i, m[alive])
            alive = alive[(data[base[alive] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
        rest, h, m, base = rest[alive], h[alive], m[alive], base[alive]
        out[rest] = q
        q += 1
    return out


class Filter:
    """Filters of ranges of the hash, one after another."""

    def __init__(self, ranges: int, parts: list[tuple[int, int, bytes]], least: int = 1):
        self.ranges, self.least = ranges, least
        held = {s: (m, b) for s, m, b in parts}
        blank = 64, bytes(8)
        chunks = [held.get(s, blank) for s in range(ranges)]
        self.bits = np.array([m for m, _ in chunks], np.uint64)
        self.start = np.cumsum([0, *(len(b) for _, b in chunks)])[:-1]
        self.data = np.frombuffer(b"".join(b for _, b in chunks), np.uint8)

    def levels(self, hashes: np.ndarray, ranges: int | None = None, first: int = 0) -> np.ndarray:
        """Levels of n-grams; ranges and first: of how many ranges this one has some, and from which on."""
        at = segment_of(hashes, ranges or self.ranges).astype(np.int64) - first
        return found_levels(hashes, self.bits[at], self.start[at], self.data, self.least)


class Known:
    """What tasks look n-grams up in: the filter and the words' exact counts, most of which fit a byte."""

    def __init__(self, filter: Filter, words: np.ndarray, counts: np.ndarray):
        self.filter, self.words = filter, words  # sorted hashes
        self.few = np.minimum(counts, 255).astype(np.uint8)
        often = counts >= 255
        self.often, self.many = words[often], counts[often]

    def word_counts(self, hashes: np.ndarray) -> np.ndarray:
        few = _look(self.words, self.few, hashes).astype(np.int64)
        return np.where(few == 255, _look(self.often, self.many, hashes), few)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


@dataclass
class Model:
    segments: int
    tokens: int
    distinct: int
    once: int
    parts: DataFrame  # merged()
    by_level: list[int]
    words_by_level: list[int]

    def least(self, filter_most: int, words_most: int) -> int:
        """The least level from on which all n-grams fit the bounds."""
        for q in range(1, LEVELS + 1):
            entries = sum(n * (k - q + 1 + (q > 1) * (FIRM - 1)) for k, n in enumerate(self.by_level) if k >= q)
            if entries * BITS // 8 <= filter_most and sum(self.words_by_level[q:]) <= words_most:
                return q
        return LEVELS

    def known(self, least: int) -> Known:
        """Collected from the segments, within the bounds that ``least`` was chosen by."""
        ranges = min(self.segments, PARTS_MOST)
        share = self.segments // ranges

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for segment, w, n, g, lg in zip(*(x.to_pylist() for x in b.columns)):
                    w, n, g, lg = (np.frombuffer(x, t) for x, t in zip((w, n, g, lg), (np.uint64, np.int64, np.uint64, np.uint8)))
                    lw = level(n)
                    keep, also = lw >= least, lg >= least
                    row = (segment // share, w[keep].tobytes(), n[keep].tobytes(), g[also].tobytes(), lg[also].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 4))], names=["segment", "words", "counts", "pairs", "levels"])

        def make(part: int, held: list[tuple]) -> pa.RecordBatch:
            w, n, g, lg = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate((np.uint64, np.int64, np.uint64, np.uint8)))
            order = np.argsort(w)
            m, bits = fill(np.concatenate([w, g]), np.concatenate([level(n), lg]), least)
            row = (part, m, bits, w[order].tobytes(), n[order].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["segment", "m", "bits", "words", "counts"])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []
            for b in batches:
                for part, *row in zip(*(x.to_pylist() for x in b.columns)):
                    if part != at and held:
                        yield make(at, held)
                        held = []
                    at = part
                    held.append(row)
            if held:
                yield make(at, held)

        rows = self.parts.select("segment", "words", "word_counts", "pairs", "levels").mapInArrow(tidied(pick), "segment int, words binary, counts binary, pairs binary, levels binary")
        if share > 1:
            rows = rows.repartition("segment").sortWithinPartitions("segment")
        found = rows.mapInArrow(tidied(build), "segment int, m long, bits binary, words binary, counts binary")
        got = sorted(found.toLocalIterator(), key=lambda r: r["segment"])
        w = np.frombuffer(b"".join(r["words"] for r in got), np.uint64)  # parts are ranges: sorted
        return Known(Filter(ranges, [(r["segment"], r["m"], r["bits"]) for r in got], least), w, np.frombuffer(b"".join(r["counts"] for r in got), np.int64))


def learn(docs: DataFrame, text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> Model:
    """Counts over all rows of docs."""
    plain = docs.select(F.col(text).cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 << max(0, (-(-size // segment_bytes) - 1).bit_length())
    parts = checkpointed(merged(counted(plain, segments)))
    total = parts.agg(F.sum("tokens"), F.sum("distinct"), F.sum("once"), *[F.sum(F.col(c)[i]) for c in ("by_level", "words_by_level") for i in range(LEVELS + 1)]).first()
    n = [x or 0 for x in total]
    return Model(segments, n[0], n[1], n[2], parts, n[3 : LEVELS + 4], n[LEVELS + 4 :])


def _rare(p: Piece, known: Known) -> np.ndarray:
    """The n-grams that the broadcast filter lacks, sorted: the same for the same texts in any order."""
    pairs = np.unique(p.pair)
    return np.unique(np.concatenate([p.word[known.word_counts(p.word) == 0], pairs[known.filter.levels(pairs) == 0]]))


def _answers(texts: DataFrame, model: Model, sent, share: int = SHARE) -> DataFrame:
    """(bucket, part, levels, places, counts) of a bucket's rare n-grams, from the segments' own filters.

    ``part`` is a range of the hash, so in their order the levels are those of the bucket's ``_rare``; counts stand for the words at ``places`` of their part.
    """
    segments, share = model.segments, min(share, model.segments)
    rows = lambda out, names, types: pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [()] * len(names), types)], names=names)

    def ask(table: pa.Table) -> pa.Table:
        h = _rare(Piece(table["text"].to_pylist()), sent.value)
        part = segment_of(h, segments // share)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(h) else []
        bucket = table["bucket"][0].as_py()
        out = [(int(part[a]), bucket, h[a:e].tobytes()) for a, e in zip(cuts, [*cuts[1:], len(h)])]
        return pa.Table.from_batches([rows(out, ["part", "bucket", "words"], (pa.int32(), pa.int64(), pa.binary()))])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, filters, w, n = None, [], None, None, None
        for b in batches:
            out, size = [], 0
            for part, kind, segment, bucket, asked, counts, pairs, levels in zip(*(x.to_pylist() for x in b.columns)):
                if part != at:
                    at, held, filters = part, [], None
                if not kind:
                    held.append((segment, *(np.frombuffer(x, t) for x, t in zip((asked, counts, pairs, levels), (np.uint64, np.int64, np.uint64, np.uint8)))))
                    continue
                if filters is None:  # segments without a row learned nothing: blank
                    w, n = (np.concatenate([x[i] for x in held] or [np.zeros(0, t)]) for i, t in ((1, np.uint64), (2, np.int64)))
                    filters = Filter(share, [(s - part * share, *fill(np.concatenate([own, pr]), np.concatenate([level(c), lv]))) for s, own, c, pr, lv in held])
                    held = []
                h = np.frombuffer(asked, np.uint64)
                c = _look(w, n, h)
                place = np.flatnonzero(c)
                q = filters.levels(h, segments, part * share).tobytes()
                out.append((bucket, part, q, place.astype(np.int32).tobytes(), c[place].tobytes()))
            yield rows(out, ["bucket", "part", "levels", "places", "counts"], (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))

    null = F.lit(None).cast("binary")
    asked = texts.groupBy("bucket").applyInArrow(ask, "part int, bucket long, words binary")
    asked = asked.select("part", F.lit(1).alias("kind"), F.lit(0).alias("segment"), "bucket", "words", null.alias("word_counts"), null.alias("pairs"), null.alias("levels"))
    own = model.parts.select(F.expr(f"segment div {share}").cast("int").alias("part"), F.lit(0).alias("kind"), "segment", F.lit(0).cast("long").alias("bucket"), "words", "word_counts", "pairs", "levels")
    both = own.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", "segment")
    return both.mapInArrow(tidied(tell), "bucket long, part int, levels binary, places binary, counts binary")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", filter_most: int = FILTER_MOST, words_most: int = WORDS_MOST) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""
    least = model.least(filter_most, words_most)
    sent = docs.sparkSession.sparkContext.broadcast(model.known(least))
    total, distinct, once = model.tokens, model.distinct, model.once
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def work(part: list, answers: pa.Table | None = None) -> list[tuple]:
        known: Known = sent.value
        p = Piece([r[-1] for r in part])
        exact = known.word_counts(p.word)
        once_each, back = np.unique(p.pair, return_inverse=True)
        one, two = known.filter.levels(p.word), known.filter.levels(once_each)
        if answers is not None:
            h = _rare(p, known)
            q, c, at = np.zeros(len(h), np.uint8), np.zeros(len(h), np.int64), 0
            for levels, places, counts in zip(*(answers.sort_by("part")[x].to_pylist() for x in ("levels", "places", "counts"))):
                q[at : at + len(levels)] = np.frombuffer(levels, np.uint8)
                c[at + np.frombuffer(places, np.int32)] = np.frombuffer(counts, np.int64)
                at += len(levels)
            assert at == len(h), "a bucket's texts have changed"
            one = np.where(exact > 0, one, _look(h, q, p.word))
            exact = np.where(exact > 0, exact, _look(h, c, p.word))
            two = np.where(two > 0, two, _look(h, q, once_each))
        c1 = MEAN[one]
        c2 = np.minimum(MEAN[two][back], np.minimum(c1[p.token], c1[p.before]))
        p1 = (c1 + once / (distinct + 1)) / (total + once) if total else np.ones(len(c1))
        log = np.log10((c2 + MU * p1[p.token]) / (c1[p.before] + MU))
        base = np.log10((exact + 1) / (total + distinct + 1))[p.token]
        sums = [np.add.reduceat(x, p.first) for x in (base, log, (exact > 0)[p.token].astype(np.int64))]
        return [(r[0], int(n), int(k), float(b), float(s)) for r, n, b, s, k in zip(part, p.sizes, *sums)]

    def made(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(_rows(batches), SCORE_BYTES):
            yield made(work(part))

    def both(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([made(work(list(zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist())), answers) if len(texts) else [])])

    if least == 1:
        return rows.mapInArrow(tidied(run), schema)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    texts = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // ASK_BYTES)))))
    return texts.groupBy("bucket").cogroup(_answers(texts, model, sent).groupBy("bucket")).applyInArrow(both, schema)


def digest(docs: DataFrame, filter_most: int = FILTER_MOST, words_most: int = WORDS_MOST) -> DataFrame:
    """The rows of op12."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = score(docs, model, filter_most=filter_most, words_most=words_most)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
