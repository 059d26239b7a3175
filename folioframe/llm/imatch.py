"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency, ln(documents / documents
with the term), lies in a band. A document keeps its distinct terms of the lexicon,
sorted; for each of ``SUBSETS`` random subsets of the lexicon the kept terms of the
subset are hashed in order. Subsets keep a quarter of the lexicon, an eighth and so on
down to 1/512, so that likeness is graded: dense subsets match only copies, thin ones
also match partly equal texts.

Sizes. A term in the band occurs in at least ``documents * exp(-IDF_MOST)`` documents,
and documents have ``t`` distinct terms on average, so the lexicon has at most
``t * exp(IDF_MOST)`` terms whatever the corpus. Its true size is counted before it
is sent to the tasks; one beyond ``LEXICON_MOST`` is used in slices by hash, each sent
on its own, and the slices' kept terms are joined by document.

Defined results: null and blank texts keep no term and have the empty fingerprint;
texts with equal fingerprints have likeness 1; rows equal in id come in the order of
their texts; a null id sorts first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

IDF_LEAST = math.log(5)
IDF_MOST = math.log(2000)
LEVELS = 8
EACH = 8
SUBSETS = LEVELS * EACH
LEXICON_MOST = 4_000_000
#: Terms that a task counts before it passes the counts on.
HELD_TERMS = 400_000
EMPTY = "-" * 8


def terms(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): documents with the term, over all documents. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(terms(t))
            if len(held) > HELD_TERMS:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def in_band(n: Column, n_docs: int, least: float = IDF_LEAST, most: float = IDF_MOST) -> Column:
    return (n <= n_docs * math.exp(-least)) & (n >= n_docs * math.exp(-most))


class Lexicon:
    """Terms with their hashes and the bits of the subsets that hold them."""

    def __init__(self, words: list[str]):
        from xxhash import xxh64_intdigest

        words = sorted(words)
        self.place = {w: i for i, w in enumerate(words)}
        self.hash = np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
        self.mask = np.zeros(len(words), np.uint64)
        for k in range(SUBSETS):
            x = self.hash ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)  # a hash of (term, subset)
            for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
            x ^= x >> np.uint64(31)
            self.mask |= ((x >> np.uint64(64 - 2 - k // EACH)) == 0).astype(np.uint64) << np.uint64(k)

    def kept(self, text: str | None) -> np.ndarray:
        place = self.place
        return np.sort(np.fromiter((place[w] for w in terms(text) if w in place), np.int64))


def signature(hashes: np.ndarray, masks: np.ndarray) -> list[str]:
    """One hash for each subset, over kept terms in term order; EMPTY where none is kept."""
    from xxhash import xxh32_hexdigest

    if not len(hashes):
        return [EMPTY] * SUBSETS
    out = []
    for k in range(SUBSETS):
        mine = hashes[(masks >> np.uint64(k)) & np.uint64(1) == 1]
        out.append(xxh32_hexdigest(mine.tobytes()) if len(mine) else EMPTY)
    return out


def likeness(a: list[str], b: list[str]) -> float:
    """Share of equal hashes among the subsets that either text has terms in; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    used = [(x, y) for x, y in zip(a, b) if x != EMPTY or y != EMPTY]
    return sum(x == y for x, y in used) / len(used)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term) of the band, over all documents."""
    return document_frequencies(docs, text).where(in_band(F.col("n"), docs.count())).select("term")


def _quantiles(docs: DataFrame, parts: int) -> list[int]:
    cuts = docs.agg(F.percentile_approx("o", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))).first()[0] if parts > 1 else None
    return sorted(set(cuts or []))


def _places(cuts: list[int], before: dict[int, int]):
    """Column of the keys' bucket (the number of cuts up to the key) and of the bucket that gets a first key too."""
    steps = np.array(cuts, np.int64)

    @F.pandas_udf("array<struct<bucket:int,halo:int>>")
    def places(o):
        at = np.searchsorted(steps, o.to_numpy(), side="right")
        return pd.Series([[(b, 0), (before[k], 1)] if k in before else [(b, 0)] for b, k in zip(at.tolist(), o.tolist())])

    return places("o")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, halo, doc_id, text), sorted by id within buckets of whole partitions.

    Texts are shuffled once. The first document of each bucket is also the last row
    (halo = 1) of the bucket before, that of the first bucket in the last one, so each
    document's follower stands next to it. The driver sees one id for each bucket.
    """
    spark = docs.sparkSession
    least = -(2**63)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(least)).alias("o"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _quantiles(rows, 4 * parts)
    own = rows.select("o", _places(cuts, {})[0]["bucket"].alias("bucket"))
    firsts = sorted((r["bucket"], r["o"]) for r in own.groupBy("bucket").agg(F.min("o").alias("o")).collect())
    if not firsts:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("halo"), "doc_id", "text")
    before = {o: firsts[i - 1][0] for i, (_, o) in enumerate(firsts)}  # -1: the last bucket
    rows = rows.withColumn("at", F.explode(_places(cuts, before))).select("at.bucket", "at.halo", "o", "doc_id", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "halo", "o", "text").select("bucket", "halo", "doc_id", "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (doc_id, text, next text) from the rows of with_next."""
    waiting = None  # (bucket, doc_id, text)
    for b in batches:
        out = []
        for bucket, halo, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
            text = text or ""
            if waiting and waiting[0] == bucket:
                out.append((*waiting[1:], text))
            waiting = (bucket, doc_id, text) if not halo else None
        yield out


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digest(docs: DataFrame, most: int = LEXICON_MOST) -> DataFrame:
    """The rows of op4."""
    spark = docs.sparkSession
    words = checkpointed(lexicon(docs))
    n = words.count()
    ordered = with_next(docs)
    if n > most:
        return _digest_by_slices(ordered, words, -(-n // most))
    sent = spark.sparkContext.broadcast([r[0] for r in words.toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _opened(sent)
        known: tuple[str, list[str]] | None = None

        def mark(text: str) -> list[str]:
            at = lex.kept(text)
            return signature(lex.hash[at], lex.mask[at])

        for pairs in _pairs(batches):
            out = []
            for doc_id, text, following in pairs:
                own = known[1] if known and known[0] == text else mark(text)
                after = mark(following)
                changed = edited(text, following)
                other = mark(changed)
                out.append((doc_id, len(text), _sha(changed), "".join(own), "".join(other), likeness(own, other), likeness(own, after)))
                known = following, after
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 7, _ARROW.types)], schema=_ARROW)

    return ordered.mapInArrow(run, _SCHEMA)


_OPEN: list = []


def _opened(sent) -> Lexicon:
    """The lexicon of a broadcast, built once in a worker process."""
    words = sent.value
    if not _OPEN or _OPEN[0] is not words:
        _OPEN[:] = [words, Lexicon(words)]
    return _OPEN[1]


def _digest_by_slices(ordered: DataFrame, words: DataFrame, slices: int) -> DataFrame:
    """For lexicons too large to send at once: kept terms by slices of the lexicon, then joined by row."""
    spark = ordered.sparkSession

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in _pairs(batches):
            flat = []
            for d, a, b in pairs:
                # rows are told apart by both texts: an edited text doesn't show the half that it lost
                own, changed = _sha(a + "\0" + b), edited(a, b)
                flat += [(d, kind, t, len(a), _sha(changed), own) for kind, t in enumerate((a, b, changed))]
            cols = list(zip(*flat)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "kind", "text", "n_chars", "sha", "own"])

    flat = ordered.mapInArrow(texts, "doc_id long, kind int, text string, n_chars long, sha string, own string").withColumn("row", F.xxhash64("doc_id", "own")).drop("own")
    found = None
    for k in range(slices):
        mine = words.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == k)
        sent = spark.sparkContext.broadcast([r[0] for r in mine.toLocalIterator()])

        def run(batches, sent=sent):
            lex = _opened(sent)
            for b in batches:
                kept = [[(w, int(lex.hash[lex.place[w]]), int(lex.mask[lex.place[w]])) for w in terms(t) if w in lex.place] for t in b.column("text").to_pylist()]
                packed = [["%s\t%d\t%d" % x for x in row] for row in kept]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "kind", "n_chars", "sha")), pa.array(packed, pa.list_(pa.string()))], names=["row", "doc_id", "kind", "n_chars", "sha", "kept"])

        part = flat.mapInArrow(run, "row long, doc_id long, kind int, n_chars long, sha string, kept array<string>")
        found = part if found is None else found.unionByName(part)
    whole = found.groupBy("row", "doc_id", "n_chars", "sha").agg(*[F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("kept"))))).alias(f"k{k}") for k in range(3)], (F.count(F.lit(1)) / (3 * slices)).cast("int").alias("times"))

    def end(batches):
        def mark(packed):
            at = sorted((x.split("\t") for x in packed), key=lambda x: x[0])
            return signature(np.array([int(x[1]) for x in at], np.uint64), np.array([int(x[2]) for x in at], np.uint64))

        for b in batches:
            out = []
            for doc_id, n, sha, *kept, times in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_chars", "sha", "k0", "k1", "k2", "times"))):
                own, after, other = (mark(x) for x in kept)
                out += [(doc_id, n, sha, "".join(own), "".join(other), likeness(own, other), likeness(own, after))] * times
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 7, _ARROW.types)], schema=_ARROW)

    return whole.mapInArrow(end, _SCHEMA)
