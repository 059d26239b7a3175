"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint holds 64 majority bits over the hashes of a text's shingles.
Linking works on distinct fingerprints only, so copies cost nothing:

1. Dealing. Of ``radius + 1`` equal bit fields, fingerprints at most ``radius`` bits
   apart agree on one at least. For each field, its first bits deal the fingerprints
   into ranges; there are so many of these bits that a range holds ``RANGE``
   fingerprints on average. One that holds over ``CROWD`` is dealt again by the fields
   of its other bits, until it doesn't or few bits are left.
2. The index. The fingerprints of a range are sorted by Gray rank, so neighbours share
   many bits. Runs of ``FANOUT`` form the next nodes upwards; a node stores the bits
   on which its whole run agrees (mask and pattern).
3. The search is of the index in itself, node against node, from the top. A pair of
   nodes carries its accumulated difference; a pair of children adds the differing bits
   that both masks fix and their parents' didn't. Over ``radius``, both whole groups
   are dropped. At the entries the accumulated difference is the distance.
4. A task reduces its links to a spanning forest; the forests are joined by
   alternating star contraction, in tables, with reliable checkpoints.

Defined results: null and blank texts have fingerprint zero and link like any
other; rows without id take part and are returned; equal rows are all returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, map_rows, small, tidied

SEED = 42
FANOUT = 2
#: Fingerprints of a range on average, and those from which it is dealt again.
RANGE, CROWD = 1024, 16_384
#: Pairs of nodes that the search holds at once.
PIECE = 2_000_000
#: Edges for each task of a round over them.
EDGES = 500_000
ONES = 0xFFFFFFFFFFFFFFFF


def _fingerprinter(width: int):
    def make():
        from xxhash import xxh64_intdigest

        def one(text: str | None) -> int:
            w = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if not w:
                return 0
            if len(w) < width:
                shingles = iter([b" ".join(w)])
                n = 1
            else:
                shingles = map(b" ".join, zip(*(w[i:] for i in range(width))))
                n = len(w) - width + 1
            ones = np.zeros(64, np.int64)
            h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
            for i in range(0, n, 65536):
                ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
            return int(bits.view(np.int64)[0])

        return lambda rows: [(i, one(t)) for i, t in rows]

    return make


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, _fingerprinter(width), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the binary reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Index over fingerprints that come in groups; a search stays in its group."""

    def __init__(self, group: np.ndarray, fps: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(fps), group))
        self.fps, group = fps[order], group[order]
        self.order = order
        self.dropped = self.kept = 0  # pairs of groups that searches have dropped and opened
        self.compared = 0  # pairs of entries that were compared one by one
        ones = np.full(len(fps), ONES, np.uint64)
        # level 0: the entries; each level: mask, pattern, first child, children
        self.levels = [(ones, self.fps, None, None)]
        mask, pattern = ones, self.fps
        while len(group):
            n = len(group)
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[starts, n])
            place = np.arange(n) - np.repeat(starts, size)
            first = np.flatnonzero(place % fanout == 0)
            both, either = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            mask = np.bitwise_and.reduceat(mask, first) & ~(both ^ either)
            pattern = both & mask
            self.levels.append((mask, pattern, first, np.diff(np.r_[first, n])))
            group = group[first]
            if size.max() <= fanout:
                break

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, later place, distance) of all pairs within radius, in bounded pieces."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]) if top else 0)
        todo = [(top, roots, roots, np.zeros(len(roots), np.int16))]
        while todo:
            level, a, b, acc = todo.pop()
            if not level:
                yield a, b, acc
                continue
            mask, _, first, count = self.levels[level]
            below, pattern, _, _ = self.levels[level - 1]
            n = count[a] * count[b]
            if len(a) > 1 and n.sum() > PIECE:
                half = len(a) // 2
                todo += [(level, a[half:], b[half:], acc[half:]), (level, a[:half], b[:half], acc[:half])]
                continue
            pair = np.repeat(np.arange(len(a)), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            x, y = first[a][pair] + at // count[b][pair], first[b][pair] + at % count[b][pair]
            once = x <= y if level > 1 else x < y  # within a node, each pair once; an entry is no pair with itself
            pair, x, y = pair[once], x[once], y[once]
            fresh = below[x] & below[y] & ~(mask[a] & mask[b])[pair]
            new = acc[pair] + np.bitwise_count((pattern[x] ^ pattern[y]) & fresh).astype(np.int16)
            near = new <= radius
            if level > 1:
                self.kept += int(near.sum())
                self.dropped += int(len(near) - near.sum())
            else:
                self.compared += len(near)
            todo.append((level - 1, x[near], y[near], new[near]))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n nodes' components."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fields(bits: int, n: int) -> list[int]:
    """Masks of the n fields that ``bits`` falls into, from the highest bit down."""
    places = [i for i in range(63, -1, -1) if bits >> i & 1]
    return [sum(1 << p for p in places[k * len(places) // n : (k + 1) * len(places) // n]) for k in range(n)]


def first_bits(mask: int, n: int) -> int:
    """The n highest bits of a mask."""
    return sum(1 << p for p in [i for i in range(63, -1, -1) if mask >> i & 1][:n])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp): fps by their bits in each of the masks."""
    one = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
    return fps.select("fp", F.explode(F.array(*[one(m) for m in masks])).alias("x")).select("x.mask", "x.key", "fp")


def _dealt(fps: DataFrame, radius: int) -> DataFrame:
    """(mask, key, fp): the ranges of all fields; those that are too full by finer keys."""
    n, own = fps.count(), 64 // (radius + 1)
    bits = min(own, max(0, math.ceil(math.log2(max(1, n / RANGE)))))
    masks = [first_bits(m, bits) for m in fields(ONES, radius + 1)] if bits else [0]
    rows = _keyed(fps, masks)
    parts = []
    while True:
        # at most one range in CROWD rows is full, so few are counted out
        full = checkpointed(rows.groupBy("mask", "key").count().where(F.col("count") > CROWD).select("mask", "key"))
        known = sorted(r["mask"] & ONES for r in full.select("mask").distinct().collect())  # some of the few masks
        finer = {m: [m | x for x in fields(ONES & ~m, radius + 1)] for m in known if (ONES & ~m).bit_count() > 16}
        if not finer:
            break
        full = full.where(F.col("mask").isin([_signed(m) for m in finer]))
        parts.append(rows.join(full, ["mask", "key"], "left_anti"))
        crowd = rows.join(full, ["mask", "key"], "left_semi")
        rows = reduce(DataFrame.unionByName, [_keyed(crowd.where(F.col("mask") == _signed(m)).select("fp"), x) for m, x in finer.items()])
    return reduce(DataFrame.unionByName, [*parts, rows])


def _link_tasks(radius: int, rows_at_once: int = 1_000_000):
    def some(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        index = GrayIndex(group, fp.view(np.uint64))
        distinct, number = np.unique(index.fps, return_inverse=True)
        label = np.arange(len(distinct))
        for a, b, _ in index.pairs(radius):
            label = forest(label[number[a]], label[number[b]], len(distinct))[label]
        other = np.flatnonzero(label != np.arange(len(distinct)))
        cols = distinct[other].view(np.int64), distinct[label[other]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, 2, rows_at_once):
            yield some(*cols)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows_at_once: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches in pieces that hold whole groups by the first ``keys`` columns."""
    parts: list[list[np.ndarray]] = []
    held = 0
    for x in batches:
        if not x.num_rows:
            continue
        parts.append([c.to_numpy(zero_copy_only=False) for c in x.columns])
        held += x.num_rows
        if held >= rows_at_once:
            cols = [np.concatenate(c) for c in zip(*parts)]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield [c[:cut] for c in cols]
            parts, held = [[c[cut:] for c in cols]], 0
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that join what distinct ``fps`` (column fp) within radius join."""
    dealt = _dealt(fps, radius).repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(tidied(_link_tasks(radius)), "a long, b long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node that has a link, by alternating star contraction."""

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = checkpointed(tidy(edges))
    number = edges.count()
    settled = not number
    # few edges need few tasks; a table that grows keeps its partitions
    narrow = lambda df: df.coalesce(1 + number // EDGES)
    for _ in range(rounds):
        if settled:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = narrow(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = checkpointed(narrow(tidy(narrow(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))))
        low = narrow(large.groupBy("a").agg(F.min("b").alias("m")))
        to_low = narrow(large.join(low, "a").select("b", "m").toDF("a", "b").union(low.select("a", "m").toDF("a", "b")))
        new = checkpointed(narrow(tidy(to_low)))
        # rows are distinct, so equal numbers and no new row mean equal tables
        before, number = number, new.count()
        settled = number == before and narrow(new.join(edges, ["a", "b"], "left_anti")).isEmpty()
        edges = new
    if not settled:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled(rows: DataFrame, found: DataFrame, key: str, doc_id: str = "doc_id") -> DataFrame:
    """rows with their group and component_id: the smallest id of all rows whose ``key`` is theirs or linked to it by ``found`` (node, root).

    A key of over a 10,000th of all rows is joined by broadcast, since there are fewer
    than 10,000 of these; so no key lands in one task with more than that share.
    """
    member = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    classes = checkpointed(rows.groupBy(key).agg(F.min(doc_id).alias("rep"), F.count(F.lit(1)).alias("n")))
    named = member.join(classes, member["node"] == classes[key])
    smallest = named.groupBy("root").agg(F.min("rep").alias("smallest"))
    of = named.select(key, "root").join(smallest, "root").select(key, "root", "smallest")
    # a key of one row and without link needs no label
    label = classes.join(of, key, "left").where("n > 1 or smallest is not null").select(key, "n", F.coalesce("smallest", "rep").alias("component_id"), F.coalesce("root", key).alias("group"))
    most = rows.count() / 10_000
    hot, cold = label.where(F.col("n") > most).drop("n"), label.where(F.col("n") <= most).drop("n")
    marked = rows.join(F.broadcast(hot), key, "left")
    far = marked.where("group is null").drop("component_id", "group").join(cold, key, "left")
    far = far.withColumn("component_id", F.coalesce("component_id", doc_id)).withColumn("group", F.coalesce("group", key))
    return far.unionByName(marked.where("group is not null"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, group): component_id is the smallest id reachable by links."""
    marked = checkpointed(fingerprints(docs, width, doc_id, text))
    found = components(links(checkpointed(marked.select("fp").distinct()), radius))
    return labelled(marked, found, "fp")


def first_of_each(docs: DataFrame, found: DataFrame, key: str, marked: Callable[[Column], Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest id. Rows without id stay.

    found: (doc_id, ``key``, component_id, group); ``marked`` computes the key of a text.
    Of a group's rows that share that id, the first by all columns' text stays, so reruns
    agree; rows of other groups that share it stay as well.
    """
    own, whole, mine, theirs, group, place = fresh(docs, "id", "text", "key", "own", "group", "n")
    kept = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"))
    kept = checkpointed(kept.where("first").drop("first"))
    of = lambda ids: docs.join(small(ids.select(own)), F.col(doc_id) == F.col(own), "left_semi")
    out = of(kept.where("n = 1")).unionByName(docs.where(F.col(doc_id).isNull()))
    again = kept.where("n > 1")
    if again.isEmpty():
        return out
    as_text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"})
    twice = of(again).withColumn(whole, as_text).withColumn(mine, marked(F.col(text)))
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(own), F.col(key).alias(theirs), F.col("group").alias(group)).distinct()
    rows = twice.join(first, (F.col(doc_id) == F.col(own)) & (F.col(mine) == F.col(theirs)))
    at = F.row_number().over(Window.partitionBy(doc_id, group).orderBy(whole))
    return out.unionByName(rows.withColumn(place, at).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns]))


def deduplicated(docs: DataFrame, width: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates."""
    make = _fingerprinter(width)

    @F.pandas_udf("long")
    def marked(texts):
        return pd.Series([fp for _, fp in make()([(0, t) for t in texts])], dtype="int64")

    return first_of_each(docs, near_duplicates(docs, width, radius, doc_id, text), "fp", marked, doc_id, text)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op3."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
