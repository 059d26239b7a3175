"""Near copies by five-word shingles: Gray-order index for candidates, exact Jaccard similarity for links.

Two texts are linked where their sets of shingles have a similarity of at least
``least``; groups are the connected components. No pair is lost. A fingerprint of 64
bits differs by about ten bits at a similarity of 0.8, where an index over all
fingerprints has nothing left to exclude, so the index works inside smaller groups:

1. Texts with equal sets are one class; all below works on classes.
2. Prefixes. In any fixed order of shingles, sets of that similarity share a shingle
   among the first n - ceil(least * n) + 1 of each. Classes that share one of these
   meet in its group; a shingle of one class only is dropped at once.
3. In each group the Gray-order index finds fingerprints up to ``RADIUS`` bits apart. A
   spanning forest of these pairs, nearest first, is checked exactly, so a large
   group of near copies is joined by one pair a class.
4. The exact rest. Groups whose classes are not all joined yet give the pairs across
   components that lengths, places and counts of hashes by bins don't exclude: first a
   spanning forest of the components by the most that a pair may share, then, among
   what is still apart, every pair. All of these are checked exactly.

The order puts shingles that are frequent in a sample last. It bears on speed only.
Shingles and sets are compared by 64-bit hashes.

Defined results: texts without words are one class; texts of fewer words than a
shingle have one shingle; rows without id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows, small, tidied
from .gray_index import SEED, GrayIndex, components, first_of_each, forest, gray_rank, labelled, whole_groups

#: Bits up to which the index looks; at a similarity of 0.8 one pair in a thousand differs by more.
RADIUS = 18
#: Fingerprints of a group that are searched together, next to one another in Gray order.
CHUNK = 2048
#: Hashes up to which a set's bins go with each of its tokens; those of larger sets go with their pairs.
BINNED = 512
#: Documents in the sample and the shingles taken from it that count as frequent.
SAMPLE = 4_000
FREQUENT = 500_000
#: Pairs made at once.
PIECE = 1_000_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(w)] if len(w) < width else map(b" ".join, zip(*(w[i:] for i in range(width))))
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in parts), np.uint64))


def _class_of(members: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(members.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")


def _frequent(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles that repeat in a sample, from rare to frequent."""
    step = max(1, rows.count() // SAMPLE)

    def make():
        return lambda found: [(int(x),) for _, t in found for x in shingle_set(t, width).view(np.int64)]

    some = map_rows(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0), make, "token long")
    top = some.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(FREQUENT)
    return np.array([r.token for r in top.select("token").collect()][::-1], np.int64).view(np.uint64)


def _fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of distinct hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def _bins(hashes: np.ndarray) -> bytes:
    """Counts of hashes by bins, about one for each hash, two bits each: 3 is three or more."""
    size = max(16, 1 << len(hashes).bit_length() - 1)
    count = np.minimum(np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size), 3).astype(np.uint8)
    return (count[::4] | count[1::4] << 2 | count[2::4] << 4 | count[3::4] << 6).tobytes()


def _marked(rows: DataFrame, width: int, least: Fraction, frequent: np.ndarray) -> DataFrame:
    """(doc_id, class, n, fp, bins, prefix) of each row."""

    def make():
        by_value = np.argsort(frequent)
        values = frequent[by_value]

        def one(i, t):
            s = shingle_set(t, width)
            n = len(s)
            if not n:
                return i, _class_of(s), 0, 0, b"", b""
            rank = np.zeros(n, np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                rank = np.where(values[at] == s, by_value[at] + 1, 0)
            order = np.lexsort((s, rank))[: n + int(-least * n // 1) + 1]  # n - ceil(least * n) + 1
            return i, _class_of(s), n, _fingerprint(s), _bins(s), s[order].tobytes()

        return lambda found: [one(*r) for r in found]

    return map_rows(rows, make, "doc_id long, class long, n long, fp long, bins binary, prefix binary")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class, n, place) of (class, n, prefix)."""
    for x in batches:
        tokens = [np.frombuffer(p, np.int64) for p in x.column(2).to_pylist()]
        if not tokens:
            continue
        size = np.array([len(t) for t in tokens])
        place = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        node, n = (np.repeat(x.column(k).to_numpy(zero_copy_only=False), size) for k in (0, 1))
        cols = np.concatenate(tokens), node, n.astype(np.int32), place.astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "class", "n", "place"])


def _by_token(rows: DataFrame, of: str) -> DataFrame:
    """The rows (token first) of tokens that have two values of a column."""
    names = rows.columns
    at = names.index(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, 1, 500_000):
            token, value = cols[0], cols[at]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[starts, len(token)])
            keep = np.repeat(np.maximum.reduceat(value, starts) != np.minimum.reduceat(value, starts), size)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=names)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(tidied(run), schema)


def spanning(a: np.ndarray, b: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Places of the pairs that make a spanning forest of n nodes, nearest first."""
    label = np.arange(n)
    taken = []
    for d in np.unique(distance):
        at = np.flatnonzero(distance == d)
        while len(at):
            x, y = label[a[at]], label[b[at]]
            at, x, y = (v[x != y] for v in (at, x, y))
            if not len(at):
                break
            # each component takes its first pair; all at once, for they stand in one order
            first = np.unique(np.unique(np.stack([x, y], 1).reshape(-1), return_index=True)[1] // 2)
            taken.append(at[first])
            label = forest(x[first], y[first], n)[label]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _near_tasks(least: Fraction):
    up, down = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node, n, fp in whole_groups(batches, 1, 200_000):
            order = np.lexsort((gray_rank(fp.view(np.uint64)), token))
            token, node, n, fp = (c[order] for c in (token, node, n, fp))
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            place = np.arange(len(token)) - np.repeat(starts, np.diff(np.r_[starts, len(token)]))
            group = np.cumsum(place % CHUNK == 0)
            index = GrayIndex(group, fp.view(np.uint64))
            found = []
            for a, b, d in index.pairs(RADIUS):
                a, b = index.order[a], index.order[b]
                close = np.minimum(n[a], n[b]).astype(np.int64) * down >= np.maximum(n[a], n[b]).astype(np.int64) * up
                a, b, d = a[close], b[close], d[close]
                some = spanning(a, b, d, len(token))
                found.append((a[some], b[some], d[some]))
            if found:
                a, b, d = (np.concatenate(x) for x in zip(*found))
                some = spanning(a, b, d, len(token))
                both = np.unique(np.stack([np.maximum(node[a[some]], node[b[some]]), np.minimum(node[a[some]], node[b[some]])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _near_pairs(shared: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """(a, b): spanning forests of what the index finds in the groups of shared prefix shingles."""
    rows = shared.join(classes.select("class", "fp"), "class").select("token", "class", "n", "fp")
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(tidied(_near_tasks(least)), "a long, b long").distinct()


def most_shared(bins: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hashes that the sets i and j share at most.

    Where a bin of one counts more than that of the other, the difference is not shared.
    Sets with other numbers of bins fold to the smaller number.
    """
    size = np.array([4 * len(x) for x in bins])
    out = np.minimum(n[i], n[j])
    both = np.minimum(size[i], size[j])
    for s in np.unique(both[both > 0]):
        mine = np.flatnonzero(both == s)
        used, at = np.unique(np.r_[i[mine], j[mine]], return_inverse=True)
        table = np.stack([_folded(bins[k], int(s)) for k in used])
        x, y = at[: len(mine)], at[len(mine) :]
        step = max(1, 4_000_000 // int(s))
        for p in range(0, len(mine), step):
            q = mine[p : p + step]
            left, right = table[x[p : p + step]], table[y[p : p + step]]
            # a bin that is full may hold more, so it takes nothing from the other
            only_left = np.where(right < 3, np.maximum(left - right, 0), 0).sum(1, dtype=np.int64)
            only_right = np.where(left < 3, np.maximum(right - left, 0), 0).sum(1, dtype=np.int64)
            out[q] = np.minimum(n[i[q]] - only_left, n[j[q]] - only_right)
    return out


def _folded(packed: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(packed, np.uint8)
    count = np.stack([x >> k & 3 for k in (0, 2, 4, 6)], 1).reshape(-1, size)
    return np.minimum(count.sum(0, dtype=np.int8), 3).astype(np.int8)


def _pair_tasks(least: Fraction, spread_out: bool):
    up, down = least.numerator, least.denominator

    def batch(*cols) -> pa.RecordBatch:
        n = max(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in cols], names=["a", "b", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node, n, place, group, packed in whole_groups(batches, 1, 100_000):
            n, place = n.astype(np.int64), place.astype(np.int64)
            _, number, own = np.unique(node, return_index=True, return_inverse=True)
            bins = [packed[k] for k in number]
            has = np.array([len(x) > 0 for x in bins])
            component = np.unique(group, return_inverse=True)[1][number]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            first = np.repeat(starts, np.diff(np.r_[starts, len(token)]))
            before = np.arange(len(token)) - first  # rows of the same shingle that stand before
            todo = np.flatnonzero(before)
            total = np.r_[0, np.cumsum(before[todo])]
            at, found, alive = 0, [], []
            while at < len(todo):
                stop = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, "right")) - 1)
                mine, count = todo[at:stop], before[todo[at:stop]]
                i = np.repeat(mine, count)
                j = np.arange(count.sum()) + np.repeat(first[mine] - (total[at:stop] - total[at]), count)
                at = stop
                i, j = (v[group[i] != group[j]] for v in (i, j))
                keep = np.minimum(n[i], n[j]) * down >= np.maximum(n[i], n[j]) * up
                # at their first common shingle, no more can be shared than it and what follows in both
                keep &= np.minimum(n[i] - place[i], n[j] - place[j]) * (up + down) >= up * (n[i] + n[j])
                i, j = i[keep], j[keep]
                both, of = np.unique(np.stack([np.maximum(own[i], own[j]), np.minimum(own[i], own[j])], 1), axis=0, return_inverse=True)
                if len(both):
                    a, b = both.T
                    size, shared = n[number], most_shared(bins, n[number], a, b)
                    keep = shared * (up + down) >= up * (size[a] + size[b])
                    alive.append(np.unique(token[i[keep[of.reshape(-1)]]]))
                    if not spread_out:  # pairs without bins wait for the second round
                        keep &= has[a] & has[b]
                    a, b, apart = a[keep], b[keep], 1000 - 1000 * shared[keep] // (size[a] + size[b] - shared)[keep]
                    if not spread_out:
                        some = spanning(component[a], component[b], apart, len(token))
                        a, b, apart = a[some], b[some], apart[some]
                    found.append((a, b, apart))
            if found:
                a, b, apart = (np.concatenate(x) for x in zip(*found))
                some = np.arange(len(a)) if spread_out else spanning(component[a], component[b], apart, len(token))
                both = np.unique(np.stack([a[some], b[some]], 1), axis=0)
                a, b = node[number][both[:, 0]], node[number][both[:, 1]]
                yield batch(np.maximum(a, b), np.minimum(a, b), None)
                yield batch(None, None, np.unique(np.concatenate(alive)))

    return run


def _rest_pairs(shared: DataFrame, classes: DataFrame, found: DataFrame, least: Fraction, spread_out: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the groups that ``found`` (node, root) doesn't join and nothing excludes, or a spanning forest of them.

    Also the rows of ``shared`` whose token has such pairs: no other can give one later.
    """
    label = found.select(F.col("node").alias("class"), "root")
    rows = shared.join(label, "class", "left").select("token", "class", "n", "place", F.coalesce("root", "class").alias("group"))
    mixed = checkpointed(_by_token(rows, "group"))
    light = classes.select("class", F.when(F.col("n") <= BINNED, F.col("bins")).otherwise(F.lit(b"")).alias("bins"))
    whole = mixed.join(light, "class").select(*mixed.columns, "bins")
    out = checkpointed(whole.repartition("token").sortWithinPartitions("token").mapInArrow(tidied(_pair_tasks(least, spread_out)), "a long, b long, token long"))
    alive = out.where("token is not null").select("token").distinct()
    pairs = out.where("a is not null").select("a", "b").distinct()
    return _bounded(pairs, classes, least) if spread_out else pairs, mixed.join(alive, "token", "left_semi").drop("group")


def _bounded(pairs: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """The pairs whose bins let them have the similarity, where one of them is too large to have had bins before."""

    def make():
        up, down = least.numerator, least.denominator

        def may(n1, n2, x, y):
            if max(n1, n2) <= BINNED:
                return True
            shared = most_shared([x, y], np.array([n1, n2]), np.array([0]), np.array([1]))
            return int(shared[0]) * (up + down) >= up * (n1 + n2)

        return lambda found: [(a, b) for a, b, n1, n2, x, y in found if may(n1, n2, x, y)]

    bins = F.when(F.col("n") > BINNED // 2, F.col("bins")).otherwise(F.lit(b""))  # partners of large sets
    side = lambda k, n, x: classes.select(F.col("class").alias(k), F.col("n").alias(n), bins.alias(x))
    both = small(checkpointed(pairs)).join(side("a", "n1", "x"), "a").join(side("b", "n2", "y"), "b")
    return map_rows(both.select("a", "b", "n1", "n2", "x", "y"), make, "a long, b long")


def _checked(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, least: Fraction) -> DataFrame:
    """The pairs whose sets have the similarity."""

    def sets():
        def one(t):
            s = shingle_set(t, width)
            return _class_of(s), s.tobytes()

        return lambda found: [one(t) for _, t in found]

    def check():
        up, down = least.numerator, least.denominator

        def near(x, y):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both * down >= up * (len(x) + len(y) - both)

        return lambda found: [(a, b) for a, b, x, y in found if near(x, y)]

    pairs = checkpointed(pairs)
    wanted = checkpointed(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
    ids = checkpointed(classes.select("class", "rep").join(small(wanted), "class", "left_semi").select(F.col("rep").alias("doc_id")).distinct())
    members = map_rows(rows.join(small(ids), "doc_id", "left_semi"), sets, "class long, members binary")
    members = checkpointed(members.join(small(wanted), "class", "left_semi"))
    side = lambda k: members.select(F.col("class").alias(k), F.col("members").alias(f"{k}_members"))
    both = small(pairs).join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_members", "b_members")
    return checkpointed(map_rows(both, check, "a long, b long").distinct())  # rows that share an id give a set twice


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class, component_id, group): component_id is the smallest id reachable by links."""
    least = Fraction(str(least))
    rows = _rows(docs, doc_id, text)
    marked = checkpointed(_marked(rows, width, least, _frequent(rows, width)))
    one = F.first(F.struct("n", "fp", "bins", "prefix")).alias("x")  # equal in all rows of a class
    classes = checkpointed(marked.groupBy("class").agg(F.min("doc_id").alias("rep"), one).select("class", "rep", "x.*"))
    tokens = classes.select("class", "n", "prefix").mapInArrow(tidied(_spread), "token long, class long, n int, place int")
    shared = checkpointed(_by_token(tokens, "class"))
    close = _checked(rows, classes, _near_pairs(shared, classes, least), width, least)
    found = components(close)
    for spread_out in (False, True):
        pairs, shared = _rest_pairs(shared, classes, found, least, spread_out)
        rest = _checked(rows, classes, pairs, width, least)
        if not rest.isEmpty():
            found = components(found.toDF("a", "b").union(rest))
    return labelled(marked.select("doc_id", "class"), found, "class")


def deduplicated(docs: DataFrame, width: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest id. Rows without id stay."""

    @F.pandas_udf("long")
    def marked(texts):
        return pd.Series([_class_of(shingle_set(t, width)) for t in texts], dtype="int64")

    return first_of_each(docs, near_copies(docs, width, least, doc_id, text), "class", marked, doc_id, text)
