"""k-means on integer vectors with block-norm screening.

A vector's components become integers floor(256 * x). Beside them stands, made once, a
compressed vector: each component over a power of two, rounded to a signed byte, and for each
of eight segments the norms of what the bytes hold and of what they leave. The centroids are
compressed likewise in each round. With x = a + e and c = b + g (compressed parts and rests),

    x.c = a.b + a.g + e.c <= a.b + sum over segments of |a||g| + |e||c|

by Cauchy-Schwarz, so one product of bytes (exact in 32-bit floats) and two of eight norms bound
all distances from below. Each vector first meets the centroid of its least bound; only centroids
whose bound does not exceed that distance get an exact integer one. Bounds are shortened by a
margin for rounding, so no nearest centroid is lost, and ties go to the smaller number.
Norms alone, (|x| - |c|)^2 by segment, would rule out nothing where vectors have one length, as
embeddings mostly do.

Every round is one pass over the vectors: tasks screen, assign and add up, Spark merges one row
of sums for each task and centroid. Centroids (``K`` rows) are all that the driver sees.

Numbers. Vectors whose components all lie within ``PLAIN`` are kept as 32-bit integers and their
distances are exact in 64 bits. Others (any float) keep their exact doubles and meet all
centroids with Python's integers, as a plain vector does with a centroid beyond ``PLAIN`` that
the bounds don't rule out. Sums go to Spark in limbs of 31 bits. A distance or inertia beyond a
long is null.

Defined results: vectors that are null, have another number of components or hold a null,
NaN or infinity (also after scaling) are left out; equal vectors get equal rows; rows that share an id are each
kept, and start centroids with equal hashes (repeated ids) come in the order of their
stored bytes; rows without id never start a centroid but are assigned; with fewer than ``K``
vectors each one with an id starts a centroid; without any there is no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

DIM = 64
BLOCK = 8
K = 40
ROUNDS = 5
SEED = 2
#: Components up to which 64-bit integers hold all squared distances.
PLAIN = 1 << 27
BYTE = 127
LIMB = 31
LONG = (1 << 63) - 1
#: Vectors that a task screens at once.
PIECE = 4096


def segment_norms(v: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row, rounded up to 32 bits."""
    n = np.sqrt((v.astype(np.float64).reshape(len(v), DIM // BLOCK, BLOCK) ** 2).sum(2))
    return np.nextafter((n * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


class Screen:
    """Compressed rows: bytes, their power of two, segment norms of both parts, squared length."""

    def __init__(self, small: np.ndarray, shift: np.ndarray, held: np.ndarray, rest: np.ndarray, square: np.ndarray):
        self.small, self.shift, self.held, self.rest, self.square = small, shift, held, rest, square

    @staticmethod
    def of(v: np.ndarray) -> Screen:
        most = np.abs(v).max(1, initial=0)
        shift = np.where(most > BYTE, np.ceil(np.log2(np.maximum(most, 1) / BYTE)), 0).astype(np.int64)
        unit = (1 << shift)[:, None]
        small = np.clip((2 * v + unit) // (2 * unit), -BYTE, BYTE)
        return Screen(small.astype(np.int8), shift, segment_norms(small * unit), segment_norms(v - small * unit), (v * v).sum(1))

    def bounds(self, centres: Screen, whole: np.ndarray) -> np.ndarray:
        """Rows x centroids: no more than the squared distances. ``whole``: segment norms of the centroids."""
        dot = (self.small.astype(np.float32) @ centres.small.astype(np.float32).T).astype(np.float64)
        dot *= (1 << self.shift)[:, None] * (1 << centres.shift)[None, :]
        f = np.float64
        dot += self.held.astype(f) @ centres.rest.astype(f).T + self.rest.astype(f) @ whole.astype(f).T
        a = self.square[:, None] + centres.square[None, :].astype(f)
        return np.maximum(a - 2 * dot - 1e-9 * a - 1, 0)


def nearest(v: np.ndarray, screen: Screen, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each row, and how many exact distances were taken.

    All components lie within PLAIN.
    """
    bounds = screen.bounds(Screen.of(centres), segment_norms(centres))
    best = bounds.argmin(1)
    far = ((v - centres[best]) ** 2).sum(1)
    taken = len(v)
    may = bounds <= far[:, None]
    may[np.arange(len(v)), best] = False
    for c in np.flatnonzero(may.any(0)):
        rows = np.flatnonzero(may[:, c] & (bounds[:, c] <= far))  # a nearer one found since may rule it out
        d = ((v[rows] - centres[c]) ** 2).sum(1)
        taken += len(rows)
        won = (d < far[rows]) | ((d == far[rows]) & (c < best[rows]))
        far[rows[won]], best[rows[won]] = d[won], c
    return best, far, taken


class Centres:
    """Centroids of any size; those within PLAIN as an array."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.plain = [i for i, c in enumerate(rows) if all(abs(x) < PLAIN for x in c)]
        self.wide = [i for i in range(len(rows)) if i not in set(self.plain)]
        self.array = np.array([rows[i] for i in self.plain], np.int64).reshape(-1, DIM)

    def of_one(self, x: list[int]) -> tuple[int, int]:
        """(centroid, squared distance) of one vector, with Python's integers."""
        d, i = min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(self.rows))
        return i, d

    def of(self, v: np.ndarray, screen: Screen) -> tuple[list[int], list[int]]:
        """(centroids, squared distances) of plain vectors."""
        if not self.plain:
            found = [self.of_one(x) for x in v.tolist()]
            return [i for i, _ in found], [d for _, d in found]
        best, far, _ = nearest(v, screen, self.array)
        best = np.array(self.plain)[best]
        for c in self.wide:
            length = math.isqrt(sum(x * x for x in self.rows[c]))
            for r in np.flatnonzero((float(length) * (1 - 1e-9) - np.sqrt(screen.square.astype(np.float64))).clip(0) ** 2 <= far):
                d = sum((a - b) ** 2 for a, b in zip(v[r].tolist(), self.rows[c]))
                if d < far[r] or (d == far[r] and c < best[r]):
                    best[r], far[r] = c, d
        return best.tolist(), far.tolist()


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, plain, v, small, shift, norms): integers and compressed form of the vectors that are kept.

    ``v`` holds 64 32-bit integers where they are plain, else doubles.
    """
    e = F.col(embedding)
    whole = (F.size(e) == DIM) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * 256) < float("inf")))
    kept = rows.where(e.isNotNull() & whole).select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("e"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, DIM)
            x = np.floor(x * 256)  # exact, by a power of two
            plain = (np.abs(x) < PLAIN).all(1)
            whole = np.where(plain[:, None], x, 0).astype(np.int64)
            short, c = whole.astype(np.int32), Screen.of(whole)
            data = [(short[i] if plain[i] else x[i]).tobytes() for i in range(len(x))]
            norms = np.concatenate([c.held, c.rest], axis=1)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (c.small, norms)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plain), pa.array(data, pa.binary()), packed[0], pa.array(c.shift.astype(np.int32)), packed[1]], names=["vec_id", "plain", "v", "small", "shift", "norms"])

    return kept.mapInArrow(make, "vec_id long, plain boolean, v binary, small binary, shift int, norms binary")


def _ints(plain: bool, v: bytes) -> list[int]:
    return [int(x) for x in np.frombuffer(v, np.int32 if plain else np.float64)]


def starts(table: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.where("vec_id is not null").withColumn("h", h).orderBy("h", "plain", "v").limit(k).collect()  # k rows
    return [_ints(r["plain"], r["v"]) for r in first]


def _assign(batches: Iterator[pa.RecordBatch], centres: Centres) -> Iterator[tuple]:
    """(ids, plain vectors or None, wide vectors, clusters, distances) of pieces of one kind."""
    for b in batches:
        for lo in range(0, b.num_rows, PIECE):
            piece = b.slice(lo, PIECE)
            plain = np.asarray(piece.column(1).to_pylist(), bool)
            ids, raw, small, shift, norms = (piece.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            at = np.flatnonzero(plain).tolist()
            if at:
                v = np.frombuffer(b"".join(raw[i] for i in at), np.int32).reshape(-1, DIM).astype(np.int64)
                n = np.frombuffer(b"".join(norms[i] for i in at), np.float32).reshape(-1, 2, DIM // BLOCK)
                screen = Screen(np.frombuffer(b"".join(small[i] for i in at), np.int8).reshape(-1, DIM), np.array([shift[i] for i in at], np.int64), n[:, 0], n[:, 1], (v * v).sum(1))
                yield [ids[i] for i in at], v, [], *centres.of(v, screen)
            at = np.flatnonzero(~plain).tolist()
            if at:
                wide = [_ints(False, raw[i]) for i in at]
                found = [centres.of_one(x) for x in wide]
                yield [ids[i] for i in at], None, wide, [i for i, _ in found], [d for _, d in found]


def _limbs(x: int, n: int) -> list[int]:
    """n numbers of 31 bits, lowest first, the last with the sign."""
    return [(x >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(n - 1)] + [x >> (LIMB * (n - 1))]


def next_centres(table: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """One round: floors of the means; centroids without vectors stay."""
    k = len(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Centres(centres)
        plain = np.zeros((k, DIM), np.int64)
        more = [[0] * DIM for _ in range(k)]
        count = np.zeros(k, np.int64)
        for _, v, wide, best, _ in _assign(batches, at):
            count += np.bincount(best, minlength=k)
            if v is not None:
                np.add.at(plain, best, v)
            for c, x in zip(best, wide):
                more[c] = [a + b for a, b in zip(more[c], x)]
        out = []
        for c in np.flatnonzero(count).tolist():
            total = [int(a) + b for a, b in zip(plain[c], more[c])]
            n = max(x.bit_length() for x in total) // LIMB + 1
            split = [_limbs(x, n) for x in total]
            out += [(c, i, int(count[c]) if not i else 0, [x[i] for x in split]) for i in range(n)]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["cluster", "limb", "n", "sums"])

    part = table.mapInArrow(add, "cluster int, limb int, n long, sums array<long>")
    merged = part.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(19,0)")) for i in range(DIM)]).alias("sums"))
    sums: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    for r in merged.collect():  # a few rows for each centroid
        counts[r["cluster"]] = counts.get(r["cluster"], 0) + r["n"]
        have = sums.setdefault(r["cluster"], [0] * DIM)
        for i, x in enumerate(r["sums"]):
            have[i] += int(x) << (LIMB * r["limb"])
    return [[s // counts[c] for s in sums[c]] if c in sums else old for c, old in enumerate(centres)]


def assigned(table: DataFrame, centres: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, best, far in _assign(batches, Centres(centres)):
            held = [d if d <= LONG else None for d in far]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(held, pa.int64())], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), centroids) after the rounds and a last assignment."""
    table = checkpointed(vectors(rows, vec_id, embedding))
    centres = starts(table, k, seed)
    if not centres:
        return table.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance"), centres
    for _ in range(rounds):
        centres = next_centres(table, centres)
    return assigned(table, centres), centres


def digest(rows: DataFrame) -> DataFrame:
    """The rows of op13."""
    found, centres = cluster(rows)
    found = checkpointed(found)
    wide = F.sum(F.col("distance").cast("decimal(19,0)"))
    own = {r["cluster"]: int(r["d"]) if r["whole"] else None for r in found.groupBy("cluster").agg(wide.alias("d"), (F.count("distance") == F.count(F.lit(1))).alias("whole")).collect()}
    fit = lambda x: x if x is not None and x <= LONG else None
    every = fit(None if None in own.values() else sum(own.values()))
    of_each = [(i, fit(own.get(i)), every, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres)]
    named = found.sparkSession.createDataFrame(of_each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    x = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
    away = "list_sum(list_transform(list_zip(e.v, m.v), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT))"
    near = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT e.vec_id, m.c, {away} AS d FROM e CROSS JOIN {m} m) GROUP BY vec_id"
    steps = [f"e AS MATERIALIZED (SELECT vec_id, {x} AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})",
             f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, v FROM e QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) <= {K})"]
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(away=away, m=f'm{i}')})")
        mean = "(s - ((s % n) + n) % n) // n"
        steps.append(f"s{i} AS (SELECT c, i, sum(e.v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN e USING (vec_id) CROSS JOIN range(1, {DIM + 1}) t(i) GROUP BY c, i)")
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(x.v, m.v) AS v FROM m{i} m LEFT JOIN (SELECT c, list(({mean})::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY c) x USING (c))")
    return f"""WITH {", ".join(steps)}, f AS MATERIALIZED ({near.format(away=away, m=f"m{ROUNDS}")})
 SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM f JOIN m{ROUNDS} m USING (c)"""


ORACLE = _oracle()
