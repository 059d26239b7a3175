"""Mixing sources to target weights by the cube method.

Each source has a target in words. A unit (a document) is taken
``floor(target / source size)`` times for sure and once more with the remaining
fraction. Which units get the extra copy is balanced sampling: the vector of
fractional inclusion probabilities moves through the null space of two
constraints (words, documents) until entries reach 0 or 1.

Flight in blocks: units of a source are dealt by a hash into blocks of bounded
size, and every block flies, also the only one of a small source. A flight leaves at
most two fractional units, which keep their probabilities; those of many blocks form
the blocks of the next level. What is left at last meets the units of the source's
block 0, flies once more, and the one or two units left then land by chance. Landing
leaves a gap of words, which swaps of one copy between two units of block 0 close:
they keep the number of documents. Only a gap wider than any unit takes or gives
single copies.

Giants, units over ``1 / GIANT`` of a source of many blocks or a fourth of a smaller one, fly and land first, and the
rest of the target is shared by the other units, whose probabilities move: no later
swap could make up for a giant.

Everything is decided by hashes of ids and a seed, so reruns agree.

Defined results: null texts have size 0 and are taken by chance like any other
(they add nothing); a null source is a source of its own, last; rows equal in id,
source and size are ordered arbitrarily among themselves, which changes nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, words_of

WEIGHTS = (5, 2, 1)
MOST = 3.0
BLOCK = 2048
#: Blocks whose rest is flown together on the next level.
GATHER = 512
#: Sources up to which their plan (under 100 bytes each) is broadcast.
FEW = 20_000
#: A unit over this part of its source is a giant, in sources of many blocks and of one.
GIANT, GIANT_OF_ONE = 64, 4
SEED = 20
EPS = 1e-9


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n, rank, target) by filling up sources to their limit.

    In the order of limit over weight, a source stops at its limit if the rest's
    fair share reaches it; those after the first that doesn't share what is left.
    The windows run over one row for each source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("rank", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("rank") % len(weights) + 1)
    s = s.withColumn("w", w).withColumn("limit", most * F.col("source_size").cast("double"))
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("limit") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*", F.sum("source_size").over(all_rows).cast("double").alias("all_size"), F.sum("w").over(all_rows).alias("all_w"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limit_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    s = s.withColumn("level", (F.col("all_size") - F.col("limit_before")) / (F.col("all_w") - F.col("w_before")))
    s = s.withColumn("full", F.col("limit") <= F.col("level") * F.col("w"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), "rank", "level"))).over(all_rows)["level"]
    return s.select("source", "source_size", "n", "rank", F.when(F.col("full"), F.col("limit")).otherwise(shared * F.col("w")).alias("target"))


def _chance(*keys) -> float:
    return int.from_bytes(hashlib.blake2b(repr((SEED, *keys)).encode(), digest_size=7).digest(), "big") / 2**56


def flight(size: list[int], prob: list[float], key) -> list[float]:
    """Moves ``prob`` until at most two entries are fractional.

    A window of three fractional units has one direction that changes neither the
    documents nor the words that are taken; a step along it fixes one of the three.
    """
    p = list(prob)
    n = 0
    window: list[int] = []
    draws = np.random.default_rng(int(_chance("flight", key) * 2**53)).random(len(p) + 1)
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        window.append(i)
        if len(window) < 3:
            continue
        a, b, c = window
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min(((1 - p[k]) / d if d > 0 else p[k] / -d) for k, d in zip(window, u) if d)
        down = min((p[k] / d if d > 0 else (1 - p[k]) / -d) for k, d in zip(window, u) if d)
        step = up if draws[n] * (up + down) < down else -down
        n += 1
        for k, d in zip(window, u):
            x = p[k] + step * d
            p[k] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
        window = [k for k in window if 0.0 < p[k] < 1.0]
    return p


def land(size: list[int], prob: list[float], key) -> list[int]:
    """Whole copies (0 or 1) from probabilities: a flight, then chance for the one or two units that it leaves."""
    p = flight(size, prob, (key, "last"))
    return [int(round(x)) if not EPS < x < 1 - EPS else int(_chance("landing", key, i) < x) for i, x in enumerate(p)]


def close_gap(size: np.ndarray, copies: np.ndarray, gap: float, most: int) -> np.ndarray:
    """Copies from 0 to ``most`` whose words are more by about ``gap``.

    While the gap is wider than any unit, units take (or give) a copy each in their
    order; then the best swap of a copy between two units is made as long as it helps.
    """
    copies = copies.copy()
    widest = size.max(initial=0)
    while abs(gap) > widest > 0:
        able = np.flatnonzero((size > 0) & ((copies < most) if gap > 0 else (copies > 0)))
        some = able[np.cumsum(size[able]) <= abs(gap)]
        if not len(some):
            break
        copies[some] += 1 if gap > 0 else -1
        gap -= np.sign(gap) * size[some].sum()
    for _ in range(64):
        up, down = np.flatnonzero(copies < most), np.flatnonzero(copies > 0)
        if not len(up) or not len(down) or abs(gap) < 0.5:
            break
        down = down[np.argsort(size[down], kind="stable")]
        at = np.searchsorted(size[down], size[up] - gap)
        near = np.stack([np.clip(at - 1, 0, len(down) - 1), np.clip(at, 0, len(down) - 1)])
        left = np.abs(gap - (size[up] - size[down][near]))
        side, i = np.unravel_index(left.argmin(), left.shape)
        if left[side, i] >= abs(gap) - 1e-9:
            break
        copies[up[i]] += 1
        copies[down[near[side, i]]] -= 1
        gap -= size[up[i]] - size[down[near[side, i]]]
    if len(size) and abs(gap) >= 0.5:  # a single copy where no swap helps
        able = np.flatnonzero((size > 0) & ((copies < most) if gap > 0 else (copies > 0)))
        left = np.abs(abs(gap) - size[able])
        if len(able) and left.min() < abs(gap):
            copies[able[left.argmin()]] += 1 if gap > 0 else -1
    return copies


def into(size: np.ndarray, copies: np.ndarray, low: float, high: float, most: int) -> np.ndarray:
    """Copies whose words come into a range, by single copies more or less as long as these help."""
    copies = copies.copy()
    beyond = lambda t: np.maximum(0.0, np.maximum(low - t, t - high))
    while True:
        taken = (size * copies).sum()
        step = np.r_[np.where(copies < most, size, 0), np.where(copies > 0, -size, 0)]
        left = beyond(taken + step)
        if not len(step) or left.min() >= beyond(taken):
            return copies
        k = int(left.argmin())
        copies[k % len(size)] += 1 if k < len(size) else -1


def _ordered(units: pa.Table) -> tuple[list[int], list[int], list[float]]:
    order, size, prob = (units[c].to_pylist() for c in ("order", "size", "prob"))
    at = sorted(range(units.num_rows), key=lambda i: (order[i], size[i]))
    return at, [size[i] for i in at], [prob[i] for i in at]


def _put(units: pa.Table, name: str, at: list[int], values, kind) -> pa.Table:
    out = np.zeros(len(at), kind)
    out[at] = values
    return units.set_column(units.schema.get_field_index(name), name, pa.array(out))


def _fly(units: pa.Table) -> pa.Table:
    """One block's flight."""
    at, size, prob = _ordered(units)
    return _put(units, "prob", at, flight(size, prob, (units["rank"][0].as_py(), units["block"][0].as_py())), np.float64)


def _land(units: pa.Table, most: int) -> pa.Table:
    """The last block of a source: its copies, whose words are to come to ``rest``."""
    at, size, prob = _ordered(units)
    sure = np.array([units["sure"][i].as_py() for i in at])
    copies = sure + np.array(land(size, prob, units["rank"][0].as_py()))
    words = np.array(size)
    low, high = units["low"][0].as_py(), units["high"][0].as_py()  # what others leave to these units
    if low < high:
        copies = into(words, copies, low, high, most)
    taken = float((words * copies).sum())
    gap = low - taken if taken < low else high - taken if taken > high else 0.0
    return _put(units, "sure", at, close_gap(words, copies, gap, most), np.int64)


def _with_ratio(units: DataFrame, ratio) -> DataFrame:
    """units with their sure copies and the probability of one more."""
    whole = F.floor(ratio + EPS)
    return units.withColumn("sure", whole.cast("long")).withColumn("prob", F.greatest(ratio - whole, F.lit(0.0)))


def _by_rank(units: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """units with their source's row of a plan: sent to all tasks if sources are few, else joined with Spark's splitting of skewed keys."""
    return units.join(F.broadcast(plan) if few else plan.hint("merge"), "rank", "left")


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for rows (doc_id, source, size)."""
    sizes = checkpointed(sizes)
    plan = targets(sizes, weights, most)
    largest, n_sources = plan.agg(F.max("n"), F.count(F.lit(1))).first()
    columns = ["doc_id", "source", "size", "source_size", "target"]
    if largest is None:
        return sizes.join(plan, "source").select(*columns, F.lit(0).cast("long").alias("copies"))
    few = n_sources <= FEW
    order = F.xxhash64("doc_id", "size", F.lit(SEED))
    plan = plan.withColumn("blocks", F.ceil(F.col("n") / block)).withColumnRenamed("source", "of")
    units = sizes.join(F.broadcast(plan) if few else plan.hint("merge"), F.col("source").eqNullSafe(F.col("of"))).select(
        *columns, "rank", order.alias("order"), F.pmod(order, F.col("blocks")).cast("long").alias("block"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"),
        (F.col("size") * F.when(F.col("blocks") > 1, GIANT).otherwise(GIANT_OF_ONE) > F.col("source_size")).alias("giant"),
    )
    top = int(most)
    landed = lambda df: df.groupBy("rank").applyInArrow(lambda t: _land(t, top), df.schema)
    # giants first, then the ratio of the others
    giants = units.where("giant")
    held = giants.groupBy("rank").agg(F.sum("size").alias("held"))
    least = F.greatest(F.lit(0.0), F.col("target") - most * (F.col("source_size") - F.col("held")))
    giants = _by_rank(_with_ratio(giants, F.col("ratio")), held, few).withColumn("low", least).withColumn("high", F.col("target")).drop("held")
    giants = checkpointed(landed(giants))
    parts = [giants.withColumn("copies", F.col("sure"))]
    taken = giants.groupBy("rank").agg(F.sum(F.col("size") * F.col("sure")).alias("taken"), F.sum("size").alias("held"))
    units = _by_rank(units.where("not giant"), taken, few)
    rest, room = F.col("target") - F.col("taken"), F.col("source_size") - F.col("held")
    moved = F.when(room > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), rest / room))).otherwise(0.0)
    units = units.withColumn("ratio", F.when(F.col("taken").isNull(), F.col("ratio")).otherwise(moved)).withColumn("target_left", F.coalesce(rest, F.col("target"))).drop("taken", "held")
    flown = _with_ratio(units, F.col("ratio"))
    flown = checkpointed(flown.groupBy("rank", "block").applyInArrow(_fly, flown.schema))
    last, level = flown.where("block = 0"), flown.where("block <> 0")
    fractional = (F.col("prob") > EPS) & (F.col("prob") < 1 - EPS)
    copied = F.col("sure") + F.round("prob").cast("long")
    fixed = [level.where(~fractional)]
    n_blocks = -(-largest // block)
    left = level.where(fractional)
    while n_blocks > GATHER:  # blocks of what the level before left
        n_blocks = -(-n_blocks // GATHER)
        again = left.withColumn("block", F.pmod(F.xxhash64("block"), F.lit(n_blocks)))
        again = checkpointed(again.groupBy("rank", "block").applyInArrow(_fly, again.schema))
        fixed.append(again.where(~fractional))
        left = again.where(fractional)
    done = reduce(DataFrame.unionByName, fixed).withColumn("copies", copied)
    words = done.groupBy("rank").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    last = _by_rank(last.unionByName(left), words, few)
    rest = F.col("target_left") - F.coalesce(F.col("words"), F.lit(0))
    last = landed(last.withColumn("low", rest).withColumn("high", rest).drop("words"))
    parts += [done, last.withColumn("copies", F.col("sure"))]
    return reduce(DataFrame.unionByName, [x.select(*columns, "copies") for x in parts])


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents with docs' columns; a document taken twice has two rows.

    Rows equal in id and source are one unit here and share its decision; its size
    counts all of them. Rows without id are kept once.
    """
    units = sized(docs, doc_id, text, source).where("doc_id is not null").groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    own, of, taken, copy = fresh(docs, "id", "source", "copies", "copy")
    copies = mix(units).select(F.col("doc_id").alias(own), F.col("source").alias(of), F.col("copies").alias(taken))
    named = docs.join(copies, (F.col(doc_id) == F.col(own)) & F.col(source).eqNullSafe(F.col(of)), "left")
    times = F.when(F.col(doc_id).isNull(), F.lit(1)).otherwise(F.coalesce(F.col(taken), F.lit(0))).cast("int")
    return named.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op1."""
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
