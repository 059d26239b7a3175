"""Recurring shapes: chains, folds, interval unions, nearest and first matches, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_groups(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "group_id") -> DataFrame:
    """Numbers groups from 0; ``breaks`` (over lag columns or row values) starts a new one. Null starts none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__break", F.when(breaks, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def interval_union(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], gap: float, name: str = "group_id") -> DataFrame:
    """Groups of intervals whose gap to all before is at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__break", F.when(F.col(start) - reach > gap, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def running_means(values: Column, tolerance: float) -> Column:
    """Means of clusters of an array: sorted values join the last cluster if near its mean."""
    empty = F.expr("cast(array() as array<struct<s:double,n:bigint>>)")

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (F.abs(v - F.when(F.size(acc) > 0, last["s"] / last["n"])) <= tolerance)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["s"] + v).alias("s"), (last["n"] + 1).alias("n"))))
        fresh = F.concat(acc, F.array(F.struct(v.alias("s"), F.lit(1).cast("long").alias("n"))))
        return F.when(near, grown).otherwise(fresh)

    return F.aggregate(F.array_sort(values), empty, step, lambda acc: F.transform(acc, lambda x: x["s"] / x["n"]))


def running_variance(values: Column) -> Column:
    """Population variance of an array of doubles, one after the other by Welford's rule; 0 without any, nulls left out.

    Partial sums would be merged in the order in which tasks end, so a variance at a threshold would fall on either side of it.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))

    def step(acc: Column, v: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (v - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["sq"] + (v - mean) * (v - acc["mean"])).alias("sq"))

    return F.aggregate(F.array_compact(values), start, step, lambda acc: F.when(acc["n"] > 1, acc["sq"] / acc["n"]).otherwise(0.0))


def anchor_groups(values: Column, tolerance: float) -> Column:
    """Group numbers along a sorted array of numbers: one farther than ``tolerance`` from its group's first starts a group."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("g"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        fresh = acc["anchor"].isNull() | (F.abs(v - acc["anchor"]) > tolerance)
        g = acc["g"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, v).otherwise(acc["anchor"]).alias("anchor"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def mean_bands(centres: Column, tolerance: float) -> Column:
    """Band numbers along an array of numbers in its order: one within ``tolerance`` of the mean of the last band joins it."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(-1).alias("b"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        near = (acc["n"] > 0) & (F.abs(v - acc["s"] / F.greatest(acc["n"], F.lit(1))) <= tolerance)
        b = acc["b"] + F.when(near, 0).otherwise(1)
        s = F.when(near, acc["s"]).otherwise(F.lit(0.0)) + v
        n = F.when(near, acc["n"]).otherwise(F.lit(0).cast("long")) + 1
        return F.struct(s.alias("s"), n.alias("n"), b.alias("b"), F.concat(acc["out"], F.array(b)).alias("out"))

    return F.aggregate(centres, start, step, lambda acc: acc["out"])


#: Height of a band of a page, in points.
BAND = 24


def banded(df: DataFrame, low: Column, high: Column | None = None, name: str = "band") -> DataFrame:
    """df by bands of its page: the one of ``low``, or a row for each from ``low`` to ``high``.

    Joins of points with spans of y carry page and band as equalities, so that only
    neighbours meet instead of all elements of a page.
    """
    at = lambda v: F.floor(v / BAND).cast("int")
    return df.withColumn(name, at(low) if high is None else F.explode_outer(F.sequence(at(low), at(high))))


def around(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[Column, Column], low: Column, high: Column | None = None, name: str = "near") -> DataFrame:
    """left with the rows of right on its page whose bands its span of y touches, as an array.

    Both are shuffled once, by page, and meet there as one row: the page's right rows as an array for each
    band. A left row takes only its bands' arrays along. A right row stands in the band of ``low``, or in each
    from ``low`` to ``high``, and so can come more than once. Without any the array is empty or null.
    """
    rest = lambda df: F.struct(*[c for c in df.columns if c not in keys])
    r = banded(right.repartition(*keys), low, high, "__band").where("__band is not null")
    r = r.groupBy(*keys, "__band").agg(F.collect_list(rest(right)).alias("__r"))
    r = r.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__band", "__r"))).alias("__m"))
    none = F.array().cast(r.schema["__m"].dataType.valueType)
    first, last = [F.floor(v / BAND).cast("int") for v in span]
    l = left.withColumns({"__a": first, "__b": last}).groupBy(*keys).agg(F.collect_list(F.struct(rest(left).alias("own"), F.col("__a").alias("a"), F.col("__b").alias("b"))).alias("__l"))
    met = lambda x: F.when(x["a"] <= x["b"], F.flatten(F.transform(F.sequence(x["a"], x["b"]), lambda b: F.coalesce(F.try_element_at("__m", b), none))))
    both = l.join(r, keys, "left").select(*keys, F.explode(F.transform("__l", lambda x: F.struct(x["own"].alias("own"), met(x).alias("near")))).alias("__x"))
    return both.select(*keys, "__x.own.*", F.col("__x.near").alias(name)).select(*left.columns, name)


def beside(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[Column, Column], low: Column, high: Column | None = None, name: str = "near") -> DataFrame:
    """left with the rows of right on its page whose bands its span of y touches, as an array; null or empty without any.

    As ``around``, but left stays as rows: the page's right rows stand in one row by bands, which left rows look up by hash.
    So left is shuffled once, neither sorted nor grouped again. For pages with few right rows.
    """
    rest = F.struct(*[c for c in right.columns if c not in keys])
    r = banded(right, low, high, "__band").where("__band is not null").repartition(*keys)
    r = r.groupBy(*keys, "__band").agg(F.collect_list(rest).alias("__r"))
    r = r.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__band", "__r"))).alias("__m"))
    none = F.array().cast(r.schema["__m"].dataType.valueType)
    a, b = [F.floor(v / BAND).cast("int") for v in span]
    own = lambda i: F.coalesce(F.try_element_at("__m", i), none)
    met = F.when(a == b, own(a)).when(a < b, F.flatten(F.transform(F.sequence(a, F.greatest(a, b)), own)))
    return left.join(r.hint("shuffle_hash"), keys, "left").withColumn(name, met).select(*left.columns, name)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], distance: Column, within: Column, payload: Column, order: Column, name: str) -> DataFrame:
    """left with the payload of its nearest right row (ties: first in order); null where none is within."""
    joined = left.join(right, keys, "left").where(within | F.lit(True))
    hit = F.when(within, F.struct(distance.alias("d"), order.alias("o"), payload.alias("p")))
    best = joined.groupBy(*left_id).agg(F.min(hit).alias("__b"))
    return left.join(best, left_id, "left").withColumn(name, F.col("__b.p")).drop("__b")


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """Most frequent value of each group; ties go to the one seen first."""
    seen = F.struct(*order)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(seen).alias("__o"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), "__o")).alias(name))


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str, a: str, b: str, name: str = "component") -> DataFrame:
    """Smallest node reachable within a page, for bounded pages: one fold over each page's edges.

    Nodes and edges of a page meet in one row; labels go through the edges as often
    as a page has nodes at most, until they settle.
    """
    links = edges.groupBy(*keys).agg(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("__e"))
    pages = nodes.groupBy(*keys).agg(F.array_sort(F.collect_set(node)).alias("__n")).join(links, keys, "left")
    schema = ", ".join([*(f"{k} {t}" for k, t in pages.select(*keys).dtypes), f"{node} {dict(nodes.dtypes)[node]}", f"{name} {dict(nodes.dtypes)[node]}"])

    def run(batches):
        import pyarrow as pa

        for x in batches:
            cols = x.to_pydict()
            out = []
            for *key, ns, es in zip(*(cols[k] for k in keys), cols["__n"], cols["__e"]):
                root = {n: n for n in ns}

                def find(i):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for e in es or ():
                    i, j = find(e["a"]), find(e["b"])
                    root[max(i, j)] = min(i, j)
                out += [(*key, n, find(n)) for n in ns]
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, node, name], r)) for r in out]) if out else pa.RecordBatch.from_pydict({k: [] for k in [*keys, node, name]})

    return pages.mapInArrow(run, schema)
