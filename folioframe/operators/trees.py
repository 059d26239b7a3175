"""Trees: brackets matched by windows, roots, depths and paths by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds between two cuts of the lineage.
EACH = 4


def bracketed(events: DataFrame, keys: list[str], order: str, kind: str) -> DataFrame:
    """events with ``depth`` (elements open around one), ``parent`` (the innermost of them) and ``closes``.

    ``kind`` is 1 where an element opens, -1 where the innermost open one closes, 0 for one
    without content. Closing where nothing is open does nothing; what never closes stays open to the end.
    Two passes over a page's sorted events whatever the depth: the element that is open at a
    level is the last one that was opened to it.
    """
    ahead = Window.partitionBy(*keys).orderBy(order)
    up = ahead.rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("__s", F.sum(kind).over(up))
    e = e.withColumn("__d", F.col("__s") - F.least(F.lit(0), F.min("__s").over(up))).drop("__s")  # a walk that doesn't go below 0
    e = e.withColumn("depth", F.when(F.col(kind) == 1, F.col("__d") - 1).when(F.col(kind) == 0, F.col("__d")).otherwise(F.coalesce(F.lag("__d").over(ahead), F.lit(0))))
    # an opening stands at its own level for others and at the one above for itself
    asks = F.struct(F.col("depth").alias("level"), F.lit(False).alias("opens"))
    both = F.array_compact(F.array(asks, F.when(F.col(kind) == 1, F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("opens")))))
    rows = e.withColumn("__r", F.explode(both))
    level = Window.partitionBy(*keys, "__r.level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(F.col("__r.level") > 0, F.last(F.when(F.col("__r.opens"), F.col(order)), ignorenulls=True).over(level))
    rows = rows.withColumn("__p", found).where(~F.col("__r.opens"))
    return rows.select(*events.columns, "depth", F.when(F.col(kind) >= 0, F.col("__p")).alias("parent"), F.when(F.col(kind) < 0, F.col("__p")).alias("closes"))


def within(elements: DataFrame, keys: list[str], order: str, kind: str, flag: Column) -> DataFrame:
    """bracketed() rows with ``inside``: whether an element or one around it is flagged, at any level.

    A flagged element counts from its opening to what closes it; no list of ancestors is made.
    """
    opening = elements.where(F.col(kind) == 1).select(*keys, F.col(order).alias("closes"), F.coalesce(flag, F.lit(False)).alias("__f"))
    e = elements.join(opening, [*keys, "closes"], "left")
    own = F.coalesce(flag, F.lit(False))
    step = F.when((F.col(kind) == 1) & own, 1).when((F.col(kind) == -1) & F.col("__f"), -1).otherwise(0)
    up = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("inside", (F.sum(step).over(up) > 0) | ((F.col(kind) == 0) & own)).drop("__f")


def rooted(nodes: DataFrame, keys: list[str], node: str, parent: str, paths: bool = True) -> DataFrame:
    """nodes with ``depth``, ``root``, ``path`` (nodes from the root on) and ``cyclic``.

    Pointer doubling: in each round a node takes over what the node it points to knows and points to
    where that points, so a tree of depth n takes log2(n) joins. A node whose parent is null or no node is a root.
    Nodes on a cycle, or below one, never reach a root: they are cyclic, with null depth, root and path.
    """
    known = nodes.select(*keys, F.col(node).alias(parent), F.lit(True).alias("__known"))
    n = nodes.join(known, [*keys, parent], "left")
    up = F.when(F.col("__known"), F.col(parent))
    own = [c for c in nodes.columns]
    n = n.select(*own, up.alias("__up"), F.when(up.isNull(), 0).otherwise(1).alias("depth"), F.coalesce(up, F.col(node)).alias("root"), F.array(F.col(node)).alias("path") if paths else F.lit(None).cast("array<long>").alias("path"))
    n = kept(n)
    most = max(1, n.count()).bit_length() + 1
    for i in range(most):
        if n.where("__up is not null").limit(1).count() == 0:
            break
        above = n.select(*keys, F.col(node).alias("__up"), F.col("__up").alias("__next"), F.col("depth").alias("__depth"), F.col("root").alias("__root"), F.col("path").alias("__path"))
        moved = n.join(above, [*keys, "__up"], "left")
        at = F.col("__depth").isNotNull()
        n = moved.select(
            *own, F.col("__next").alias("__up"), F.when(at, F.col("depth") + F.col("__depth")).otherwise(F.col("depth")).alias("depth"), F.when(at, F.col("__root")).otherwise(F.col("root")).alias("root"),
            F.when(at & F.lit(paths), F.concat("__path", "path")).otherwise(F.col("path")).alias("path"),
        )
        n = kept(n)
    cyclic = F.col("__up").isNotNull()
    return n.select(*own, *[F.when(~cyclic, F.col(c)).alias(c) for c in ("depth", "root", "path")], cyclic.alias("cyclic"))


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or "/tmp/folioframe-checkpoints")
    return df.checkpoint()


def merged(trees: DataFrame, keys: list[str], page: str, node: str, parent: str, role: str, merge: tuple[str, ...]) -> DataFrame:
    """One tree for each document out of its pages' trees: roots with a role in ``merge`` give way to their children.

    ``parent`` is null for the children of the document's own root; depths count from it.
    """
    r = rooted(trees, [*keys, page], node, parent)
    gone = r.where((F.col("depth") == 0) & F.col(role).isin(*merge)).select(*keys, page, F.col(node).alias("root"), F.lit(1).alias("__m"))
    r = r.join(gone, [*keys, page, "root"], "left").where((F.col("depth") > 0) | F.col("__m").isNull() | F.col("cyclic"))
    less = F.coalesce(F.col("__m"), F.lit(0))
    up = F.when((F.col("depth") == 1) & (less == 1), None).otherwise(F.col(parent))
    return r.select(*keys, page, node, up.alias(parent), role, (F.col("depth") + 1 - less).alias("depth"), F.when(less == 1, F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(1)))).otherwise(F.col("path")).alias("path"), "cyclic")


def outline(items: DataFrame, destinations: DataFrame, keys: list[str], node: str, parent: str, name: str) -> DataFrame:
    """items with their depth and ``page``, counted from 1: the page of the named destination, the first one where there is none.

    ``destinations`` has (name, page), one row for each name.
    """
    r = rooted(items, keys, node, parent)
    few = destinations.limit(SMALL + 1).count() <= SMALL
    to = destinations.select(name, F.col("page").alias("__page"))
    return r.join(F.broadcast(to) if few else to, name, "left").withColumn("page", F.coalesce("__page", F.lit(0)) + 1).drop("__page")


#: Rows up to which a table of names is sent to all tasks.
SMALL = 500_000
