"""How far the sources of a language differ in their terms: counts and pair sums by DuckDB in shards.

Tasks count the terms of their documents with one DuckDB statement over pieces of Arrow
batches. Spark merges the counts by (lang, term, source) and then hashes them by
(lang, term) into shards, where DuckDB keeps the terms with enough documents and, in a
second pass, makes partial pair sums, each source's strongest terms and a histogram of its
counts. Spark merges the sums and ranks them.

Pair sums are over all kept terms, also those that neither source has, without a row for
each of them. With z the smoothed share of a term that a source lacks,

    sum f(p, q) = sum over shared terms of f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)
                + sum over terms of the first of f(p, zq) - f(zp, zq)
                + sum over terms of the second of f(zp, q) - f(zp, zq)
                + V f(zp, zq)

so shards join only sources that share a term, and the two middle sums follow from how
often each count occurs. Shares depend on totals, hence two passes with a checkpoint between.

Sizes. Counts are merged by source before terms come together, so a term that every
document holds has one row a source. Shards are read sorted, ``CHUNK`` rows at a time;
pairs are made for ``BLOCK`` sources at a time. Totals (a row for each language and source) are
broadcast after a count, beyond it joined by shuffle.

Defined results: null text, language and source are read as empty; empty texts and
texts without terms still make their source occur; repeated rows count each as a
document; ties rank by item in UTF-8 order; an empty table gives no row; further columns are ignored.
Arithmetic is exact: 128-bit integers in DuckDB, decimals of 38 digits in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, checkpointed, tidied

LEAST_DOCUMENTS = 3
TOP = 200
SCALE = 1_000_000_000
#: Bytes of text that a task counts at once, rows of a shard and sources that it pairs at once.
PIECE_BYTES = 16 << 20
CHUNK = 250_000
BLOCK = 256

#: What terms are made of: letters of ASCII and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "CASE WHEN strlen(text) = length(text) THEN lower(text) ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END"

_COUNT = f"""SELECT place, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM (
 SELECT doc, place, term, count(*) AS n FROM (SELECT doc, place, unnest(regexp_extract_all({_LOWER}, '{TERM}')) AS term FROM piece) GROUP BY doc, place, term) GROUP BY place, term"""

_KEEP = f"""SELECT lang, term, source, n, (sum(n) OVER p)::BIGINT AS n_lang, (row_number() OVER p = 1)::BIGINT AS is_first
 FROM piece WINDOW p AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER p >= {LEAST_DOCUMENTS}"""


def _p(n: str, total: str, terms: str = "v") -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({n} + 1)) // ({total} + {terms}))::BIGINT"


def _f(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) // {q})"


_SHARES = f"CREATE OR REPLACE TEMP TABLE share AS SELECT lang, term, source, place, n, {_p('n', 'total')} AS p, {_p('0', 'total')} AS z, {_p('n_lang', 'total_lang')} AS q FROM piece"
_PAIRS = f"""SELECT 'pair' AS kind, a.lang, a.source, b.source AS item, sum({_f('a.p', 'b.p')} - {_f('a.p', 'b.z')} - {_f('a.z', 'b.p')} + {_f('a.z', 'b.z')})::DECIMAL(38, 0) AS value
 FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source WHERE a.place // {BLOCK} = {{block}} GROUP BY a.lang, a.source, b.source"""
_TERMS = f"""SELECT 'term' AS kind, lang, source, term AS item, {_f('p', 'q')}::DECIMAL(38, 0) AS value FROM share WHERE p > q
 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}"""
_ONES = "SELECT 'count' AS kind, lang, source, n::VARCHAR AS item, count(*)::DECIMAL(38, 0) AS value FROM share GROUP BY lang, source, n"


def _duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute("SET memory_limit = '1GB'")
    c.execute("SET temp_directory = ''")  # pieces are bounded; nothing is left in a task's folder
    return c


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents, some ``PIECE_BYTES`` at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
        held.append(b)
        size += b.nbytes
        if size >= PIECE_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _placed(piece: pa.Table) -> tuple[pa.Table, pa.Array, pa.Array]:
    """((doc, place, text), languages, sources): each pair of language and source stands for its place, a number."""
    lang, source = (piece[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    both = pc.add(pc.multiply(lang.indices.cast(pa.int64()), len(source.dictionary)), source.indices.cast(pa.int64())).dictionary_encode()
    of = both.dictionary
    return (
        pa.table({"doc": pa.array(range(piece.num_rows), pa.int64()), "place": both.indices, "text": piece["text"]}),
        lang.dictionary.take(pc.divide(of, len(source.dictionary))),
        source.dictionary.take(pc.subtract(of, pc.multiply(pc.divide(of, len(source.dictionary)), len(source.dictionary)))),
    )


def _batches(c, sql: str, schema: pa.Schema) -> list[pa.RecordBatch]:
    return c.sql(sql).to_arrow_table().cast(schema).to_batches()


def whole_terms(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Rows sorted by lang and term, about ``most`` at a time; a term's rows stay together."""
    most = most or CHUNK
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held)
        last = pc.and_(pc.equal(t["lang"], t["lang"][-1]), pc.equal(t["term"], t["term"][-1]))
        end = t.num_rows - (pc.sum(last).as_py() or 0)
        if end:
            yield t.slice(0, end)
        held, rows = t.slice(end).to_batches(), t.num_rows - end
    if held:
        yield pa.Table.from_batches(held)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents with the term, over whole texts."""

    schema = pa.schema([("place", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _duck()
        for piece in _pieces(batches):
            rows, langs, sources = _placed(piece)
            c.register("piece", rows)
            for b in _batches(c, _COUNT, schema):
                yield pa.RecordBatch.from_arrays([langs.take(b["place"]), sources.take(b["place"]), b["term"], b["n"], b["docs"]], names=["lang", "source", "term", "n", "docs"])

    plain = docs.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(a) for x, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    part = plain.mapInArrow(tidied(count), "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame) -> DataFrame:
    """(lang, term, source, n, n_lang, is_first): the terms in enough documents of their language."""

    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("n_lang", pa.int64()), ("is_first", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _duck()
        for piece in whole_terms(batches):
            c.register("piece", piece)
            yield from _batches(c, _KEEP, schema)

    return counts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(tidied(keep), "lang string, term string, source string, n long, n_lang long, is_first long")


def totals(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, total_lang, v, place): a row for each occurring group, also one without terms."""
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.sum("is_first").alias("v"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "total_lang", "v"]).withColumn("place", place)


def partial_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, lang, source, item, value): merged sums of the shards' pairs, terms and histograms."""

    schema = pa.schema([*((c, pa.string()) for c in ("kind", "lang", "source", "item")), ("value", pa.decimal128(38, 0))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _duck()
        for piece in whole_terms(batches):
            c.register("piece", piece)
            c.execute(_SHARES)
            for (block,) in c.execute(f"SELECT DISTINCT place // {BLOCK} FROM share").fetchall():
                yield from _batches(c, _PAIRS.format(block=block), schema)
            for q in (_TERMS, _ONES):
                yield from _batches(c, q, schema)

    few = groups.limit(SMALL + 1).count() <= SMALL
    both = kept.join(F.broadcast(groups) if few else groups, ["lang", "source"])
    shards = both.repartition("lang", "term").sortWithinPartitions("lang", "term")
    part = shards.mapInArrow(tidied(sums), "kind string, lang string, source string, item string, value decimal(38,0)")
    return part.groupBy("kind", "lang", "source", "item").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact; 1 where there is no term."""
    up = (F.lit(SCALE).cast("decimal(38,0)") * (n + 1)).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, F.greatest(total + terms, F.lit(1)).cast("decimal(38,0)"))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), as a decimal."""
    away = (p - q).cast("long")
    return F.call_function("div", away * away, q).cast("decimal(38,0)")


def pair_sums(sums: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    g = groups.select("lang", "source", "total", "v", share(F.lit(0), F.col("total"), F.col("v")).alias("z"))
    g = F.broadcast(g) if g.limit(SMALL + 1).count() <= SMALL else g
    other = g.select("lang", F.col("source").alias("item"), F.col("z").alias("zo"))
    apart = F.col("source") != F.col("item")
    base = g.join(other, "lang").where(apart).select("lang", "source", "item", (F.col("v").cast("decimal(19,0)") * excess(F.col("z"), F.col("zo"))).cast("decimal(38,0)").alias("value"))
    counts = sums.where("kind = 'count'").select("lang", "source", F.col("item").cast("long").alias("n"), F.col("value").alias("times")).join(g, ["lang", "source"])
    mine = counts.withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).join(other, "lang").where(apart)
    p, z, zo = F.col("p"), F.col("z"), F.col("zo")
    own = mine.select("lang", "source", "item", (F.col("times") * (excess(p, zo) - excess(z, zo))).cast("decimal(38,0)").alias("value"))
    theirs = mine.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * (excess(zo, p) - excess(zo, z))).cast("decimal(38,0)").alias("value"))
    shared = sums.where("kind = 'pair'").select("lang", "source", "item", "value")
    return base.unionByName(own).unionByName(theirs).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op11: pairs of sources and strongest terms, ranked."""
    kept = checkpointed(kept_terms(term_counts(docs)))
    groups = checkpointed(totals(docs, kept))
    sums = checkpointed(partial_sums(kept, groups))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = pair_sums(sums, groups).withColumn("rank", rank)
    terms = sums.where("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value")).withColumn("rank", rank).where(F.col("rank") <= TOP)
    order = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return order(pairs, "pair").unionByName(order(terms, "term"))


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT doc, lang, source, unnest(regexp_extract_all({_LOWER}, '{TERM}')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
 n AS (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
 s AS (SELECT *, {_p('n', 'sum(n) OVER o', 'count(*) OVER o')} AS p FROM n WINDOW o AS (PARTITION BY lang, source)),
 l AS (SELECT lang, term, {_p('n', 'sum(n) OVER o', 'count(*) OVER o')} AS q FROM k WINDOW o AS (PARTITION BY lang)),
 v AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum({_f('a.p', 'b.p')})::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
 UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)
 UNION ALL SELECT lang, source, 'term', term, {_f('p', 'q')} FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q)
 SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM v) WHERE part = 'pair' OR rank <= {TOP}"""
