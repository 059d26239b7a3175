"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document. Its outcome is one bit of
``fail_bits``; the measurements stay beside it. A policy is a versioned set of
rules, so a bit mask: applying it, comparing versions and asking what each rule
costs (ablation) read the ledger and never the texts again.

Defined results: a null text has no words, an empty table gives an empty
ledger, repeated rows are judged each on its own, other columns of the input are
ignored (the ledger has ``doc_id``, ``source`` and its own columns only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Rule name -> condition of failure over the measurements. The order gives the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_density": "100 * n_symbols > 25 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "100 * word_chars < 250 * n_words",
    "long_words": "100 * word_chars > 1200 * n_words",
}

#: Version -> the rules that it enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_density", "duplicate_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[policy])


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Evaluates columns once for each row, whatever is asked of them above.

    The optimiser would write an expression again wherever its name is used, also
    into filters below; a generator over an array of one struct holds the line.
    """
    return df.select(F.explode(F.array(F.struct(*columns))).alias("__r")).select("__r.*")


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements of each whole text, by columns ``keep``.

    Windows of three words are sorted with their places; equal neighbours mark both.
    That is n log n in the words of one text and needs no shuffle.
    """
    kept = [F.col(c) for c in keep]
    t = F.coalesce(F.col(text), F.lit(""))
    a = _once(docs, *kept, t.alias("__t"), words_of(t).alias("__w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    n = F.size("__w")
    m = F.greatest(n - 2, F.lit(1))
    windows = F.arrays_zip(
        F.slice("__w", 1, m).alias("a"), F.slice("__w", 2, m).alias("b"), F.slice("__w", 3, m).alias("c"), F.sequence(F.lit(1), m).alias("p")
    )
    known = [F.col(c) for c in MEASURES[:-1]]
    a = _once(
        a, *kept, n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(windows)).alias("__s"),
    )
    same = F.zip_with("__s", F.slice("__s", 2, F.greatest(F.size("__s"), F.lit(1))), lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False)))
    a = _once(a, *kept, *known, F.col("__s.p").alias("__p"), same.alias("__e"))
    marked = F.filter(F.arrays_zip(F.col("__p").alias("p"), F.col("__e").alias("x"), F.concat(F.array(F.lit(False)), "__e").alias("y")), lambda w: (w["x"] | w["y"]) & w["p"].isNotNull())
    places = F.array_distinct(F.flatten(F.transform(marked, lambda w: F.array(w["p"], w["p"] + 1, w["p"] + 2))))
    return _once(a, *kept, *known, F.when(F.col("__p").isNull(), F.lit(0)).otherwise(F.size(places)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measurements and ``fail_bits`` (bit i: rule i fails)."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("long"))
    return measure(docs, text, keep).withColumn("fail_bits", bits)


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str = CURRENT, by: tuple[str, ...] = ()) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects.

    The ledger is first reduced to its distinct bit patterns (at most 2 to the
    number of rules for each group), with map-side counts; the rest works on those.
    """
    m = mask(policy)
    patterns = book.groupBy(*by, F.col("fail_bits").bitwiseAND(F.lit(m)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(RULES) if name in POLICIES[policy]])
    rows = patterns.select(*by, "p", "n", F.explode(rules).alias("r"))
    hit = F.col("p").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(*by, F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("p") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.bit_or("p").alias("seen_bits"),
    )


def accepted(docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy passes, with docs' columns; nothing is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    book = ledger(docs.select(row, F.col(text).alias("__text")), "__text", ("__row",))
    return book.where(passes(policy)).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op9."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes(CURRENT).alias("kept"), "fail_bits",
    )


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls, t, doc_id
  FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1
), p AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN p USING (rid)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * word_chars < 250 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * word_chars > 1200 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
