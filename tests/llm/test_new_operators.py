"""Source audit, log-frequency Bloom filter and block centroids against plain loops, with edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import block_centroids as bc
from folioframe.llm import log_bloom as lb
from folioframe.llm import source_audit as sa

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, place int, value string, segment int, fp long"


def documents():
    r = random.Random(7)
    words = "the of and wind river Stone cloud green over under éa straße x1y don't ÄB".split()
    out = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "é", None, "z"])) for i in range(120)]
    out += [(200, None, "en", "only null"), (201, "", "fr", "a"), (202, "123 ... !!!", "fr", "b"), (203, "the " * 20000, "en", "a"), (204, "x" * 50000, "en", "b"), (None, "the of and", "en", "b")]
    out += [out[3]] * 4 + [(300 + k, "copy of a copy", "en", "hot") for k in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, "clash", 1, 2, "v", 3, 4) for i, t, lang, s in documents()], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11


def audit(rows):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for t, _, _ in rows]
    out = set()
    for lang in {x[1] for x in rows}:
        df, count = Counter(), {}
        for c, (_, own, s) in zip(terms, rows):
            if own == lang:
                df.update(c.keys())
                count.setdefault(s, Counter()).update(c)
        kept = [t for t in df if df[t] >= 3]
        v = len(kept)
        whole = Counter({t: sum(c[t] for c in count.values()) for t in kept})
        n = {s: sum(c[t] for t in kept) for s, c in count.items()}
        p = lambda c, total: 1 + 10**9 * (c + 1) // (total + v)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = [(sum(f(p(count[s][t], n[s]), p(count[o][t], n[o])) for t in kept), o) for o in count if o != s]
            own = [(t, p(count[s][t], n[s]), p(whole[t], sum(n.values()))) for t in kept if count[s][t]]
            best = [(f(a, q), t) for t, a, q in own if a > q]
            for part, found in (("pair", pairs), ("term", best)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= 200}
    return out


def test_audit_against_a_plain_count(docs):
    got = [tuple(r) for r in sa.digest(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == audit(documents())


def test_audit_in_small_chunks_and_blocks(docs, monkeypatch):
    for name, value in (("CHUNK", 3), ("BLOCK", 1), ("PIECE_BYTES", 200), ("SMALL", 0)):
        monkeypatch.setattr(sa, name, value)
    monkeypatch.setattr(sa, "_PAIRS", sa._PAIRS.replace("place // 256", "place // 1"))
    assert {tuple(r) for r in sa.digest(docs).collect()} == audit(documents())


def test_audit_of_large_counts(spark):
    share = spark.range(1).select(sa.share(F.lit(5 * 10**11), F.lit(7 * 10**11), F.lit(10**7)).alias("p")).first()["p"]
    assert share == 1 + 10**9 * (5 * 10**11 + 1) // (7 * 10**11 + 10**7)
    assert spark.range(1).select(sa.excess(F.lit(10**9 + 1), F.lit(1)).alias("f")).first()["f"] == 10**18


def test_audit_of_nothing(nothing):
    assert sa.digest(nothing).count() == 0


def test_terms_stay_together():
    rows = [("en", t) for t in sorted(["a"] * 7 + ["b"] + ["c"] * 2 + ["d"] * 5)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[k : k + 3]]) for i in (0, 1)], names=["lang", "term"]) for k in range(0, len(rows), 3)]
    pieces = [p["term"].to_pylist() for p in sa.whole_terms(iter(batches), 2)]
    assert sum(pieces, []) == [t for _, t in rows] and len(pieces) > 1
    assert sum(len(set(p)) for p in pieces) == 4


# ---- 12


def plain_words(t):
    return (t or "").encode().lower().split()


def test_base_columns_against_a_plain_count(docs):
    rows = documents()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(w for i, t, _, _ in rows if i is not None and not held(i) for w in [*plain_words(t), b""])
    n, v = sum(train.values()), len(train)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lb.digest(docs).collect())
    want = []
    for i, t, _, _ in rows:
        w = [*plain_words(t), b""]
        want.append((-1 if i is None else i, held(i), len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert got == sorted(want)


def test_words_of_arrow_are_words():
    r = random.Random(1)
    texts = [None, "", " "] + ["".join(r.choice("aB \t\n\v\f\r\x1c\x1d\x1e\x1f\x85  éÄ\x00") for _ in range(r.randrange(40))) for _ in range(500)]
    p = lb.Piece(texts)
    from xxhash import xxh64_intdigest

    got = [p.word[p.token[a : a + n]].tolist() for a, n in zip(p.first, p.sizes)]
    assert got == [[xxh64_intdigest(w) for w in [*plain_words(t), b""]] for t in texts]


def test_filter_never_forgets_and_seldom_errs():
    r = np.random.default_rng(3)
    h = np.sort(r.integers(0, 1 << 63, 60_000).astype(np.uint64) * np.uint64(2))
    level = lb.level(np.minimum(r.zipf(1.7, len(h)), 1_000_000))
    for least in (1, 4):
        keep = level >= least
        parts = []
        for s in range(4):
            own = keep & (lb.segment_of(h, 4) == s)
            parts.append((s, *lb.fill(h[own], level[own], least)))
        f = lb.Filter(4, parts, least)
        got = f.levels(h[keep])
        assert (got >= level[keep]).all() and (got > level[keep]).mean() < 0.03
        strange = r.integers(0, 1 << 63, 60_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        assert (f.levels(strange) > 0).mean() < (0.03 if least == 1 else 1e-4)


def test_levels_stand_for_their_counts():
    c = np.arange(1, 2000)
    q = lb.level(c)
    assert q[0] == 1 and (np.diff(q.astype(int)) >= 0).all()
    for k in np.unique(q[c < 1000]):
        own = c[q == k]
        assert own.max() == 1999 or lb.MEAN[k] == own.mean()
    assert (lb.MEAN[q[:3]] == [1, 2, 3]).all()


def test_score_is_the_formula_over_exact_counts(docs):
    rows = documents()
    train = [[b"", *plain_words(t), b""] for i, t, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for x in train for w in x[1:]), Counter(p for x in train for p in zip(x, x[1:]))
    mean = lambda c: float(lb.MEAN[lb.level(np.array([c]))[0]]) if c else 0.0
    n, v, s = sum(one.values()), len(one), sum(c == 1 for c in one.values())
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lb.digest(docs).collect()}
    off = []
    for i, t, _, _ in rows:
        x = [b"", *plain_words(t), b""]
        want = 0.0
        for a, b in zip(x, x[1:]):
            c2 = min(mean(two[a, b]), mean(one[a]), mean(one[b]))
            want += math.log10((c2 + lb.MU * (mean(one[b]) + s / (v + 1)) / (n + s)) / (mean(one[a]) + lb.MU))
        off.append(abs(got[i, len(x) - 1] - want) / len(x))
    # the filter takes a few n-grams for more frequent ones
    assert sum(x < 1e-6 for x in off) > 0.4 * len(off) and max(off) < 0.15


def test_rare_ngrams_by_shuffle_give_the_same(docs, monkeypatch):
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"])
    model = lb.learn(docs.where(~lb.held_out(F.col("doc_id"))), segment_bytes=2000)
    assert model.segments > 8
    whole = sorted(lb.score(docs, model).collect(), key=key)
    monkeypatch.setattr(lb, "PARTS_MOST", 2)
    assert model.least(600, 12) > 1
    slim = sorted(lb.score(docs, model, filter_most=600, words_most=12).collect(), key=key)
    assert len(whole) == len(slim) == len(documents())
    for a, b in zip(whole, slim):
        assert a[:4] == b[:4] and a["score"] == pytest.approx(b["score"], abs=0.15 * a["n_tokens"])
    assert sum(abs(a["score"] - b["score"]) < 1e-6 * a["n_tokens"] for a, b in zip(whole, slim)) > 0.3 * len(whole)


def test_rare_ngrams_are_looked_up_by_buckets_of_texts(docs, monkeypatch):
    model = lb.learn(docs.where(~lb.held_out(F.col("doc_id"))), segment_bytes=500)
    assert model.segments >= 32
    least = model.least(600, 12)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model.known(least))
    texts = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)))
    answers = lb._answers(texts, model, sent).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts")).collect()
    assert 1 < len(answers) <= 4 and all(r["n"] == r["parts"] <= -(-model.segments // lb.SHARE) for r in answers), "a row for each text and segment"
    # however texts and segments are dealt out, scores are the same
    key = lambda r: tuple((x is not None, x) for x in r[:3])
    got = []
    for size in (1 << 10, 4 << 20):
        monkeypatch.setattr(lb, "ASK_BYTES", size)
        got.append(sorted(lb.score(docs, model, filter_most=600, words_most=12).collect(), key=key))
    for a, b in zip(*got, strict=True):
        assert a[:3] == b[:3] and a["base_score"] == pytest.approx(b["base_score"]) and a["score"] == pytest.approx(b["score"])


def test_model_beats_single_words_on_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    r = lb.digest(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_scores_of_nothing(nothing, spark):
    assert lb.digest(nothing).count() == 0
    some = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert [(r["held_out"], r["n_known"], r["base_score"], r["score"]) for r in lb.digest(some).collect()] == [(False, 0, 0.0, 0.0)] * 2


# ---- 13


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), n) for n, (i, _) in enumerate(kept) if i is not None)[:k]
    c = [kept[n][1] for _, n in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // own.count(j) for x in zip(*(v for o, (_, v) in zip(own, kept) if o == j))] if j in own else m for j, m in enumerate(c)]
    found = [near(v) for _, v in kept]
    fits = lambda x: x if x < 1 << 63 else None
    inertia = lambda ds: None if any(d >= 1 << 63 for d in ds) else fits(sum(ds))
    return sorted(
        ((i if i is not None else -1, j, fits(d), inertia([x for x, y in found if y == j]), inertia([x for x, _ in found]), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found)),
        key=str,
    )


def got_clusters(df):
    return sorted(((r[0] if r[0] is not None else -1, *r[1:]) for r in bc.digest(df).collect()), key=str)


VEC = "vec_id long, embedding array<float>, label int, cluster string, v int, distance double"


def vectors(n, scale=1.0):
    r = np.random.default_rng(5)
    return [(i, (r.normal(size=64) * scale).astype(np.float32).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", 1, 2.0) for i, e in rows], VEC)


@pytest.mark.parametrize("scale", [0.2, 40.0])
def test_clusters_against_plain_loops(spark, scale):
    rows = vectors(150, scale)
    rows += [rows[0]] * 3 + [(500, rows[1][1]), (None, rows[2][1]), (501, None), (502, [1.0] * 63), (503, [1.0] * 65), (504, [1.0] * 63 + [None]), (505, [float("nan")] + [0.0] * 63), (506, [float("inf")] * 64), (507, [0.0] * 64)]
    assert got_clusters(frame(spark, rows)) == plain_clusters(rows)


def test_giants_are_exact(spark):
    rows = vectors(45) + [(100, [3e38] * 64), (101, [-3e38, *[0.0] * 63]), (102, [6e5] * 64)]
    assert got_clusters(frame(spark, rows)) == plain_clusters(rows)


def test_few_equal_and_no_vectors(spark):
    few = vectors(3) + [(9, vectors(1)[0][1])]
    assert got_clusters(frame(spark, few)) == plain_clusters(few)
    equal = [(i, [0.5] * 64) for i in range(60)]
    assert got_clusters(frame(spark, equal)) == plain_clusters(equal)
    assert bc.digest(frame(spark, [])).count() == 0
    assert bc.digest(frame(spark, [(1, None)])).count() == 0


def test_screen_spares_nearly_all_exact_distances(spark, data):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{data}/../sf0.1/embeddings.parquet").collect()])
    for scale, most in ((256, 1.1), (100_000, 2.0)):
        v = np.floor(x * scale).astype(np.int64)
        for centres in (v[:40], np.array([v[i::40].mean(0).astype(np.int64) for i in range(40)])):
            best, far, taken = bc.nearest(v, bc.Screen.of(v), centres)
            d = ((v[:, None] - centres[None]) ** 2).sum(2)
            assert (d.argmin(1) == best).all() and (d.min(1) == far).all()
            assert taken <= most * len(v), "of 40 exact distances for each vector one or two are taken"


def test_bounds_hold_whatever_the_rounding():
    r = np.random.default_rng(8)
    for scale, shift in product((1, 100, 10**4, 10**7), (0, 1)):
        v = (r.normal(size=(200, 64)) * scale + shift * scale).round().astype(np.int64)
        c = v[:30] + r.integers(-2, 3, (30, 64))
        bound = bc.Screen.of(v).bounds(bc.Screen.of(c), bc.segment_norms(c))
        assert (bound <= ((v[:, None] - c[None]) ** 2).sum(2)).all()
