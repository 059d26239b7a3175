"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; a binary classifier over character n-grams
predicts each bit. A text is decoded to the codeword with the least weighted loss:
the bit's loss exp(-margin), weighted by how reliable the bit was on rows held
back from its fit. The margin between the best and the second-best codeword flags
ambiguous texts.

Features: lower-cased text with runs of non-letters as one space; 2-grams and 3-grams
of code points hashed into ``DIM`` places, square roots of their shares, over the
whole text in pieces. Classifiers are ridge regressions on a bounded, hash-chosen
sample: about ``PER_LANGUAGE`` learnable documents of each language and about ``SAMPLE`` of all, with at
least one document of each language however many there are. The driver solves a system of as
many unknowns as the sample has rows, or of ``DIM`` where those are fewer.

Defined results: texts that are null or hold no letter are ``und`` with score 0, as
is every text where nothing could be learned; one learned language is predicted for
all others with score 1; rows that repeat are judged each on its own; other columns
(also language and source) are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows, small

DIM = 4096
PER_LANGUAGE = 400
SAMPLE = 4096
RIDGE = 1e-3
PIECE = 1 << 20
#: Languages up to which all divisions in two are used as bits.
EXHAUSTIVE = 6
AMBIGUOUS = 0.2
SEED = 11

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    out = np.zeros(DIM, np.float64)
    carry = np.zeros(0, np.uint32)
    for at in range(0, len(text), PIECE):
        piece = _OTHER.sub(" ", text[at : at + PIECE].lower())
        if not at:
            piece = " " + piece
        if at + PIECE >= len(text):
            piece += " "
        a = np.concatenate([carry, np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)])
        done = len(carry)
        for n, mult in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
            if len(a) < n:
                continue
            h = a[: len(a) - n + 1] * np.uint32(mult)
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + a[k : len(a) - n + 1 + k]
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)
            h = h[max(0, done - n + 1) :]  # those within the carried end are counted already
            out += np.bincount(h >> np.uint32(32 - 12), minlength=DIM)
        carry = a[-2:]
    return out


def shape(c: np.ndarray) -> np.ndarray:
    total = c.sum(-1, keepdims=True)
    return np.sqrt(c / np.where(total > 0, total, 1))


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """n rows of +1 and -1: all divisions in two for few languages, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        sides = [set(c) for k in range(0, n - 1) for c in combinations(range(1, n), k)]
        return np.array([[1.0 if i == 0 or i in s else -1.0 for s in sides] for i in range(n)])
    bits = int(np.ceil(10 * np.log2(n)))
    r = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(50 if n <= 256 else 1):
        code = r.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        d = (code.shape[1] - code @ code.T) / 2
        least = d[~np.eye(n, dtype=bool)].min()
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # bits

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous)."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = shape(counts(text)) @ self.weight + self.bias
        loss = np.exp(-np.clip(self.code * margin, -3, 3)) @ self.trust
        like = np.exp(-8 * (loss - loss.min()))
        like /= like.sum()
        order = np.argsort(-like, kind="stable")
        return self.languages[order[0]], float(like[order[0]]), bool(like[order[0]] - like[order[1]] < AMBIGUOUS)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """From shaped features and their languages; a fifth is held back to weigh the bits."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIM, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    place = {v: i for i, v in enumerate(languages)}
    y = code[[place[v] for v in labels]]

    def solve(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = x[rows], y[rows]
        mean = a.mean(0)
        a = a - mean
        middle = b.mean(0)
        ridge = max(RIDGE * (a**2).sum(), 1e-9)  # equal features leave nothing but the mean
        if len(rows) <= DIM:
            w = a.T @ np.linalg.solve(a @ a.T + ridge * np.eye(len(rows)), b - middle)
        else:
            w = np.linalg.solve(a.T @ a + ridge * np.eye(DIM), a.T @ (b - middle))
        return w, middle - mean @ w

    back = np.arange(len(labels)) % 5 == 4
    trust = np.ones(code.shape[1])
    if back.any() and (~back).sum() > len(languages):
        w, bias = solve(np.flatnonzero(~back))
        right = (np.sign(x[back] @ w + bias) == y[back]).mean(0)
        trust = np.clip(2 * right - 1, 0.05, 1.0)
    w, bias = solve(np.arange(len(labels)))
    return Model(languages, code, w, bias, trust / trust.sum())


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits on a sample that the driver gets as feature vectors: per_language rows of each language on average, ``SAMPLE`` of all."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    # a null id has no remainder and is not learned from
    able = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    able = able.where(F.col("text").rlike(r"\p{L}")).withColumn("draw", draw)
    of_each = checkpointed(able.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("draw", "doc_id", "text")).alias("first")))
    kinds = of_each.count()
    if not kinds:
        return fit(np.zeros((0, DIM)), [])
    share = F.lit(float(min(per_language, SAMPLE / kinds))) / F.col("n")
    drawn = able.join(small(of_each.select("lang", share.alias("share"), F.col("first.draw").alias("least"))), "lang").where("draw < share and draw > least")
    first = of_each.select("first.doc_id", "first.text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [shape(counts(t)).astype(np.float32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(vectors, pa.binary())], names=["doc_id", "lang", "x"])

    rows = drawn.select("doc_id", "text", "lang").unionByName(first)
    sample = rows.mapInArrow(run, "doc_id long, lang string, x binary").dropDuplicates().collect()  # rows that repeat whole count once
    sample.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    sample = [sample[i] for i in np.random.default_rng(SEED).permutation(len(sample))]
    return fit(np.array([np.frombuffer(r["x"], np.float32) for r in sample], np.float64).reshape(-1, DIM), [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x bits numbers

    def make():
        m = sent.value
        return lambda rows: [(i, *m.predict(t)) for i, t in rows]

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return map_rows(rows, make, "doc_id long, lang_pred string, score double, ambiguous boolean")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op5."""
    found = predict(docs, learn(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
