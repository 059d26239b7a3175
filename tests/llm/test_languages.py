"""Language identification where the sample is odd: equal texts, one row, very many languages."""

import re

import numpy as np

from folioframe.llm import ecoc_langid as ecoc


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def learnable(n):
    import zlib

    return [i for i in range(4 * n + 40) if zlib.crc32(str(i).encode()) % 3 != 1][:n]


def test_equal_texts_under_two_languages(spark):
    ids = learnable(4)
    found = ecoc.digest(frame(spark, [(i, "the same words", "ab"[k % 2]) for k, i in enumerate(ids)])).collect()
    assert len(found) == 4 and {r["lang_pred"] for r in found} <= {"a", "b"} and all(0 <= r["score"] <= 1 for r in found)


def test_one_row_and_rows_that_repeat(spark):
    (i,) = learnable(1)
    assert [r["lang_pred"] for r in ecoc.digest(frame(spark, [(i, "words", "a")])).collect()] == ["a"]
    assert {r["lang_pred"] for r in ecoc.digest(frame(spark, [(i, "words", "a")] * 50)).collect()} == {"a"}


def test_each_language_has_a_row_however_many(spark, monkeypatch):
    monkeypatch.setattr(ecoc, "SAMPLE", 100)
    ids = learnable(400)
    docs = frame(spark, [(i, f"{'abcdefghij'[k % 10] * 4} {'klmnopqrst'[k // 10 % 10] * 4} {'uvwx'[k // 100] * 4}", f"l{k}") for k, i in enumerate(ids)])
    model = ecoc.learn(docs)
    assert len(model.languages) == 400
    right = [r for r in ecoc.predict(docs, model).join(docs, "doc_id").collect() if r["lang_pred"] == r["lang"]]
    assert len(right) > 200  # one short text each; by chance it would be one


def place(gram):
    """Place of one n-gram, with plain numbers."""
    u = 0xFFFFFFFF
    h = ord(gram[0]) * {2: 0x9E3779B1, 3: 0x85EBCA6B}[len(gram)] & u
    for c in gram[1:]:
        h = ((h ^ h >> 15) * 0x2C1B3C6D + ord(c)) & u
    return ((h ^ h >> 13) * 0x297A2D39 & u) >> 20


def test_counts_of_features(monkeypatch):
    text = "  Ab, ab\tÉé 9 ab! straße 😀 x" * 3
    plain = " " + re.sub(r"[^a-zßé]+", " ", text.lower()) + " "
    want = np.zeros(ecoc.DIM)
    for n in (2, 3):
        for i in range(len(plain) - n + 1):
            want[place(plain[i : i + n])] += 1
    assert (ecoc.counts(text) == want).all()
    assert (ecoc.counts(text.upper().replace("STRASSE", "straße")) == want).all()
