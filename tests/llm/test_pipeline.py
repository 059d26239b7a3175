"""The pipeline stage by stage against plain Python, on the smallest tables."""

import re

import numpy as np

import corpus_pipeline
from folioframe.llm import bpe_rounds, cube_mix, pii_crf, quality_ledger


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    seen["start"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda n: [r.doc_id for r in seen[n]]

    bad = {r.doc_id for r in quality_ledger.digest(spark.read.parquet(f"{data}/documents.parquet")).collect() if not r.kept}
    assert sorted(ids("quality")) == sorted(r.doc_id for r in seen["start"] if r.doc_id not in bad)

    from tests.llm.test_near_copies import kept

    assert sorted(ids("near_duplicates")) == kept([(r.doc_id, r.text) for r in seen["quality"]])

    before = {r.doc_id: r.text for r in seen["near_duplicates"]}
    weights = pii_crf.fitted()
    for r in seen["personal_data"]:
        assert r.text == pii_crf.masked(before[r.doc_id], pii_crf.spans(before[r.doc_id], weights)[1]) and r.n_chars == len(r.text)
        assert not pii_crf.base_spans(r.text)

    size = {r.doc_id: len(words(r.text)) for r in seen["personal_data"]}
    taken = {}
    for r in seen["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    plan = {r.source: r.target for r in cube_mix.targets(cube_mix.sized(spark.read.parquet(f"{tmp_path}/personal_data"))).collect()}
    largest = max(size.values())
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in plan.items())

    coder = bpe_rounds.opened(bpe_rounds.default_path())
    text = {r.doc_id: r.text for r in seen["mixing"]}
    assert sorted(ids("encoding")) == sorted(ids("mixing"))
    for r in seen["encoding"]:
        assert coder.decode(bytes(r.ids)) == text[r.doc_id] and r.n_tokens == len(np.frombuffer(r.ids, "<u4"))


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 0


EDGES = [
    (1, None), (None, " ".join(f"none{i}" for i in range(60))), (2, ""), (3, " \n\t"), (4, "x" * 200_000), (5, "w " * 30_000), (6, "same text here " + " ".join(f"word{i}" for i in range(80))),
    (7, "same text here " + " ".join(f"word{i}" for i in range(80))), (7, "other text " + " ".join(f"w{i}" for i in range(90))), (8, None), (9, " ".join(f"v{i}" for i in range(25_000))), (10, " ".join(f"u{i} a.b{i}@mail.example.com" for i in range(70))),
]


def test_stages_on_edges(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, class string, token long, fp string, __copies int, `a b` string"
    for n, rows in enumerate((EDGES, [])):
        docs = spark.createDataFrame([(i, t, None, [None, "a"][k % 2], None, "clash", 1, "clash", 3, "v") for k, (i, t) in enumerate(rows)], schema)
        ids = {r.doc_id for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "encoding":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{n}{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}{name}")
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
            if name == "near_duplicates" and rows:
                kept = sorted(r.doc_id or 0 for r in docs.select("doc_id").collect())
                assert kept == [0, 6, 7, 9] and docs.where("doc_id = 7").first().text.startswith("other")
        assert (docs.count() > 0) == bool(rows)
