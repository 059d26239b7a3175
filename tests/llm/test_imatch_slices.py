"""A lexicon in slices gives what a whole one gives, also for rows that differ only in what their edit loses."""

import random

from folioframe.llm import imatch


def test_slices_tell_rows_apart(spark):
    r = random.Random(6)
    words = [f"w{i:02d}" for i in range(40)]
    rows = [(i, " ".join(r.choice(words) for _ in range(12))) for i in range(40)]
    start = " ".join(words[:6]) + " "
    rows += [(50, start + " ".join(words[k : k + 6])) for k in (10, 16, 22, 28)]  # equal id, length and first half
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: tuple(map(str, x))
    whole = sorted(imatch.digest(df).collect(), key=key)
    assert sorted(imatch.digest(df, most=7).collect(), key=key) == whole and len(whole) == len(rows)
    assert len({x["fingerprint"] for x in whole if x["doc_id"] == 50}) == 4
