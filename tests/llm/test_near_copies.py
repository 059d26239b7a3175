"""Groups of near copies against all pairs in plain Python."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([b" ".join(w)] if w else [])


def kept(texts):
    """Smallest id of each component of pairs with a similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if j < i and label[i] != label[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    return sorted(set(label.values()))


def planted():
    """Texts, each with copies that have one to a fifth of their words changed, some of which are too far."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    common = [word() for _ in range(30)]
    texts = []
    for n in [3, 5, 8, 20, 40, 60, 100, 150, 200, 300, 400, 1200] * 2:
        base = [word() for _ in range(n)] + common * r.randrange(2)
        texts.append(base)
        for share in (0, 0.005, 0.01, 0.02, 0.02, 0.03, 0.05):
            copy = list(base)
            for _ in range(round(share * n)):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy[: len(copy) - r.randrange(1 + len(copy) // 20)])
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " "), (902, "")]


def test_stage_removes_planted_near_copies(spark):
    texts = planted()
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(texts, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == kept(texts)


def test_rest_finds_what_the_index_misses(spark, monkeypatch):
    from folioframe.llm import near_copies

    monkeypatch.setattr(near_copies, "RADIUS", -1)
    monkeypatch.setattr(near_copies, "PIECE", 5)
    monkeypatch.setattr(near_copies, "BINNED", 150)
    texts = planted()
    got = near_copies.deduplicated(spark.createDataFrame(texts, SCHEMA))
    assert sorted(r.doc_id for r in got.collect()) == kept(texts)


def test_spanning_forest_is_nearest_first():
    import numpy as np

    from folioframe.llm.near_copies import spanning

    r = np.random.default_rng(1)
    for _ in range(50):
        n, m = 30, 80
        a, b, d = r.integers(0, n, m), r.integers(0, n, m), r.integers(0, 6, m)
        some = spanning(a, b, d, n)
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        least = 0
        for k in np.argsort(d, kind="stable"):
            x, y = find(a[k]), find(b[k])
            if x != y:
                root[x] = y
                least += d[k]
        assert d[some].sum() == least and len(some) == n - len({find(x) for x in range(n)})


def test_most_shared_is_a_bound():
    import numpy as np

    from folioframe.llm.near_copies import _bins, most_shared

    r = np.random.default_rng(2)
    sets = []
    for n in (3, 20, 120, 130, 260, 500, 600):
        base = r.integers(0, 1 << 62, n).astype(np.uint64)
        for share in (0.0, 0.1, 0.5):
            other = base.copy()
            other[: int(share * n)] = r.integers(0, 1 << 62, int(share * n))
            sets.append(np.unique(other))
    i, j = (x.reshape(-1) for x in np.meshgrid(range(len(sets)), range(len(sets))))
    bound = most_shared([_bins(s) for s in sets], np.array([len(s) for s in sets]), i, j)
    true = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (bound >= true).all() and (bound < np.minimum([len(sets[a]) for a in i], [len(sets[b]) for b in j])).sum() > 100
