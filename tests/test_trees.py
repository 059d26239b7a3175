"""Brackets against a plain stack, trees against plain walks: deep, broken, cyclic."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import trees

KEY = ["page_id"]


def stack(kinds):
    """(depth, parent, closes) of each event by a list used as a stack."""
    out, open_ = [], []
    for i, k in enumerate(kinds):
        top = open_[-1] if open_ else None
        if k == -1:
            out.append((len(open_), None, top))
            if open_:
                open_.pop()
        else:
            out.append((len(open_), top, None))
            if k == 1:
                open_.append(i)
    return out


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(3)
    rows = [(p, i, r.choice([1, 1, -1, -1, 0]), r.choice("ABC")) for p in range(30) for i in range(r.randrange(0, 60))]
    rows += [(100, i, 1 if i < 1000 else -1, "A" if i == 3 else "B") for i in range(2005)]
    return rows, spark.createDataFrame(rows, "page_id long, ordinal long, kind int, role string")


def by_page(rows):
    out = {}
    for p, i, k, role in sorted(rows):
        out.setdefault(p, []).append((k, role))
    return out


def test_brackets_against_a_stack(events):
    rows, df = events
    got = {(r["page_id"], r["ordinal"]): (r["depth"], r["parent"], r["closes"]) for r in trees.bracketed(df, KEY, "ordinal", "kind").collect()}
    want = {(p, i): x for p, seq in by_page(rows).items() for i, x in enumerate(stack([k for k, _ in seq]))}
    assert got == want
    assert max(x[0] for x in want.values()) == 1000


def test_inside_at_any_level(events):
    rows, df = events
    e = trees.within(trees.bracketed(df, KEY, "ordinal", "kind"), KEY, "ordinal", "kind", F.col("role") == "A").where("kind >= 0")
    got = {(r["page_id"], r["ordinal"]): r["inside"] for r in e.collect()}
    want = {}
    for p, seq in by_page(rows).items():
        open_ = []
        for i, (k, role) in enumerate(seq):
            if k >= 0:
                want[p, i] = role == "A" or "A" in open_
            if k == 1:
                open_.append(role)
            elif k == -1 and open_:
                open_.pop()
    assert got == want and sum(want.values()) > 990


def test_a_chain_of_a_thousand_and_cycles(spark):
    rows = [(1, i, i - 1 if i else None) for i in range(1000)] + [(2, 0, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, None), (2, 5, 4), (2, 6, 99), (3, 0, 0)]
    got = {(r["page_id"], r["ordinal"]): r for r in trees.rooted(spark.createDataFrame(rows, "page_id long, ordinal long, parent long"), KEY, "ordinal", "parent").collect()}
    assert len(got) == len(rows)
    assert all(got[1, i]["depth"] == i and got[1, i]["root"] == 0 and got[1, i]["path"] == list(range(i + 1)) for i in range(1000))
    assert [got[2, i]["cyclic"] for i in range(7)] == [True] * 4 + [False] * 3 and got[3, 0]["cyclic"]
    assert got[2, 0]["depth"] is None and got[2, 5]["path"] == [4, 5]
    assert (got[2, 6]["depth"], got[2, 6]["root"]) == (0, 6), "a parent that is no node makes a root"


def test_pages_become_one_tree(spark):
    rows = [("d", 1, 0, None, "Document"), ("d", 1, 1, 0, "H1"), ("d", 1, 2, 1, "Span"), ("d", 2, 0, None, "Sect"), ("d", 2, 1, 0, "P"), ("e", 1, 0, None, "Document"), ("d", 3, 0, 1, "P"), ("d", 3, 1, 0, "P")]
    t = trees.merged(spark.createDataFrame(rows, "doc string, page long, node long, parent long, role string"), ["doc"], "page", "node", "parent", "role", ("Document",))
    got = {(r["doc"], r["page"], r["node"]): (r["parent"], r["depth"], r["path"]) for r in t.collect()}
    assert got == {("d", 1, 1): (None, 1, [1]), ("d", 1, 2): (1, 2, [1, 2]), ("d", 2, 0): (None, 1, [0]), ("d", 2, 1): (0, 2, [0, 1]), ("d", 3, 0): (1, None, None), ("d", 3, 1): (0, None, None)}


def test_outline_without_destination(spark):
    items = spark.createDataFrame([(1, 0, None, "a"), (1, 1, 0, "b"), (1, 2, 1, None)], "page_id long, ordinal long, parent long, name string")
    to = spark.createDataFrame([("b", 6)], "name string, page long")
    got = {r["ordinal"]: (r["depth"], r["page"]) for r in trees.outline(items, to, KEY, "ordinal", "parent", "name").collect()}
    assert got == {0: (0, 1), 1: (1, 7), 2: (2, 1)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, ordinal long, parent long, kind int")
    assert trees.rooted(none, KEY, "ordinal", "parent").count() == 0
    assert trees.bracketed(none.drop("parent"), KEY, "ordinal", "kind").count() == 0
