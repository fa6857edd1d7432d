"""Surviving records and linked groups."""

import random

import pytest
from pyspark.sql import functions as F

from gapweave.llm.components import group_labels
from gapweave.llm.survivors import Bundle, build_survivors, choose_bundles

SCHEMA = "g long, id long, trust int, seen long, a string, b string, w int, h int, other string"


def plain(*names):
    return [Bundle(n, (n,)) for n in names]


def chosen(df, *args, **kw):
    return {(r["g"], r["bundle"]): r["id"] for r in choose_bundles(df, "g", "id", "trust", "seen", *args, **kw).collect()}


def test_order_of_trust_recency_and_id(spark):
    rows = [
        (1, 1, 2, 5, "x", None, 1, None, "z"), (1, 2, 3, None, "y", "p", None, None, "z"), (1, 3, 3, 4, "y", None, None, 3, "z"),
        (1, 4, 3, 4, None, "q", None, None, "z"), (2, 5, 1, 1, "only", "one", 1, 1, "z"), (None, 6, 1, 1, "no", "group", 1, 1, "z"),
        (3, 7, None, 1, "r", "s", 1, 1, "z"), (3, 7, None, 1, "r", "s", 1, 1, "z"), (4, 8, 0, 1, "t", None, 1, 1, "z"), (4, None, 9, 9, "u", "u", 1, 1, "z"), (4, 9, None, 1, "v", None, 1, 1, "z"),
    ]
    got = chosen(spark.createDataFrame(rows, SCHEMA), plain("a", "b", "w", "h"))
    # Groups with one record id, whatever its repeats, have no row; neither have fields without a value.
    assert got == {(1, "a"): 3, (1, "b"): 4, (1, "w"): 1, (1, "h"): 3, (4, "a"): 9, (4, "w"): 9, (4, "h"): 9}


def test_fractions_of_trust_count(spark):
    rows = [(1, 1, "0.1", 9, "x", "p"), (1, 2, "0.9", 1, "y", "q"), (2, 3, "NaN", 9, "x", "p"), (2, 4, "0.000001", 1, "y", "q"), (3, 5, None, 2, "x", "p"), (3, 6, "-1", 3, "y", "p")]
    df = spark.createDataFrame(rows, "g long, id long, trust string, seen long, a string, b string").withColumn("trust", F.col("trust").cast("double"))
    for dependencies in ([], [("a", "b")]):
        assert chosen(df, plain("a", "b"), dependencies) == {(1, "a"): 2, (1, "b"): 2, (2, "a"): 4, (2, "b"): 4, (3, "a"): 5, (3, "b"): 5}


def test_bundles_come_from_one_record(spark):
    rows = [(1, 1, 5, 1, "x", None, 10, None, ""), (1, 2, 1, 1, "y", None, 20, 30, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    bundles = [Bundle("a", ("a",)), Bundle("size", ("w", "h"), (F.col("w") > 0,))]
    picked = choose_bundles(df, "g", "id", "trust", "seen", bundles)
    out = build_survivors(df, picked, "g", "id", bundles).collect()
    assert [tuple(r) for r in out] == [(1, "x", 20, 30)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert choose_bundles(df, "g", "id", "trust", "seen", plain("a", "b")).count() == 0
    assert choose_bundles(df, "g", "id", "trust", "seen", plain("a", "b"), [("a", "b")]).count() == 0


def brute(rows, dependencies):
    """The best trust sum over all choices that keep the dependencies and leave nothing empty without need."""
    at = {"a": 4, "b": 5, "w": 6}
    parent = {y: x for x, y in dependencies}
    top = {(f, r[i]): max(s[2] for s in rows if s[i] == r[i]) for f, i in at.items() for r in rows if r[i] is not None}

    def search(names, pick):
        if not names:
            return sum(top[f, v] for f, v in pick.items() if v is not None)
        f = names[0]
        p = pick.get(parent.get(f))
        open_ = {r[at[f]] for r in rows if r[at[f]] is not None and (p is None or r[at[parent[f]]] == p)} or {None}
        return max(search(names[1:], pick | {f: v}) for v in open_)

    return search(["a", "b", "w"], {})


@pytest.mark.parametrize("dependencies", [[("a", "b")], [("a", "b"), ("b", "w")], [("a", "b"), ("a", "w")]])
def test_dependencies_reach_the_best_sum(spark, dependencies):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        for i in range(rng.randint(2, 6)):
            rows.append((g, g * 10 + i, rng.randint(0, 5), rng.randint(0, 3), rng.choice([None, "x", "y", "z"]), rng.choice([None, "p", "q"]), rng.choice([None, 1, 2]), None, ""))
    df = spark.createDataFrame(rows, SCHEMA)
    got = chosen(df, plain("a", "b", "w"), dependencies)
    by = {r[1]: r for r in rows}
    at = {"a": 4, "b": 5, "w": 6}
    for g in range(40):
        own = [r for r in rows if r[0] == g]
        pick = {f: by[got[g, f]][at[f]] for f in at if (g, f) in got}
        total = sum(by[got[g, f]][2] for f in pick)
        assert total == brute(own, dependencies)
        for x, y in dependencies:
            if x in pick and y in pick:
                assert any(r[at[x]] == pick[x] and r[at[y]] == pick[y] for r in own)


def test_dependencies_are_checked(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        choose_bundles(df, "g", "id", "trust", "seen", plain("a", "b"), [("b", "a")])


def labels(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("parts", [2000, 3])
def test_components(spark, monkeypatch, parts):
    if parts == 3:
        monkeypatch.setattr("gapweave.llm.components.SPLIT_FROM", 0)
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)]  # a chain
    pairs += [(1000, 1000 + i) for i in range(50)] + [(3000 - i, 3000) for i in range(30)]  # hubs at either end
    pairs += [(rng.randint(5000, 5060), rng.randint(5000, 5060)) for _ in range(40)]
    pairs += [(7, None), (None, 8), (9, 9), (900, 900), (5, 4), (4, 5), (4, 5)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(*p, "x") for p in pairs], "id1 long, id2 long, node string")
    assert {r.node: r.label for r in group_labels(df, "id1", "id2", parts).collect()} == labels(pairs)


def test_components_of_nothing(spark):
    for rows in ([], [(1, 1), (None, 2)]):
        out = group_labels(spark.createDataFrame(rows, "id1 long, id2 long"), "id1", "id2")
        assert out.columns == ["node", "label"] and out.count() == 0
