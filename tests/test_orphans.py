"""References that do not resolve, and joins split by skew."""

import random
from datetime import datetime, timedelta

import pytest

from gapweave.operators.orphans import Reference, orphan_months
from gapweave.operators.skew import heavy_keys, lookup_join, many_join
from gapweave.runtime import shared_dir

T0 = datetime(2024, 1, 1)


def at(days):
    return None if days is None else T0 + timedelta(days=days)


@pytest.mark.parametrize("parts", [2000, 2])
def test_against_brute_force(spark, parts):
    rng = random.Random(6)
    parents = []
    for i in range(20):
        a = rng.choice([None, *range(0, 60)])
        parents.append((i, at(a), at(rng.choice([None, rng.randint(0, 90)])), "x"))
    parents += [parents[3], (4, at(70), at(80), "x"), (None, at(0), None, "x")]
    rows = [(rng.choice([1, rng.randint(0, 25)]), at(rng.choice([None, rng.randint(0, 100)])), "y") for _ in range(400)] + [(None, at(3), "y")]
    other = [(rng.randint(0, 25), at(rng.randint(0, 100))) for _ in range(50)]
    p = spark.createDataFrame(parents, "id long, imported timestamp_ntz, deleted timestamp_ntz, ref_id string")
    refs = [Reference("t", "fid", "ts", spark.createDataFrame(rows, "fid long, ts timestamp_ntz, ref_month string")), Reference("u", "pid", "ts", spark.createDataFrame(other, "pid int, ts timestamp_ntz"))]
    found = orphan_months(refs, p, "id", "imported", "deleted", parts, piece=30 if parts == 2 else 10_000)
    got = {(r.ref_table, r.ref_field, r.ref_month, r.ref_id): r.orphan_refs for r in found.collect()}
    want = {}
    for table, field, data in (("t", "fid", rows), ("u", "pid", other)):
        for i, t, *_ in data:
            if i is None or any(x == i and t is not None and a is not None and a <= t and (b is None or b > t) for x, a, b, _ in parents):
                continue
            key = (table, field, t and t.strftime("%Y-%m"), i)
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_empty_tables(spark):
    p = spark.createDataFrame([], "id long, imported timestamp, deleted timestamp")
    r = spark.createDataFrame([], "fid long, ts timestamp")
    assert orphan_months([Reference("t", "fid", "ts", r)], p, "id", "imported", "deleted").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_joins_equal_plain_ones(spark, how):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, rng.randint(0, 30), None]), i) for i in range(300)], "k long, n int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 25)], "k long, v string")
    counts = left.groupBy("k").count()
    heavy = heavy_keys(counts, "k", "count", 300, 10)
    assert {r.k for r in heavy.collect()} >= {1} and heavy.count() < 10

    def plain(df):
        return sorted(map(str, map(tuple, df.select(sorted(df.columns)).collect())))

    assert plain(lookup_join(left, right, "k", how, heavy)) == plain(left.join(right, "k", how))


@pytest.mark.parametrize("piece", [10_000, 40, 7])
def test_joins_of_repeated_keys_cut_in_pieces_equal_plain_ones(spark, piece):
    rng = random.Random(2)
    # One key holds half of the rows of each side.
    left = spark.createDataFrame([(rng.choice([1, rng.randint(2, 30)]) if i % 20 else None, i) for i in range(200)], "k long, n int")
    right = spark.createDataFrame([(rng.choice([1, rng.randint(5, 40)]), f"v{i}") for i in range(120)], "k long, v string")
    got, want = many_join(left, right, ["k"], piece), left.join(right, "k")
    assert sorted(map(tuple, got.select("k", "n", "v").collect())) == sorted(map(tuple, want.select("k", "n", "v").collect()))
    assert many_join(left.limit(0), right, ["k"], piece).isEmpty()


def test_shared_folder_is_the_configured_one(spark, monkeypatch):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
