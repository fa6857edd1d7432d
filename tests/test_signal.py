"""Peaks, windows and neighbours."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave import runtime
from gapweave.operators import groups, knn, signal, windows
from gapweave.runtime import materialize


def series_df(spark, series, fps=1.0):
    rows = [(g, i, float(v), fps, "x") for g, s in series.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "user long, frame int, value double, fps double, g string")


def peaks_of(values, order, fps):
    """Peaks by their definition, one series at a time."""
    runs, i = [], 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[j + 1] == values[i]:
            j += 1
        runs.append((i, j, values[i]))
        i = j + 1
    out, last = [], 0
    for n in range(1, len(runs) - 1):
        a, b, v = runs[n]
        mid = (a + b) // 2
        if v > runs[n - 1][2] and v > runs[n + 1][2] and v == max(values[max(0, mid - order) : mid + order + 1]):
            out.append((mid, (mid - last) / fps))
            last = mid
    return out


LITERAL = {
    1: ([0, 1, 0, 0, 2, 0, 0], [(1, 1.0), (4, 3.0)]),
    2: ([0, 2, 2, 0, 0, 3, 3, 0], [(1, 1.0), (5, 4.0)]),
    3: ([10, 10, 10, 10], []),
    4: ([1, 2], []),
    5: ([3, 1, 1, 3], []),
    6: ([0, 5, 0, 5, 0], [(1, 1.0), (3, 2.0)]),
}


@pytest.mark.parametrize("chunk", [1 << 18, 3, 1])
def test_literal_series(spark, chunk):
    df = series_df(spark, {k: v for k, (v, _) in LITERAL.items()})
    got = signal.peaks(df, "user", "frame", "value", 1, F.col("fps"), chunk)
    by = {k: [] for k in LITERAL}
    for r in got.orderBy("user", "frame").collect():
        by[r["user"]].append((r["frame"], r["hash"]))
    assert by == {k: v for k, (_, v) in LITERAL.items()}


@pytest.mark.parametrize("chunk,fps,seconds", [(1 << 18, 1.0, 2), (7, 1.0, 3), (5, 2.0, 1.6), (4, 0.5, 4)])
def test_random_series(spark, chunk, fps, seconds):
    rng = random.Random(chunk)
    series = {k: [rng.randint(0, 6) for _ in range(rng.randint(1, 60))] for k in range(25)}
    series[99] = [1] * 20 + [2] * 17 + [1] * 20
    got = {}
    for r in signal.peaks(series_df(spark, series, fps), "user", "frame", "value", seconds, F.col("fps"), chunk).orderBy("user", "frame").collect():
        got.setdefault(r["user"], []).append((r["frame"], r["hash"]))
    want = {k: p for k, s in series.items() if (p := peaks_of(s, int(seconds * fps), fps))}
    assert got == want


@pytest.mark.parametrize("chunk,fps,seconds", [(1 << 18, 1.0, 2), (1 << 18, 0.5, 2), (7, 1.0, 3), (1 << 18, 0.5, 1)])
def test_peaks_of_rows_in_order(spark, chunk, fps, seconds):
    rng = random.Random(chunk + seconds)
    series = {k: [rng.randint(0, 6) for _ in range(rng.randint(1, 60))] for k in range(25)}
    series[99] = [1] * 20 + [2] * 17 + [1] * 20
    rows = [(g, 1000 - i // 2, -i, float(v)) for g, s in series.items() for i, v in enumerate(reversed(s))]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, 1, 9.0), (3, 5, 5, None)], "user long, ts int, o int, value double")
    # Times repeat; the second column decides there.
    got = signal.ordered_peaks(df, "user", ["ts", "o"], "value", seconds, fps, chunk=chunk)
    order = int(seconds * fps)
    want = {(k, f, h) for k, s in series.items() for f, h in (peaks_of(s, order, fps) if order else [])}
    assert {tuple(r) for r in got.select("user", "frame", "hash").collect()} == want
    if chunk == 1 << 18 and order:
        # One sorting forwards, one backwards, one of the peaks.
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [") == 3


def test_windows_are_formed_once(spark, monkeypatch):
    """Numbering runs its input twice, so it must be given a written table, which is deleted afterwards."""
    seen, number = [], windows.number_items
    monkeypatch.setattr(windows, "number_items", lambda df, order: seen.append(df) or number(df, order))
    df = spark.createDataFrame([(1, i, float(i % 4)) for i in range(30)], "f long, frame int, hash double")
    assert windows.hash_windows(df, "f", "frame", "hash", 6).count() == 24
    assert [hasattr(x, "_gapweave_path") for x in seen] == [True]
    assert not Path(seen[0]._gapweave_path.removeprefix("file://")).exists()


@pytest.mark.parametrize("length", [3, 12])
def test_truncation_of_known_length(spark, length):
    rng = random.Random(length)
    rows = [(i, [rng.choice([0.0, -1.0, 0.1, 2.5, float("nan"), 7.0]) for _ in range(length)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    both = df.select(windows.truncate_scene("v", 5.0).alias("a"), windows.truncate_scene("v", 5.0, length).alias("b"))
    assert both.where("not (a <=> b)").count() == 0


def test_unusable_rates_and_nulls(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 0.0, 0.0), (2, 0, 0.0, None), (2, 1, 1.0, None), (None, 1, 1.0, 1.0), (3, 0, 0.0, 0.01), (3, 1, 1.0, 0.01), (3, 2, 0.0, 0.01)]
    df = spark.createDataFrame(rows, "user long, frame int, value double, fps double")
    assert signal.peaks(df, "user", "frame", "value", 10, F.col("fps")).count() == 0
    assert signal.peaks(df.where("false"), "user", "frame", "value", 10, F.col("fps")).count() == 0


def test_frame_means(spark):
    df = spark.createDataFrame([(1, 0, [0, 255, 3]), (1, 1, []), (1, 2, None)], "f long, frame int, px array<int>")
    assert [tuple(r) for r in signal.frame_means(df, "f", "frame", "px").collect()] == [(1, 0, 86.0)]


@pytest.mark.parametrize("spare", [0, 1])
@pytest.mark.parametrize("chunk", [1 << 18, 10, 3])
def test_sliding_windows(spark, spare, chunk):
    rng = random.Random(8)
    data = {g: sorted(rng.sample(range(200), rng.randint(0, 40))) for g in range(15)}
    rows = [(g, f, float(f % 7)) for g, fs in data.items() for f in fs]
    rows += rows[:5] + [(None, 1, 1.0), (1, None, 1.0), (1, 500, None)]
    rng.shuffle(rows)
    out = windows.sliding(spark.createDataFrame(rows, "g long, f int, v double"), "g", "f", "v", 4, spare, chunk)
    got = {(r["g"], r["f"]): r["values"] for r in out.collect()}
    want = {(g, fs[i]): [float(x % 7) for x in fs[i : i + 4]] for g, fs in data.items() for i in range(len(fs) - 3 - spare)}
    assert got == want and out.count() == len(want)


def test_scene_and_speed(spark):
    df = spark.createDataFrame([([10.0, 5.0, 3.0, 2.0],), ([0.0, 0.0, 0.0, 0.0],)], "values array<double>")
    got = df.select(windows.truncate_scene("values", 14), windows.normalise_speed("values")).collect()
    assert got[0][0] == [10.0, 5.0, 0.0, 0.0] and got[0][1] == [256.0, 128.0, 76.8, 51.2]
    assert got[1][0] == got[1][1] == [0.0] * 4


def test_numbering(spark):
    rng = random.Random(2)
    keys = [(rng.randint(0, 5), i) for i in range(200)]
    rng.shuffle(keys)
    out = windows.number_items(spark.createDataFrame(keys, "a int, b int").repartition(7), ["a", "b"])
    assert [(r.a, r.b) for r in sorted(out.collect(), key=lambda r: r.item)] == sorted(keys)
    assert sorted(r.item for r in out.collect()) == list(range(200))


@pytest.mark.parametrize("how", ["broadcast", "blocks", "grid"])
@pytest.mark.parametrize("step", [1, 3])
def test_radius_pairs(spark, monkeypatch, how, step):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    v = np.round(rng.uniform(0, 6, (150, 4)), 1)
    v[100:] = v[:50]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [0.0] * 4), (999, None)], "id long, v array<double>")
    if how == "grid":
        out = knn.grid_pairs(df, "id", "v", 4, 1.5, step)
    else:
        out = knn.radius_pairs(df, "id", "v", 1.5, step, broadcast_bytes=knn.BROADCAST_BYTES if how == "broadcast" else 0)
    d2 = sum((v[:, None, k] - v[None, :, k]) ** 2 for k in range(4))
    want = {(i, j) for i in range(0, 150, step) for j in range(150) if d2[i, j] < 2.25}
    assert {(r.q, r.item) for r in out.collect()} == want and out.count() == len(want)


def test_backends(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.5]), (2, [5.0, 5.0])], "id long, v array<double>")
    for name in knn.BACKENDS:
        got = {r.item for r in knn.neighbours(df, "id", "v", 1.0, name, length=2).where("q = 0").collect()}
        assert got == {0, 1}, name
    with pytest.raises(ValueError):
        knn.neighbours(df, "id", "v", 1.0, "nosuch")
    assert knn.radius_pairs(df.where("false"), "id", "v", 1.0).count() == 0


def test_cells_are_chosen_where_they_part_most_pairs(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.uniform(0, 60, (300, 12)))], "id long, v array<double>")
    assert knn.cell_share(df, "v", 12, 0.3) < knn.GRID_SHARE < knn.cell_share(df, "v", 12, 20.0) <= 1.0
    assert knn.cell_share(df.where("false"), "v", 12, 0.3) == 1.0
    for radius in (0.3, 20.0):
        same = {(r.q, r.item) for r in knn.radius_pairs(df, "id", "v", radius).collect()}
        assert {(r.q, r.item) for r in knn.neighbours(df, "id", "v", radius, length=12).collect()} == same


def test_topk_ties(spark):
    df = spark.createDataFrame([(0, i, 1.0) for i in range(30)], "q long, item long, d2 double")
    assert sorted(r.item for r in knn.nearest(df, 20).collect()) == list(range(20))


@pytest.mark.parametrize("step", [1, 3])
@pytest.mark.parametrize("radius", [1.5, 2.5, 3.0])
def test_windows_on_a_lattice_meet_in_places(spark, monkeypatch, step, radius):
    """Gaps in whole steps are joined by place, not compared each with each or cell by cell."""
    rng = np.random.default_rng(4)
    v = 2.0 * rng.integers(-1, 3, (300, 5))
    v[0] = 2.0**30
    df = spark.createDataFrame([(i + 7, x.tolist()) for i, x in enumerate(v)] + [(None, [0.0] * 5), (999, None)], "id long, v array<double>")
    for slow in ("radius_pairs", "grid_pairs"):
        monkeypatch.setattr(knn, slow, None)
    got = [tuple(r) for r in knn.of_classes(*knn.class_pairs(df, "id", "v", radius, 5, step)).select("q", "item", "d2").collect()]
    d2 = ((v[:, None] - v[None]) ** 2).sum(2)
    assert sorted(got) == [(i + 7, j + 7, d2[i, j]) for i in range(300) for j in range(300) if d2[i, j] < radius**2 and (i + 7) % step == 0]


def test_classes_of_vectors_off_the_lattice(spark):
    rng = np.random.default_rng(5)
    v = rng.uniform(0, 3, (60, 3))
    v[30:] = v[:30]
    v[4, 1], v[5, 2] = float("nan"), float("inf")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    pairs = lambda rows: sorted((r.q, r.item) for r in rows.collect())
    queries, near = knn.class_pairs(df, "id", "v", 1.0, 3, 2)
    same = pairs(knn.radius_pairs(df, "id", "v", 1.0, 2))
    assert pairs(knn.of_classes(queries, near)) == same
    assert near.select("class").distinct().count() < queries.count()
    firsts = {r[0] for r in queries.select("class").collect()}
    for backend in ("auto", "block"):
        assert pairs(knn.class_neighbours(df, "id", "v", 1.0, backend, 3, 2)) == [p for p in same if p[0] in firsts]
    assert knn.class_pairs(df.where("false"), "id", "v", 1.0, 3)[1].count() == 0


def test_large_written_tables_are_not_broadcast_for_the_size_of_their_files(spark):
    """The files of 150,000 such rows are below Spark's bound of 10 MB, their hash table in the driver is not."""
    a, b = (materialize(spark.range(150_000).select("id", F.xxhash64("id", F.lit(i)).alias(f"x{i}")), "some") for i in (1, 2))
    few = materialize(spark.range(30).select("id"), "few")
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    assert joins(a.join(b, "id")) == joins(a.join(b.groupBy("id").agg(F.max("x2")), "id", "left_semi")) == 0
    assert joins(a.join(few, "id")) == joins(a.join(F.broadcast(b), "id")) == 1


def test_all_pairs_by_classes(spark):
    rng = np.random.default_rng(6)
    v = 2.0 * rng.integers(0, 3, (80, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [0.0] * 4), (99, None)], "id long, v array<double>")
    rows = lambda x: sorted((r.q, r.item, r.d2) for r in x.collect())
    assert rows(knn.all_pairs(df, "id", "v", 3.0, 4)) == rows(knn.radius_pairs(df, "id", "v", 3.0))
    assert rows(knn.all_pairs(df.where("false"), "id", "v", 3.0, 4)) == []


def test_lowest_items_of_files_with_equal_vectors(spark, monkeypatch):
    """A file that repeats a vector stands once in a neighbourhood of classes, and its representatives stay the same."""
    rng = np.random.default_rng(7)
    v = 2.0 * rng.integers(0, 2, (60, 3))
    df = spark.createDataFrame([(i, i // 20, 3 * i, x.tolist()) for i, x in enumerate(v)], "item long, file long, frame int, v array<double>")
    near = [knn.class_pairs(df, "item", "v", 2.5, 3, 1, None, low)[1].withColumnRenamed("class", "q") for low in (None, ("file", "frame"))]
    whole, low = (sorted(map(tuple, groups.neighbour_reps(x, df, "file").collect())) for x in near)
    assert whole == low and near[1].count() < near[0].count()
    monkeypatch.setattr(runtime, "PART_ROWS", 10)
    again = knn.named(knn.class_pairs(df, "item", "v", 2.5, 3, lowest=("file", "frame"))[1])
    assert again._gapweave_rows > 10
    parts = groups.written_reps(again, df.withColumnRenamed("file", "filename_id"), "file")
    assert sorted(map(tuple, parts.collect())) == whole and len(parts._gapweave_path) > 1


def test_counts_of_files_do_not_move_the_files(spark, monkeypatch):
    from gapweave.plans import event_queries

    reps = spark.createDataFrame([(0, 1), (0, 2), (5, 1), (5, 3), (5, 4)], "q long, filename_id long")
    monkeypatch.setattr(event_queries, "reps", lambda s, d: (spark.createDataFrame([(0, 0), (2, 0), (5, 5)], "q long, class long"), reps))
    out = event_queries.file_counts(spark, "")
    assert sorted(map(tuple, out.collect())) == [(0, 2), (2, 2), (5, 3)]
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
