"""Near-duplicate series, repeats between batches and nearest windows."""

import glob
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapweave.llm import hnsw, setsketch
from gapweave.llm.history import HistoryIndex, integer_token, rare_prefixes, repeats_between_batches, rounds, same_path, spell, spelled, token_order
from gapweave.llm.setsketch import near_duplicates, run_set
from gapweave.llm.signal_queries import gap_tokens
from gapweave.llm.vector_queries import gap_windows
from gapweave.llm.vectors import near_vectors, nearest_windows
from gapweave.runtime import materialize, shared_dir


# -- near-duplicate series ---------------------------------------------------------------------------


def noisy(rng, base, edits):
    v = list(base)
    for _ in range(edits):
        i = rng.randrange(len(v))
        v[i : i + rng.randint(0, 1)] = [rng.uniform(0, 255)] * rng.randint(0, 2)
    return v


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    series = {}
    for i in range(30):
        base = [rng.uniform(0, 255) for _ in range(rng.randint(20, 120))]
        series[len(series)] = base
        for edits in (0, 1, 3, 6):
            series[len(series)] = noisy(rng, base, edits)
    series[900], series[901], series[902] = [0.0] * 50, [0.4] * 30, [1.0, None, float("nan"), 2.0, 3.0]
    rows = [(k, v, "x") for k, v in series.items()] + [(None, [1.0] * 9, "x"), (903, None, "x"), (904, [], "x")]
    df = spark.createDataFrame(rows, "id long, brightness array<double>, class string").drop("class").withColumn("_key", F.lit(1))
    members, pairs = near_duplicates(df, "id", "brightness")
    cls = {r["id"]: r["class"] for r in members.collect()}
    found = {(r.a, r.b) for r in pairs.collect()}

    def runs(v):
        w = np.array([setsketch.UNKNOWN if x is None or x != x else int(np.floor(x)) for x in v], np.int64)
        return set(run_set(w, 4).tolist())

    sets = {k: s for k, v in series.items() if (s := runs(v))}
    assert set(cls) == set(sets)
    for a in sets:
        for b in sets:
            if a < b:
                likeness = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                x, y = sorted((cls[a], cls[b]))
                assert (x == y) == (sets[a] == sets[b])
                if x != y:
                    assert ((x, y) in found) == (likeness >= 0.5), (a, b, likeness)
    assert cls[900] == cls[901]


def test_likelihood_estimates_likeness():
    rng = np.random.default_rng(0)
    s = setsketch.Sketch()
    factors = s.factors()
    for shared, own in ((200, 0), (150, 50), (100, 100), (20, 180)):
        common = rng.integers(0, 2**63, shared, dtype=np.uint64)
        x, y = (np.concatenate([common, rng.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2))
        r = [setsketch.registers(v, s, factors) for v in (x, y)]
        guess = setsketch.likeness_by_likelihood(*r, np.array([len(x)]), np.array([len(y)]), s.base)[0]
        assert abs(guess - shared / (shared + 2 * own)) < 0.12


def test_registers_merge():
    s = setsketch.Sketch()
    f = s.factors()
    a, b = np.arange(50, dtype=np.uint64) * 7919, np.arange(60, dtype=np.uint64) * 104729 + 3
    both = np.maximum(setsketch.registers(a, s, f), setsketch.registers(b, s, f))
    assert (both == setsketch.registers(np.union1d(a, b), s, f)).all()


def test_sketches_of_many_series_are_those_of_each():
    rng = np.random.default_rng(1)
    s = setsketch.Sketch()
    f = s.factors()
    lengths = [0, 3, 4, 30, 2, 9000, 50, 0]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = rng.integers(0, 9, offsets[-1])
    flat[rng.random(len(flat)) < 0.02] = setsketch.UNKNOWN
    runs, starts = setsketch.run_sets(flat, offsets, 4)
    one = [run_set(flat[i:j], 4) for i, j in zip(offsets, offsets[1:])]
    assert [x.tolist() for x in one] == [runs[i:j].tolist() for i, j in zip(starts, starts[1:])]
    begin = starts[:-1][np.diff(starts) > 0]
    full = [x for x in one if len(x)]
    assert (setsketch.registers(runs, s, f, begin) == np.concatenate([setsketch.registers(x, s, f) for x in full])).all()
    assert len(set(setsketch.digests(runs, begin))) == len(full) and setsketch.digests(full[0], np.zeros(1, int)) == setsketch.digests(runs, begin)[:1]
    assert [setsketch.unpack_values(p).tolist() for p in setsketch.pack_series(flat, offsets)] == [flat[i:j].tolist() for i, j in zip(offsets, offsets[1:])]


@pytest.mark.parametrize("values", [[], [0, 254, setsketch.UNKNOWN], [255, 3, setsketch.UNKNOWN], [-1, 2**31 - 1], [2**31, setsketch.UNKNOWN], [-(2**31)], [setsketch.UNKNOWN]])
def test_packed_values(values):
    v = np.array(values, np.int64)
    assert (setsketch.unpack_values(setsketch.pack_values(v)) == v).all()


def test_near_duplicates_of_nothing(spark):
    members, pairs = near_duplicates(spark.createDataFrame([], "id long, brightness array<double>"), "id", "brightness")
    assert members.count() == 0 and pairs.count() == 0


# -- repeats between batches -------------------------------------------------------------------------


def brute_repeats(sets, batch, t=0.5):
    return {
        (a, b) for a in sets for b in sets
        if batch.get(a) is not None and batch.get(b) is not None and batch[a] < batch[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])
    }


def random_sets(rng, n=80):
    sets = {}
    for i in range(n):
        if i and rng.random() < 0.5:
            old = sorted(sets[rng.randrange(i)])
            keep = [x for x in old if rng.random() < rng.choice([1.0, 0.9, 0.7, 0.5])]
            sets[i] = set(keep) | {rng.randrange(300) for _ in range(rng.randint(0, 4))} or {1}
        else:
            sets[i] = {min(299, int(rng.expovariate(0.02))) for _ in range(rng.randint(1, 40))}
    return sets


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed, tmp_path):
    rng = random.Random(seed)
    sets = random_sets(rng)
    batch = {i: i // 12 for i in sets} | {3: None}
    tokens = spark.createDataFrame([(s, t) for s, v in sets.items() for t in v], "set long, token long")
    batches = spark.createDataFrame([(k, v) for k, v in batch.items() if k != 5], "set long, batch int")
    index = HistoryIndex(spark, f"file://{tmp_path}/index", buckets=3, fan=2, growth=3, large=12, piece=[10_000, 5, 2][seed])
    got = {(r["first"], r["second"]) for r in repeats_between_batches(tokens, batches, index, share=[1.0, 0.0, 0.4][seed]).collect()}
    assert got == brute_repeats(sets, {k: v for k, v in batch.items() if k != 5})


def test_rounds():
    sizes = [(b, 10) for b in range(9)]
    assert rounds(sizes, 0) == [[b] for b in range(9)]
    assert rounds(sizes, 1.0) == [[0], [1], [2, 3], [4, 5, 6, 7], [8]]
    assert rounds([(3, 5), (4, 1), (5, 50), (6, 1)], 1.0) == [[3], [4], [5], [6]]


def token_rows(spark, sets):
    return spark.createDataFrame([(s, len(v), t) for s, v in sets.items() for t in v], "set long, size long, token long")


def test_index_batch_by_batch(spark, tmp_path):
    sets = random_sets(random.Random(9))
    sets |= {i: sets[2] for i in (25, 33, 34, 35, 61, 62)}  # copies within and between batches
    batch = {i: i // 20 for i in sets}
    df = token_rows(spark, sets)
    index = HistoryIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.create(df.where("set < 20"))
    got = set()
    for b in range(1, 4):
        new = index.prepare(df.where(f"set >= {20 * b} and set < {20 * b + 20}"))
        got |= {(r.accepted, r.new) for r in index.set_pairs(index.probe(new), new).collect()}
        before = len(index._versions.latest()[1]["generations"])
        index.append(new)
        assert len(index._versions.latest()[1]["generations"]) <= before + 1
        with pytest.raises(ValueError, match="added before"):
            index.append(new)
    assert got == brute_repeats(sets, batch)
    # Copies have neither postings nor tokens of their own.
    held = {r.set for r in index.read("sets").select("set").collect()}
    assert 2 in held and not held & {25, 33, 34, 35, 61, 62} and index.read("ids").count() == len(sets)


def test_probe_reads_only_what_it_touches(spark, tmp_path):
    sets = {i: {i * 10 + j for j in range(6)} for i in range(400)}
    index = HistoryIndex(spark, f"file://{tmp_path}/index", buckets=32)
    index.create(token_rows(spark, sets))
    new = index.prepare(token_rows(spark, {1000: sets[7]}))
    assert [tuple(r) for r in index.probe(new).collect()] == [(7, 7)]
    whole = len(index.read("postings").inputFiles()) + len(index.read("sets").inputFiles())
    (tokens,), (found,) = index._buckets(new.prefixes, "token"), index._buckets(new.prefixes, "set")
    plan = index.read("postings", tokens)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "").replace("[(bucket", "[bucket") or "bucket" in plan.split("PartitionFilters")[1][:60]
    assert len(tokens) <= 4 and len(found) == 1 and whole >= 40


def test_sketches_keep_chance_meetings_out_of_the_candidates(spark, tmp_path):
    sets = {0: set(range(40)), 1: set(range(100, 140))}
    index = HistoryIndex(spark, f"file://{tmp_path}/index")
    index.create(token_rows(spark, sets))
    # 10 shares its rarest tokens with 0 but too few in all, 11 is 1 with ten other tokens.
    new = index.prepare(token_rows(spark, {10: set(range(8)) | set(range(200, 232)), 11: set(range(100, 130)) | set(range(300, 310))}))
    assert [tuple(r) for r in index.probe(new).collect()] == [(1, 11)]
    assert [(r.a, r.b) for r in new.candidates[0].collect()] == [(1, 11)]


def test_what_is_written_on_the_way_is_deleted(spark, tmp_path):
    sets = random_sets(random.Random(4))
    folder = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*/*"))
    tokens = materialize(spark.createDataFrame([(s, t) for s, v in sets.items() for t in v], "set long, token long"), "tokens")
    batches = spark.createDataFrame([(i, i // 20) for i in sets], "set long, batch int")
    got = repeats_between_batches(tokens, batches, HistoryIndex(spark, f"file://{tmp_path}/index"), spend=True)
    assert {tuple(r) for r in got.collect()} == brute_repeats(sets, {i: i // 20 for i in sets})
    left = {x for x in set(glob.glob(f"{folder}/*/*")) - before if glob.glob(f"{x}/**/*.parquet", recursive=True)}
    assert not {x for x in left if re.search("/(tokens|batch-tokens|digests|classes|members|class-tokens|prefixes|candidates)-[^/]*$", x)}


def test_generations_are_merged_and_the_order_is_renewed(spark, tmp_path):
    rng = random.Random(5)
    index = HistoryIndex(spark, f"file://{tmp_path}/index", buckets=2, fan=2, growth=3)
    index.create(token_rows(spark, {0: {1, 2, 3}}))
    first = index._versions.latest()[1]["order"]
    sets = {0: {1, 2, 3}}
    for b in range(1, 8):
        new = {b * 10 + i: set(rng.sample(range(30), 4)) for i in range(2)}
        ready = index.prepare(token_rows(spark, new))
        got = {(r.accepted, r.new) for r in index.set_pairs(index.probe(ready), ready).collect()}
        assert got == {(a, c) for a in sets for c in new if len(sets[a] & new[c]) >= 0.5 * len(sets[a] | new[c])}
        index.append(ready)
        index.vacuum()
        sets |= new
    state = index._versions.latest()[1]
    assert state["order"] != first and len(state["generations"]) <= 4 and len(index._versions.numbers()) == 1


def test_large_sets_are_ranked_alike(spark):
    sets = random_sets(random.Random(4), 30)
    df = spark.createDataFrame([(s, len(v), t) for s, v in sets.items() for t in v], "set long, size long, token long")
    order = token_order(df)
    one = {tuple(r) for r in rare_prefixes(df, order, 0.5).collect()}
    assert one == {tuple(r) for r in rare_prefixes(df, order, 0.5, large=3).collect()}


def test_repeats_of_nothing(spark, tmp_path):
    nothing = spark.createDataFrame([], "set long, token long"), spark.createDataFrame([], "set long, batch int")
    assert repeats_between_batches(*nothing, HistoryIndex(spark, f"file://{tmp_path}/a")).count() == 0
    one = spark.createDataFrame([(1, 5)], "set long, token long"), spark.createDataFrame([(1, 0), (2, 1)], "set long, batch int")
    assert repeats_between_batches(*one, HistoryIndex(spark, f"file://{tmp_path}/b")).count() == 0


def test_spellings():
    same = ["/a/Möwe 1.mp4", "\\A\\möwe 1.MP4\t", " //a/./Möwe 1.mp4", "/a///MÖWE 1.mp4 "]
    assert len({spell(x) for x in same}) == 1
    other = ["/a/Mowe 1.mp4", "/a/Möwe  1.mp4", "a/Möwe 1.mp4", "/a/Möwe 1.mp4/", "/a/../a/Möwe 1.mp4", "/a/Möwe1.mp4"]
    assert len({spell(x) for x in [same[0], *other]}) == 1 + len(other)
    assert spell(None) is None and spell("") == "" and spell(" . ") == ""
    assert spell("/Straße") != spell("/strasse") and spell("/ΟΔΟΣ") == spell("/οδος") == spell("/οδοσ")


def test_columns_are_spelled_alike(spark):
    names = ["/A//b/", "\\x\\.\\Y ", "\t ./a", "", " ", "/", ".", None, "/Möwe", "a\tb", "/a/../b", "C:\\É\\"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(spelled("n").alias("s")).collect()]
    assert got == [spell(n) for n in names]


def test_same_path(spark):
    rows = [(1, "/a/B.mp4", 0), (2, "\\a\\b.mp4 ", 1), (3, "/a/b.mp4", 1), (4, None, 2), (5, None, 3), (6, "/a/c", None), (7, "/A/./b.mp4", 4), (7, "/A/./b.mp4", 4)]
    out = same_path(spark.createDataFrame(rows, "id long, name string, batch_no int"), "id", "name", "batch_no")
    assert sorted(map(tuple, out.collect())) == [(1, 2), (1, 3), (1, 7), (2, 7), (3, 7)]


def test_tokens_are_exact(spark):
    rows = [(1, 2, 3), (1, 3, 2), (0, 0, 0), (-1, 2, 3), (1 << 40, 2, 3), (1 << 21, 0, 0)]
    df = spark.createDataFrame(rows, "a long, b long, c long").select(integer_token([F.col(x) for x in "abc"]).alias("t"))
    got = [r.t for r in df.collect()]
    assert len(set(got)) == len(rows) and got[0] == (1 << 42) + (2 << 21) + 3 and got[3] < 0 and got[4] < 0


def test_unknown_gaps_keep_their_place(spark, tmp_path):
    """A gap that is NaN or infinite parts its neighbours; only gaps that are null are not there."""
    nan, inf = float("nan"), float("inf")
    gaps = [1.0, 2.0, nan, 4.0, 5.0, 6.0, None, 7.0, inf, 1e300, 1e300, 1e300, -1e300, 9.5, 9.0]
    rows = [(1, i, g) for i, g in enumerate(gaps)] + [(2, i, float(i)) for i in range(12)] + [(3, i, float(i)) for i in range(11)]
    spark.createDataFrame(rows, "filename_id long, frame int, hash double").write.parquet(f"file://{tmp_path}/hashes.parquet")
    got = {}
    for r in gap_tokens(spark, f"file://{tmp_path}").collect():
        got.setdefault(r.set, set()).add(r.token)
    # 4 5 6, 5 6 7, 1e300 three times, and those with -1e300; not 2 4 5, which are no neighbours.
    assert {t for t in got[1] if t >= 0} == {(4 << 42) + (5 << 21) + 6, (5 << 42) + (6 << 21) + 7} and len(got[1]) == 6
    assert len(got[2]) == 10 and 3 not in got
    windows = gap_windows(spark, f"file://{tmp_path}").where("filename_id = 1").collect()
    assert len(windows) == 2 and all(None in list(r)[2:] for r in windows)


# -- nearest windows ---------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 900), st.integers(1, 6), st.integers(0, 10**6))
def test_graph_reaches_every_close_vector(n, width, seed):
    rng = np.random.default_rng(seed)
    v = np.round(rng.uniform(0, 60_000, (n, width)))
    v[n // 2 :] = v[: n - n // 2] + rng.integers(-40, 41, (n - n // 2, width))
    v = np.unique(v, axis=0)
    g, order = hnsw.build(v)
    g = hnsw.Graph.unpack(*g.pack(), width)
    ids, dist = hnsw.Searcher(g).search(v, 12)
    assert (np.sort(order) == np.arange(len(v))).all()
    exact = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    want = got = 0
    for i in range(len(v)):
        near = [int(j) for j in np.argsort(exact[i], kind="stable")[:4] if exact[i, j] < 600]
        want += len(near)
        got += len(set(near) & {int(order[x]) for x in ids[i] if x >= 0})
    assert got >= 0.97 * want


def windows_of(rng, owners=40, per=30, width=4):
    rows = {}
    scenes = [[rng.randint(10_000, 60_000) for _ in range(width)] for _ in range(25)]
    for o in range(owners):
        for p in range(per):
            if rng.random() < 0.4:
                v = [x + rng.choice([0, 0, rng.randint(-200, 200)]) for x in rng.choice(scenes)]
            else:
                v = [rng.randint(10_000, 60_000) for _ in range(width)]
            rows[o, p * 10] = v
    return rows


def brute_nearest(rows, k, radius):
    keys = sorted(rows)
    v = np.array([rows[x] for x in keys], float)
    out = set()
    for i, (o, p) in enumerate(keys):
        d2 = ((v - v[i]) ** 2).sum(1)
        near = sorted((d2[j], *keys[j]) for j in np.flatnonzero(d2 < radius**2) if keys[j][0] != o)[:k]
        out |= {(o, p, a, b, d) for d, a, b in near}
    return out


@pytest.mark.parametrize("cell,graph", [(16_000, 60_000), (100, 60), (300, 40)])
def test_nearest_windows_against_brute_force(spark, cell, graph):
    rows = windows_of(random.Random(2))
    rows |= {(0, 5000 + i): [11_111] * 4 for i in range(60)} | {(100 + i, 7): [11_111] * 4 for i in range(9)}  # a hot vector
    data = [(o, p, *v, 1) for (o, p), v in rows.items()] + [(None, 1, 1, 1, 1, 1, 1), (1, None, 1, 1, 1, 1, 1), (5, 999, None, 1, 1, 1, 1), (0, 0, *rows[0, 0], 2)]
    df = spark.createDataFrame(data, "f long, w int, a long, b long, c long, d long, o int")
    got = {tuple(r) for r in nearest_windows(df, "f", "w", ["a", "b", "c", "d"], 5, 600.0, cell=cell, graph=graph).collect()}
    want = brute_nearest(rows, 5, 600.0)
    assert got <= want or len(got - want) < 0.01 * len(want)
    assert len(got & want) >= 0.99 * len(want)


def test_narrow_beams_are_widened(spark):
    """One owner holds more near vectors than a beam takes; the others must still be found."""
    rows = {(1, i): [20_000 + i, 20_000] for i in range(120)} | {(2, 0): [20_300, 20_000], (3, 0): [19_700, 20_000]}
    df = spark.createDataFrame([(o, p, *v) for (o, p), v in rows.items()], "f long, w int, a long, b long")
    got = {tuple(r) for r in nearest_windows(df, "f", "w", ["a", "b"], 5, 600.0).collect()}
    assert got == brute_nearest(rows, 5, 600.0)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "f long, w int, a long, b long")
    assert nearest_windows(df, "f", "w", ["a", "b"], 5, 600.0).count() == 0
    assert near_vectors(df, "f", "w", ["a", "b"], 600.0, 7).count() == 0
