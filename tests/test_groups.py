"""Groups, profiles and reports."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.config import SearchParams
from gapweave.operators import groups, profile, report
from gapweave.operators.windows import playable_range
from gapweave.plans import registry
from gapweave.plans.search import Catalog, report_groups, scored_classes, scored_pairs, search, search_items

X = [10, 20, 15, 40, 25, 50, 20]


def test_correlation_literals():
    assert profile.correlation(X, [1.7 * v + 35 for v in X]) == pytest.approx(1.0)
    assert profile.correlation([0, 10, 0, 10, 0, 10, 0], list(range(7))) < 0.5
    triangle = [50 - abs(i - 50) for i in range(100)]
    assert profile.correlation(triangle, triangle[2:] + [0, 0]) > 0.99
    assert profile.correlation([1], X) == profile.correlation([3, 3, 3], X) == profile.correlation(None, X) == 0.0


def test_correlation_column(spark):
    rng = random.Random(1)
    rows = [([rng.random() for _ in range(rng.randint(0, 30))], [rng.random() for _ in range(rng.randint(0, 30))]) for _ in range(40)] + [(None, [1.0]), ([2.0, 2.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for r in profile.score_profiles(df, "a", "b", samples=100).collect():
        assert r.score == pytest.approx(profile.correlation(r.a, r.b, samples=100), abs=1e-9)


def test_segment_rounds_half_to_even(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)], 2, [1.0, 1.5, -4.0], 1.0), ([1.0], 5, [1.0], 1.0), ([1.0, 2.0], 0, [0.0], 1.0)], "p array<double>, frame int, v array<double>, fps double")
    assert [r[0] for r in df.select(profile.segment("p", "frame", "v", "fps")).collect()] == [[2.0, 3.0], [], [1.0]]


def greedy(neighbourhoods, whitelist, score, threshold):
    """Groups found query by query: pairs once accepted are not looked at again."""
    known, out = set(), []
    for q, files in neighbourhoods.items():
        pairs = {p for p in itertools.combinations(sorted(files), 2) if p not in known and p not in whitelist}
        if score is not None:
            pairs = {p for p in pairs if score[q, p] >= threshold}
        known |= pairs
        if score is None:
            if pairs:
                out.append((q, frozenset(x for p in pairs for x in p)))
            continue
        left = {x for p in pairs for x in p}
        while left:
            part, todo = set(), [min(left)]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += [y for p in pairs if x in p for y in p]
            left -= part
            out.append((q, frozenset(part)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("verify", [False, True])
def test_groups_against_the_greedy_loop(spark, seed, verify):
    rng = random.Random(seed)
    hoods = {q: sorted(rng.sample(range(8), rng.randint(2, 5))) for q in range(12)}
    white = {p for p in itertools.combinations(range(8), 2) if rng.random() < 0.2}
    reps = spark.createDataFrame([(q, f, 100 * q + f, f) for q, fs in hoods.items() for f in fs], "q long, filename_id long, item long, frame int")
    wl = spark.createDataFrame([(b, a) for a, b in white] + [(1, None)], "id1 long, id2 long")
    pairs = groups.without_whitelisted(groups.file_pairs(reps), wl)
    if verify:
        score = {(q, p): rng.random() for q, fs in hoods.items() for p in itertools.combinations(fs, 2)}
        table = spark.createDataFrame([(q, *p, s) for (q, p), s in score.items()], "q long, file1 long, file2 long, score double")
        scored = pairs.join(table, ["q", "file1", "file2"]).select("q", "file1", "file2", "score")
        found = groups.verified_groups(reps, scored, 0.4)
        key = ["q", "label"]
    else:
        score = None
        found = groups.duplicate_groups(reps, pairs)
        key = ["q"]
    got = {}
    for r in found.collect():
        got.setdefault(tuple(r[k] for k in key), set()).add(r.filename_id)
    assert sorted(((k[0], frozenset(v)) for k, v in got.items()), key=str) == greedy(hoods, white, score, 0.4)


def test_components_literals(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 1, 2), (2, 2, 3), (2, 9, None)], "q long, a long, b long")
    got = {(r.q, r.node): r.label for r in groups.component_labels(df, "q", "a", "b").collect()}
    assert got == {(1, 2): 2, (1, 3): 2, (2, 1): 1, (2, 2): 1, (2, 3): 1}


def test_saved_groups(spark):
    saved = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 1), (5, 2), (5, 3)], "g long, f long")
    alive = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "f long")
    wl = spark.createDataFrame([(2, 1), (1, 2), (3, None)], "id1 long, id2 long")
    kept = {r.g for r in groups.keep_saved_groups(saved, alive, wl, "g", "f").collect()}
    assert kept == {2, 5}


def test_report(spark):
    members = spark.createDataFrame([(1, 7, 42.0, "/v/a.MKV", 600.0), (1, 8, 0.0, "/v/noext", 90061.9), (1, 9, None, None, None)], "group long, filename_id long, offset double, name string, duration double")
    media = spark.createDataFrame([(7, "mkv", "h264", 1280, 720, 123456)], "filename_id long, extension string, codec string, width int, height int, file_size long")
    lines = [r.line for r in report_groups(members, media).collect()]
    assert "match=00:00:42 duration=00:10:00 ext=mkv codec=h264 resolution=1280x720 size=120.56 KiB path=/v/a.MKV" in lines
    assert "match=00:00:00 duration=01:01:01 ext=unknown codec=unknown resolution=unknown size=unknown path=/v/noext" in lines
    assert len(lines) == 3 and all(lines)
    assert report.group_sizes(members, "group").first().heading == "Group of 3 files found"


def test_search_end_to_end(spark):
    rng = random.Random(4)
    scene = [round(rng.uniform(10, 60), 3) for _ in range(20)]
    rows, files = [], []
    for f in range(6):
        gaps = [round(rng.uniform(10, 60), 3) for _ in range(10)] + ([g + rng.uniform(-0.1, 0.1) for g in scene] if f < 3 else []) + [round(rng.uniform(10, 60), 3) for _ in range(10)]
        frame = 0
        for g in gaps:
            frame += round(g * 25)
            rows.append((f, frame, g))
        files.append((f, f"/v/{f}.mkv", 25.0, 3000.0))
    hashes = spark.createDataFrame(rows, "filename_id long, frame int, hash double")
    table = spark.createDataFrame(files, "filename_id long, name string, fps double, duration double")
    found = search(Catalog(table, hashes), SearchParams(scenelength=1e9))
    assert {r.filename_id for r in found.collect()} == {0, 1, 2}
    white = spark.createDataFrame([(1, 0), (0, 2), (2, 1)], "id1 long, id2 long")
    assert search(Catalog(table, hashes, None, white), SearchParams(scenelength=1e9)).count() == 0
    profiles = spark.createDataFrame([(f, [float(v) for v in np.random.default_rng(0 if f < 2 else f).uniform(0, 255, 40_000)]) for f in range(6)], "filename_id long, brightness array<double>")
    hit = search(Catalog(table, hashes, profiles), SearchParams(scenelength=1e9, verify_brightness=True, brightness_correlation=-1.0))
    assert {r.filename_id for r in hit.collect()} == {0, 1, 2}
    assert search(Catalog(table, hashes.where("false"), profiles), SearchParams()).count() == 0
    assert found.where(F.col("offset").isNull()).count() == 0


def test_search_keeps_files_of_unknown_length(spark):
    rng = random.Random(5)
    scene = [round(rng.uniform(10, 60), 3) for _ in range(20)]
    # File 1 goes on for a quarter of all rows; of 2 and 3 one has no duration, the other no fps.
    sizes = {1: 60, 2: 20, 3: 20, 4: 40, 5: 40, 6: 40}
    rows = []
    for f, n in sizes.items():
        frame = 0
        for g in [round(rng.uniform(10, 60), 3) for _ in range(n - 20)] + (scene if f < 5 else [round(rng.uniform(10, 60), 3) for _ in range(20)]):
            frame += round(g * 25)
            rows.append((f, frame, g))
    known = {1: (25.0, None), 2: (25.0, None), 3: (None, 600.0)}
    files = spark.createDataFrame([(f, f"/v/{f}.mkv", *known.get(f, (25.0, 9000.0))) for f in sizes], "filename_id long, name string, fps double, duration double")
    hashes = spark.createDataFrame(rows, "filename_id long, frame int, hash double")
    items = search_items(Catalog(files, hashes), SearchParams())
    assert {r.filename_id: r["count"] for r in items.groupBy("filename_id").count().collect()} == {f: n - 12 for f, n in sizes.items()}
    found = search(Catalog(files, hashes), SearchParams(scenelength=1e9)).collect()
    assert {r.filename_id for r in found} == {1, 2, 3, 4}
    assert {r.filename_id for r in found if r.offset is None} == {3}


def test_bounds_of_files_of_unknown_length(spark):
    gaps = spark.createDataFrame([(f, frame) for f in (1, 2, 3, 4) for frame in (5, 50, 95, 1000)], "f long, frame int")
    files = spark.createDataFrame([(1, 1.0, 100.0), (2, 1.0, None), (3, None, 100.0)], "f long, fps double, duration double")
    kept = playable_range(gaps, files, "f", "frame", 10, 10).collect()
    assert sorted(map(tuple, kept)) == [(1, 50), (2, 50), (2, 95), (2, 1000), (3, 5), (3, 50), (3, 95), (3, 1000)]


def test_whole_search_against_brute_force(spark, tmp_path):
    """A pair under /media/vault, a scene within the first 30 s and file 1, which never ends, come out."""
    rng = random.Random(6)
    whole = [float(rng.randint(10, 60)) for _ in range(16)]
    early = [float(rng.randint(1, 2)) for _ in range(16)]

    def noise(n):
        return [float(rng.randint(10, 60)) for _ in range(n)]

    gaps = {1: noise(40) + whole + noise(10), 2: whole + noise(8), 3: noise(8) + [g + 0.5 for g in whole], 4: early + noise(4), 5: early + noise(6), 6: noise(20)}
    names = {2: "/media/vault/2.mkv", 3: "/media/vault/3.mkv"}
    hashes = [(f, int(sum(g[: i + 1])), x) for f, g in gaps.items() for i, x in enumerate(g)]
    tables = {
        "filenames": ([(f, names.get(f, f"/v/{f}.mkv"), 1.0, None if f == 1 else 9000.0) for f in gaps], "id long, name string, fps double, duration double"),
        "hashes": (hashes, "filename_id long, frame int, hash double"),
        "brightness": ([], "filename_id long, brightness array<double>, loaded_at timestamp"),
        "whitelist": ([], "id1 long, id2 long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    items = [(f, [x if sum(g[i : i + j]) <= 300 else 0.0 for j, x in enumerate(g[i : i + 12])]) for f, g in gaps.items() for i in range(len(g) - 12)]
    hoods = {q: sorted({f for f, v in items if sum((x - y) ** 2 for x, y in zip(w, v, strict=True)) < 9}) for q, (_, w) in enumerate(items)}
    want = {(q, f) for q, fs in greedy({q: fs for q, fs in hoods.items() if len(fs) > 1}, set(), None, 0) for f in fs}
    got = registry.queries()["catalogue_groups_all"](spark, str(tmp_path)).collect()
    assert {(r.group, r.filename_id) for r in got} == want and len(got) == len(want)
    assert {f for _, f in want} == {1, 2, 3, 4, 5}


def hoods(seed):
    rng = random.Random(seed)
    return [(q, f, 100 * q + f, f) for q in range(0, 90, 3) for f in rng.sample(range(-3, 20), rng.randint(2, 9))]


@pytest.mark.parametrize("tasks", [1, 7])
def test_first_pairs_are_found_without_the_pairs_of_all_neighbourhoods(spark, monkeypatch, tasks):
    reps = spark.createDataFrame(hoods(1), "q long, filename_id long, item long, frame int")
    want = groups.first_reports(groups.file_pairs(reps))
    monkeypatch.setattr(groups, "FIRST_TASKS", (tasks, tasks))
    got = groups.first_pairs(reps)
    assert sorted(map(tuple, got.select("q", "file1", "file2").collect())) == sorted(map(tuple, want.select("q", "file1", "file2").collect()))
    ends = groups.first_pairs(reps, ends=True)
    assert sorted(map(tuple, ends.select("q", "filename_id").collect())) == sorted(map(tuple, groups.endpoints(want).select("q", "filename_id").collect()))
    assert groups.first_pairs(reps.where("false")).count() == groups.first_pairs(reps.where("false"), ends=True).count() == 0


def test_forest_links_what_its_edges_link(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(400)] + [(None, 1, 2), (1, None, 2)]
    edges = spark.createDataFrame(rows, "q long, a long, b long")
    few = groups.forest(edges.coalesce(1), "q", "a", "b")
    labels = lambda e: sorted(map(tuple, groups.component_labels(e.where("a <> b"), "q", "a", "b").collect()))
    assert labels(few) == labels(edges) and few.count() < 4 * 41


def test_counts_of_classes(spark):
    rng = random.Random(3)
    named = {0: [0, 5, 9], 1: [1], 2: [2, 3, 30], 4: [4, 8], 6: [6, 7]}
    shown = [(q, a, b, rng.random()) for q in named for a, b in itertools.combinations(range(6), 2) if rng.random() < 0.7]
    schema = "q long, file1 long, file2 long, score double"
    every = spark.createDataFrame([(x, a, b, s) for q, a, b, s in shown for x in named[q]], schema)
    queries = spark.createDataFrame([(x, q) for q, xs in named.items() for x in xs], "q long, class long")
    for rows in (shown, []):
        classes = spark.createDataFrame(rows, schema)
        assert groups.class_verify_counts(classes, queries, 0.8).collect() == groups.verify_counts(every if rows else classes, 0.8).collect()


def copied_hoods(seed, copies=4):
    """Neighbourhoods in which most files have copies, which have the same segments: (q, file, segment)."""
    rng = random.Random(seed)
    rows = [(q, f, rng.randint(0, 3)) for q in range(0, 60, 3) for f in rng.sample(range(12), rng.randint(1, 5))]
    return [(q, f + 100 * k, s) for q, f, s in rows for k in range(copies if f % 3 else 1)]


def test_copies_are_one_class(spark):
    rows = copied_hoods(6)
    df = spark.createDataFrame(rows, "q long, file long, segment long")
    members, heads = groups.file_classes(df, "file", ["q", "segment"])
    same = {}
    for q, f, s in rows:
        same.setdefault(f, set()).add((q, s))
    want = {f: min(g for g in same if same[g] == same[f]) for f in same}
    assert {r.file: r["class"] for r in members.collect()} == want and members.count() == len(want)
    assert sorted(map(tuple, heads.select("q", "class", "segment").collect())) == sorted({(q, want[f], s) for q, f, s in rows})
    reps = df.select("q", F.col("file").alias("filename_id"), F.col("file").alias("item"))
    first = groups.first_reports(groups.file_pairs(reps))
    assert sorted(map(tuple, groups.first_pairs(reps).collect())) == sorted(map(tuple, first.select("q", "file1", "file2").collect()))
    assert sorted(map(tuple, groups.first_pairs(reps, ends=True).collect())) == sorted(map(tuple, groups.endpoints(first).select("q", "filename_id").collect()))


@pytest.mark.parametrize("seed", range(2))
def test_pairs_of_copies_are_scored_as_classes(spark, seed):
    rng = random.Random(seed)
    rows = copied_hoods(seed)
    likeness = {(a, b): rng.random() for a in range(4) for b in range(a, 4)}
    by = {}
    for q, f, s in rows:
        by.setdefault(q, []).append((f, s))
    shown = [(q, *sorted((f, g)), likeness[min(s, t), max(s, t)]) for q, fs in by.items() for (f, s), (g, t) in itertools.combinations(fs, 2)]
    segments = sorted({(q, min(s, t), max(s, t), likeness[min(s, t), max(s, t)]) for q, fs in by.items() for (f, s), (g, t) in itertools.combinations(fs, 2)})
    members = spark.createDataFrame(rows, "q long, file long, segment long")
    scores = spark.createDataFrame(segments, "q long, segment1 long, segment2 long, score double")
    scored = spark.createDataFrame(shown, "q long, file1 long, file2 long, score double")
    assert sorted(map(tuple, scored_pairs(members, scores).collect())) == sorted(shown)
    classes, pairs = scored_classes(members, scores)
    queries = scored.select("q", F.col("q").alias("class")).distinct()
    counted = groups.class_verify_counts(pairs.withColumnsRenamed({"class1": "file1", "class2": "file2"}), queries, 0.6)
    assert counted.collect() == groups.verify_counts(scored, 0.6).collect()
    reps = members.select("q", F.col("file").alias("filename_id"), F.col("file").alias("item"), F.col("file").cast("int").alias("frame"))
    accepted = pairs.where("score >= 0.6").groupBy("class1", "class2").agg(F.min("q").alias("q"))
    want = groups.verified_groups(reps, scored, 0.6)
    assert sorted(map(tuple, groups.labelled_classes(reps, accepted, classes).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("word", [3, groups.WORD])
def test_whitelisted_pairs_of_copies(spark, monkeypatch, word):
    monkeypatch.setattr(groups, "WORD", word)
    rng = random.Random(word)
    reps = spark.createDataFrame([(q, f) for q, f, _ in copied_hoods(8, 5)], "q long, filename_id long")
    files = sorted({r.filename_id for r in reps.collect()})
    white = [tuple(rng.sample(files, 2)) for _ in range(300)] + [(a, b) for a in files if a % 100 == 4 for b in files] + [(None, 1), (files[0], -5)]
    wl = spark.createDataFrame(white + white[:50], "id1 long, id2 long")
    want = groups.without_whitelisted(groups.first_reports(groups.file_pairs(reps.withColumn("item", F.col("filename_id")))), wl)
    classes, firsts = groups.first_class_pairs(reps)
    got = groups.allowed_pairs(firsts, classes, "filename_id", wl).select("q", "file1", "file2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("q", "file1", "file2").collect()))
    ends = groups.allowed_ends(firsts, classes, "filename_id", wl)
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, groups.endpoints(want).select("q", "filename_id").collect()))
