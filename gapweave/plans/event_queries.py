"""The search pipeline stage by stage, on signals made of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.config import SearchParams
from gapweave.operators import groups, knn, profile, signal, windows
from gapweave.plans.search import Catalog, scored_classes, scored_pairs, search, segment_scores
from gapweave.runtime import in_parts, materialize, release, table

FPS, MIN_SECONDS, LENGTH, RADIUS, SCENE, THRESHOLD, LOOSE = 0.5, 2.0, 12, 3.0, 300.0, 0.70, 0.30


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id is not null and value is not null")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events in order of time as a series of brightness values."""
    return signal.numbered(events(spark, d), "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("filename_id"), "frame", "value")


def files(spark: SparkSession, d: str) -> DataFrame:
    counted = frames(spark, d).groupBy("filename_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "filename_id", F.format_string("/users/%d/events.mkv", "filename_id").alias("name"), F.lit(FPS).alias("fps"), (F.col("n") / FPS).alias("duration")
    )


def gaps(spark: SparkSession, d: str, seconds: float = MIN_SECONDS) -> DataFrame:
    return signal.ordered_peaks(events(spark, d).withColumnRenamed("user_id", "filename_id"), "filename_id", ["ts", "event_id"], "value", seconds, FPS)


def items(spark: SparkSession, d: str, length: int = LENGTH, scene: float | None = SCENE) -> DataFrame:
    return windows.hash_windows(gaps(spark, d), "filename_id", "frame", "hash", length, scene)


def long_form(rows: DataFrame) -> DataFrame:
    """Windows with a row per value, for comparison."""
    return rows.select("item", "filename_id", "frame", F.posexplode("values").alias("pos", "value"))


def ignoring_edges(spark: SparkSession, d: str) -> DataFrame:
    kept = windows.playable_range(gaps(spark, d), files(spark, d), "filename_id", "frame", 15.3, 20.1)
    return windows.hash_windows(kept, "filename_id", "frame", "hash", 6, SCENE)


def window_stats(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("item", *windows.window_stats("values"))


def near(spark: SparkSession, d: str, step: int = 1, lowest: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows, the queried ones with their class (q, class), and the neighbours of classes (class, item, d2); with ``lowest`` for their files."""
    rows = materialize(items(spark, d), "items")
    return rows, *knn.class_pairs(rows, "item", "values", RADIUS, LENGTH, step, lowest=("filename_id", "frame") if lowest else None)


def pairs(spark: SparkSession, d: str, grid: bool = False) -> DataFrame:
    cells = (lambda v: knn.grid_pairs(v, "item", "v", LENGTH, RADIUS)) if grid else None
    return knn.all_pairs(materialize(items(spark, d), "items"), "item", "values", RADIUS, LENGTH, cells)


def step_pairs(spark: SparkSession, d: str, step: int) -> DataFrame:
    _, queries, found = near(spark, d, step)
    return knn.of_classes(queries, found)


def top(spark: SparkSession, d: str, k: int) -> DataFrame:
    _, queries, found = near(spark, d)
    best = in_parts(knn.named(found), "q", found._gapweave_rows, "nearest", lambda part: knn.nearest(part, k))
    release(spark, found)
    return knn.of_classes(queries, best.withColumnRenamed("q", "class"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def reps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The queried windows with their class, and the files near a class; its name is its first query."""
    rows, queries, found = near(spark, d, lowest=True)
    return queries, groups.written_reps(knn.named(found), rows)


def all_reps(spark: SparkSession, d: str) -> DataFrame:
    queries, found = reps(spark, d)
    return knn.of_classes(queries, found.withColumnRenamed("q", "class"))


def file_counts(spark: SparkSession, d: str) -> DataFrame:
    queries, found = reps(spark, d)
    # A file is there once, and a neighbourhood is written by one task, so that no more than a row for each is moved.
    counted = found.groupBy(F.col("q").alias("class")).agg(F.count("filename_id").alias("files"))
    return knn.of_classes(queries, counted)


def catalogue(spark: SparkSession, d: str, whitelist: bool = False) -> Catalog:
    """The events as a catalogue; the whitelist holds the found pairs whose numbers sum to a multiple of 3."""
    listed = None
    if whitelist:
        pairs = groups.first_pairs(reps(spark, d)[1]).where("(file1 + file2) % 3 = 0")
        listed = materialize(pairs.select(F.col("file2").alias("id1"), F.col("file1").alias("id2")), "whitelist")
    brightness = frames(spark, d).groupBy("filename_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"]).alias("brightness"))
    return Catalog(files(spark, d), gaps(spark, d), brightness, listed)


def group_rows(spark: SparkSession, d: str, verify: bool = False, whitelist: bool = False, least: float = THRESHOLD) -> DataFrame:
    found = search(catalogue(spark, d, whitelist), SearchParams(verify_brightness=verify, brightness_correlation=least, radius=RADIUS, indexlength=LENGTH, scenelength=SCENE))
    return found.select(F.col("group"), *(["label"] if verify else []), "filename_id", "item", "frame", "offset")


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queried windows with their class, and the ``segment_scores`` of the neighbourhoods of classes."""
    c = catalogue(spark, d)
    rows, queries, found = near(spark, d, lowest=True)
    represented = groups.written_reps(knn.named(found), rows)
    return queries, *segment_scores(represented, rows, c)


def all_scored(spark: SparkSession, d: str) -> DataFrame:
    queries, members, scores = scored(spark, d)
    return knn.of_classes(queries, scored_pairs(members, scores).withColumnRenamed("q", "class"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    queries, members, scores = scored(spark, d)
    pairs = scored_classes(members, scores)[1].withColumnsRenamed({"class1": "file1", "class2": "file2"})
    return groups.class_verify_counts(pairs, queries, THRESHOLD)


def segments(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d)
    assert c.brightness is not None
    rows = items(spark, d).join(c.brightness, "filename_id").withColumn("fps", F.lit(FPS))
    part = rows.select("item", profile.segment("brightness", "frame", "values", "fps").alias("part"))
    return part.select("item", F.size("part").alias("points"), F.round(F.aggregate("part", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


QUERIES = {
    "signal_frames": frames,
    "extrema": gaps,
    "extrema_wide": lambda s, d: gaps(s, d, 4.0),
    "peak_counts": lambda s, d: signal.peak_counts(gaps(s, d), "filename_id"),
    "hash_windows": lambda s, d: long_form(items(s, d)),
    "windows_ignore_edges": lambda s, d: long_form(ignoring_edges(s, d)),
    "windows_speed_norm": lambda s, d: long_form(items(s, d).withColumn("values", windows.normalise_speed("values"))).withColumn("value", F.round("value", 6)),
    "scene_truncated": lambda s, d: long_form(items(s, d, 6, 16.0)),
    "window_stats": lambda s, d: window_stats(s, d).withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6)}),
    "knn_radius": pairs,
    "knn_grid": lambda s, d: pairs(s, d, grid=True),
    "knn_topk20": lambda s, d: top(s, d, 20),
    "knn_step": lambda s, d: step_pairs(s, d, 5),
    "knn_embeddings": lambda s, d: knn.radius_pairs(vectors(s, d), "vec_id", "embedding", 1.1).select("q", "item"),
    "knn_lsh": lambda s, d: knn.lsh_pairs(vectors(s, d), "vec_id", "embedding", 1.1).select("q", "item"),
    "neighbour_reps": all_reps,
    "neighbour_files": file_counts,
    "duplicate_pairs": lambda s, d: groups.first_pairs(reps(s, d)[1]),
    "duplicate_groups": group_rows,
    "group_sizes": lambda s, d: group_rows(s, d).groupBy("group").agg(F.count(F.lit(1)).alias("members")),
    "groups_whitelisted": lambda s, d: group_rows(s, d, whitelist=True),
    "brightness_segments": segments,
    "brightness_corr": lambda s, d: all_scored(s, d).withColumn("score", F.round("score", 6)),
    "verified_groups": lambda s, d: group_rows(s, d, verify=True),
    "verified_groups_loose": lambda s, d: group_rows(s, d, verify=True, whitelist=True, least=LOOSE),
    "verify_counts": counts,
}


def _gap_sql(order: int = 1) -> str:
    return f"""frames as (select user_id as fid, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame, value as b from events
    where user_id is not null and value is not null),
  changes as (select *, lag(b) over (partition by fid order by frame) as pb from frames),
  runs as (select fid, frame as l, b, lag(b) over o as pv, lead(b) over o as nv, lead(frame) over o as nf from changes where pb is null or pb <> b
    window o as (partition by fid order by frame)),
  tops as (select fid, cast((l + nf - 1) // 2 as int) as frame, b from runs where pv < b and nv < b),
  maxima as (select fid, frame, max(b) over (partition by fid order by frame rows between {order} preceding and {order} following) as m from frames),
  gaps as (select fid, frame, (frame - coalesce(lag(frame) over (partition by fid order by frame), 0)) / {FPS} as hash from tops join maxima using (fid, frame) where b = m)"""


def _item_sql(length: int = LENGTH, source: str = "gaps") -> str:
    leads = ", ".join(f"lead(hash, {i}) over o" for i in range(length))
    return f"""slid as (select fid, frame, [{leads}] as v, lead(hash, {length}) over o as more, count(*) over (partition by fid) as n from {source}
    window o as (partition by fid order by frame)),
  items as (select row_number() over (order by fid, frame) - 1 as item, fid, frame, v from slid where more is not null and n >= 5)"""


def _long_sql(values: str) -> str:
    return f"select item, filename_id, frame, pos - 1 as pos, vals[pos] as value from (select item, fid as filename_id, frame, {values} as vals, unnest(range(1, len(v) + 1)) as pos from items) x"


_D2 = " + ".join(f"(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])" for i in range(1, LENGTH + 1))
_BASE = f"with recursive {_gap_sql()}, {_item_sql()}"
_NEAR = f"{_BASE}, near as (select a.item as q, b.item, {_D2} as d2 from items a join items b on {_D2} < {RADIUS**2})"
_REPS = f"""{_NEAR}, found as (select n.q, i.fid, min(i.item) as item, arg_min(i.frame, i.item) as frame from near n join items i on i.item = n.item group by n.q, i.fid),
  reps as (select * from found where q in (select q from found group by q having count(*) > 1)),
  pairs as (select a.q, a.fid as f1, b.fid as f2, a.item as i1, b.item as i2 from reps a join reps b on a.q = b.q and a.fid < b.fid)"""


def _group_sql(pairs: str) -> str:
    return f"""firsts as (select f1, f2, min(q) as q from {pairs} group by f1, f2),
  members as (select q, f1 as fid from firsts union select q, f2 from firsts)
  select m.q as "group", m.fid as filename_id, r.item, r.frame, r.frame / {FPS} as "offset" from members m join reps r on r.q = m.q and r.fid = m.fid"""


_WHITE = "kept as (select * from pairs where (f1 + f2) % 3 <> 0)"
_SEGMENTS = f"""series as (select fid, list(b order by frame) as s from frames group by fid),
  segs as (select item, s[frame + 1 : frame + greatest(1, cast(round_even(list_sum(list_filter(v, lambda x: x > 0)) * {FPS}, 0) as int))] as part from items join series using (fid))"""
_SCORED = f"""{_REPS}, {_SEGMENTS},
  wanted as (select distinct i1, i2 from pairs),
  sampled as (select item, i, part[lo + 1] + (p - lo) * (part[lo + 2] - part[lo + 1]) as x from (
    select item, part, i, i * (len(part) - 1) / 999.0 as p, cast(floor(least(i * (len(part) - 1) / 999.0, len(part) - 2)) as int) as lo
    from segs, range(1000) g(i) where len(part) > 1 and item in (select i1 from wanted union select i2 from wanted)) y),
  lagged as (select w.i1, w.i2, l.lag, corr(a.x, b.x) as r from wanted w join sampled a on a.item = w.i1 cross join (select unnest(range(-20, 21)) as lag) l
    join sampled b on b.item = w.i2 and b.i = a.i - l.lag group by w.i1, w.i2, l.lag),
  scores as (select w.i1, w.i2, coalesce(max(case when isfinite(r) then r end), 0.0) as score from wanted w left join lagged l using (i1, i2) group by w.i1, w.i2),
  scored as (select p.q, p.f1 as file1, p.f2 as file2, s.score from pairs p join scores s on s.i1 = p.i1 and s.i2 = p.i2)"""


def _verified_sql(threshold: float, also: str = "") -> str:
    return f"""{_SCORED}, firsts as (select file1 as f1, file2 as f2, min(q) as q from scored where score >= {threshold} {also} group by 1, 2),
  edges as (select q, f1 as x, f2 as y from firsts union select q, f2, f1 from firsts),
  reach as (select q, x as fid, y as seen from edges union select r.q, r.fid, e.y from reach r join edges e on e.q = r.q and e.x = r.seen)
  select g.q as "group", g.label, g.fid as filename_id, r.item, r.frame, r.frame / {FPS} as "offset"
  from (select q, fid, min(seen) as label from reach group by q, fid) g join reps r on r.q = g.q and r.fid = g.fid"""


_EMBEDDED = """select a.vec_id as q, b.vec_id as item from embeddings a, embeddings b
  where list_sum(list_transform(range(1, 65), lambda i: (cast(a.embedding[i] as double) - cast(b.embedding[i] as double)) ** 2)) < 1.1 * 1.1"""
_PREFIX = "(list_sum(v[1 : i - 1]))"
ORACLES = {
    "signal_frames": f"with {_gap_sql()} select fid as filename_id, frame, b as value from frames",
    "extrema": f"with {_gap_sql()} select fid as filename_id, frame, hash from gaps",
    "extrema_wide": f"with {_gap_sql(2)} select fid as filename_id, frame, hash from gaps",
    "peak_counts": f"with {_gap_sql()} select fid as filename_id, count(*) as peaks from gaps group by fid",
    "hash_windows": f"{_BASE} {_long_sql('v')}",
    "windows_ignore_edges": f"""with {_gap_sql()}, bounds as (select fid, cast(trunc(15.3 * {FPS}) as bigint) as lo, cast(trunc((count(*) / {FPS} - 20.1) * {FPS}) as bigint) as hi from frames group by fid),
      cut as (select g.* from gaps g join bounds b using (fid) where frame between lo and hi), {_item_sql(6, "cut")} {_long_sql("v")}""",
    "windows_speed_norm": f"{_BASE} select item, filename_id, frame, pos, round(value, 6) as value from ({_long_sql('case when list_avg(v) = 0 then v else list_transform(v, lambda x: 128 * x / list_avg(v)) end')}) z",
    "scene_truncated": f"with {_gap_sql()}, {_item_sql(6)} {_long_sql(f'list_transform(v, lambda x, i: case when i > 1 and {_PREFIX} > 16 then 0.0 else x end)')}",
    "window_stats": f"{_BASE} select item, len(v) as length, round(list_sum(v), 6) as total, round(list_avg(v), 6) as mean from items",
    "knn_radius": f"{_NEAR} select * from near",
    "knn_grid": f"{_NEAR} select * from near",
    "knn_topk20": f"{_NEAR} select q, item, d2 from (select *, row_number() over (partition by q order by d2, item) as i from near) x where i <= 20",
    "knn_step": f"{_NEAR} select * from near where q % 5 = 0",
    "knn_embeddings": _EMBEDDED,
    "neighbour_reps": f"{_REPS} select q, fid as filename_id, item, frame from reps",
    "neighbour_files": f"{_REPS} select q, count(distinct fid) as files from reps group by q",
    "duplicate_pairs": f"{_REPS} select min(q) as q, f1 as file1, f2 as file2 from pairs group by f1, f2",
    "duplicate_groups": f"{_REPS}, {_group_sql('pairs')}",
    "group_sizes": f'{_REPS}, z as (with {_group_sql("pairs")}) select "group", count(*) as members from z group by 1',
    "groups_whitelisted": f"{_REPS}, {_WHITE}, {_group_sql('kept')}",
    "brightness_segments": f"{_BASE}, {_SEGMENTS} select item, len(part) as points, round(coalesce(list_sum(part), 0.0), 4) as total from segs",
    "brightness_corr": f"{_SCORED} select q, file1, file2, round(score, 6) as score from scored",
    "verified_groups": _verified_sql(THRESHOLD),
    "verified_groups_loose": _verified_sql(LOOSE, "and (file1 + file2) % 3 <> 0"),
    "verify_counts": f"""{_SCORED}, w as (select *, min(case when score >= {THRESHOLD} then q end) over (partition by file1, file2) as f from scored)
      select count(*) as checked, count(*) filter (score < {THRESHOLD}) as rejected from w where f is null or q <= f""",
}
