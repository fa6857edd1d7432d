"""Queries on the catalogue tables: search, paths, formats, media facts and maintenance."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.config import SearchParams
from gapweave.functions import scalar
from gapweave.operators import catalog, groups, paths, report
from gapweave.plans import search as plan
from gapweave.runtime import table
from gapweave.sources import media as source
from gapweave.sources import tables

ROOTS = ["/srv/Video/raw takes", "/mnt/pool"]
LIKE_ROOT = "/SRV/video"
RADIUS, LENGTH = 0.6, 12


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filenames").select(F.col("id").alias("filename_id"), "name", "fps", "duration")


def named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filenames").where("name is not null")


def whitelist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "whitelist").select("id1", "id2")


def media(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "media_info").select("filename_id", "extension", "codec", "width", "height", "file_size", "probed_at", "probe_id")
    return report.latest_media(facts, "filename_id", ["probed_at", "probe_id"])


def catalogue(spark: SparkSession, d: str) -> plan.Catalog:
    return plan.Catalog(files(spark, d), table(spark, d, "hashes"), table(spark, d, "brightness"), whitelist(spark, d))


def measured(spark: SparkSession, d: str) -> plan.Catalog:
    """The catalogue of the files with fps and duration, which is what the SQL of some queries asks for."""
    return replace(catalogue(spark, d), files=files(spark, d).where("fps is not null and duration is not null"))


def found(spark: SparkSession, d: str, **settings: object) -> DataFrame:
    params = SearchParams(radius=RADIUS, indexlength=LENGTH, knnlib="grid", ignore_start=30, ignore_end=30, scenelength=1e9, exclude_dirs=("/media/vault",), **settings)  # type: ignore[arg-type]
    return plan.search(measured(spark, d), params)


def catalogue_groups(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("group", "filename_id", "item", "frame")


def search_report(spark: SparkSession, d: str) -> DataFrame:
    return plan.report_groups(found(spark, d), media(spark, d))


def found_all(spark: SparkSession, d: str) -> DataFrame:
    """The search of all files with the settings it has from the start: nothing excluded, nothing ignored."""
    return plan.search(catalogue(spark, d), SearchParams(knnlib="fine"))


def catalogue_groups_all(spark: SparkSession, d: str) -> DataFrame:
    return found_all(spark, d).select("group", "filename_id", "item", "frame")


def search_report_all(spark: SparkSession, d: str) -> DataFrame:
    return plan.report_groups(found_all(spark, d), media(spark, d))


def saved(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise matches as saved groups of two, grouped by their first file and frame."""
    rows = table(spark, d, "scene_pairs").where("id2 is not null")
    return rows.select(F.col("id1").alias("group"), F.explode(F.array("id1", "id2")).alias("filename_id"))


def saved_groups(spark: SparkSession, d: str) -> DataFrame:
    alive = table(spark, d, "filenames").where("deleted_at is null").select(F.col("id").alias("filename_id"))
    return groups.keep_saved_groups(saved(spark, d), alive, whitelist(spark, d), "group", "filename_id").distinct()


def import_candidates(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2023-02-01 00:00:00").cast("timestamp_ntz")
    listing = named(spark, d).select("id", "name", F.col("imported_at").cast("timestamp").alias("modified"))
    return paths.importable(listing, "name", "modified", ["mp4", "mkv", "avi", "ts"], ROOTS, now.cast("timestamp")).select("id")


def batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The files of the last batch, and all before it."""
    rows = table(spark, d, "filenames")
    last = rows.agg(F.max("batch_no")).first()[0]
    return rows.where(F.col("batch_no") == F.lit(last)), rows.where(F.col("batch_no") < F.lit(last))


def upsert(spark: SparkSession, d: str) -> DataFrame:
    new, old = batches(spark, d)
    changed = old.where("id % 10 = 0 and name is not null").groupBy("name").agg(F.lit(25.0).alias("fps"), F.lit(1.0).alias("duration"))
    added = new.where("name is not null").groupBy("name").agg(F.lit(30.0).alias("fps"), F.lit(2.0).alias("duration"))
    known = old.groupBy("name").agg(F.min("id").alias("id"), F.max("fps").alias("fps"), F.max("duration").alias("duration")).where("name is not null")
    both = changed.unionByName(added.join(changed.select("name"), "name", "left_anti"))
    return catalog.upsert_by_name(known.select("id", "name", "fps", "duration"), both)


def deleted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filenames").where("deleted_at is not null").select("id")


def cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows left of each table when the deleted files go."""
    gone, out = deleted(spark, d), None
    for name, columns in (("filenames", ["id"]), ("hashes", ["filename_id"]), ("brightness", ["filename_id"]), ("media_info", ["filename_id"]), ("whitelist", ["id1", "id2"])):
        left = catalog.delete_keys(table(spark, d, name), gone, "id", columns).agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(name).alias("table_name"), "left_rows")
        out = left if out is None else out.unionByName(left)
    return out


def tidy(spark: SparkSession, d: str) -> DataFrame:
    """Rows left of each table when orphans are tidied away."""
    known, out = table(spark, d, "filenames"), None
    for name, columns in (("hashes", ["filename_id"]), ("brightness", ["filename_id"]), ("media_info", ["filename_id"]), ("whitelist", ["id1", "id2"])):
        left = catalog.keep_known(table(spark, d, name), known, "id", columns).agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(name).alias("table_name"), "left_rows")
        out = left if out is None else out.unionByName(left)
    return out


def replaced_media(spark: SparkSession, d: str) -> DataFrame:
    facts = media(spark, d).select("filename_id", "codec", F.coalesce("file_size", F.lit(-1)).alias("file_size"))
    new = files(spark, d).where("filename_id % 3 = 0").select("filename_id", F.lit("av1").alias("codec"), F.lit(1).cast("long").alias("file_size"))
    return catalog.replace_rows(facts, new, "filename_id")


def new_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that whitelisting the two files of each reported match would add."""
    rows = named(spark, d)
    ends = table(spark, d, "scene_pairs").select(F.col("pair_id").alias("list"), F.explode(F.array("id1", "id2")).alias("id"))
    lists = ends.join(rows.select("id", "name"), "id").select("list", "name")
    return catalog.whitelist_pairs(rows, lists, whitelist(spark, d).where("id2 is not null"))


def purge(spark: SparkSession, d: str) -> DataFrame:
    rows = named(spark, d)
    return catalog.purge_counts(rows, rows.where("deleted_at is null"))


def cache_counts(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "scene_pairs").select(F.explode(F.array("id1", "id2")).alias("filename_id")).where("filename_id is not null")
    have = media(spark, d)
    probed = table(spark, d, "filenames").select(F.col("id").alias("filename_id"), F.lit("h264").alias("codec"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.when(F.col("id") % 2 == 0, F.lit(1000)).alias("file_size"))
    fresh = report.cacheable(probed.join(report.to_probe(members, have), "filename_id", "left_semi"))
    return report.cache_counts(members, have, fresh)


#: Texts with their meanings, for the functions on constants.
_RATES = ["25/1", "30000/1001", "0/0", "1000/1", "90000/1", "24", "", "a/b", "25/0"]
_CLOCKS = ["01:02:03.50", "02:03", "7.25", "x", "00:00:00"]
_LISTS = ["mp4, .MKV,,avi ,mp4", "", " .Ts "]
_PROBES = [
    (1, '{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"mjpeg","width":3000,"height":3000,"avg_frame_rate":"0/0","r_frame_rate":"90000/1","disposition":{"attached_pic":1}},{"codec_type":"video","codec_name":"h264","width":640,"height":360,"avg_frame_rate":"0/0","r_frame_rate":"25/1"},{"codec_type":"video","codec_name":"hevc","width":360,"height":640,"avg_frame_rate":"30/1"}],"format":{"duration":"12.5"}}', None),
    (2, '{"streams":[{"codec_type":"audio"}],"format":{"duration":"N/A"}}', None),
    (3, "no json", None),
    (4, None, "probe timed out"),
]
_HEADERS = [
    (1, "ffmpeg version 6\n  Duration: 00:01:02.50, start: 0\n    Stream #0:0: Video: h264, yuv420p, 1920x1080, 1000 kb/s, 25 fps, 25 tbr\nOutput #0\n    Stream #0:0: Video: rawvideo, rgb24, 128x72, q=2"),
    (2, "ffmpeg version 6\n  Duration: N/A\n    Stream #0:0: Video: vp9, 640x360 , x"),
    (3, ""),
]


def constants(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "n long, x string")


def probes(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.createDataFrame([(str(a), b, c) for a, b, c in _PROBES], "path string, json string, error string")
    return source.read_probe(rows)


def media_streams(s: SparkSession, d: str) -> DataFrame:
    """The largest stream of each file, all its probes taken as the streams of one probe."""
    rows = table(s, d, "media_info").where("filename_id is not null")
    stream = F.struct("probe_id", F.lit("video").alias("codec_type"), F.col("codec").alias("codec_name"), "width", "height")
    probed = rows.groupBy(F.col("filename_id").cast("string").alias("path")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(stream)).alias("streams"))).alias("json"))
    best = source.read_probe(probed.withColumn("error", F.lit(None).cast("string")))
    return best.select(F.col("path").cast("long").alias("filename_id"), "codec", F.coalesce("width", F.lit(-1)).alias("width"), F.coalesce("height", F.lit(-1)).alias("height"))


def headers(spark: SparkSession, _: str) -> DataFrame:
    rows = source.read_header(spark.createDataFrame(_HEADERS, "n long, header string")).drop("header")
    return rows.fillna(-1)


def listing(spark: SparkSession, d: str) -> DataFrame:
    """Parquet files of the data folder older than an hour of a day long after."""
    return source.scan_files(spark, d, ["parquet"], [], F.lit("2100-01-01").cast("timestamp")).select(scalar.basename(F.col("path")).alias("name"))


_LATEST = "(select * from (select *, row_number() over (partition by filename_id order by probed_at desc nulls last, probe_id desc) as rn from media_info where filename_id is not null) where rn = 1)"
_SIZE = "case when {c} is null then 'unknown' when {c} < 1024 then printf('%.2f B', {c}::double) when {c} < 1048576 then printf('%.2f KiB', {c} / 1024.0) when {c} < 1073741824 then printf('%.2f MiB', {c} / 1048576.0) when {c} < 1099511627776 then printf('%.2f GiB', {c} / 1073741824.0) else printf('%.2f TiB', {c} / 1099511627776.0) end"
_RES = "case when coalesce({w}, 0) <> 0 and coalesce({h}, 0) <> 0 then {w} || 'x' || {h} else 'unknown' end"
_EXT = r"regexp_extract(lower({n}), '[^/.][^/]*\.([^./]*)$', 1)"
_DIR = r"case when regexp_extract({n}, '^(.*/)[^/]*$', 1) ~ '^/+$' then regexp_extract({n}, '^(.*/)[^/]*$', 1) else regexp_replace(regexp_extract({n}, '^(.*/)[^/]*$', 1), '/+$', '') end"
_CLOCK = "strftime(to_timestamp(cast(trunc({s}) as bigint)) at time zone 'UTC', '%H:%M:%S')"
_UNDER = " or ".join(f"name = '{r}' or starts_with(name, '{r}/')" for r in ROOTS)

QUERIES = {
    "catalogue_items": lambda s, d: plan.search_items(measured(s, d), SearchParams(indexlength=LENGTH)).select("item", "filename_id", "frame"),
    "catalogue_items_all": lambda s, d: plan.search_items(catalogue(s, d), SearchParams(indexlength=LENGTH)).select("item", "filename_id", "frame"),
    "catalogue_groups": catalogue_groups,
    "search_report": search_report,
    "catalogue_groups_all": catalogue_groups_all,
    "search_report_all": search_report_all,
    "saved_groups_filter": saved_groups,
    "ext_filter": lambda s, d: named(s, d).where(paths.has_extension(F.col("name"), ["mp4", "ts", "mkv"])).select("id"),
    "path_prefix_filter": lambda s, d: named(s, d).where(paths.is_under(F.col("name"), ROOTS)).select("id", "name"),
    "path_like_filter": lambda s, d: named(s, d).where(paths.is_like_prefix(F.col("name"), LIKE_ROOT)).select("id", "name"),
    "path_anti": lambda s, d: named(s, d).where(~paths.is_under(F.col("name"), ROOTS)).select("id", "name"),
    "path_listed": lambda s, d: named(s, d).where(paths.is_listed_under(F.col("name"), ["/"])).select("id"),
    "dir_counts": lambda s, d: paths.files_per_directory(table(s, d, "filenames"), "name"),
    "name_parts": lambda s, d: named(s, d).select("id", scalar.extension_or_unknown(F.col("name")).alias("ext"), scalar.dirname(F.col("name")).alias("dir"), scalar.basename(F.col("name")).alias("base")),
    "import_candidates": import_candidates,
    "new_only": lambda s, d: paths.only_new(batches(s, d)[0].where("name is not null"), batches(s, d)[1], "name").select("id"),
    "import_counts": lambda s, d: paths.import_counts(batches(s, d)[0].where("name is not null"), "name", batches(s, d)[1]),
    "durations": lambda s, d: files(s, d).select("filename_id", scalar.format_duration(F.col("duration") * 60).alias("shown")),
    "file_sizes": lambda s, d: table(s, d, "media_info").where("file_size > 0").select("probe_id", scalar.format_size(F.col("file_size")).alias("shown")).distinct(),
    "resolutions": lambda s, d: table(s, d, "media_info").select("probe_id", scalar.resolution(F.col("width"), F.col("height")).alias("shown")).distinct(),
    "known_durations": lambda s, d: files(s, d).select("filename_id", F.round(scalar.known_duration(F.col("duration"), F.lit(None).cast("double"), F.lit(500), F.col("fps")), 6).alias("seconds"), scalar.known_fps(F.col("fps"), F.lit(None).cast("double")).alias("rate")),
    "valid_names": lambda s, d: named(s, d).select("id", scalar.valid_text(F.col("name")).alias("name")),
    "parse_rate_files": lambda s, d: table(s, d, "filenames").select(
        "id", F.round(scalar.parse_rate(F.concat(F.round(F.col("fps") * 1001).cast("bigint").cast("string"), F.lit("/1001"))), 6).alias("fps")),
    "clock_to_seconds_files": lambda s, d: table(s, d, "filenames").where("duration >= 0 and duration < 86400").select(
        "id", scalar.clock_seconds(scalar.format_duration(F.col("duration"))).alias("seconds")),
    "parse_exts_media": lambda s, d: table(s, d, "media_info").where("filename_id is not null").groupBy("filename_id").agg(
        F.array_join(scalar.parse_extensions(F.array_join(F.collect_list(F.concat(F.lit(" ."), F.upper("extension"))), ",")), ",").alias("exts")),
    "best_stream_media": media_streams,
    "parse_rate": lambda s, d: constants(s, _RATES).select("n", F.round(scalar.parse_rate(F.col("x")), 6).alias("fps")),
    "clock_to_seconds": lambda s, d: constants(s, _CLOCKS).select("n", scalar.clock_seconds(F.col("x")).alias("seconds")),
    "parse_exts": lambda s, d: constants(s, _LISTS).select("n", F.array_join(scalar.parse_extensions(F.col("x")), ",").alias("exts")),
    "best_stream": lambda s, d: probes(s, d).select("path", "codec", F.coalesce("width", F.lit(-1)).alias("width"), F.coalesce("height", F.lit(-1)).alias("height")),
    "first_stream": lambda s, d: probes(s, d).select("path", "has_video", "fps", "duration", "error"),
    "decoder_headers": headers,
    "file_listing": listing,
    "frame_range": lambda s, d: tables.frame_range(table(s, d, "hashes"), 1000, 5000).select("filename_id", "frame", "hash"),
    "file_infos": lambda s, d: tables.file_infos(table(s, d, "filenames")).select("id", "name", "fps", "duration"),
    "media_for_files": lambda s, d: tables.for_files(media(s, d), table(s, d, "scene_pairs").select(F.col("id1").alias("filename_id")), "filename_id").select("filename_id", "codec", F.coalesce("file_size", F.lit(-1)).alias("file_size")),
    "brightness_json": lambda s, d: table(s, d, "brightness").where("filename_id is not null and brightness is not null").withColumn("t", tables.profile_to_json("brightness")).withColumn("b", tables.profile_from_json("t")).groupBy("filename_id").agg(F.max(F.size("b")).alias("points"), F.round(F.max(F.aggregate("b", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))), 4).alias("total")),
    "media_enrich": lambda s, d: report.enrich(files(s, d).where("name is not null"), media(s, d)).select("filename_id", "extension", "codec", "resolution", "size"),
    "cache_counts": cache_counts,
    "upsert_merge": upsert,
    "replace_rows": replaced_media,
    "cascade_delete": cascade,
    "orphan_tidy": tidy,
    "whitelist_pairs": new_whitelist,
    "purge_counts": purge,
    "delete_media": lambda s, d: catalog.delete_keys(media(s, d), deleted(s, d), "id", ["filename_id"]).select("filename_id"),
}

_OLD = "(select * from filenames where batch_no < (select max(batch_no) from filenames))"
_NEW = "(select * from filenames where batch_no = (select max(batch_no) from filenames))"
_PAIRED = "(select id1 as id from scene_pairs union select id2 from scene_pairs where id2 is not null)"


def _left(name: str, columns: list[str], condition: str) -> str:
    return f"select '{name}' as table_name, count(*) as left_rows from {name} t where " + " and ".join(condition.format(c=f"t.{c}") for c in columns)


_TABLES = [("hashes", ["filename_id"]), ("brightness", ["filename_id"]), ("media_info", ["filename_id"]), ("whitelist", ["id1", "id2"])]
_LEADS = ", ".join(f"lead(hash, {i}) over o as g{i}" for i in range(LENGTH))


def _catalogue_sql(ignore: float, excluded: str) -> str:
    return f"""once as (select filename_id as fid, frame, min(hash) as hash from hashes where filename_id is not null and frame is not null and hash is not null group by 1, 2),
  playable as (select o.* from once o join filenames f on f.id = o.fid where {excluded} and f.fps is not null and f.duration is not null
    and o.frame between cast(trunc({ignore} * f.fps) as bigint) and cast(trunc((f.duration - {ignore}) * f.fps) as bigint)),
  slid as (select fid, frame, {_LEADS}, lead(hash, {LENGTH}) over o as more, count(*) over (partition by fid) as n from playable window o as (partition by fid order by frame)),
  items as (select row_number() over (order by fid, frame) - 1 as item, * from slid where more is not null and n >= 5)"""


_D2 = " + ".join(f"(a.g{i} - b.g{i}) * (a.g{i} - b.g{i})" for i in range(LENGTH))
_SUM = " + ".join(f"g{i}" for i in range(LENGTH))
_GROUPED = """  found as (select n.q, i.fid, min(i.item) as item, arg_min(i.frame, i.item) as frame from near n join items i on i.item = n.item group by 1, 2),
  reps as (select * from found where q in (select q from found group by q having count(*) > 1)),
  pairs as (select a.q, a.fid as f1, b.fid as f2 from reps a join reps b on a.q = b.q and a.fid < b.fid
    where not exists (select 1 from whitelist w where least(w.id1, w.id2) = a.fid and greatest(w.id1, w.id2) = b.fid and w.id2 is not null)),
  firsts as (select f1, f2, min(q) as q from pairs group by f1, f2),
  members as (select q, f1 as fid from firsts union select q, f2 from firsts),
  groups as (select m.q, m.fid, r.item, r.frame from members m join reps r on r.q = m.q and r.fid = m.fid)"""
_FOUND = f"""{_catalogue_sql(30, "coalesce(not (f.name = '/media/vault' or starts_with(f.name, '/media/vault/')), true)")},
  cells as (select *, cast(floor(({_SUM}) / 2.1) as bigint) as z from items),
  near as (select a.item as q, b.item from cells a join (select *, z + unnest([-1, 0, 1]) as y from cells) b on a.z = b.y where {_D2} < {RADIUS**2}),
{_GROUPED}"""
#: The windows of all files: without fps or duration, what is not known bounds nothing.
_ALL_ITEMS = f"""once as (select filename_id as fid, frame, min(hash) as hash from hashes where filename_id is not null and frame is not null and hash is not null group by 1, 2),
  playable as (select o.* from once o join filenames f on f.id = o.fid
    where f.fps is null or (o.frame >= 0 and (f.duration is null or o.frame <= cast(trunc(f.duration * f.fps) as bigint)))),
  slid as (select fid, frame, {_LEADS}, lead(hash, {LENGTH}) over o as more, count(*) over (partition by fid) as n from playable window o as (partition by fid order by frame)),
  items as (select row_number() over (order by fid, frame) - 1 as item, * from slid where more is not null and n >= 5)"""
#: The search of all files: radius 3, values after 300 s set to 0, cells by the sums of both halves of a window.
_CUT = ", ".join(f"case when {' + '.join(['0.0', *(f'g{j}' for j in range(i))])} > 300 then 0.0 else g{i} end as g{i}" for i in range(LENGTH))
_HALVES = ", ".join(f"cast(floor(({' + '.join(f'g{i}' for i in h)}) / 7.35) as bigint) as z{n}" for n, h in enumerate([range(6), range(6, LENGTH)]))
_FOUND_ALL = f"""{_ALL_ITEMS},
  cut as (select item, fid, frame, {_CUT} from items),
  cells as (select *, {_HALVES} from cut),
  reached as (select *, z0 + s.a as y0, z1 + t.b as y1 from cells, (select unnest([-1, 0, 1]) as a) s, (select unnest([-1, 0, 1]) as b) t),
  near as (select a.item as q, b.item from cells a join reached b on a.z0 = b.y0 and a.z1 = b.y1 where {_D2} < 9),
{_GROUPED}"""
_LINES = f"""select g.q as "group", f.name, 'match=' || coalesce({_CLOCK.format(s="g.frame / f.fps")}, 'unknown') || ' duration=' || coalesce({_CLOCK.format(s="f.duration")}, 'unknown')
      || ' ext=' || coalesce(m.extension, coalesce(nullif({_EXT.format(n="f.name")}, ''), 'unknown')) || ' codec=' || coalesce(m.codec, 'unknown') || ' resolution=' || {_RES.format(w="m.width", h="m.height")}
      || ' size=' || {_SIZE.format(c="m.file_size")} || ' path=' || coalesce(f.name, '') as line
      from groups g join filenames f on f.id = g.fid left join {_LATEST} m on m.filename_id = g.fid"""
ORACLES = {
    "catalogue_items": f"with {_catalogue_sql(0, 'true')} select item, fid as filename_id, frame from items",
    "catalogue_items_all": f"with {_ALL_ITEMS} select item, fid as filename_id, frame from items",
    "catalogue_groups": f'with {_FOUND} select q as "group", fid as filename_id, item, frame from groups',
    "catalogue_groups_all": f'with {_FOUND_ALL} select q as "group", fid as filename_id, item, frame from groups',
    "search_report_all": f"with {_FOUND_ALL} {_LINES}",
    "search_report": f"with {_FOUND} {_LINES}",
    "saved_groups_filter": """with saved as (select id1 as g, id1 as f from scene_pairs where id2 is not null union select id1, id2 from scene_pairs where id2 is not null),
      alive as (select * from saved where f in (select id from filenames where deleted_at is null)),
      sized as (select g, count(*) as n from alive group by g having count(*) > 1),
      wl as (select distinct least(id1, id2) as x, greatest(id1, id2) as y from whitelist where id2 is not null and id1 <> id2),
      pairs as (select a.g, count(*) as p, count(wl.x) as w from alive a join alive b on a.g = b.g and a.f < b.f left join wl on wl.x = a.f and wl.y = b.f group by a.g)
      select g as "group", f as filename_id from alive where g in (select g from pairs where w < p) and g in (select g from sized)""",
    "ext_filter": f"select id from filenames where name is not null and {_EXT.format(n='name')} in ('mp4', 'ts', 'mkv') and not ends_with(lower(name), '.d.ts')",
    "path_prefix_filter": f"select id, name from filenames where name is not null and ({_UNDER})",
    "path_like_filter": f"select id, name from filenames where name = '{LIKE_ROOT}' or name ilike '{LIKE_ROOT}/%'",
    "path_anti": f"select id, name from filenames where name is not null and not ({_UNDER})",
    "path_listed": "select id from filenames where starts_with(name, '/')",
    "dir_counts": f"select {_DIR.format(n='name')} as directory, count(*) as files from filenames where name is not null group by 1",
    "name_parts": f"select id, coalesce(nullif({_EXT.format(n='name')}, ''), 'unknown') as ext, {_DIR.format(n='name')} as dir, regexp_extract(name, '([^/]*)$', 1) as base from filenames where name is not null",
    "import_candidates": f"select id from filenames where name is not null and {_EXT.format(n='name')} in ('mp4', 'mkv', 'avi', 'ts') and not ends_with(lower(name), '.d.ts') and not ({_UNDER}) and imported_at < timestamp '2023-01-31 23:00:00'",
    "new_only": f"select id from {_NEW} n where name is not null and name not in (select name from {_OLD} o where name is not null)",
    "import_counts": f"select count(*) as scanned, count(*) filter (k) as already, count(*) filter (not k) as queued from (select name in (select name from {_OLD} o where name is not null) as k from {_NEW} n where name is not null) x",
    "durations": f"select id as filename_id, {_CLOCK.format(s='duration * 60')} as shown from filenames",
    "file_sizes": f"select distinct probe_id, {_SIZE.format(c='file_size')} as shown from media_info where file_size > 0",
    "resolutions": f"select distinct probe_id, {_RES.format(w='width', h='height')} as shown from media_info",
    "known_durations": "select id as filename_id, round(coalesce(duration, case when fps > 0 then 500 / fps end), 6) as seconds, coalesce(case when fps > 0 then fps end, 25.0) as rate from filenames",
    "valid_names": "select id, name from filenames where name is not null",
    "parse_rate_files": "select id, case when r > 0 and r <= 240 then round(r, 6) end as fps from (select id, cast(round(fps * 1001) as bigint) / 1001.0 as r from filenames) x",
    "clock_to_seconds_files": "select id, floor(duration) as seconds from filenames where duration >= 0 and duration < 86400",
    "parse_exts_media": """select filename_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list(lower(trim(regexp_replace(lower(trim(extension)), '^[.]+', '')))), lambda e: e <> ''))), ','), '') as exts
      from media_info where filename_id is not null group by 1""",
    "best_stream_media": """select filename_id, coalesce(codec, 'unknown') as codec, coalesce(width, -1) as width, coalesce(height, -1) as height from (
      select *, row_number() over (partition by filename_id order by cast(coalesce(width, 0) as bigint) * coalesce(height, 0) desc, probe_id) as i from media_info where filename_id is not null) x where i = 1""",
    "parse_rate": "select * from (values (0, 25.0), (1, round(30000 / 1001.0, 6)), (2, null), (3, null), (4, null), (5, 24.0), (6, null), (7, null), (8, null)) t(n, fps)",
    "clock_to_seconds": "select * from (values (0, 3723.5), (1, 123.0), (2, 7.25), (3, null), (4, 0.0)) t(n, seconds)",
    "parse_exts": "select * from (values (0, 'avi,mkv,mp4'), (1, ''), (2, 'ts')) t(n, exts)",
    "best_stream": "select * from (values ('1', 'h264', 640, 360), ('2', 'unknown', -1, -1), ('3', 'unknown', -1, -1), ('4', 'unknown', -1, -1)) t(path, codec, width, height)",
    "first_stream": "select * from (values ('1', true, 25.0, 12.5, null), ('2', false, null, null, null), ('3', false, null, null, 'probe output is no JSON'), ('4', false, null, null, 'probe timed out')) t(path, has_video, fps, duration, error)",
    "decoder_headers": "select * from (values (1, 25.0, 1920, 1080, 128, 72, 62.5, 1562), (2, 0.0, 640, 360, 640, 360, -1.0, -1), (3, -1.0, -1, -1, -1, -1, -1.0, -1)) t(n, fps, source_width, source_height, width, height, duration, frames)",
    "frame_range": "select filename_id, frame, hash from hashes where frame between 1000 and 5000",
    "file_infos": "select id, name, fps, duration from filenames",
    "media_for_files": f"select filename_id, codec, coalesce(file_size, -1) as file_size from {_LATEST} m where filename_id in (select id1 from scene_pairs)",
    "brightness_json": "select filename_id, max(len(brightness)) as points, round(max(coalesce(list_sum(brightness), 0)), 4) as total from brightness where filename_id is not null and brightness is not null group by 1",
    "media_enrich": f"""select f.id as filename_id, coalesce(m.extension, coalesce(nullif({_EXT.format(n="f.name")}, ''), 'unknown')) as extension, coalesce(m.codec, 'unknown') as codec,
      {_RES.format(w="m.width", h="m.height")} as resolution, {_SIZE.format(c="m.file_size")} as size from filenames f left join {_LATEST} m on m.filename_id = f.id where f.name is not null""",
    "cache_counts": f"""select count(*) filter (k) as reused, count(*) filter (not k) as probed, count(*) filter (not k and id % 2 = 0 and id in (select id from filenames)) as stored
      from (select id, id in (select filename_id from media_info where filename_id is not null) as k from {_PAIRED} p) x""",
    "upsert_merge": f"""with known as (select name, min(id) as id, max(fps) as fps, max(duration) as duration from {_OLD} o where name is not null group by name),
      changed as (select distinct name, 25.0 as fps, 1.0 as duration from {_OLD} o where id % 10 = 0 and name is not null),
      added as (select distinct name, 30.0 as fps, 2.0 as duration from {_NEW} n where name is not null and name not in (select name from changed)),
      new as (select * from changed union all select * from added)
      select id, name, fps, duration from known where name not in (select name from new)
      union all select k.id, n.name, n.fps, n.duration from new n join known k using (name)
      union all select (select max(id) from known) + row_number() over (order by name), name, fps, duration from new where name not in (select name from known)""",
    "replace_rows": f"""select filename_id, codec, coalesce(file_size, -1) as file_size from {_LATEST} m where filename_id not in (select id from filenames where id % 3 = 0)
      union all select id, 'av1', 1 from filenames where id % 3 = 0""",
    "cascade_delete": " union all ".join(
        _left(n, c, "({c} is null or {c} not in (select id from filenames where deleted_at is not null))") for n, c in [("filenames", ["id"]), *_TABLES]
    ),
    "orphan_tidy": " union all ".join(_left(n, c, "{c} in (select id from filenames)") for n, c in _TABLES),
    "whitelist_pairs": """with l as (select p.pair_id as list, n.name from scene_pairs p join filenames n on n.id in (p.id1, p.id2) where n.name is not null),
      i as (select distinct l.list, f.id from l join filenames f using (name))
      select distinct a.id as id1, b.id as id2 from i a join i b on a.list = b.list and a.id < b.id
      where not exists (select 1 from whitelist w where least(w.id1, w.id2) = a.id and greatest(w.id1, w.id2) = b.id and w.id2 is not null)""",
    "purge_counts": "select count(*) filter (name not in (select name from filenames where deleted_at is null and name is not null)) as to_delete, count(*) as files from filenames where name is not null",
    "delete_media": "select distinct filename_id from media_info where filename_id is not null and filename_id not in (select id from filenames where deleted_at is not null)",
}
