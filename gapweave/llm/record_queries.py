"""Queries on surviving records and linked groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm.components import group_labels
from gapweave.llm.survivors import Bundle, build_survivors, choose_bundles
from gapweave.runtime import table

#: Codecs that say nothing.
PLACEHOLDERS = ["", "unknown", "n/a", "none"]
NUMBERS = ["width", "height", "file_size"]
#: The table of probers is small and fixed; beyond this many bytes its join is left to the optimiser.
SMALL_TABLE = 10_000_000


def plain_codec() -> Column:
    return F.lower(F.regexp_replace("codec", r"^[\s ]+|[\s ]+$", ""))


def usable_codec() -> Column:
    return F.col("codec").isNotNull() & ~plain_codec().isin(PLACEHOLDERS)


def rated_probes(spark: SparkSession, d: str) -> DataFrame:
    """media_info with the trust of its prober, 0 where the prober is unknown."""
    trust = table(spark, d, "probers").where("prober is not null").groupBy("prober").agg(F.max("trust").alias("trust"))
    return table(spark, d, "media_info").join(trust, "prober", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The probe that supplies each field.

    The definition lets every field choose for itself. Each is then a bundle that no dependency ties to another, so
    the bound at the root of the search is reached by the best value of each, and nothing is left to branch on.
    ``p4_survivors`` has dependent fields and branches.
    """
    bundles = [Bundle("codec", ("codec",), (usable_codec(),)), *[Bundle(f, (f,), (F.col(f) > 0,)) for f in NUMBERS]]
    chosen = choose_bundles(rated_probes(spark, d), "filename_id", "probe_id", "trust", "probed_at", bundles)
    return chosen.select("filename_id", F.col("bundle").alias("field_name"), "probe_id")


def consistent_bundles() -> list[Bundle]:
    """Codec and container go together, width and height come from one probe, the size stands alone."""
    return [
        Bundle("codec", ("codec",), (usable_codec(),)),
        Bundle("extension", ("extension",), (F.trim("extension") != "",)),
        Bundle("resolution", ("width", "height"), (F.col("width") > 0, F.col("height") > 0)),
        Bundle("file_size", ("file_size",), (F.col("file_size") > 0,)),
    ]


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One built record per file; what no probe supplies is -1 or empty."""
    probes, bundles = rated_probes(spark, d).withColumn("codec", plain_codec()), consistent_bundles()
    chosen = choose_bundles(probes, "filename_id", "probe_id", "trust", "probed_at", bundles, [("codec", "extension")])
    built = build_survivors(probes, chosen, "filename_id", "probe_id", bundles)
    return built.fillna(-1, NUMBERS).fillna("", ["codec", "extension"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "filenames").where("id is not null").select("id").distinct()
    pairs = table(spark, d, "scene_pairs").where("id1 <> id2").select("id1", "id2").distinct()
    pairs = pairs.join(known.withColumnRenamed("id", "id1"), "id1", "left_semi").join(known.withColumnRenamed("id", "id2"), "id2", "left_semi")
    return group_labels(pairs, "id1", "id2").select(F.col("node").alias("filename_id"), F.col("label").alias("group_id"))


_FIELD = """
  select filename_id, '{f}' as field_name, probe_id,
    row_number() over (partition by filename_id order by trust desc, probed_at desc nulls last, probe_id desc) as rn
  from rated where {ok}"""
_RANK = "{'t': trust, 'r': coalesce(probed_at, timestamp '0001-01-01'), 'id': probe_id}"
_BEST = "select filename_id, arg_max({{{values}}}, {rank}) as x from rated where {ok} group by 1"
ORACLES = {
    "p4_survivors": f"""with rated as (select m.filename_id, m.probe_id, m.probed_at, coalesce(p.trust, 0) as trust, m.width, m.height, m.file_size,
        case when lower(trim(m.codec)) not in ('', 'unknown', 'n/a', 'none') then lower(trim(m.codec)) end as codec, case when trim(m.extension) <> '' then m.extension end as extension
        from media_info m left join probers p on m.prober = p.prober
        where m.filename_id in (select filename_id from media_info where filename_id is not null group by 1 having count(distinct probe_id) >= 2)),
      cv as (select filename_id, codec, max({_RANK}) as rc from rated where codec is not null group by 1, 2),
      ev as (select filename_id, extension, max({_RANK}) as re from rated where extension is not null group by 1, 2),
      ce as (select distinct filename_id, codec, extension from rated where codec is not null and extension is not null),
      options as (select cv.filename_id, cv.codec, ce.extension, rc, re, rc.t + coalesce(re.t, 0) as s from cv left join ce using (filename_id, codec) left join ev on ev.filename_id = cv.filename_id and ev.extension = ce.extension
        union all select filename_id, null, extension, null, re, re.t from ev where filename_id not in (select filename_id from cv)),
      pick as (select filename_id, codec, extension from (select *, row_number() over (partition by filename_id order by s desc, rc desc nulls last, re desc nulls last) as i from options) o where i = 1),
      size as ({_BEST.format(values="'w': width, 'h': height", rank=_RANK, ok="width > 0 and height > 0")}),
      bytes as ({_BEST.format(values="'b': file_size", rank=_RANK, ok="file_size > 0")}),
      ids as (select filename_id from pick union select filename_id from size union select filename_id from bytes)
      select i.filename_id, coalesce(p.codec, '') as codec, coalesce(p.extension, '') as extension, coalesce(s.x.w, -1) as width, coalesce(s.x.h, -1) as height, coalesce(b.x.b, -1) as file_size
      from ids i left join pick p using (filename_id) left join size s using (filename_id) left join bytes b using (filename_id)""",
    "p4_found": "with rated as (select m.*, coalesce(p.trust, 0) as trust from media_info m left join probers p on m.prober = p.prober where m.filename_id in (select filename_id from media_info where filename_id is not null group by 1 having count(distinct probe_id) >= 2)) select filename_id, field_name, probe_id from ("
    + " union all ".join(_FIELD.format(f=f, ok=f"{f} > 0") for f in NUMBERS)
    + " union all "
    + _FIELD.format(f="codec", ok="codec is not null and lower(trim(codec)) not in ('', 'unknown', 'n/a', 'none')")
    + ") x where rn = 1",
    "p6_found": """with recursive links as (
        select id1 as a, id2 as b from scene_pairs where id1 <> id2 and id1 in (select id from filenames) and id2 in (select id from filenames)
        union select id2, id1 from scene_pairs where id1 <> id2 and id1 in (select id from filenames) and id2 in (select id from filenames)),
      reach as (select a as node, a as seen from links union select r.node, l.b from reach r join links l on r.seen = l.a)
      select node as filename_id, min(seen) as group_id from reach group by node""",
}
QUERIES = {"p4_found": p4_found, "p4_survivors": p4_survivors, "p6_found": p6_found}
