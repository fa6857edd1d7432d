"""Queries on near-duplicate signals and repeated files."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm.history import HistoryIndex, integer_token, repeats_between_batches, same_path, whole_seconds
from gapweave.llm.setsketch import near_duplicates
from gapweave.operators.skew import many_join
from gapweave.operators.windows import sliding
from gapweave.runtime import materialize, release, shared_dir, table

MIN_SERIES, MIN_RATIO = 20, 0.9


def latest_series(spark: SparkSession, d: str) -> DataFrame:
    """Each existing file of known duration with its latest brightness series of 20 values or more."""
    files = table(spark, d, "filenames").where("id is not null and duration > 0 and not isnan(duration)")
    files = files.groupBy(F.col("id").alias("filename_id")).agg(F.max("duration").alias("duration"))
    rows = table(spark, d, "brightness").where("filename_id is not null")
    last = rows.groupBy("filename_id").agg(F.max(F.struct("loaded_at", "brightness")).alias("last"))
    series = last.select("filename_id", F.col("last.brightness").alias("brightness")).where(F.size("brightness") >= MIN_SERIES)
    return series.join(files, "filename_id")


def close_durations(pairs: DataFrame, members: DataFrame, ratio: float) -> DataFrame:
    """Pairs of members of paired classes whose durations are within ``ratio``.

    Members meet by class and by step of a logarithmic scale on which close durations are at most one step
    apart, so members far apart in duration never meet. An infinite duration is near itself only.
    """
    step = F.floor(F.log("duration") / F.lit(-math.log(ratio))).cast("long")
    m = members.withColumn("step", F.when(F.col("duration") < float("inf"), step).otherwise(1 << 40))
    left = m.select(F.col("class").alias("a"), F.col("filename_id").alias("p"), F.col("duration").alias("dp"), F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    right = m.select(F.col("class").alias("b"), F.col("filename_id").alias("q"), F.col("duration").alias("dq"), "step")
    met = many_join(materialize(pairs.join(left, "a"), "class-pairs"), right, ["b", "step"]).where((F.col("a") != F.col("b")) | (F.col("p") < F.col("q")))
    met = met.where(F.least("dp", "dq") >= F.lit(ratio) * F.greatest("dp", "dq"))
    return met.select(F.least("p", "q").alias("filename_id1"), F.greatest("p", "q").alias("filename_id2"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    series = materialize(latest_series(spark, d), "series")
    members, pairs = near_duplicates(series, "filename_id", "brightness")
    members = materialize(members.join(series.select("filename_id", "duration"), "filename_id"), "members")
    same = members.select(F.col("class").alias("a"), F.col("class").alias("b")).groupBy("a", "b").count().where("count > 1").select("a", "b")
    return close_durations(pairs.unionByName(same), members, MIN_RATIO)


MIN_GAPS, GAP_RUN = 12, 3


def usable(gap: Column) -> Column:
    """A gap that is a finite number. Others keep their place in a sequence, but nothing is told about them."""
    return ~F.isnan(gap) & (F.abs(gap) < float("inf"))


def gap_tokens(spark: SparkSession, d: str) -> DataFrame:
    """(set, token): the different runs of three gaps in whole seconds of each file with 12 gaps or more.

    A gap that is NaN or infinite is unknown: it counts as a gap and parts its neighbours, and runs that hold it
    are left out.
    """
    runs = sliding(table(spark, d, "hashes"), "filename_id", "frame", "hash", GAP_RUN)
    gaps = [F.col("values")[i] for i in range(GAP_RUN)]
    token = F.when(usable(gaps[0]) & usable(gaps[1]) & usable(gaps[2]), integer_token([whole_seconds(g) for g in gaps]))
    counted = runs.select(F.col("filename_id").alias("set"), token.alias("token")).groupBy("set", "token").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "gap-tokens")
    # Short sets are the fewer, so that mostly these are sent to the tokens and not both shuffled.
    short = materialize(counted.groupBy("set").agg(F.sum("n").alias("n")).where(F.col("n") < MIN_GAPS - GAP_RUN + 1).select("set"), "short-sets")
    release(spark)
    tokens = materialize(counted.where("token is not null and set is not null").join(short, "set", "left_anti").select("set", "token"), "tokens")
    release(spark, counted, short)
    return tokens


#: Tokens that a folder of the index should hold about.
BUCKET_ROWS = 1_000_000


def history(spark: SparkSession, rows: int) -> HistoryIndex:
    """A new index in the shared folder, cut into folders for so many tokens."""
    return HistoryIndex(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex[:10]}", buckets=8 + rows // BUCKET_ROWS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Through the index: each batch, or a round of small ones, is probed against all before it, then appended."""
    files = table(spark, d, "filenames").select("id", "name", "batch_no")
    by_name = same_path(files, "id", "name", "batch_no")
    batches = files.where("id is not null").groupBy(F.col("id").alias("set")).agg(F.min("batch_no").alias("batch"))
    tokens = gap_tokens(spark, d)
    by_gaps = repeats_between_batches(tokens, batches, history(spark, tokens.count()), spend=True)
    found = by_name.unionByName(by_gaps).distinct()
    return found.select(F.col("first").alias("filename_id1"), F.col("second").alias("filename_id2"))


def p2_last_batch(spark: SparkSession, d: str) -> DataFrame:
    """The gap sequences of the last batch against an index of all batches before it, which is built first."""
    files = table(spark, d, "filenames").where("id is not null and batch_no is not null").select(F.col("id").alias("set"), "batch_no")
    last = files.agg(F.max("batch_no")).first()[0]
    tokens = gap_tokens(spark, d)
    sized = tokens.join(tokens.groupBy("set").agg(F.count(F.lit(1)).alias("size")), "set").join(files, "set")
    sized = materialize(sized.select("set", "size", "token", (F.col("batch_no") == F.lit(last)).cast("int").alias("last")), "sized-tokens", by="last")
    index = history(spark, sized.count())
    index.create(sized.where("last = 0").drop("last"))
    batch = index.prepare(sized.where("last = 1").drop("last"))
    found = index.set_pairs(index.probe(batch), batch)
    return found.select(F.col("accepted").alias("filename_id1"), F.col("new").alias("filename_id2"))


def p2_nightly(spark: SparkSession, d: str) -> DataFrame:
    """All that the files of the last batch repeat, by gap sequence or by name."""
    files = table(spark, d, "filenames").select("id", "name", "batch_no")
    last = files.agg(F.max("batch_no")).first()[0]
    names = files.withColumn("late", (F.col("batch_no") == F.lit(last)).cast("int"))
    by_name = same_path(names, "id", "name", "late").select(F.col("first").alias("filename_id1"), F.col("second").alias("filename_id2"))
    return by_name.unionByName(p2_last_batch(spark, d)).distinct()


_PATHS = r"""(select id, batch_no, case when x like '/%' then '/' else '' end || array_to_string(list_filter(string_split(x, '/'), lambda s: s <> '' and s <> '.'), '/') as k
  from (select id, batch_no, lower(nfc_normalize(replace(trim(name, ' ' || chr(9)), chr(92), '/'))) as x from filenames where name is not null) y)"""
_NAMES = f"select a.id as filename_id1, b.id as filename_id2 from {_PATHS} a join {_PATHS} b on a.k = b.k and a.batch_no < b.batch_no"
_GAPS = """
  select x.id as filename_id1, y.id as filename_id2 from filenames x join (
    with g as (select filename_id as id, frame, cast(floor(min(hash)) as bigint) as s from hashes
        where filename_id is not null and frame is not null and hash is not null group by 1, 2),
      w as (select id, s, lead(s) over o as s2, lead(s, 2) over o as s3, count(*) over (partition by id) as n from g window o as (partition by id order by frame)),
      r as (select distinct id, s, s2, s3 from w where s3 is not null and n >= 12),
      n as (select id, count(*) as n from r group by id),
      c as (select a.id as i1, b.id as i2, count(*) as c from r a join r b on a.s = b.s and a.s2 = b.s2 and a.s3 = b.s3 and a.id <> b.id group by 1, 2)
    select i1, i2 from c join n p on p.id = i1 join n q on q.id = i2 where c >= 0.5 * (p.n + q.n - c)) z on x.id = z.i1
  join filenames y on y.id = z.i2 and x.batch_no < y.batch_no"""
QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_last_batch": p2_last_batch, "p2_nightly": p2_nightly}
ORACLES = {
    "p1_found": """with latest as (
        select filename_id, brightness, row_number() over (partition by filename_id order by loaded_at desc nulls last) as rn from brightness where filename_id is not null),
      s as (select l.filename_id as id, f.duration as dur, list_transform(l.brightness, lambda x: cast(floor(x) as bigint)) as v
        from latest l join filenames f on f.id = l.filename_id where rn = 1 and len(l.brightness) >= 20 and f.duration > 0 and not isnan(f.duration)),
      runs as (select distinct id, dur, unnest(list_transform(range(1, len(v) - 2), lambda i: v[i:i + 3])) as r from s),
      n as (select id, count(*) as n from runs group by id),
      both_ as (select a.id as i1, b.id as i2, count(*) as c from runs a join runs b on a.r = b.r and a.id < b.id
        and least(a.dur, b.dur) >= 0.9 * greatest(a.dur, b.dur) group by 1, 2)
      select i1 as filename_id1, i2 as filename_id2 from both_ join n x on x.id = i1 join n y on y.id = i2 where c >= 0.5 * (x.n + y.n - c)""",
    "p2_found": f"select distinct * from ({_NAMES} union all {_GAPS}) x",
    "p2_nightly": f"select distinct * from ({_NAMES} union all {_GAPS}) x where filename_id2 in (select id from filenames where batch_no = (select max(batch_no) from filenames))",
    "p2_last_batch": f"select * from ({_GAPS}) x where filename_id2 in (select id from filenames where batch_no = (select max(batch_no) from filenames))",
}
