"""Fixed-length windows over ordered values, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.operators.signal import fits_one_chunk
from gapweave.runtime import materialize, release

#: Frames per chunk. A group has at most one row per frame, so a chunk has at most so many rows.
CHUNK = 1 << 18


def sliding(df: DataFrame, group: str, order: str, value: str, length: int, spare: int = 0, chunk: int = CHUNK, fits: bool | None = None) -> DataFrame:
    """Windows of ``length`` successive values of a group: (group, order of the first value, values).

    ``spare`` more values must follow a window, so a group of n values gives n - length + 1 - spare
    windows. With ``spare`` 1 the last possible window is not made.

    Rows with a null group, order or value are left out first; a repeated (group, order) counts once, with
    its least value. ``order`` must be of an integer type. A group is worked on in chunks of ``chunk``
    successive order values, each of bounded size, so one group may hold any share of the rows. Only the
    last rows of a chunk need others: they meet the first rows of the next chunks in a second, small pass, which is
    left out where all order values lie in one chunk; ``fits`` tells that, if it is known.
    """
    if length < 1 or spare < 0:
        raise ValueError("length must be 1 or more and spare 0 or more")
    ahead = length - 1 + spare
    rows = df.where(F.col(group).isNotNull() & F.col(order).isNotNull() & F.col(value).isNotNull()).select(
        F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(value).alias("_v"), F.floor(F.col(order) / F.lit(chunk)).cast("long").alias("_c")
    )
    rows = rows.repartition("_g", "_c").groupBy("_g", "_c", "_o").agg(F.min("_v").alias("_v"))
    w = Window.partitionBy("_g", "_c").orderBy("_o")
    if not ahead:
        return rows.select(F.col("_g").alias(group), F.col("_o").alias(order), F.array("_v").alias("values"))
    following: list[Column] = [F.lead("_v", j).over(w).alias(f"_v{j}") for j in range(1, ahead + 1)]
    chunked = rows.select("_g", "_c", "_o", "_v", *following, F.row_number().over(w).alias("_i"))
    values = F.array("_v", *[f"_v{j}" for j in range(1, length)])
    inner = chunked.where(F.col(f"_v{ahead}").isNotNull()).select(F.col("_g").alias(group), F.col("_o").alias(order), values.alias("values"))
    if fits_one_chunk(df.where(F.col(order).isNotNull()), order, chunk) if fits is None else fits:
        return inner
    # Ends of chunks: rows without enough followers, and first rows that may follow them.
    many = rows.groupBy("_g").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo < _hi").select("_g")
    ends = chunked.where(F.col(f"_v{ahead}").isNull() | (F.col("_i") <= ahead)).join(many, "_g", "left_semi")
    across = Window.partitionBy("_g").orderBy("_o")
    stitched = ends.select(
        "_g", "_o", "_v", F.col(f"_v{ahead}").isNull().alias("_tail"), *[F.lead("_v", j).over(across).alias(f"_v{j}") for j in range(1, ahead + 1)]
    ).where(F.col("_tail") & F.col(f"_v{ahead}").isNotNull())
    return inner.unionByName(stitched.select(F.col("_g").alias(group), F.col("_o").alias(order), values.alias("values")))


def playable_range(gaps: DataFrame, files: DataFrame, key: str, frame: str, ignore_start: float = 0.0, ignore_end: float = 0.0) -> DataFrame:
    """Gaps whose frame lies in the part of the file that is not ignored, both ends included.

    ``files`` has columns ``key``, fps and duration. Bounds are cut to whole frames towards zero. A gap keeps
    its length although the peak before it may be left out. A file of unknown duration has no upper bound, one
    of unknown fps no bound at all; gaps without a row in ``files`` are left out.
    """
    low = (F.lit(float(ignore_start)) * F.col("fps")).cast("bigint")
    high = ((F.col("duration") - F.lit(float(ignore_end))) * F.col("fps")).cast("bigint")
    bounds = files.select(key, low.alias("_low"), high.alias("_high"))
    after = F.col("_low").isNull() | (F.col(frame) >= F.col("_low"))
    before = F.col("_high").isNull() | (F.col(frame) <= F.col("_high"))
    return gaps.join(bounds, key).where(F.col(frame).isNotNull() & after & before).drop("_low", "_high")


def long_enough(gaps: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Gaps of groups with ``least`` rows or more."""
    counted = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
    return gaps.join(counted, key, "left_semi")


#: Windows up to so many values are truncated in generated code.
UNROLLED = 16


def truncate_scene(values: str, seconds: float, length: int | None = None) -> Column:
    """Window values with each set to 0 once those before it sum to more than ``seconds``.

    If ``length`` is given, all windows have so many values.
    """
    if length is not None and length <= UNROLLED:
        terms, before = [F.get(values, F.lit(i)) for i in range(length)], F.lit(0.0)
        kept = []
        for x in terms:
            kept.append(F.when(before > F.lit(float(seconds)), F.lit(0.0)).otherwise(x))
            before = before + x
        return F.array(*kept)

    def keep(x: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(F.col(values), F.lit(1), i), F.lit(0.0), lambda a, v: a + v)
        return F.when(before > F.lit(float(seconds)), F.lit(0.0)).otherwise(x)

    return F.transform(values, keep)


def normalise_speed(values: str) -> Column:
    """Window values times 128 over their mean; unchanged if the mean is 0."""
    mean = F.aggregate(F.col(values), F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return F.when(mean == 0, F.col(values)).otherwise(F.transform(values, lambda v: F.lit(128.0) * v / mean))


def window_stats(values: str) -> list[Column]:
    """Length, sum and mean of a window."""
    total = F.aggregate(F.col(values), F.lit(0.0), lambda a, v: a + v)
    return [F.size(values).alias("length"), total.alias("total"), (total / F.greatest(F.size(values), F.lit(1))).alias("mean")]


def number_items(df: DataFrame, order: list[str], name: str = "item") -> DataFrame:
    """Number all rows from 0 in the order of the columns, without bringing them together.

    Rows are range-partitioned and sorted, written with their place in the partition, and moved by the
    number of rows in the partitions before, of which there is one row each.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = sorted_.withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed.select("*", F.shiftright("_id", 33).alias("_part")), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + local).drop("_part", "_id", "_before")


def hash_windows(gaps: DataFrame, key: str, frame: str, hash_: str, length: int = 12, scene_seconds: float | None = 300.0, least: int = 5) -> DataFrame:
    """Numbered windows for the radius join: (item, key, frame, values).

    Groups with fewer than ``least`` gaps have none, and the last possible window of a group is not made.
    Values after ``scene_seconds`` are set to 0. Items are numbered by key and frame.
    """
    # Several passes follow (sizes, chunks, the sample for numbering), so the gaps are formed once.
    known = materialize(gaps.where(F.col(frame).isNotNull() & F.col(hash_).isNotNull()).select(key, frame, hash_), "gaps")
    rows = sliding(long_enough(known, key, least), key, frame, hash_, length, spare=1, fits=fits_one_chunk(known, frame, CHUNK))
    if scene_seconds is not None:
        rows = rows.withColumn("values", truncate_scene("values", scene_seconds, length))
    # Numbering takes a sample first, for which the windows would be formed a second time.
    formed = materialize(rows, "windows")
    out = number_items(formed, [key, frame]).select("item", key, frame, "values")
    release(gaps.sparkSession, known, formed)
    return out
