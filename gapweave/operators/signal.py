"""Peaks of value series and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Frames worked on together; a series is cut into chunks of so many, so one may hold any share of the rows.
CHUNK = 1 << 18


def numbered(df: DataFrame, group: str, order: list[str], name: str = "frame") -> DataFrame:
    """Each row's place within its group, from 0, in the order of the columns ``order``."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("int"))


def fits_one_chunk(df: DataFrame, order: str, chunk: int = CHUNK) -> bool:
    """Whether all order values lie in one chunk, so that every group is small enough to be sorted as a whole.

    This reads one column, once; it saves the pass that matches the ends of chunks.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    return low is None or low // chunk == high // chunk


def with_neighbours(df: DataFrame, group: str, order: str, columns: list[str], chunk: int | None = CHUNK) -> DataFrame:
    """Add ``prev_x`` and ``next_x`` for each named column: its value in the row before and after, in the group.

    Both are null at the ends of a group. A group is sorted in chunks of the order column; only the first and
    last rows of chunks are matched across chunks. With ``chunk`` None every group is sorted as a whole.
    (group, order) must be unique and not null.
    """
    if chunk is None:
        w = Window.partitionBy(group).orderBy(order)
        return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns], *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    w = Window.partitionBy(group, "_chunk").orderBy(order)
    cut = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    near = cut.select(
        "*",
        *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns],
        *[F.lead(c).over(w).alias(f"next_{c}") for c in columns],
        (F.lag(F.lit(True), 1, False).over(w)).alias("_has_prev"),
        (F.lead(F.lit(True), 1, False).over(w)).alias("_has_next"),
    )
    inner = near.where("_has_prev and _has_next")
    across = Window.partitionBy(group).orderBy(order)
    edge = near.where("not (_has_prev and _has_next)").select(
        *df.columns, "_chunk", "_has_prev", "_has_next",
        *[F.when(F.col("_has_prev"), F.col(f"prev_{c}")).otherwise(F.lag(c).over(across)).alias(f"prev_{c}") for c in columns],
        *[F.when(F.col("_has_next"), F.col(f"next_{c}")).otherwise(F.lead(c).over(across)).alias(f"next_{c}") for c in columns],
    )
    return inner.unionByName(edge).drop("_chunk", "_has_prev", "_has_next")


def peak_order(min_seconds: float, fps: Column) -> Column:
    """Frames to either side in which a peak must not be exceeded: ``min_seconds`` in whole frames."""
    return (F.lit(float(min_seconds)) * fps).cast("long")


def moving_maximum(df: DataFrame, group: str, frame: str, value: str, order: Column, name: str = "window_max", chunk: int | None = CHUNK) -> DataFrame:
    """Add the greatest value at most ``order`` frames away, ``order`` being constant within a group and 1 or more.

    Frames are whole numbers without gaps, so that frames and rows count alike.
    """
    own = df.withColumn("_order", order)
    if chunk is None:
        own = own.withColumn("_scaled", F.col(frame).cast("double") / F.col("_order"))
        high = f"max(`{value}`) over (partition by `{group}` order by _scaled range between 1.0000001D preceding and 1.0000001D following)"
        return own.withColumn(name, F.expr(high)).drop("_order", "_scaled")
    own = own.withColumn("_chunk", F.floor(F.col(frame) / F.lit(chunk)))
    first = F.floor((F.col(frame) - F.col("_order")) / F.lit(chunk))
    last = F.floor((F.col(frame) + F.col("_order")) / F.lit(chunk))
    spread = own.withColumn("_at", F.explode(F.sequence(first, last)))
    # In units of the order the frame is one step to either side, whatever the group's order; the excess
    # lies far below one frame and far above rounding.
    spread = spread.withColumn("_scaled", F.col(frame).cast("double") / F.col("_order"))
    high = f"max(`{value}`) over (partition by `{group}`, _at order by _scaled range between 1.0000001D preceding and 1.0000001D following)"
    return spread.withColumn(name, F.expr(high)).where("_at = _chunk").drop("_at", "_chunk", "_order", "_scaled")


def peaks(df: DataFrame, group: str, frame: str, value: str, min_seconds: float, fps: Column, chunk: int = CHUNK) -> DataFrame:
    """Local maxima of each series with the gap to the one before: (group, frame, hash).

    A peak is a run of equal values above both neighbouring runs; it stands at the middle of the run,
    rounded down, and a run at either end of the series is none. It counts only if nothing within
    ``min_seconds`` to either side is higher; equally high peaks are all kept. ``hash`` is the time in seconds
    since the previous peak, or since frame 0.

    ``frame`` counts the rows of a series from 0 without gaps. Defined cases: rows with a null group, frame
    or value are left out; series that are constant or below three values have no peaks; series for which
    ``min_seconds`` is less than one frame, or whose fps is null or not above 0, have none either.
    """
    rows = df.select(F.col(group).alias("g"), F.col(frame).cast("long").alias("f"), F.col(value).alias("v"), fps.alias("fps"))
    rows = rows.where("g is not null and f is not null and v is not null and fps > 0").where(peak_order(min_seconds, F.col("fps")) >= 1)
    if fits_one_chunk(rows, "f", chunk):
        return _bounded_peaks(rows, min_seconds).select(F.col("g").alias(group), F.col("f").cast("int").alias(frame), "hash")
    near = with_neighbours(rows, "g", "f", ["v"], chunk)
    starts = near.where("prev_v is null or prev_v <> v").drop("prev_v", "next_v")
    runs = with_neighbours(starts, "g", "f", ["f", "v"], chunk)
    tops = runs.where("prev_v < v and next_v < v").select("g", F.floor((F.col("f") + F.col("next_f") - 1) / 2).cast("long").alias("f"))
    high = moving_maximum(rows, "g", "f", "v", peak_order(min_seconds, F.col("fps")), chunk=chunk).where("v = window_max")
    kept = high.join(tops, ["g", "f"]).select("g", "f", "fps")
    gaps = with_neighbours(kept, "g", "f", ["f"], chunk)
    return gaps.select(
        F.col("g").alias(group), F.col("f").cast("int").alias(frame), ((F.col("f") - F.coalesce("prev_f", F.lit(0))) / F.col("fps")).alias("hash")
    )


def ordered_peaks(df: DataFrame, group: str, order: list[str], value: str, min_seconds: float, fps: float, frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """``peaks`` of series whose frames are their rows in the order of the columns ``order``, at one known rate: (group, frame, hash).

    The rows of a series that fits one chunk are numbered, compared and bounded in one sorting; a second one goes backwards.
    Rows with a null group or value are left out and get no number.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    reach = int(float(min_seconds) * fps) if fps > 0 else 0
    longest = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if reach < 1 or longest > chunk:
        return peaks(numbered(rows, group, order, frame), group, frame, value, min_seconds, F.lit(fps), chunk)
    keys = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    w = Window.partitionBy("g").orderBy(*[f"o{i}" for i in range(len(order))])
    # Frames are the rows themselves, so the nearest frames are the nearest rows.
    near = rows.select(F.col(group).alias("g"), F.col(value).alias("v"), *keys).select(
        "*", (F.row_number().over(w) - 1).cast("long").alias("f"), F.lag("v").over(w).alias("prev_v"), F.max("v").over(w.rowsBetween(-reach, reach)).alias("window_max")
    )
    starts = near.withColumns({"fps": F.lit(float(fps)), "start": F.col("prev_v").isNull() | (F.col("prev_v") != F.col("v"))})
    return _peaks_of_runs(starts, w).select(F.col("g").alias(group), F.col("f").cast("int").alias(frame), "hash")


def _bounded_peaks(rows: DataFrame, min_seconds: float) -> DataFrame:
    """``peaks`` of series that are each sorted as a whole: all windows share one partitioning, so one shuffle does."""
    starts = with_neighbours(rows, "g", "f", ["v"], None).withColumn("start", F.col("prev_v").isNull() | (F.col("prev_v") != F.col("v")))
    high = moving_maximum(starts.drop("next_v"), "g", "f", "v", peak_order(min_seconds, F.col("fps")), chunk=None)
    return _peaks_of_runs(high, Window.partitionBy("g").orderBy("f"))


def _peaks_of_runs(high: DataFrame, w: WindowSpec) -> DataFrame:
    """Peaks (g, f, hash) of rows (g, f, v, fps, prev_v, start, window_max), ``start`` telling the first rows of runs; ``w`` sorts a series by f."""
    # Each row gets the start of its run and the values of the runs before and after.
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, so that the frame grows row by row instead of being formed anew for each.
    ahead = Window.partitionBy("g").orderBy(F.col("f").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marked = high.select(
        "g", "f", "v", "fps", "window_max",
        F.last(F.when(F.col("start"), F.struct("f", F.col("prev_v").alias("before"))), True).over(run).alias("own"),
        F.last(F.when(F.col("start"), F.struct("f", "v")), True).over(ahead).alias("next"),
    )
    tops = marked.where("own.before < v and next.v < v and v = window_max and f = floor((own.f + next.f - 1) / 2)")
    return with_neighbours(tops.select("g", "f", "fps"), "g", "f", ["f"], None).select(
        "g", "f", ((F.col("f") - F.coalesce("prev_f", F.lit(0))) / F.col("fps")).alias("hash")
    )


def peak_counts(found: DataFrame, group: str) -> DataFrame:
    """How many peaks each series has."""
    return found.groupBy(group).agg(F.count(F.lit(1)).alias("peaks"))


def frame_means(frames: DataFrame, group: str, frame: str, pixels: str) -> DataFrame:
    """The mean of all bytes of each frame: (group, frame, value)."""
    total = F.aggregate(F.col(pixels), F.lit(0.0), lambda a, x: a + x)
    return frames.where(F.size(pixels) > 0).select(group, frame, (total / F.size(pixels)).alias("value"))
