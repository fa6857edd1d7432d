"""References to records that do not exist: orphans per table, field and period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators.skew import HEAVY_PARTS, PIECE, heavy_keys, lookup_join, many_join
from gapweave.runtime import materialize


@dataclass(frozen=True)
class Reference:
    """A column of a table that refers to a parent id at the time another column gives."""

    table: str
    field: str
    time: str
    rows: DataFrame


def _spans(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Each parent id with its life spans reduced to one row; ``_n`` counts different spans."""
    return (
        parents.where(F.col(key).isNotNull())
        .select(F.col(key).alias("ref_id"), F.col(start).alias("_from"), F.col(end).alias("_to"))
        .groupBy("ref_id")
        .agg(
            F.min("_from").alias("_from"),
            F.min("_to").alias("_to"),
            F.count_distinct(F.struct("_from", "_to")).alias("_n"),
        )
    )


def orphan_months(
    references: Sequence[Reference], parents: DataFrame, key: str, start: str, end: str, parts: int = HEAVY_PARTS, piece: int = PIECE
) -> DataFrame:
    """References that resolve to no living parent: one row per table, field, month and id, with their number.

    A reference resolves if a parent row has its id, ``start`` is not after the reference's time, and
    ``end`` is null or after it. Columns: ref_table, ref_field, ref_month (``YYYY-MM``), ref_id,
    orphan_refs.

    Rows are counted per key and month before any other shuffle, with the first and last time, which
    decides nearly all months of a key at once. Only months in which a parent begins or ends are
    looked at row by row, to count. Keys with over 1 / ``parts`` of all references meet a broadcast (fewer than
    ``parts`` ids) and the others a shuffle join; row by row, a key with more than ``piece`` different times is cut
    into pieces. The counts of heavy and other keys are united.

    Defined cases: a null id is no reference. A reference without a time never resolves and has a null
    month. A parent without a start never resolves anything. Parent rows that repeat count once; ids
    with several different life spans are checked row by row. Empty tables give an empty result.
    Columns other than those named are ignored, so clashing names do no harm.
    """
    rows = None
    for r in references:
        part = r.rows.select(
            F.lit(r.table).alias("ref_table"),
            F.lit(r.field).alias("ref_field"),
            F.col(r.field).cast("long").alias("ref_id"),
            F.col(r.time).alias("_time"),
        ).where("ref_id is not null")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("ref_month", F.date_format("_time", "yyyy-MM"))
    group = ["ref_table", "ref_field", "ref_month", "ref_id"]
    months = materialize(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_refs"), F.min("_time").alias("_first"), F.max("_time").alias("_last")),
        "reference-months",
    )
    total = months.agg(F.sum("_refs")).first()[0] or 0
    heavy = heavy_keys(months, "ref_id", "_refs", total, parts)
    spans = _spans(parents, key, start, end)
    judged = lookup_join(months, spans, "ref_id", "left", heavy).withColumn(
        "_state",
        F.when(F.col("_n").isNull() | F.col("_first").isNull() | ((F.col("_n") == 1) & F.col("_from").isNull()), "all")
        .when(F.col("_n") > 1, "mixed")
        .when((F.col("_last") < F.col("_from")) | (F.col("_first") >= F.col("_to")), "all")
        .when((F.col("_first") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_last") < F.col("_to"))), "none")
        .otherwise("mixed"),
    )
    judged = materialize(judged.where("_state <> 'none'").select(*group, "_refs", "_state"), "reference-states")
    whole = judged.where("_state = 'all'").select(*group, F.col("_refs").alias("orphan_refs"))
    mixed = judged.where("_state = 'mixed'").select(*group)
    if mixed.isEmpty():
        return whole
    # Row by row only here; times are counted first, so a hot key costs one row per time and its copies nothing.
    times = materialize(
        rows.join(mixed, group, "left_semi").groupBy(*group, "_time").agg(F.count(F.lit(1)).alias("_refs")), "reference-times"
    )
    lives = parents.where(F.col(key).isNotNull()).select(
        F.col(key).alias("ref_id"), F.col(start).alias("_from"), F.col(end).alias("_to")
    ).distinct()
    alive = (
        many_join(times, lives, ["ref_id"], piece)
        .where((F.col("_from") <= F.col("_time")) & (F.col("_to").isNull() | (F.col("_to") > F.col("_time"))))
        .select(*group, "_time")
        .distinct()
    )
    rest = times.join(alive, [*group, "_time"], "left_anti").groupBy(*group).agg(F.sum("_refs").alias("orphan_refs"))
    return whole.unionByName(rest)
