"""Joins and layouts that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.runtime import materialize

#: A key with more than 1 / HEAVY_PARTS of all rows is heavy, so there are at most HEAVY_PARTS of them.
HEAVY_PARTS = 2000


def heavy_keys(counts: DataFrame, key: str, weight: str, total: int, parts: int = HEAVY_PARTS) -> DataFrame:
    """Keys that weigh over ``total / parts``; fewer than ``parts`` rows, so they may be broadcast.

    ``counts`` may hold a key in several rows. A null key is never heavy.
    """
    least = max(1.0, total / parts)
    return counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(weight).alias("_w")).where(F.col("_w") > least).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str, heavy: DataFrame) -> DataFrame:
    """``left`` joined on ``key`` to ``right``, in which a key occurs once, without shuffling the heavy keys of ``left``.

    Rows of heavy keys meet a broadcast of the heavy part of ``right`` (bounded by the bound on
    ``heavy``); all others meet the rest in a shuffle join. ``how`` is inner, left, left_semi or
    left_anti; a null key matches nothing.
    """
    marked = left.join(F.broadcast(heavy.select(F.col(key), F.lit(True).alias("_heavy"))), key, "left")
    hot = marked.where("_heavy").drop("_heavy")
    cold = marked.where("_heavy is null").drop("_heavy")
    hot_right = right.join(F.broadcast(heavy), key, "left_semi")
    return hot.join(F.broadcast(hot_right), key, how).unionByName(cold.join(right, key, how))


#: Rows of one key that a task of ``many_join`` takes from either side, unless a 2000th of the table is more.
PIECE = 10_000


def many_join(left: DataFrame, right: DataFrame, keys: list[str], piece: int = PIECE, parts: int = HEAVY_PARTS) -> DataFrame:
    """Inner join of two tables in which a key may repeat on both sides, with hot keys cut into pieces.

    The rows of each key are counted on both sides first. A key with over ``piece`` rows on a side (or a
    ``parts``-th of that table, if that is more, so that at most 2 x ``parts`` keys are hot and may be broadcast)
    is cut there into pieces of about that size, by a hash of the row, and each two pieces meet in a place of
    their own. All other keys are joined as they are. Null keys match nothing. Rows that are alike in all columns
    stay together, so repeated rows should be counted before. Columns other than the keys must differ by name.
    """
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(*keys, one.alias("_l"), no.alias("_r")).unionByName(right.select(*keys, no.alias("_l"), one.alias("_r")))
    counts = both.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    hot = materialize(counts.where((F.col("_l") > piece) | (F.col("_r") > piece)), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys)
    total = hot.agg(F.sum("_l"), F.sum("_r")).first()
    hot = hot.select(*keys, *[F.ceil(F.greatest(F.lit(1), F.col(c)) / F.lit(max(piece, t // parts))).cast("int").alias(c) for c, t in zip(("_l", "_r"), total, strict=True)])
    hot = hot.where("_l > 1 or _r > 1")
    out = []
    for df, own, other in ((left, "_l", "_r"), (right, "_r", "_l")):
        marked = df.join(F.broadcast(hot), keys, "left")
        at = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(own), F.lit(1))).cast("int")
        marked = marked.withColumn(f"_at{own}", at).withColumn(f"_at{other}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        out.append(marked.drop("_l", "_r"))
    return out[0].join(out[1], [*keys, "_at_l", "_at_r"]).drop("_at_l", "_at_r")


def any_of(columns: list[Column]) -> Column:
    """True if any of the conditions holds; false for none."""
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out
