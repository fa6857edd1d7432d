"""Groups of records that pairwise matches link, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators.skew import HEAVY_PARTS, heavy_keys, lookup_join
from gapweave.runtime import discard, materialize


#: Below this many rows a plain shuffle join does, as even one key with all of them fits a task.
SPLIT_FROM = 1_000_000


def _lookup(left: DataFrame, total: int, right: DataFrame, key: str, how: str, parts: int) -> DataFrame:
    """Join ``left``, of ``total`` rows, to a table with one row per key, with the hot keys of a large ``left`` split off."""
    if total < SPLIT_FROM:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return lookup_join(left, right, key, how, heavy_keys(counts, key, "_n", total, parts))


def group_labels(pairs: DataFrame, first: str, second: str, parts: int = HEAVY_PARTS) -> DataFrame:
    """One row (node, label) per node of a pair; the label is the smallest node linked to it, itself included.

    Each round takes the least neighbour of every node as its parent (the minimum is formed before the
    shuffle, so a hub costs no more than its distinct partners), follows parents by pointer jumping until
    none changes, and rewrites the edges between the roots. The graph loses at least one node per edge
    component each round, usually most of them, and the loop ends when no edge is left. Every round's
    tables are written to the shared folder, which cuts the lineage and survives lost executors.

    Defined cases: a null end, or a pair of a node with itself, links nothing and gives no row.
    Repeated pairs and both directions count once. No pairs give no rows. Other columns are ignored.
    """
    edges = materialize(
        pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col(first) != F.col(second)))
        .select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
        .distinct(),
        "edges",
    )
    labels, nodes = None, 0
    while links := edges.count():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = materialize(ends.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("label")), "parents")
        roots = parents.count()
        parents = _jump(parents, roots, parts)
        if labels is None:
            labels, nodes = parents, roots
        else:
            above = parents.select(F.col("node").alias("label"), F.col("label").alias("_root"))
            moved = materialize(_lookup(labels, nodes, above, "label", "left", parts).select("node", F.coalesce("_root", "label").alias("label")), "labels")
            discard(labels)
            labels = moved
        as_a = parents.select(F.col("node").alias("a"), F.col("label").alias("_a"))
        as_b = parents.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        rewritten = _lookup(_lookup(edges, links, as_a, "a", "inner", parts), links, as_b, "b", "inner", parts)
        nxt = materialize(rewritten.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        discard(edges, *([parents] if parents is not labels else []))
        edges = nxt
    discard(edges)
    if labels is None:
        kind = edges.schema["a"].dataType
        return pairs.select(F.col(first).cast(kind).alias("node"), F.col(first).cast(kind).alias("label")).where(F.lit(False))
    return labels


def _jump(parents: DataFrame, total: int, parts: int) -> DataFrame:
    """Replace each node's parent by its parent's parent until all point to roots."""
    while True:
        above = parents.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("_up"))
        jumped = materialize(_lookup(parents, total, above, "label", "left", parts), "parents")
        done = jumped.where("_up is not null").isEmpty()
        nxt = jumped.select("node", F.coalesce("_up", "label").alias("label"))
        nxt._gapweave_path = jumped._gapweave_path
        discard(parents)
        parents = nxt
        if done:
            return parents
