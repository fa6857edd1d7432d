"""One surviving record per duplicate group, chosen bundle by bundle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.operators.skew import any_of
from gapweave.runtime import materialize


@dataclass(frozen=True)
class Bundle:
    """Fields that must come from one record. ``usable``: conditions on the record, all of which must hold."""

    name: str
    fields: tuple[str, ...]
    usable: tuple[Column, ...] = field(default=())

    def condition(self, df: DataFrame) -> Column:
        """True for records that may supply this bundle: every field known and every condition true."""
        ok = F.lit(True)
        for f in self.fields:
            ok = ok & F.col(f).isNotNull()
        for c in self.usable:
            ok = ok & F.coalesce(c, F.lit(False))
        return ok


#: Trust is added up exactly; it counts to nine decimal places.
TRUST = "decimal(28,9)"


def _trust(value: Column) -> Column:
    return F.coalesce(value.try_cast(TRUST), F.lit(0).cast(TRUST))


def _value(b: Bundle) -> Column:
    return F.struct(*[F.col(f).alias(f"v{i}") for i, f in enumerate(b.fields)])


def choose_bundles(
    records: DataFrame,
    group: str,
    record: str,
    trust: str,
    recency: str,
    bundles: Sequence[Bundle],
    dependencies: Sequence[tuple[str, str]] = (),
    min_records: int = 2,
) -> DataFrame:
    """The record that supplies each bundle of each duplicate group: (group, bundle, record id).

    The choice maximises the trust summed over the bundles. Among equal sums an earlier bundle of the
    list gets the better record, by trust, then the later ``recency`` (null last), then the larger
    record id. ``dependencies`` are pairs (A, B) of bundle names, A before B in the list and each B in
    one pair at most: the values chosen for A and B must occur together in some record of the group,
    in which both are usable. A bundle is never left empty for the sake of others: B stays empty only
    where nothing usable agrees with A's choice, and is free where A is empty.

    The search is branch and bound, run level by level over all groups at once. The bound of a partial
    choice is its trust plus the best trust of each open bundle. A bundle without dependencies is
    settled at the root by its best value. The rest starts from a lower bound, the best single record in
    which all of them are usable; a partial choice whose bound lies below it is cut, and of partial
    choices that agree in all values later bundles depend on, only the best goes on. Records are reduced
    to their distinct values by aggregation first, so a group may hold any share of all rows and no
    group is ever gathered in one place.

    Defined cases: a null group or record id takes no part. Rows that repeat a record id count as one
    record for ``min_records``, and may each supply a value. A null trust, and one that is no finite number, counts as 0; fractions count to nine
    places. A group without a
    usable value of a bundle has no row for it. An empty table gives an empty result; other columns are
    ignored.
    """
    names = [b.name for b in bundles]
    parent = {b: a for a, b in dependencies}
    if len(parent) < len(dependencies) or any(names.index(a) >= names.index(b) for a, b in dependencies):
        raise ValueError("a bundle may depend on one earlier bundle")
    rank = F.struct(_trust(F.col(trust)).alias("t"), F.col(recency).alias("r"), F.col(record).alias("id"))
    rows = records.where(F.col(group).isNotNull() & F.col(record).isNotNull())
    free = [b for b in bundles if b.name not in parent and b.name not in parent.values()]
    tied = [b for b in bundles if b not in free]
    best = rows.groupBy(group).agg(
        F.min(record).alias("_least"), F.max(record).alias("_most"),
        *[F.max(F.when(b.condition(rows), rank)).alias(f"_best{bundles.index(b)}") for b in free],
    )
    # A count of two different ids needs no set: the least and the greatest differ.
    if min_records == 2:
        eligible = best.where("_least <> _most")
    else:
        counted = rows.select(group, record).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
        eligible = best.join(counted.where(F.col("_n") >= min_records).select(group), group)
    found = None
    if free:
        found = eligible.select(
            F.col(group), F.explode(F.array(*[F.struct(F.lit(b.name).alias("bundle"), F.col(f"_best{bundles.index(b)}.id").alias(record)) for b in free])).alias("_x")
        ).select(group, "_x.bundle", f"_x.{record}").where(F.col(record).isNotNull())
    if tied:
        searched = _search(rows.join(eligible.select(group), group, "left_semi"), group, record, rank, tied, parent)
        found = searched if found is None else found.unionByName(searched)
    return found


def _search(rows: DataFrame, group: str, record: str, rank: Column, tied: list[Bundle], parent: dict[str, str]) -> DataFrame:
    """The branch and bound over bundles that dependencies tie together."""
    at = {b.name: i for i, b in enumerate(tied)}
    slim = rows.select(
        F.col(group).alias("_g"), rank.alias("_rank"),
        *[F.when(b.condition(rows), _value(b)).alias(f"_v{i}") for i, b in enumerate(tied)],
    ).where(any_of([F.col(f"_v{i}").isNotNull() for i in range(len(tied))]))
    # Distinct value combinations with the best record that shows each.
    slim = materialize(slim.groupBy("_g", *[f"_v{i}" for i in range(len(tied))]).agg(F.max("_rank").alias("_rank")), "bundle-values")
    t = F.col("_rank.t")
    whole = F.lit(True)
    for i in range(len(tied)):
        whole = whole & F.col(f"_v{i}").isNotNull()
    one = F.coalesce(F.max(F.when(whole, t * len(tied))), F.lit(-(10**18)))
    bounds = slim.groupBy("_g").agg(
        one.alias("_low"), *[F.max(F.when(F.col(f"_v{i}").isNotNull(), t)).alias(f"_top{i}") for i in range(len(tied))]
    )
    front = bounds.withColumn("_sum", F.lit(0).cast(TRUST))
    for i, b in enumerate(tied):
        own = slim.where(F.col(f"_v{i}").isNotNull())
        if b.name in parent:
            p = at[parent[b.name]]
            pairs = own.where(F.col(f"_v{p}").isNotNull()).select("_g", f"_v{p}", f"_v{i}").distinct()
            values = own.groupBy("_g", f"_v{i}").agg(F.max("_rank").alias(f"_r{i}"))
            values = pairs.join(values, ["_g", f"_v{i}"])
            # Without a choice for the parent every usable value is open to the child.
            alone = own.groupBy("_g", f"_v{i}").agg(F.max("_rank").alias(f"_r{i}"))
            with_parent = front.where(F.col(f"_v{p}").isNotNull()).join(values, ["_g", f"_v{p}"], "left")
            without = front.where(F.col(f"_v{p}").isNull()).join(alone, "_g", "left")
            front = with_parent.unionByName(without)
        else:
            front = front.join(own.groupBy("_g", f"_v{i}").agg(F.max("_rank").alias(f"_r{i}")), "_g", "left")
        front = front.withColumn("_sum", F.col("_sum") + F.coalesce(F.col(f"_r{i}.t"), F.lit(0)))
        bound = F.col("_sum") + sum((F.coalesce(F.col(f"_top{j}"), F.lit(0)) for j in range(i + 1, len(tied))), F.lit(0))
        front = front.where(bound >= F.col("_low"))
        live = sorted({at[parent[x.name]] for x in tied[i + 1 :] if x.name in parent and at[parent[x.name]] <= i})
        done = [f"_r{j}" for j in range(i + 1)]
        keep = ["_low", "_sum", *[f"_top{j}" for j in range(len(tied))], *done]
        order = F.struct("_sum", *done)
        front = (
            front.groupBy("_g", *[f"_v{j}" for j in live])
            .agg(F.max_by(F.struct(*keep), order).alias("_x"))
            .select("_g", *[f"_v{j}" for j in live], *[F.col(f"_x.{k}").alias(k) for k in keep])
        )
    return front.select(
        F.col("_g").alias(group),
        F.explode(F.array(*[F.struct(F.lit(b.name).alias("bundle"), F.col(f"_r{i}.id").alias(record)) for i, b in enumerate(tied)])).alias("_x"),
    ).select(group, "_x.bundle", f"_x.{record}").where(F.col(record).isNotNull())


def build_survivors(records: DataFrame, chosen: DataFrame, group: str, record: str, bundles: Sequence[Bundle]) -> DataFrame:
    """One row per group with each bundle's fields, taken from the record ``chosen`` names.

    A record id that occurs in several rows supplies the greatest of its usable values. A bundle
    without a chosen record is null.
    """
    out = None
    for b in bundles:
        ids = chosen.where(F.col("bundle") == b.name).select(group, record)
        rows = records.where(b.condition(records)).select(group, record, _value(b).alias("_v"))
        part = ids.join(rows, [group, record]).groupBy(group).agg(F.max("_v").alias("_v"))
        part = part.select(group, *[F.col(f"_v.v{i}").alias(f) for i, f in enumerate(b.fields)])
        out = part if out is None else out.join(part, group, "full")
    return out
