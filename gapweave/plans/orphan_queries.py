"""Queries on references that do not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.operators.orphans import Reference, orphan_months
from gapweave.runtime import table

REFERENCES = [
    ("hashes", "filename_id", "loaded_at"),
    ("brightness", "filename_id", "loaded_at"),
    ("media_info", "filename_id", "loaded_at"),
    ("whitelist", "id1", "added_at"),
    ("whitelist", "id2", "added_at"),
]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = [Reference(t, f, time, table(spark, d, t)) for t, f, time in REFERENCES]
    return orphan_months(refs, table(spark, d, "filenames"), "id", "imported_at", "deleted_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "ref_month", "ref_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return (
        _orphans(spark, d)
        .groupBy("ref_table", "ref_field", "ref_month")
        .agg(F.count(F.lit(1)).alias("orphan_ids"), F.sum("orphan_refs").alias("orphan_refs"))
    )


_UNRESOLVED = """
  select r.* from (
    %s
  ) r
  where r.ref_id is not null and not exists (
    select 1 from filenames f where f.id = r.ref_id and f.imported_at <= r.t
      and (f.deleted_at is null or f.deleted_at > r.t))
""" % "\n    union all\n    ".join(
    f"select '{t}' as ref_table, '{f}' as ref_field, cast({f} as bigint) as ref_id, {time} as t from {t}" for t, f, time in REFERENCES
)

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLES = {
    "p5_found": f"select distinct ref_table, ref_field, strftime(t, '%Y-%m') as ref_month, ref_id from ({_UNRESOLVED}) u",
    "p5_report": f"""select ref_table, ref_field, strftime(t, '%Y-%m') as ref_month, count(distinct ref_id) as orphan_ids,
      cast(count(*) as bigint) as orphan_refs from ({_UNRESOLVED}) u group by all""",
}
