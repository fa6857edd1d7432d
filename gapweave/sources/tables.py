"""Reading and writing tables, saved results and stored profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A saved result: one row per member of a group.
SAVED = "group long, filename_id long, name string, fps double, duration double, offset double"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A parquet table; with a schema its footer need not be read to plan."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def file_infos(files: DataFrame, key: str = "id") -> DataFrame:
    """All files in the order of their ids."""
    return files.orderBy(key)


def frame_range(gaps: DataFrame, low: int, high: int, frame: str = "frame") -> DataFrame:
    """Gaps from frame ``low`` to ``high``, both included; the bounds reach the scan."""
    return gaps.where(F.col(frame).between(low, high))


def for_files(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the files in ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def profile_to_json(profile: str) -> Column:
    return F.to_json(F.col(profile))


def profile_from_json(text: str) -> Column:
    """The profile in a JSON array; null if it is none."""
    return F.from_json(F.col(text), "array<double>")


def write_saved(groups: DataFrame, path: str) -> None:
    """Write result groups as JSON lines; rows as in ``SAVED``."""
    groups.write.mode("overwrite").json(path)


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Read saved groups with a fixed schema; nothing but plain values is ever built from the text."""
    return spark.read.schema(SAVED).json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines as text files."""
    lines.select("line").write.mode("overwrite").text(path)
