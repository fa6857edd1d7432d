"""Filters on file paths. Roots are absolute paths without a trailing separator, as ``absolute`` gives them."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions import scalar
from gapweave.operators.skew import any_of

DEFAULT_EXTENSIONS = ("mp4", "mkv", "avi", "ts", "asf", "flv", "wmv", "mpg", "mpeg", "mov")
SETTLE_SECONDS = 3600


def absolute(paths: Iterable[str]) -> list[str]:
    return [os.path.abspath(p) for p in paths]


def is_under(path: Column, roots: Iterable[str]) -> Column:
    """True for a root itself and all below it; the root ``/`` holds only itself. Case matters; no roots hold nothing."""
    return any_of([(path == r) | path.startswith(r + "/") for r in roots])


def is_listed_under(path: Column, roots: Iterable[str]) -> Column:
    """As ``is_under``, but ``/`` holds everything, and no roots hold everything."""
    roots = list(roots)
    return any_of([(path == r) | path.startswith(r.rstrip("/") + "/") for r in roots]) if roots else F.lit(True)


def is_like_prefix(path: Column, root: str) -> Column:
    """As the stored catalogue matched prefixes: ASCII case ignored below the root, and ``%`` and ``_`` are wildcards.

    A backslash stands for itself.
    """
    return (path == root) | path.ilike((root.rstrip("/") + "/%").replace("\\", "\\\\"))


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    """True for names with one of the extensions, declaration files (``.d.ts``) excepted."""
    return scalar.extension(path).isin(sorted(extensions)) & ~F.lower(path).endswith(".d.ts")


def is_settled(modified: Column, now: Column, seconds: int = SETTLE_SECONDS) -> Column:
    """True for files last changed more than ``seconds`` ago."""
    return (now.cast("double") - modified.cast("double")) > seconds


def importable(listing: DataFrame, path: str, modified: str, extensions: Iterable[str], excludes: Iterable[str], now: Column) -> DataFrame:
    """Files to import: a wanted extension, outside the excluded folders, unchanged for an hour."""
    c = F.col(path)
    return listing.where(has_extension(c, extensions) & ~is_under(c, absolute(excludes)) & is_settled(F.col(modified), now))


def only_new(listing: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows whose name the catalogue lacks; null names are never known."""
    return listing.join(known.where(F.col(name).isNotNull()).select(name).distinct(), name, "left_anti")


def files_per_directory(files: DataFrame, path: str) -> DataFrame:
    """How many files each directory holds: (directory, files), by directory."""
    return files.where(F.col(path).isNotNull()).groupBy(scalar.dirname(F.col(path)).alias("directory")).agg(F.count(F.lit(1)).alias("files")).orderBy("directory")


def import_counts(listing: DataFrame, path: str, known: DataFrame) -> DataFrame:
    """One row: files scanned, already known, and left to import."""
    names = known.where(F.col(path).isNotNull()).select(path).distinct().withColumn("_known", F.lit(True))
    return listing.join(names, path, "left").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("_known")).alias("already"), F.count_if(F.col("_known").isNull()).alias("queued")
    )
