"""Scalar expressions on times, sizes, rates, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FPS = 240.0
DEFAULT_FPS = 25.0
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def format_duration(seconds: Column) -> Column:
    """HH:MM:SS; the fraction is dropped, and hours start again after 24. Null stays null."""
    return F.date_format(F.timestamp_seconds(seconds.cast("bigint")), "HH:mm:ss")


def format_size(size: Column) -> Column:
    """A byte count with two decimals in the largest fitting unit up to TiB; null gives ``unknown``."""
    out = F.lit("unknown")
    value = size.cast("double")
    for power in range(len(UNITS) - 1, -1, -1):
        text = F.format_string(f"%.2f {UNITS[power]}", value / float(1024**power))
        out = F.when(value.isNotNull() & ((value < float(1024 ** (power + 1))) | F.lit(power == len(UNITS) - 1)), text).otherwise(out)
    return out


def resolution(width: Column, height: Column) -> Column:
    """``WxH``, or ``unknown`` if either is null or 0."""
    known = F.coalesce((width != 0) & (height != 0), F.lit(False))
    return F.when(known, F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise(F.lit("unknown"))


def parse_extensions(text: Column) -> Column:
    """The different extensions of a comma-separated list: trimmed, in lower case, without leading dots, none empty; sorted."""
    parts = F.transform(F.split(text, ","), lambda p: F.regexp_replace(F.lower(F.trim(p)), r"^\.+", ""))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def parse_rate(text: Column) -> Column:
    """Frames per second of ``n/d`` or a plain number; null unless it is a number above 0 and at most 240."""
    parts = F.split(F.trim(text), "/")
    top = parts[0].try_cast("double")
    value = F.when(F.size(parts) == 1, top).when(F.size(parts) == 2, F.try_divide(top, F.get(parts, F.lit(1)).try_cast("double")))
    return F.when((value > 0) & (value <= MAX_FPS), value)


def clock_seconds(text: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or ``s``; null for anything else."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    n = F.size(parts)
    return (
        F.when(n == 1, parts[0])
        .when(n == 2, parts[0] * 60 + F.get(parts, F.lit(1)))
        .when(n == 3, parts[0] * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2)))
    )


def known_duration(reported: Column, probed: Column, frames: Column, fps: Column) -> Column:
    """The first known of: the reported duration, the probed one, frames over fps."""
    counted = F.when((fps > 0) & (frames > 0), frames / fps)
    return F.coalesce(reported, probed, counted)


def known_fps(reported: Column, probed: Column) -> Column:
    """The reported rate if above 0, else the probed one, else 25."""
    return F.coalesce(F.when(reported > 0, reported), F.when(probed > 0, probed), F.lit(DEFAULT_FPS))


def valid_text(name: Column) -> Column:
    """The name if it is valid UTF-8, else without its broken parts."""
    return F.coalesce(F.try_validate_utf8(name), F.regexp_replace(F.make_valid_utf8(name), "�", ""))


def extension(path: Column) -> Column:
    """The last suffix of the file name in lower case without its dot, or empty; a leading dot starts no suffix."""
    return F.regexp_extract(F.lower(path), r"[^/.][^/]*\.([^./]*)$", 1)


def extension_or_unknown(path: Column) -> Column:
    return F.coalesce(F.nullif(extension(path), F.lit("")), F.lit("unknown"))


def dirname(path: Column) -> Column:
    """All before the last separator, without trailing separators; ``/`` for files of the root, empty if there is none."""
    head = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    return F.when(F.regexp_like(head, F.lit("^/+$")), head).otherwise(F.regexp_replace(head, "/+$", ""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
