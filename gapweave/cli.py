"""Command line: python -m gapweave.cli CATALOGUE [options]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave import config
from gapweave.functions.scalar import DEFAULT_FPS, parse_extensions
from gapweave.operators import report
from gapweave.operators.catalog import HASH_METHODS, PEAK_SECONDS, Catalogue
from gapweave.operators.paths import absolute, files_per_directory, is_listed_under, only_new
from gapweave.plans.search import Catalog, report_groups, search
from gapweave.runtime import materialize
from gapweave.sources import media, tables
from gapweave.streaming.incremental import hash_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gapweave")
    p.add_argument("catalogue", help="folder of the catalogue")
    p.add_argument("--config")
    p.add_argument("--profile")
    p.add_argument("--dir", help="import media files below a folder")
    p.add_argument("--file", help="import one media file")
    p.add_argument("--refresh", action="store_true", help="import known files again")
    p.add_argument("--hash-method", choices=sorted(HASH_METHODS))
    p.add_argument("--numjobs", type=int, help="tasks that probe and decode at once; as many as the cluster runs if not given")
    p.add_argument("--nice", type=int, help="niceness of the programs that probe and decode")
    p.add_argument("--vidext", help="comma-separated extensions")
    p.add_argument("--exclude-dir", action="append")
    p.add_argument("--search", action="store_true")
    p.add_argument("--searchres", help="saved result: written by --search, else shown")
    p.add_argument("--search-exclude-dir", action="append")
    for name, kind in (("ignore_start", float), ("ignore_end", float), ("indexlength", int), ("scenelength", float), ("radius", float), ("step", int), ("knnlib", str)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--verify-brightness", action=argparse.BooleanOptionalAction)
    p.add_argument("--brightness-correlation", type=float)
    p.add_argument("--fixspeed", action="store_true", default=None)
    p.add_argument("--whitelist", nargs="+")
    p.add_argument("--list-db-files", action="store_true")
    p.add_argument("--list-db-dirs", action="store_true")
    p.add_argument("--list-db-path", action="append", default=[])
    p.add_argument("--delete-db-path", action="append", default=[])
    p.add_argument("--purge", action="store_true")
    p.add_argument("--tidy", action="store_true")
    p.add_argument("--delete", action="store_true", help="really delete")
    p.add_argument("--vacuum", action="store_true")
    return p


def show(rows: DataFrame, column: str) -> None:
    """Print a text column row by row, one partition at a time."""
    for r in rows.select(column).toLocalIterator():
        print(r[0])


def listing(names: DataFrame) -> DataFrame:
    """Which of the named files can be read, tested in tasks."""
    import os
    from collections.abc import Iterator

    import pandas as pd

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[os.access(n, os.R_OK) for n in b["name"]]]

    return names.select("name").mapInPandas(test, "name string")


def import_files(spark: SparkSession, cat: Catalogue, found: DataFrame, refresh: bool, jobs: int | None = None, nice: int = 0) -> DataFrame:
    """Probe, decode and hash files that are new, or all of them, by the catalogue's recorded method.

    Returns one row per file looked at, (name, status, error), status being known, imported or failed. Each file is
    probed and decoded once, in ``jobs`` tasks at most. A file fails without stopping others: if it cannot be probed or
    decoded, has no video, or has so low a rate that a peak's surroundings are shorter than a frame.
    """
    method = cat.table("metadata").where("key = 'hash_method'").first()["value"]
    politely = ["nice", "-n", str(nice)] if nice else []
    seen = materialize(found.select(F.col("path").alias("name")).where("name is not null").distinct(), "found")
    fresh = seen if refresh else materialize(only_new(seen, cat.table("files"), "name"), "new-files")
    facts = media.read_probe(media.run_probe(fresh.repartition(jobs or spark.sparkContext.defaultParallelism), "name", [*politely, *media.PROBE]))
    facts = materialize(facts.withColumn("fps", F.coalesce("fps", F.lit(DEFAULT_FPS))), "probed")
    usable = facts.where(F.col("has_video") & (F.col("fps") * PEAK_SECONDS >= 1))
    frames = media.decode_frames(usable.select("path").repartition(jobs or spark.sparkContext.defaultParallelism), method, program=[*politely, *media.DECODER])
    frames = materialize(frames, "frames")
    rows = frames.where("frame is not null").join(usable.select("path", "fps", "duration"), "path").withColumnRenamed("path", "name")
    results = materialize(hash_results(rows.select("name", "frame", "value", "fps", "duration")), "results")
    if not results.isEmpty():
        cat.store(results)
    why = facts.select(
        F.col("path").alias("name"),
        F.when(~F.col("has_video"), F.coalesce("error", F.lit("no video"))).when(F.col("fps") * PEAK_SECONDS < 1, F.lit("frame rate too low")).alias("_probe"),
    )
    broken = frames.where("error is not null").groupBy(F.col("path").alias("name")).agg(F.max("error").alias("_decode"))
    done = results.select("name", F.lit("imported").alias("_done"))
    out = seen.join(fresh.withColumn("_new", F.lit(True)), "name", "left").join(why, "name", "left").join(broken, "name", "left").join(done, "name", "left")
    return out.select(
        "name", F.when(F.col("_new").isNull(), "known").otherwise(F.coalesce("_done", F.lit("failed"))).alias("status"),
        F.coalesce("_probe", "_decode", F.when(F.col("_new") & F.col("_done").isNull(), F.lit("no frames"))).alias("error"),
    )


def import_lines(outcome: DataFrame) -> DataFrame:
    """What an import tells: a line per file with an error, then the counts."""
    told = outcome.where("error is not null").select(F.lit(0).alias("i"), F.format_string("%s %s: %s", "status", "name", "error").alias("line"))
    count = [F.count_if(F.col("status") == s) for s in ("known", "imported", "failed")]
    counts = outcome.agg(F.format_string("%d scanned, %d known, %d queued, %d imported, %d failed", F.count(F.lit(1)), count[0], F.count(F.lit(1)) - count[0], count[1], count[2]).alias("line"))
    return told.unionByName(counts.select(F.lit(1).alias("i"), "line")).orderBy("i", "line")


def with_media(cat: Catalogue, members: DataFrame) -> DataFrame:
    """Media facts of result files: those at hand, and for others what probing finds, which is kept if complete."""
    members = materialize(members.select("filename_id", "name"), "members")
    have = materialize(cat.table("media_info"), "media")
    missing = members.join(report.to_probe(members, have), "filename_id").distinct()
    probed = materialize(media.probe_media(missing), "probed-media")
    stored = report.cacheable(probed)
    counts = report.cache_counts(members, have, stored).first()
    print(f"media facts: {counts.reused} at hand, {counts.probed} probed, {counts.stored} stored")
    if counts.stored:
        cat.store_media(stored)
    return have.select(*probed.columns).unionByName(probed)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        settings = config.load(a.config)
        given = {f: getattr(a, f) for f in ("ignore_start", "ignore_end", "indexlength", "scenelength", "radius", "step", "knnlib", "verify_brightness", "brightness_correlation", "fixspeed")}
        params = config.search_params(settings, a.profile, given | {"exclude_dirs": a.search_exclude_dir}) if a.search else None
        imports = config.section(settings, "import") if a.dir or a.file else {}
        nice = a.nice if a.nice is not None else config.section(settings, "common").get("nice")
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("gapweave").getOrCreate()
    cat = Catalogue(spark, a.catalogue).open(a.hash_method or imports.get("hash_method"))
    roots = absolute(a.list_db_path)
    files = cat.table("files").where(is_listed_under(F.col("name"), roots))
    if a.whitelist:
        show(cat.whitelist(absolute(a.whitelist)).select(F.format_string("whitelisted %d and %d", "id1", "id2").alias("line")), "line")
    if a.list_db_files:
        show(files.orderBy("id"), "name")
    if a.list_db_dirs:
        show(files_per_directory(files, "name").select(F.format_string("%6d %s", "files", "directory").alias("line")), "line")
    for path in a.delete_db_path:
        show(cat.delete_under(path, a.delete), "name")
    if a.purge:
        show(cat.purge(listing(cat.table("files")), a.delete), "name")
    if a.tidy:
        cat.tidy()
    if a.vacuum:
        cat.vacuum()
    if a.dir or a.file:
        wanted = spark.range(1).select(parse_extensions(F.lit(a.vidext or imports.get("vidext") or "")).alias("x")).first()[0] or None
        excluded = a.exclude_dir if a.exclude_dir is not None else imports.get("exclude_dirs", [])
        found = media.scan_files(spark, a.dir, wanted, excluded) if a.dir else spark.createDataFrame([(absolute([a.file])[0],)], "path string")
        outcome = materialize(import_files(spark, cat, found, a.refresh, a.numjobs or imports.get("numjobs"), nice or 0), "outcome")
        show(import_lines(outcome), "line")
    if a.search and params:
        known = Catalog(cat.table("files").withColumnRenamed("id", "filename_id"), cat.table("hashes"), cat.table("brightness"), cat.table("whitelist"))
        found = materialize(search(known, params), "found")
        if a.searchres:
            tables.write_saved(found.select("group", "filename_id", "name", "fps", "duration", "offset"), a.searchres)
        show(report_groups(found, with_media(cat, found)), "line")
    elif a.searchres:
        from gapweave.operators.groups import keep_saved_groups

        saved = tables.read_saved(spark, a.searchres)
        kept = keep_saved_groups(saved, saved.join(listing(saved), "name", "left_semi"), cat.table("whitelist"), "group", "filename_id")
        show(report_groups(kept, with_media(cat, kept)), "line")
    return 0


if __name__ == "__main__":
    sys.exit(main())
