"""Changes to catalogue tables as DataFrame functions, and a versioned catalogue that applies them at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.operators.paths import absolute, is_like_prefix, is_under
from gapweave.operators.windows import number_items
from gapweave.runtime import Manifests, _fs, materialize

# ---------------------------------------------------------------------------------------------------
# Functions
# ---------------------------------------------------------------------------------------------------


def upsert_by_name(files: DataFrame, new: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """``files`` with the rows of ``new`` put in by name; a name that is there keeps its id, others get the next ids.

    ``new`` has all columns but the key. Of rows of ``new`` that share a name one is taken. New ids follow the
    order of the names. Rows of ``new`` without a name are left out.
    """
    columns = [c for c in files.columns if c != key]
    fresh = new.where(F.col(name).isNotNull()).dropDuplicates([name]).select(*columns)
    ids = files.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias(key))
    kept = files.join(fresh.select(name), name, "left_anti").select(key, *columns)
    changed = fresh.join(ids, name).select(key, *columns)
    top = files.agg(F.max(key)).first()[0] or 0
    added = number_items(fresh.join(ids, name, "left_anti").select(*columns), [name], "_n")
    added = added.select((F.lit(top) + F.col("_n") + 1).cast(files.schema[key].dataType).alias(key), *columns)
    return kept.unionByName(changed).unionByName(added)


def replace_rows(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with all rows of the keys in ``new`` replaced by those of ``new``."""
    keys = new.select(key).distinct()
    return rows.join(keys, key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def delete_keys(rows: DataFrame, gone: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """``rows`` without those in which one of the columns holds a key of ``gone``; a null holds none."""
    keys = gone.where(F.col(key).isNotNull()).select(F.col(key).alias("_gone")).distinct()
    out = rows
    for c in columns:
        out = out.join(keys, F.col(c) == F.col("_gone"), "left_anti")
    return out


def keep_known(rows: DataFrame, files: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """``rows`` whose columns all hold keys of ``files``: what is left when orphans are tidied away."""
    keys = files.where(F.col(key).isNotNull()).select(F.col(key).alias("_known")).distinct()
    out = rows
    for c in columns:
        out = out.join(keys, F.col(c) == F.col("_known"), "left_semi")
    return out


def whitelist_pairs(files: DataFrame, lists: DataFrame, whitelist: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Pairs (id1, id2), id1 below id2, of the files named in one list, without those the whitelist has already.

    ``lists`` has rows (list, name), a list being what a user would name at once. Names the catalogue lacks are left
    out; of lists with fewer than two files no pair comes, and a pair that several lists hold comes once.
    """
    ids = lists.join(files.select(key, name), name).where(F.col(key).isNotNull()).select("list", key).distinct()
    a, b = ids.select("list", F.col(key).alias("id1")), ids.select("list", F.col(key).alias("id2"))
    pairs = a.join(b, "list").where("id1 < id2").select("id1", "id2").distinct()
    have = whitelist.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
    return pairs.join(have, ["id1", "id2"], "left_anti")


def purge_counts(files: DataFrame, readable: DataFrame, name: str = "name") -> DataFrame:
    """One row: how many files are to be purged, and of how many."""
    known = readable.select(name).distinct().withColumn("_ok", F.lit(True))
    return files.join(known, name, "left").agg(F.count_if(F.col("_ok").isNull()).alias("to_delete"), F.count(F.lit(1)).alias("files"))


# ---------------------------------------------------------------------------------------------------
# Hash methods
# ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HashMethod:
    """How frames become brightness values; values of different methods cannot be compared."""

    name: str
    version: int
    video_filter: str


#: Names, versions and frame filters of the methods.
HASH_METHODS = {
    "legacy-center": HashMethod("legacy-center", 1, "crop=in_w/10:in_h/10:in_w*0.45:in_h*0.45"),
    "full-frame": HashMethod("full-frame", 1, "scale=128:72:flags=fast_bilinear"),
}
DEFAULT_METHOD = "legacy-center"
PEAK_SECONDS = 10


def hash_method(name: str) -> HashMethod:
    if name not in HASH_METHODS:
        raise ValueError(f"unknown hash method {name!r}")
    return HASH_METHODS[name]


# ---------------------------------------------------------------------------------------------------
# The catalogue
# ---------------------------------------------------------------------------------------------------

_SCHEMAS = {
    "files": "id long, name string, fps double, duration double",
    "hashes": "filename_id long, frame int, hash double",
    "brightness": "filename_id long, brightness array<double>",
    "media_info": "filename_id long, extension string, codec string, width int, height int, file_size long",
    "whitelist": "id1 long, id2 long",
    "metadata": "key string, value string",
}
#: Columns of each table that refer to files.
_REFERENCES = {"hashes": ["filename_id"], "brightness": ["filename_id"], "media_info": ["filename_id"], "whitelist": ["id1", "id2"]}


class Catalogue:
    """Tables in a folder, changed several at once or not at all.

    A version is a small manifest naming the folder of each table. A change writes new folders first and
    then the next manifest under a name that must not exist yet, so a failure on the way leaves the version
    before as it is, and of two writers at once one fails. Old folders are deleted by ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- versions ----------------------------------------------------------------------------------

    def _manifest(self) -> tuple[int, dict[str, str]]:
        return Manifests(self.spark, f"{self.folder}/manifests").latest()

    def commit(self, changes: dict[str, DataFrame]) -> None:
        """Put new contents in place of the named tables, all or none."""
        version, manifest = self._manifest()
        new = dict(manifest)
        try:
            for table, df in changes.items():
                new[table] = f"{self.folder}/tables/{table}-{uuid.uuid4().hex}"
                wanted = T._parse_datatype_string(_SCHEMAS[table])
                df.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).write.parquet(new[table])
            Manifests(self.spark, f"{self.folder}/manifests").put(version + 1, new)
        except BaseException:
            for table in changes:
                if new.get(table) != manifest.get(table):
                    fs, path = _fs(self.spark, new[table])
                    fs.delete(path, True)
            raise

    def table(self, name: str) -> DataFrame:
        _, manifest = self._manifest()
        if name in manifest:
            return self.spark.read.schema(_SCHEMAS[name]).parquet(manifest[name])
        return self.spark.createDataFrame([], _SCHEMAS[name])

    # -- schema and method -------------------------------------------------------------------------

    def open(self, method: str | None = None) -> Catalogue:
        """Make the tables if they are missing, and check that the hash method is the recorded one.

        A catalogue with files but no recorded method is taken to hold the default method.
        """
        found = {r.key: r.value for r in self.table("metadata").collect()}
        if not found:
            has_files = not self.table("files").isEmpty()
            chosen = hash_method(DEFAULT_METHOD if has_files or method is None else method)
            rows = [("hash_method", chosen.name), ("hash_method_version", str(chosen.version)), ("video_filter", chosen.video_filter), ("extrema_distance_seconds", str(PEAK_SECONDS))]
            changes = {"metadata": self.spark.createDataFrame(rows, _SCHEMAS["metadata"])}
            _, manifest = self._manifest()
            changes |= {t: self.spark.createDataFrame([], s) for t, s in _SCHEMAS.items() if t not in manifest and t != "metadata"}
            self.commit(changes)
            found = dict(rows)
        recorded = hash_method(found["hash_method"])
        if found.get("hash_method_version") != str(recorded.version):
            raise ValueError("the catalogue was made by another version of its hash method")
        if method is not None and method != recorded.name:
            raise ValueError(f"the catalogue holds {recorded.name} hashes, not {method}")
        return self

    # -- changes -----------------------------------------------------------------------------------

    def store(self, results: DataFrame) -> None:
        """Put in or replace files with their hashes and profiles: rows (name, fps, duration, index, brightness).

        ``index`` is an array of (frame, hash). Cached media facts of these files are dropped. One commit holds all. Of
        several results of one name one is taken, as a whole.
        """
        results = materialize(results.where(F.col("name").isNotNull()).dropDuplicates(["name"]), "results")
        files = upsert_by_name(self.table("files"), results.select("name", "fps", "duration"))
        ids = files.select("id", "name")
        rows = materialize(results.join(ids, "name"), "stored-results")
        hashes = rows.select(F.col("id").alias("filename_id"), F.explode("index").alias("_i")).select("filename_id", "_i.frame", "_i.hash")
        profiles = rows.select(F.col("id").alias("filename_id"), "brightness")
        gone = rows.select(F.col("id").alias("filename_id"))
        # A file may come back without any peak, so the files decide what is replaced, not the new rows.
        old_hashes = delete_keys(self.table("hashes"), gone, "filename_id", ["filename_id"])
        old_profiles = delete_keys(self.table("brightness"), gone, "filename_id", ["filename_id"])
        media = delete_keys(self.table("media_info"), gone, "filename_id", ["filename_id"])
        self.commit({"files": files, "hashes": old_hashes.unionByName(hashes), "brightness": old_profiles.unionByName(profiles), "media_info": media})

    def store_media(self, infos: DataFrame) -> None:
        """Put in or replace media facts by file."""
        self.commit({"media_info": replace_rows(self.table("media_info"), infos.dropDuplicates(["filename_id"]), "filename_id")})

    def delete_media(self, ids: DataFrame) -> None:
        """Drop the media facts of files; ``ids`` has a column filename_id."""
        self.commit({"media_info": delete_keys(self.table("media_info"), ids, "filename_id", ["filename_id"])})

    def delete_files(self, gone: DataFrame) -> None:
        """Delete files and all that refers to them; ``gone`` has a column id."""
        changes = {"files": delete_keys(self.table("files"), gone, "id", ["id"])}
        changes |= {t: delete_keys(self.table(t), gone, "id", columns) for t, columns in _REFERENCES.items()}
        self.commit(changes)

    def _delete_where(self, condition: Column, delete: bool) -> DataFrame:
        gone = self.table("files").where(condition)
        if delete:
            self.delete_files(gone)
        return gone

    def delete_under(self, path: str, delete: bool = False, like: bool = False) -> DataFrame:
        """Files under a path; they are deleted only if ``delete`` is set. ``like`` matches as the stored form did."""
        root = absolute([path])[0]
        return self._delete_where(is_like_prefix(F.col("name"), root) if like else is_under(F.col("name"), [root]), delete)

    def purge(self, readable: DataFrame, delete: bool = False) -> DataFrame:
        """Files that cannot be read any more; deleted only if ``delete`` is set, and nothing else is touched."""
        gone = self.table("files").join(readable.select("name").distinct(), "name", "left_anti").select("id", "name", "fps", "duration")
        if delete:
            self.delete_files(gone)
        return gone

    def tidy(self) -> None:
        """Delete rows that refer to files that are not there. Files without hashes stay."""
        files = self.table("files")
        self.commit({t: keep_known(self.table(t), files, "id", columns) for t, columns in _REFERENCES.items()})

    def whitelist(self, names: Iterable[str]) -> DataFrame:
        """Whitelist all pairs of the named files; returns the new pairs."""
        named = self.spark.createDataFrame([(1, n) for n in names], "list int, name string")
        pairs = whitelist_pairs(self.table("files"), named, self.table("whitelist"))
        new = self.spark.createDataFrame(pairs.collect(), _SCHEMAS["whitelist"])  # as many as the names typed allow
        self.commit({"whitelist": self.table("whitelist").unionByName(new)})
        return new

    def vacuum(self, files_per_table: int = 8) -> None:
        """Write every table anew in few files and delete all folders and manifests of older versions."""
        self.commit({t: self.table(t).coalesce(files_per_table) for t in _SCHEMAS})
        version, manifest = self._manifest()
        fs, manifests = _fs(self.spark, f"{self.folder}/manifests")
        for s in fs.listStatus(manifests):
            if s.getPath().getName() != str(version):
                fs.delete(s.getPath(), True)
        current = {p.rsplit("/", 1)[1] for p in manifest.values()}
        fs, tables = _fs(self.spark, f"{self.folder}/tables")
        for s in fs.listStatus(tables):
            if s.getPath().getName() not in current:
                fs.delete(s.getPath(), True)

    def transaction(self, work: Callable[[Catalogue], dict[str, DataFrame]]) -> None:
        """Commit the tables ``work`` returns; if it fails nothing is changed."""
        self.commit(work(self))
