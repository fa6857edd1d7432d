"""Session facts shared by the operators: the shared folder, written tables and input tables."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder. On a cluster
    a missing setting is an error, as a machine-local folder would lose data with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = "file://" + tempfile.mkdtemp(prefix="gapweave-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


#: Spark takes the bytes of files for the size of a table, and a hash table of it is some 30 times as large. Written tables
#: of more bytes than this are not broadcast by size.
BROADCAST_FILES = 512 << 10


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df``, which joins must not broadcast because it seems small; the other side of a join still may be, and so may ``F.broadcast(df)``."""
    jvm = df.sparkSession.sparkContext._jvm
    plans = jvm.org.apache.spark.sql.catalyst.plans.logical
    # No named hint forbids one side only.
    never = getattr(getattr(plans, "NO_BROADCAST_HASH$"), "MODULE$")
    hinted = plans.ResolvedHint(df._jdf.logicalPlan(), plans.HintInfo(jvm.scala.Option.apply(never)))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), hinted), df.sparkSession)


def materialize(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    With ``by`` it is laid out by that column, so that reading one of its values reads no others. The files survive a lost executor. They are deleted when the JVM ends; ``discard`` deletes earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gapweave-{_RUN}/{name}-{uuid.uuid4().hex[:10]}"
    if by is None:
        df.write.parquet(path, compression=codec)
    else:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path, compression=codec)
    fs, hadoop = _fs(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    if fs.getContentSummary(hadoop).getLength() > BROADCAST_FILES:
        out = unbroadcast(out)
    out._gapweave_path = path
    return out


#: Rows of which ``in_parts`` works on a part at once.
PART_ROWS = 4_000_000


def in_parts(df: DataFrame, key: str, rows: int, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(df)`` as a written table, where all rows of a key are made of rows of that key.

    If ``df`` has many ``rows``, it is made key by key in parts, one after the other, whose shuffle files are deleted in between.
    """
    parts = max(1, -(-rows // PART_ROWS))
    if parts == 1:
        return materialize(make(df), name)
    done = []
    for i in range(parts):
        done.append(materialize(make(df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)), name, codec="zstd"))
        release(df.sparkSession)
    paths = [t._gapweave_path for t in done]
    out = unbroadcast(df.sparkSession.read.schema(done[0].schema).parquet(*paths))
    out._gapweave_path = paths
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for t in tables:
        paths = getattr(t, "_gapweave_path", None) or []
        for path in [paths] if isinstance(paths, str) else paths:
            fs, hadoop = _fs(t.sparkSession, path)
            fs.delete(hadoop, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """``discard`` tables, and let Spark delete the shuffle files of finished jobs, which else stay until the driver happens to collect its garbage."""
    discard(*tables)
    time.sleep(0.2)  # events of the last job hold its plan for a moment,
    spark.sql("select 1").collect()  # the very last one until another follows
    spark.sparkContext._jvm.System.gc()


def discard_part(df: DataFrame, column: str, value: object) -> None:
    """Delete the rows of one value of a table that was written laid out by a column; no plan may read them any more."""
    fs, hadoop = _fs(df.sparkSession, f"{df._gapweave_path}/{column}={value}")
    fs.delete(hadoop, True)


def put_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """Make a small file that must not exist yet; False if there is one already. Of two writers one succeeds."""
    fs, hadoop = _fs(spark, path)
    if fs.getScheme() == "file":
        try:
            fs.mkdirs(hadoop.getParent())
            with open(hadoop.toUri().getPath(), "xb") as f:
                f.write(data)
            return True
        except FileExistsError:
            return False
    try:
        stream = fs.create(hadoop, False)
    except Py4JJavaError:
        if fs.exists(hadoop):
            return False
        raise
    stream.write(bytearray(data))
    stream.close()
    return True


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The whole of a small file."""
    fs, hadoop = _fs(spark, path)
    stream = fs.open(hadoop)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


class Manifests:
    """The versions of something kept in a folder: small JSON files with rising numbers, none ever overwritten."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        fs, path = _fs(self.spark, self.folder)
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())

    def latest(self) -> tuple[int, dict]:
        """The greatest number and its content; one that a writer left unfinished counts as a number, but has no content."""
        numbers = self.numbers()
        for n in reversed(numbers):
            try:
                return numbers[-1], json.loads(read_bytes(self.spark, f"{self.folder}/{n}"))
            except ValueError:
                continue
        return (numbers[-1] if numbers else 0), {}

    def put(self, number: int, content: dict) -> None:
        """Make version ``number``; an error if another writer has made it."""
        if not put_new(self.spark, f"{self.folder}/{number}", json.dumps(content).encode()):
            raise RuntimeError(f"version {number} of {self.folder} was made by another writer meanwhile")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read one input table of a data folder."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` has not got, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
