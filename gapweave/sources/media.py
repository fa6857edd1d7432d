"""Media files as sources: listings, probing and frames. External programs run inside tasks, never on the driver."""

from __future__ import annotations

import os
import subprocess
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions import scalar
from gapweave.operators.catalog import hash_method
from gapweave.operators.paths import DEFAULT_EXTENSIONS, importable

PROBE = ["ffprobe", "-v", "error", "-show_streams", "-show_format", "-of", "json"]
DECODER = ["ffmpeg"]
PROBE_SECONDS = 30
_STREAM = (
    "codec_type string, codec_name string, width int, height int, avg_frame_rate string, r_frame_rate string, disposition struct<attached_pic:int>"
)
PROBED = f"streams array<struct<{','.join(f.strip().replace(' ', ':', 1) for f in _STREAM.split(', '))}>>, format struct<duration:string>"


def scan_files(spark: SparkSession, folder: str, extensions: list[str] | None = None, excludes: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """Media files below a folder: (path, modified, size). Contents are never read.

    Only wanted extensions come, declaration files and excluded folders are left out, and so is what changed
    within the last hour.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    plain = listing.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return importable(plain, "path", "modified", list(extensions or DEFAULT_EXTENSIONS), list(excludes or []), now if now is not None else F.current_timestamp())


def run_probe(files: DataFrame, path: str = "path", command: list[str] | None = None, seconds: int = PROBE_SECONDS) -> DataFrame:
    """Run a probe program on each file: (path, json, error). Failures are values and stop nothing."""
    program = list(command or PROBE)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    done = subprocess.run([*program, p], capture_output=True, text=True, timeout=seconds, check=False)
                    failed = done.stderr.strip() or f"exit code {done.returncode}" if done.returncode else None
                    rows.append((p, None if failed else done.stdout, failed))
                except FileNotFoundError:
                    rows.append((p, None, "probe program not found"))
                except subprocess.TimeoutExpired:
                    rows.append((p, None, "probe timed out"))
            yield pd.DataFrame(rows, columns=["path", "json", "error"])

    return files.select(F.col(path).alias("path")).mapInPandas(work, "path string, json string, error string")


def read_probe(probed: DataFrame) -> DataFrame:
    """What probe output says: (path, has_video, fps, duration, codec, width, height, error).

    fps is the first usable rate of the video streams, the average rate of a stream going before its base
    rate. Codec and size come from the largest video stream that is no cover picture; of equally large ones
    the first. Output that is no JSON, or a failed probe, has no video and an error.
    """
    data = F.from_json("json", PROBED)
    videos = F.filter(F.coalesce(F.col("_d.streams"), F.array()), lambda s: s["codec_type"] == "video")
    rates = F.transform(F.col("_v"), lambda s: F.coalesce(scalar.parse_rate(s["avg_frame_rate"]), scalar.parse_rate(s["r_frame_rate"])))
    shown = F.filter("_v", lambda s: F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)
    area = F.transform("_s", lambda s: F.coalesce(s["width"], F.lit(0)).cast("long") * F.coalesce(s["height"], F.lit(0)))
    rows = probed.withColumn("_d", data).withColumn("_v", videos).withColumn("_s", shown).withColumn("_a", area)
    best = F.get(F.col("_s"), F.array_position("_a", F.array_max("_a")).cast("int") - 1)
    broken = F.col("json").isNotNull() & F.col("_d.streams").isNull() & F.col("_d.format").isNull()
    return rows.select(
        "path",
        (F.size("_v") > 0).alias("has_video"),
        F.get(F.filter(rates, lambda r: r.isNotNull()), F.lit(0)).alias("fps"),
        F.col("_d.format.duration").try_cast("double").alias("duration"),
        F.coalesce(best["codec_name"], F.lit("unknown")).alias("codec"),
        best["width"].alias("width"),
        best["height"].alias("height"),
        F.coalesce("error", F.when(broken, F.lit("probe output is no JSON"))).alias("error"),
    )


def read_header(headers: DataFrame, text: str = "header") -> DataFrame:
    """What a decoder's header text says: adds fps, source_width, source_height, width, height, duration, frames.

    The first ``Stream`` line with ``Video:`` gives the rate (0 if it has none) and the source size, the last one
    the size received. A missing part is null.
    """
    lines = F.transform(F.split(F.col(text), "\r?\n"), lambda s: F.ltrim(s))
    video = F.filter(lines, lambda s: s.startswith("Stream ") & s.contains(" Video: "))
    timing = F.get(F.filter(lines, lambda s: s.contains("Duration: ")), F.lit(0))
    rows = headers.withColumn("_first", F.get(video, F.lit(0))).withColumn("_last", F.element_at(F.when(F.size(video) > 0, video), -1)).withColumn("_time", timing)
    fps = F.when(F.col("_first").isNotNull(), F.coalesce(F.nullif(F.regexp_extract("_first", r" ([0-9]+\.?[0-9]*) (?:tbr|fps)", 1), F.lit("")).try_cast("double"), F.lit(0.0)))

    def side(line: str, group: int) -> Column:
        return F.regexp_extract(line, r" ([0-9]+)x([0-9]+)[, ]", group).try_cast("int")

    duration = scalar.clock_seconds(F.nullif(F.regexp_extract("_time", r" (\d\d:\d\d:\d\d.\d\d)", 1), F.lit("")))
    out = rows.withColumns({"fps": fps, "source_width": side("_first", 1), "source_height": side("_first", 2), "width": side("_last", 1), "height": side("_last", 2), "duration": duration})
    return out.withColumn("frames", F.when(F.col("fps") > 0, F.bround(F.col("duration") * F.col("fps"), 0).cast("long"))).drop("_first", "_last", "_time")


def decode_frames(
    files: DataFrame, method: str, width: int | None = None, height: int | None = None, path: str = "path", program: list[str] | str = "ffmpeg"
) -> DataFrame:
    """Decode files and average each frame over all its bytes: (path, frame, value, error).

    Frames come as the method's own filter leaves them, each with its size before it; ``width`` and ``height`` are for
    programs that send bare frames of a known size. One frame is held at a time. A file that fails has one row
    more, with an error and no frame; what was read before is kept, and other files go on.
    """
    video_filter, command = hash_method(method).video_filter, [program] if isinstance(program, str) else list(program)
    form = ["-f", "image2pipe", "-c:v", "ppm"] if width is None else ["-f", "rawvideo", "-pix_fmt", "rgb24"]

    def next_size(out) -> int:
        """Bytes of the frame that follows, 0 at the end."""
        if width is not None and height is not None:
            return width * height * 3
        words: list[bytes] = []
        while len(words) < 4:
            line = out.readline()
            if not line:
                return 0
            words += line.split(b"#")[0].split()
        if words[0] != b"P6":
            raise ValueError("the decoder sent no frame")
        return int(words[1]) * int(words[2]) * 3

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "frame", "value", "error"]
        for pdf in batches:
            for p in pdf["path"]:
                frame, values, error = 0, [], None
                try:
                    process = subprocess.Popen(
                        [*command, "-v", "error", "-i", p, "-vf", video_filter, *form, "-"], stdout=subprocess.PIPE, stderr=subprocess.PIPE, stdin=subprocess.DEVNULL
                    )
                except FileNotFoundError:
                    yield pd.DataFrame([(p, None, None, "decoder not found")], columns=names)
                    continue
                said: list[bytes] = []
                listener = threading.Thread(target=lambda err=process.stderr, said=said: said.append(err.read()), daemon=True)
                listener.start()
                with process:
                    try:
                        while (size := next_size(process.stdout)) and len(raw := process.stdout.read(size)) == size:
                            values.append((p, frame, float(np.frombuffer(raw, np.uint8).mean()), None))
                            frame += 1
                            if len(values) == 10_000:
                                yield pd.DataFrame(values, columns=names)
                                values = []
                    except ValueError as e:
                        error = str(e)
                        process.kill()
                    listener.join()
                if process.returncode and error is None:
                    error = b"".join(said).decode("utf-8", "replace").strip() or f"exit code {process.returncode}"
                if error is None and not frame:
                    error = "no frames"
                if error is not None:
                    values.append((p, None, None, error))
                yield pd.DataFrame(values, columns=names).astype({"frame": "Int32"})

    return files.select(F.col(path).alias("path")).mapInPandas(work, "path string, frame int, value double, error string")


def frame_brightness(files: DataFrame, method: str, width: int | None = None, height: int | None = None, path: str = "path", program: list[str] | str = "ffmpeg") -> DataFrame:
    """The frames that ``decode_frames`` reads: (path, frame, value)."""
    return decode_frames(files, method, width, height, path, program).where("error is null").select("path", "frame", "value")


def probe_media(files: DataFrame, key: str = "filename_id", name: str = "name", command: list[str] | None = None) -> DataFrame:
    """Media facts of named files: (key, extension, codec, width, height, file_size). What cannot be found is null, the codec ``unknown``."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for p in b["path"]:
                try:
                    found.append(os.path.getsize(p))
                except OSError:
                    found.append(None)
            yield pd.DataFrame({"path": b["path"], "file_size": pd.array(found, "Int64")})

    names = files.where(F.col(name).isNotNull()).select(F.col(name).alias("path")).distinct()
    seen = read_probe(run_probe(names, command=command)).join(names.mapInPandas(sizes, "path string, file_size long"), "path")
    facts = seen.select(F.col("path").alias(name), scalar.extension_or_unknown(F.col("path")).alias("extension"), "codec", "width", "height", "file_size")
    return files.select(key, name).join(facts, name).drop(name)


def readable(files: DataFrame, listing: DataFrame, name: str = "name") -> DataFrame:
    """Files that a listing of what can be read holds."""
    return files.join(listing.select(name).distinct(), name, "left_semi")
