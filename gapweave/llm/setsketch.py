"""Near-duplicate sets by SetSketch registers: banded, estimated by likelihood, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.operators.skew import many_join
from gapweave.runtime import materialize

#: Stands for a value that is null or no finite number; runs that hold it are left out.
UNKNOWN = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Sketch:
    """Parameters of the registers. Two sets of likeness j share a band with at least 1 - (1 - j**rows)**bands."""

    bands: int = 40
    rows: int = 2
    base: float = 1.0003
    rate: float = 20.0
    limit: int = 65534

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(2024)
        a = rng.integers(0, 2**63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, rng.integers(0, 2**63, self.size, dtype=np.uint64) * np.uint64(2)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack_values(values: np.ndarray) -> bytes:
    """Whole values in as few bytes as they allow: one each up to 254, four or eight beyond; a first byte tells which."""
    known = values[values != UNKNOWN]
    low, high = (int(known.min()), int(known.max())) if len(known) else (0, 0)
    if low >= 0 and high < 255:
        return b"\x01" + np.where(values == UNKNOWN, 255, values).astype(np.uint8).tobytes()
    if -(2**31) < low and high < 2**31:
        return b"\x04" + np.where(values == UNKNOWN, -(2**31), values).astype(np.int32).tobytes()
    return b"\x08" + values.tobytes()


def unpack_values(packed: bytes) -> np.ndarray:
    """The values of ``pack_values``."""
    kind, missing = {1: (np.uint8, 255), 4: (np.int32, -(2**31)), 8: (np.int64, UNKNOWN)}[packed[0]]
    v = np.frombuffer(packed, kind, offset=1).astype(np.int64)
    return np.where(v == missing, UNKNOWN, v)


def run_set(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the different runs of ``length`` successive values, sorted."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    known = values != UNKNOWN
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(length):
        h = _spread(h * np.uint64(31) + values[j : j + n].view(np.uint64))
        ok &= known[j : j + n]
    return np.unique(h[ok])


def run_sets(flat: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``run_set`` of many series at once: the hashes, series after series, and where each series' hashes start (and end)."""
    n, rows = len(flat) - length + 1, len(offsets) - 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    of = np.repeat(np.arange(rows), np.diff(offsets))
    known = flat != UNKNOWN
    h, ok = np.zeros(n, np.uint64), of[:n] == of[length - 1 :]
    for j in range(length):
        h = _spread(h * np.uint64(31) + flat[j : j + n].view(np.uint64))
        ok &= known[j : j + n]
    h, of = h[ok], of[:n][ok]
    # Sorted by hash, then stably by series; short numbers of series are sorted by their digits.
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint16 if rows < 1 << 16 else np.int64), kind="stable")]
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[fresh], np.searchsorted(of[fresh], np.arange(rows + 1))


def registers(runs: np.ndarray, s: Sketch, factors: tuple[np.ndarray, np.ndarray], starts: np.ndarray | None = None) -> np.ndarray:
    """SetSketch registers of a set: exponentially spaced, truncated minima of exponential draws.

    With ``starts``, of several sets that follow one another, none of them empty: a row each.
    """
    a, b = factors
    starts = np.zeros(1, np.int64) if starts is None else starts
    least = np.full((len(starts), s.size), np.iinfo(np.uint64).max)
    for at in range(0, len(runs), 4096):  # bounds the memory, also of one huge set
        part = runs[at : at + 4096, None] * a[None] + b[None]
        first = np.searchsorted(starts, at, side="right") - 1
        inside = starts[(starts > at) & (starts < at + len(part))] - at
        low = np.minimum.reduceat(part, np.concatenate([[0], inside]), axis=0)
        np.minimum(least[first : first + len(low)], low, out=least[first : first + len(low)])
    draw = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / s.rate
    k = np.floor(1 - np.log(np.maximum(draw, 1e-300)) / np.log(s.base))
    return np.clip(k, 0, s.limit + 1).astype(np.uint16)


def digests(runs: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each of several sets that follow one another, none of them empty."""
    if not len(starts):
        return []
    parts = [np.bitwise_xor.reduceat(_spread(runs), starts), np.add.reduceat(_spread(runs ^ np.uint64(0x5851F42D4C957F2D)), starts)]
    packed = np.stack(parts, 1).tobytes()
    return [packed[i : i + 16] for i in range(0, len(packed), 16)]


def pack_series(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """``pack_values`` of many series at once."""
    known = flat[flat != UNKNOWN]
    if len(known) and known.min() >= 0 and known.max() < 255:
        small = np.where(flat == UNKNOWN, 255, flat).astype(np.uint8).tobytes()
        return [b"\x01" + small[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [pack_values(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def band_keys(regs: np.ndarray, s: Sketch) -> np.ndarray:
    """One 64-bit key per band of each row of registers."""
    parts = regs.reshape(len(regs), s.bands, s.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for j in range(s.rows):
        h = _spread(h + parts[:, :, j])
    return h


def likeness_by_likelihood(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, base: float, steps: int = 65) -> np.ndarray:
    """The likeness under which the observed order of registers is most likely, given the sizes of both sets."""
    more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    same = x.shape[1] - more - less
    u = (nx / (nx + ny))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = top * np.linspace(0, 1, steps)[None]

    def p(z: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(z, 0, 1) * (base - 1) / base) / np.log(base)

    tiny = 1e-12
    up, down = np.maximum(p(u - v * j), tiny), np.maximum(p(v - u * j), tiny)
    score = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def sketch_series(series: DataFrame, key: str, values: str, run: int, s: Sketch) -> DataFrame:
    """Per row: whole values, number of different runs, a digest of the set of runs, registers and band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = s.factors()
        for b in batches:
            lists = b.column(1)
            offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            offsets, flat = offsets - offsets[0], flat[offsets[0] : offsets[-1]]
            flat = np.where(np.abs(flat) < 2.0**62, np.floor(flat), np.nan)
            flat = np.where(np.isnan(flat), float(UNKNOWN), flat).astype(np.int64)
            runs, starts = run_sets(flat, offsets, run)
            sizes = np.diff(starts)
            some = sizes > 0
            begin = starts[:-1][some]
            keep = pa.array(some)
            regs = registers(runs, s, factors, begin) if len(begin) else np.zeros((0, s.size), np.uint16)
            packed = pa.array(pack_series(flat, offsets), pa.binary()).filter(keep)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(keep), packed, pa.array(sizes[some].astype(np.int32)), pa.array(digests(runs, begin), pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())],
                names=["_key", "_whole", "_size", "_digest", "_regs"],
            )

    schema = f"_key {dict(series.dtypes)[key]}, _whole binary, _size int, _digest binary, _regs binary"
    return series.where(F.col(values).isNotNull()).select(F.col(key).alias("_key"), F.col(values).cast("array<double>")).mapInArrow(work, schema)


def similar_classes(classes: DataFrame, run: int, threshold: float, s: Sketch) -> DataFrame:
    """Pairs (a, b), a below b, of classes whose sets of runs have a likeness of ``threshold`` or more."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(b.num_rows, s.size)
            who = pa.array(np.repeat(np.arange(b.num_rows), s.bands))
            yield pa.RecordBatch.from_arrays(
                [pa.array(band_keys(regs, s).view(np.int64).ravel()), b.column(0).take(who), b.column(1).take(who)], names=["_band", "_class", "_size"]
            )

    kind = dict(classes.dtypes)["_class"]
    banded = classes.select("_class", "_size", "_regs").mapInArrow(bands, f"_band long, _class {kind}, _size int")
    # Most bands are met by one class alone; the others, written out, are few, and hot ones among them are cut.
    w = Window.partitionBy("_band").orderBy("_class")
    met = banded.withColumn("_met", F.lag("_class").over(w).isNotNull() | F.lead("_class").over(w).isNotNull())
    shared = materialize(met.where("_met").drop("_met"), "shared-bands")
    a, b = (shared.select("_band", F.col("_class").alias(x), F.col("_size").alias(f"_n{x}")) for x in "ab")
    near = (F.least("_na", "_nb") >= threshold * F.greatest("_na", "_nb")) & (F.col("a") < F.col("b"))
    pairs = many_join(a, b, ["_band"]).where(near).select("a", "b").distinct()
    own = classes.select("_class", "_size", "_whole", "_regs")
    for x in "ab":
        pairs = pairs.join(own.select(F.col("_class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("_size", "_whole", "_regs")]), x)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            col = dict(zip(r.schema.names, r.columns, strict=True))
            keep = np.zeros(r.num_rows, bool)
            if r.num_rows:
                x, y = (np.frombuffer(b"".join(col[f"_regs_{k}"].to_pylist()), np.uint16).reshape(r.num_rows, s.size) for k in "ab")
                guess = likeness_by_likelihood(x, y, col["_size_a"].to_numpy(), col["_size_b"].to_numpy(), s.base)
                # Five standard errors of the estimate lie between what is dropped here and the threshold.
                margin = 5 * np.sqrt(threshold * (1 - threshold) / s.size)
                wa, wb = col["_whole_a"].to_pylist(), col["_whole_b"].to_pylist()
                for i in np.flatnonzero(guess + margin >= threshold):
                    p, q = (run_set(unpack_values(w[i]), run) for w in (wa, wb))
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i] = both >= threshold * (len(p) + len(q) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([col["a"].filter(mask), col["b"].filter(mask)], names=["a", "b"])

    return materialize(pairs.mapInArrow(verify, f"a {kind}, b {kind}"), "similar-classes")


def near_duplicates(series: DataFrame, key: str, values: str, run: int = 4, threshold: float = 0.5, sketch: Sketch | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal run sets, and the pairs of classes that are near-duplicates.

    A record's set holds the runs of ``run`` successive values, rounded down; the likeness of two sets is
    (runs in both) / (runs in either). Returns (members, pairs): members has one row (key, class) per
    record with at least one run, where a class is named by its least key and holds all records with the
    same set; pairs has each two classes (a, b), a below b, of likeness ``threshold`` or more.

    Every set is reduced to SetSketch registers. Sets that agree in all registers of some band, and whose
    sizes allow the threshold, are candidates; of these a likelihood estimate from all registers drops the
    clearly unlike, and the others are compared exactly. With the default 40 bands of 2 registers a pair
    right at likeness 0.5 is missed with a probability of 1e-5, a likelier one less; registers are spaced so
    finely that two unrelated sets share a band with a probability of some 4e-7. Copies are one
    class, so a group of copies costs no more than one record.

    Defined cases: a null or too short series has no run and no row. Null, NaN and infinite values are
    unknown; runs with one are left out. A key with several rows keeps the class of its least digest.
    Null keys are left out. Empty tables give empty results.
    """
    s = sketch or Sketch()
    rows = series.where(F.col(key).isNotNull())
    sketched = materialize(sketch_series(rows, key, values, run, s), "sketches")
    # Rows with one digest have the same set, size and registers, and any one's values stand for the set.
    rest = [F.first(c).alias(c) for c in ("_size", "_whole", "_regs")]
    classes = materialize(sketched.groupBy("_digest").agg(F.min("_key").alias("_class"), *rest), "sketch-classes")
    named = classes.select("_digest", "_class")
    members = sketched.groupBy("_key").agg(F.min("_digest").alias("_digest")).join(named, "_digest").select(F.col("_key").alias(key), F.col("_class").alias("class"))
    return members, similar_classes(classes, run, threshold, s)
