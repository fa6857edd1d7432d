"""Vectors within a radius of one another, exactly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.runtime import materialize, release

#: A vector table up to so many bytes is sent to every task; a larger one is cut into blocks.
BROADCAST_BYTES = 64 << 20
#: Rows of a block of the right side when it is not sent whole, and query rows multiplied at once.
BLOCK_ROWS, BATCH_ROWS = 50_000, 512


def squared_distance(a: list[str], b: list[str]) -> Column:
    """Squared Euclidean distance of two lists of columns, unrolled so that it stays in generated code."""
    terms = [(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)]
    return sum(terms[1:], terms[0])


def _spread(rows: DataFrame, prefix: str, length: int) -> DataFrame:
    """The values of the array column v as columns, a missing one as NaN.

    Array accesses with their checks would make the generated join larger than the JVM compiles.
    """
    return rows.select("item", *[F.coalesce(F.get("v", F.lit(i)), F.lit(float("nan"))).alias(f"{prefix}{i}") for i in range(length)])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pairs(q: np.ndarray, m: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs with a squared distance below the limit, found by matrix product and measured exactly."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(m):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    norms = np.einsum("ij,ij->i", m, m)
    for at in range(0, len(q), BATCH_ROWS):
        part = q[at : at + BATCH_ROWS]
        own = np.einsum("ij,ij->i", part, part)
        rough = own[:, None] + norms[None] - 2 * part @ m.T
        # Rounding of the rough form is bounded by the norms; what passes is measured anew.
        slack = 1e-9 * (own[:, None] + norms[None] + limit)
        i, j = np.nonzero(rough < limit + slack)
        d2 = np.zeros(len(i))
        for k in range(m.shape[1]):
            d = part[i, k] - m[j, k]
            d2 += d * d
        ok = d2 < limit
        found.append((i[ok] + at, j[ok], d2[ok]))
    return tuple(np.concatenate([f[n] for f in found]) if found else np.zeros(0, int) for n in range(3))


def radius_pairs(items: DataFrame, item: str, vector: str, radius: float, step: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each queried item with all items closer than ``radius``, itself included: (q, item, d2).

    Distance is Euclidean in double precision and must be below the radius. With ``step`` only items
    divisible by it are queried. The queried rows are multiplied in blocks with all rows: a table of up to
    ``broadcast_bytes`` goes to every task, a larger one is cut into blocks, which every queried row visits.

    Defined cases: rows with a null item or vector, or a vector with nulls or of another length than most,
    must be removed before; an empty table gives no rows. Repeated items give repeated rows.
    """
    rows = items.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("v"))
    queries = rows.where(F.col("item") % step == 0) if step > 1 else rows
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    limit = float(radius) ** 2
    schema = "q long, item long, d2 double"
    if size[0] * (size[1] or 0) * 8 <= broadcast_bytes:
        table = rows.toArrow()
        shared = items.sparkSession.sparkContext.broadcast((table["item"].to_numpy(), _matrix(table["v"])))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            for b in batches:
                q = _matrix(b.column(1))
                if not len(q):
                    continue
                i, j, d2 = _pairs(q, m, limit)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(ids[j]), pa.array(d2)], names=["q", "item", "d2"])

        return queries.repartition(max(2, min(4096, size[0] // 1000 + 1))).mapInArrow(probe, schema)
    blocks = int(-(-size[0] // BLOCK_ROWS))
    right = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    parts = max(1, blocks // max(1, step))
    left = queries.withColumn("part", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Both sides stem from one table; new names keep their columns apart in the plan.
    right = right.select(*[F.col(c).alias(f"right_{c}") for c in ("item", "v", "block", "part")])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, d2 = _pairs(_matrix(a["v"]), _matrix(b["right_v"]), limit) if a.num_rows and b.num_rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"q": a["item"].combine_chunks().take(pa.array(i)), "item": b["right_item"].combine_chunks().take(pa.array(j)), "d2": pa.array(d2, pa.float64())})

    return left.groupBy("block", "part").cogroup(right.groupBy("right_block", "right_part")).applyInArrow(meet, schema)


def grid_pairs(items: DataFrame, item: str, vector: str, length: int, radius: float, step: int = 1, blocks: int = 3) -> DataFrame:
    """The result of ``radius_pairs`` by an equi-join on cells, for radii small against the spread of the values.

    Sums of up to ``blocks`` blocks of coordinates move by at most radius * sqrt(block length) within the radius.
    They cut the space into cells four times as wide; an item lies in one cell and is sought in those it can
    reach, 1.5 to the power of the blocks on average. Everything stays in generated code.
    """
    blocks = min(blocks, length)
    edges = [i * length // blocks for i in range(blocks + 1)]
    rows = items.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("v"))
    right = _spread(rows, "v", length)
    left = _spread(rows.where(F.col("item") % step == 0), "w", length).withColumnRenamed("item", "q")
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        # A hair more than the bound, so that rounding of the sums cannot part a pair.
        reach = radius * (b - a) ** 0.5 * (1 + 1e-9) + 1e-9

        def total(prefix: str, a: int = a, b: int = b) -> Column:
            return sum((F.col(f"{prefix}{i}") for i in range(a + 1, b)), F.col(f"{prefix}{a}"))

        def cell(x: Column, width: float = 4 * reach) -> Column:
            return F.floor(x / F.lit(width)).cast("long")

        right = right.withColumn(f"c{n}", cell(total("v")))
        left = left.withColumn(f"c{n}", F.explode(F.sequence(cell(total("w") - F.lit(reach)), cell(total("w") + F.lit(reach)))))
    met = left.join(right, [f"c{n}" for n in range(blocks)])
    return met.withColumn("d2", squared_distance([f"w{i}" for i in range(length)], [f"v{i}" for i in range(length)])).where(F.col("d2") < float(radius) ** 2).select("q", "item", "d2")


def lattice_step(radius: float) -> float:
    """The least power of two of which two vectors of whole multiples can differ by two steps at most within the radius."""
    return 2.0 ** math.ceil(math.log2(radius / 3**0.5))


def lattice_range(rows: DataFrame, vector: str, length: int, radius: float) -> tuple[int, int] | None:
    """The least and greatest value in steps of ``lattice_step``, or None if a value is no whole multiple of it."""
    if not 1e-150 < radius < 1e150:
        return None
    step = lattice_step(radius)
    # Missing, infinite and undefined values fail the comparison; 2**40 steps are far more than could be packed.
    whole = F.forall(F.col(vector), lambda x: F.coalesce((F.abs(x / step) < 2.0**40) & (x / step == F.rint(x / step)), F.lit(False)))
    row = rows.agg(F.min((F.size(vector) == length) & whole), F.min(F.array_min(vector)), F.max(F.array_max(vector))).first()
    return (int(row[1] // step), int(row[2] // step)) if row[0] else None


def lattice_pairs(rows: DataFrame, item: str, vector: str, length: int, radius: float, values: tuple[int, int]) -> DataFrame:
    """The result of ``radius_pairs`` for vectors that are all different and lie on a lattice, ``values`` being its ``lattice_range``.

    Within the radius two vectors differ by one step of one coordinate or of each of two. Every vector stands at its own place
    (coordinate 0) and at those one step away along coordinates 1, 2 and so on, and vectors are joined that meet. One pair meets
    twice, with the coordinates the other way round, and counts where the queried one's is lower. A place holds at most
    2 * length + 1 vectors, whatever the data. Places are packed into whole numbers without loss; steps are powers of two, so
    d2 is exact.
    """
    step = lattice_step(radius)
    # One more place on both sides for the steps.
    bits = (values[1] - values[0] + 2).bit_length()
    per = 62 // bits
    words = [[(i, bits * (i - at)) for i in range(at, min(at + per, length))] for at in range(0, length, per)]
    steps = [F.get(F.col(vector), F.lit(i)) / step - (values[0] - 1) for i in range(length)]
    packed = [reduce(lambda a, b: a + b, [F.shiftleft(steps[i].cast("long"), shift) for i, shift in word]) for word in words]
    base = rows.select(F.col(item).cast("long").alias("item"), *[x.alias(f"k{n}") for n, x in enumerate(packed)])
    places = [F.struct(*[F.col(f"k{n}") for n in range(len(words))], F.lit(0).alias("c"))]
    for m, word in enumerate(words):
        for i, shift in word:
            for by in (1 << shift, -(1 << shift)):
                places.append(F.struct(*[(F.col(f"k{n}") + F.lit(by if n == m else 0).cast("long")).alias(f"k{n}") for n in range(len(words))], F.lit(i + 1).alias("c")))
    stood = base.select("item", F.inline(F.array(*places)))
    # Columns get their names after the join, so that both sides are one shuffle.
    met = stood.alias("x").join(stood.alias("y"), [F.col(f"x.k{n}") == F.col(f"y.k{n}") for n in range(len(words))]).where("x.c < y.c")
    d2 = F.when(F.col("x.c") == 0, F.lit(step * step)).otherwise(F.lit(2 * step * step))
    itself = base.select(F.col("item").alias("q"), "item", F.lit(0.0).alias("d2"))
    return met.select(F.col("x.item").alias("q"), F.col("y.item").alias("item"), d2.alias("d2")).where(F.col("d2") < float(radius) ** 2).unionByName(itself)


def nearest(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest of each query, ties to the smaller item."""
    w = Window.partitionBy("q").orderBy("d2", "item")
    return pairs.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")


def lsh_pairs(items: DataFrame, item: str, vector: str, radius: float, bucket: float | None = None, tables: int = 8, seed: int = 17) -> DataFrame:
    """Pairs within the radius found by random projections: (q, item, d2); some are missed, none is wrong."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = items.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket or 2 * radius, numHashTables=tables, seed=seed).fit(rows)
    met = model.approxSimilarityJoin(rows, rows, radius, distCol="d")
    return met.select(F.col("datasetA.item").alias("q"), F.col("datasetB.item").alias("item"), (F.col("d") * F.col("d")).alias("d2")).where(F.col("d2") < radius * radius)


@dataclass(frozen=True)
class Backend:
    """A way to find neighbours: (items, item, vector, radius, length, step) -> (q, item, d2)."""

    find: Callable[[DataFrame, str, str, float, int | None, int], DataFrame]
    exact: bool


def _grid(items: DataFrame, item: str, vector: str, radius: float, length: int | None, step: int) -> DataFrame:
    if length is None:
        raise ValueError("the grid backend needs the length of the vectors")
    return grid_pairs(items, item, vector, length, radius, step)


def _fine(items: DataFrame, item: str, vector: str, radius: float, length: int | None, step: int) -> DataFrame:
    if length is None:
        raise ValueError("the fine backend needs the length of the vectors")
    return grid_pairs(items, item, vector, length, radius, step, blocks=6)


#: Below this share of pairs that share cells the grid is the cheaper way; a pair costs it some 20 times as much.
GRID_SHARE = 0.02


def cell_share(items: DataFrame, vector: str, length: int, radius: float, blocks: int = 3) -> float:
    """About which share of all pairs ``grid_pairs`` would compare, from the spread of the block sums; 1 if nothing is known."""
    edges = [i * length // min(blocks, length) for i in range(min(blocks, length) + 1)]
    sums = [sum((F.get(F.col(vector), F.lit(i)) for i in range(a + 1, b)), F.get(F.col(vector), F.lit(a))) for a, b in zip(edges, edges[1:], strict=False)]
    row = items.agg(*[F.percentile_approx(x.cast("double"), [0.25, 0.75], 1000) for x in sums]).first()
    share = 1.0
    for quarters, a, b in zip(row, edges, edges[1:], strict=False):
        if quarters is None:
            return 1.0
        # Half of all values lie between the quarters; a cell and its reach are six times the reach wide.
        share *= min(1.0, 0.5 * 6 * radius * (b - a) ** 0.5 / max(quarters[1] - quarters[0], 1e-12))
    return share


def _vector_classes(items: DataFrame, item: str, vector: str, radius: float, length: int | None, step: int, distinct: Callable[[DataFrame], DataFrame] | None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items of equal vectors as classes (item, head, class, *keep), the classes (v, head, class), and pairs (q, item, d2) of heads."""
    rows = items.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("v"), *keep)
    asked = F.min(F.when(F.col("item") % step == 0, F.col("item")))
    heads = materialize(rows.groupBy("v").agg(F.min("item").alias("head"), asked.alias("class")), "vectors")
    members = materialize(rows.join(heads, "v").select("item", "head", "class", *keep), "vector-members")
    vectors = heads.select(F.col("head").alias("item"), "v")
    values = lattice_range(vectors, "v", length, radius) if length else None
    if values:
        return members, heads, lattice_pairs(vectors, "item", "v", length, radius, values)
    return members, heads, distinct(vectors) if distinct else radius_pairs(vectors, "item", "v", radius)


def class_pairs(items: DataFrame, item: str, vector: str, radius: float, length: int | None = None, step: int = 1, distinct: Callable[[DataFrame], DataFrame] | None = None, lowest: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The result of ``radius_pairs`` in two tables: (q, class) and (class, item, d2).

    Queried items with equal vectors have the same neighbours, so they are one class, named by the lowest of them, and
    all that is asked of neighbourhoods can be asked of classes. Different vectors are compared once, on the lattice if
    they lie on one, else by ``distinct``, a way to find (q, item, d2) in rows (item, v), or by matrix products.
    The second table counts its pairs of classes in ``_gapweave_rows``, and ``discard`` deletes them. With ``lowest``, columns (file, frame) of ``items``, equal vectors of a file come as the lowest item of them, with
    its file and frame.
    """
    members, heads, pairs = _vector_classes(items, item, vector, radius, length, step, distinct, lowest or ())
    if step > 1:
        pairs = pairs.join(heads.where("class is not null").select(F.col("head").alias("q"), "class"), "q")
    else:
        pairs = pairs.withColumnRenamed("q", "class")  # the lowest item of all is the lowest queried one
    # Materialised, as both ends of its pairs meet many rows.
    pairs = materialize(pairs.select("class", F.col("item").alias("head"), "d2"), "class-pairs")
    release(items.sparkSession, heads)
    found = members.select("head", "item")
    if lowest:
        found = members.groupBy("head", lowest[0]).agg(F.min("item").alias("item"), F.min_by(lowest[1], "item").alias(lowest[1]))
    near = pairs.join(found, "head").select("class", "item", *(lowest or ()), "d2")
    near._gapweave_path, near._gapweave_rows = pairs._gapweave_path, pairs.count()
    return members.where(F.col("item") % step == 0).select(F.col("item").alias("q"), "class"), near


def all_pairs(items: DataFrame, item: str, vector: str, radius: float, length: int | None = None, distinct: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The result of ``radius_pairs``, by classes of equal vectors as ``class_pairs`` has them, each two of which are joined to their items once."""
    members, heads, pairs = _vector_classes(items, item, vector, radius, length, 1, distinct)
    half = materialize(pairs.where("q < item").select(F.col("q").alias("h1"), F.col("item").alias("h2"), "d2"), "vector-pairs")
    release(items.sparkSession, heads)
    ends = [members.select(F.col("head").alias(f"h{i}"), F.col("item").alias(f"i{i}")) for i in (1, 2)]
    met = half.join(ends[0], "h1").join(ends[1], "h2")
    both = met.select(F.inline(F.array(F.struct(F.col("i1").alias("q"), F.col("i2").alias("item"), "d2"), F.struct(F.col("i2").alias("q"), F.col("i1").alias("item"), "d2"))))
    equal = ends[0].join(ends[1], F.col("h1") == F.col("h2")).select(F.col("i1").alias("q"), F.col("i2").alias("item"), F.lit(0.0).alias("d2"))
    return both.unionByName(equal)


def of_classes(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of classes (class, ...) as rows of the queried items (q, ...) in them."""
    return queries.join(rows, "class").drop("class")


def named(near: DataFrame) -> DataFrame:
    """The second table of ``class_pairs`` with q, the name of a class, in place of class."""
    out = near.withColumnRenamed("class", "q")
    out._gapweave_path, out._gapweave_rows = near._gapweave_path, near._gapweave_rows
    return out


def _auto(items: DataFrame, item: str, vector: str, radius: float, length: int | None, step: int) -> DataFrame:
    if length is not None and cell_share(items, vector, length, radius) < GRID_SHARE:
        return grid_pairs(items, item, vector, length, radius, step)
    return radius_pairs(items, item, vector, radius, step)


#: The known ways, in order of preference; ``auto`` measures the spread and takes ``grid`` or ``block``; ``topk20`` keeps the 20 nearest of each query. ``fine`` is ``grid`` with
#: smaller cells and more rows, for radii of a tenth of the spread. More may be added.
BACKENDS: dict[str, Backend] = {
    "auto": Backend(_auto, True),
    "block": Backend(lambda df, i, v, r, n, step: radius_pairs(df, i, v, r, step), True),
    "grid": Backend(_grid, True),
    "fine": Backend(_fine, True),
    "topk20": Backend(lambda df, i, v, r, n, step: nearest(radius_pairs(df, i, v, r, step), 20), True),
    "lsh": Backend(lambda df, i, v, r, n, step: lsh_pairs(df, i, v, r).where(F.col("q") % step == 0), False),
}


def neighbours(items: DataFrame, item: str, vector: str, radius: float, backend: str = "auto", length: int | None = None, step: int = 1) -> DataFrame:
    """Neighbours (q, item, d2) by a named backend; an unknown name is an error."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; there are {', '.join(BACKENDS)}")
    return BACKENDS[backend].find(items, item, vector, radius, length, step)


def class_neighbours(items: DataFrame, item: str, vector: str, radius: float, backend: str = "auto", length: int | None = None, step: int = 1, lowest: tuple[str, str] | None = None) -> DataFrame:
    """Neighbours (q, item, d2) as of ``neighbours``, for the lowest queried item of each class of equal vectors only.

    What the first query tells of a neighbourhood can be had from these. An exact backend compares different vectors only,
    on the lattice if they lie on one, and all but ``topk20`` take ``lowest`` as ``class_pairs`` does.
    """
    if backend not in BACKENDS or not BACKENDS[backend].exact:
        return neighbours(items, item, vector, radius, backend, length, step)
    find = "block" if backend == "topk20" else backend
    lowest = None if backend == "topk20" else lowest
    near = named(class_pairs(items, item, vector, radius, length, step, lambda v: neighbours(v, "item", "v", radius, find, length), lowest)[1])
    return nearest(near, 20) if backend == "topk20" else near
