"""An incremental index of everything accepted so far, against which new batches are checked."""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapweave.operators.skew import HEAVY_PARTS, PIECE, heavy_keys, lookup_join, many_join
from gapweave.runtime import Manifests, _fs, discard, discard_part, materialize, release

#: Sets up to this size are ranked and compared in one task; larger ones are split over tasks.
LARGE = 1 << 16


def overlap_needed(na: Column, nb: Column, threshold: float) -> Column:
    """Least overlap of two sets of these sizes whose likeness reaches the threshold (less a rounding guard)."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - 1e-9)


def prefix_length(size: Column, threshold: float) -> Column:
    """Two sets of likeness ``threshold`` share a token among so many of each one's rarest."""
    return size - F.ceil(F.lit(threshold) * size - 1e-9) + 1


def token_order(tokens: DataFrame) -> DataFrame:
    """(token, freq): in how many of the rows (set, token) a token occurs. Fixes the global rare-first order."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


#: The sketch of a set: words of 64 bits, telling on which bits an odd number of its tokens falls.
SKETCH = ("s0", "s1")


def _sketched(by: str) -> dict[str, Column]:
    """The sketches of sets as columns of their tokens' rows."""
    bit = F.pmod(F.xxhash64("token", F.lit(2)), F.lit(64 * len(SKETCH)))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    return {s: F.bit_xor(F.when(F.shiftright(bit, 6) == i, flag).otherwise(F.lit(0).cast("long"))).over(Window.partitionBy(by)) for i, s in enumerate(SKETCH)}


def rare_prefixes(
    tokens: DataFrame, order: DataFrame, threshold: float, large: int = LARGE, heavy: DataFrame | None = None, largest: int | None = None, sketch: bool = False
) -> DataFrame:
    """The prefix of each set in rare-first order: (set, size, token, pos), pos counted from 0.

    ``tokens`` has rows (set, size, token), each token once per set. Tokens that ``order`` lacks count as
    the rarest. Sets of more than ``large`` tokens are ranked in two steps, by slices of the order; ``largest``, the size
    of the largest, tells that there are none. ``heavy`` names
    tokens of so many sets that they are to meet their rank in a broadcast. Other columns are kept. With ``sketch`` the
    sketch of the set comes too, null for sets of more than ``large`` tokens.
    """
    joined = tokens.join(order, "token", "left") if heavy is None else lookup_join(tokens, order, "token", "left", heavy)
    extra = [c for c in tokens.columns if c not in ("set", "size", "token")]
    ranked = joined.select("set", "size", "token", *extra, F.coalesce("freq", F.lit(0)).alias("f"), F.xxhash64("token").alias("h"))
    ordering = ["f", "h", "token"]
    small = ranked.where(F.col("size") <= large).withColumn("pos", F.row_number().over(Window.partitionBy("set").orderBy(*ordering)) - 1)
    small = small.withColumns(_sketched("set")) if sketch else small
    columns = ["set", "size", "token", *extra, F.col("pos").cast("long").alias("pos")]
    words = list(SKETCH) if sketch else []
    if largest is not None and largest <= large:
        return small.select(*columns, *words).where(F.col("pos") < prefix_length(F.col("size"), threshold))
    big = ranked.where(F.col("size") > large).withColumn("slice", F.shiftright("h", 52))
    counts = big.groupBy("set", "f", "slice").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("set").orderBy("f", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("set", "f", "slice", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    big = big.join(offsets, ["set", "f", "slice"]).withColumn(
        "pos", F.col("before") + F.row_number().over(Window.partitionBy("set", "f", "slice").orderBy("h", "token")) - 1
    )
    none = [F.lit(None).cast("long").alias(w) for w in words]
    return small.select(*columns, *words).unionByName(big.select(*columns, *none)).where(F.col("pos") < prefix_length(F.col("size"), threshold))


def meet(probe: DataFrame, postings: DataFrame, threshold: float, piece: int = PIECE, sets: int | None = None) -> DataFrame:
    """Candidate pairs (a, na, b, nb): prefixes share a token, and sizes, positions and sketches allow the threshold.

    Sets differ by at least as many tokens as their sketches by bits.

    A token of more than ``piece`` sets is cut into pieces; where either side has no more than so many ``sets`` in all,
    if that is known, there is none.
    """
    a = probe.select("token", *[F.col(c).alias(f"{n}a") for c, n in (("set", ""), ("size", "n"), ("pos", "p"), *[(w, w) for w in SKETCH])])
    b = postings.select("token", *[F.col(c).alias(f"{n}b") for c, n in (("set", ""), ("size", "n"), ("pos", "p"), *[(w, w) for w in SKETCH])])
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in SKETCH])
    alike = F.coalesce(F.col("na") + F.col("nb") - apart >= 2 * overlap_needed(F.col("na"), F.col("nb"), threshold), F.lit(True))
    allowed = F.lit(1) + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb")) >= overlap_needed(F.col("na"), F.col("nb"), threshold)
    sized = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")
    met = a.join(b, "token") if sets is not None and sets <= piece else many_join(a, b, ["token"], piece)
    return met.where(sized & allowed & alike).select("a", "na", "b", "nb").distinct()


def as_arrays(tokens: DataFrame, large: int = LARGE) -> DataFrame:
    """Rows (set, size, token) as rows (set, size, tokens): one per set of up to ``large`` tokens, several for larger ones."""
    part = F.when(F.col("size") > large, F.pmod(F.xxhash64("token"), F.ceil(F.col("size") / F.lit(large)))).otherwise(0).cast("int")
    return tokens.groupBy("set", "size", part.alias("_part")).agg(F.collect_list("token").alias("tokens")).drop("_part")


def verify(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, large: int = LARGE, largest: int | None = None) -> DataFrame:
    """Candidate pairs (a, na, b, nb) whose exact overlap reaches the threshold; both sides are as ``as_arrays`` gives them.

    Sets of up to ``large`` tokens are compared as arrays, larger ones token by token. ``largest`` is the size of the
    right side's largest set, if known: a pair's sizes differ by the threshold at most, so it may rule out larger ones.
    """
    small = (F.col("na") <= large) & (F.col("nb") <= large)
    compared = pairs.where(small)
    for side, x in ((left, "a"), (right, "b")):
        compared = compared.join(side.where(F.col("size") <= large).select(F.col("set").alias(x), F.col("tokens").alias(f"t{x}")), x)
    compared = compared.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("both"))
    enough = F.col("both") >= overlap_needed(F.col("na"), F.col("nb"), threshold)
    if largest is not None and largest <= large * threshold:
        return compared.where(enough).select("a", "b")
    one_by_one = pairs.where(~small)
    one_by_one = one_by_one.join(left.select(F.col("set").alias("a"), F.explode("tokens").alias("token")), "a")
    one_by_one = one_by_one.join(right.select(F.col("set").alias("b"), F.explode("tokens").alias("token")), ["b", "token"])
    one_by_one = one_by_one.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).cast("int").alias("both"))
    return compared.unionByName(one_by_one).where(enough).select("a", "b")


#: What the index keeps: for each kind of row the column that it is laid out by, and its columns as stored.
_KINDS = {
    "postings": ("token", {"token": "a", "set": "b", "size": "c", "pos": "d", "s0": "e", "s1": "f"}),
    "sets": ("set", {"set": "a", "size": "b", "tokens": "tokens"}),
    "heads": ("x", {"x": "a", "y": "b", "size": "c", "set": "d"}),
    "members": ("class", {"class": "a", "set": "b"}),
    "ids": ("set", {"set": "a"}),
}
_STORED = "a long, b long, c long, d long, e long, f long, tokens array<long>"
#: Batches of fewer rows are joined without looking for heavy tokens, as a task could hold any one's.
SPLIT_FROM = 1_000_000


@dataclass(frozen=True)
class Batch:
    """A batch made ready: its sets with their classes, the tokens of one set per class, and their prefixes."""

    members: DataFrame
    rows: DataFrame
    prefixes: DataFrame
    size: int
    sets: int
    largest: int
    id_buckets: list[int]
    candidates: list[DataFrame] = field(default_factory=list)

    def discard(self) -> None:
        """Delete what was written for the batch; nothing that was found with it may be read any more."""
        release(self.rows.sparkSession, self.members, self.rows, self.prefixes, *self.candidates)


class HistoryIndex:
    """Accepted sets in a folder, as an inverted index of rare-token prefixes partitioned by token.

    Batches have rows (set, size, token), each token once per set. Sets with equal tokens are one class, named by
    the set that came first, and only that one has postings and tokens; so copies cost one small row each.

    ``create`` fixes the token order from a first batch. ``prepare`` ranks a batch; ``probe`` finds the classes
    it repeats; ``append`` adds it. Postings lie in folders by a hash of their token, sets by a hash of their id, and
    so on: each step first finds which of the ``buckets`` its keys fall in, and reads no others. A batch is written as one
    generation by one job and counts from the moment a manifest names it. Of every level of generations ``fan`` are
    merged into one of the next, so that there are few, each set being rewritten a few times in all. When the index
    has grown ``growth``-fold since the order was fixed, which tokens are rare is counted anew and postings are formed
    by the new order, so that a token born since does not stay among the rarest. ``vacuum`` deletes what no
    manifest names any more.
    """

    def __init__(
        self, spark: SparkSession, folder: str, threshold: float = 0.5, buckets: int = 64, fan: int = 4, growth: int = 4, large: int = LARGE, piece: int = PIECE
    ):
        self.spark, self.folder, self.threshold, self.buckets = spark, folder.rstrip("/"), threshold, buckets
        self.fan, self.growth, self.large, self.piece = fan, growth, large, piece
        self._versions = Manifests(spark, f"{self.folder}/manifests")

    # -- storage -----------------------------------------------------------------------------------

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _buckets(self, rows: DataFrame, *columns: str, size: int = 0) -> list[list[int]]:
        """The buckets that the values of columns fall in: at most ``buckets`` numbers each.

        With a ``size`` of many rows for each bucket, all buckets are taken to be touched.
        """
        if size > 100 * self.buckets:
            return [list(range(self.buckets)) for _ in columns]
        row = rows.agg(*[F.collect_set(self._bucket(c)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
        return [sorted(x) for x in row]

    def _stored(self, generations: list[dict], kind: str | None = None) -> DataFrame:
        root = f"{self.folder}/generations"
        paths = [f"{root}/gen={g['name']}" + (f"/kind={kind}" if kind else "") for g in generations if kind is None or kind in g["kinds"]]
        schema = f"{_STORED}, gen string, kind string, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def read(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a kind, of the given buckets only."""
        df = self._stored(self._versions.latest()[1].get("generations", []), kind)
        if buckets is not None:
            df = df.where(F.col("bucket").isin(buckets))
        return df.select(*[F.col(at).alias(c) for c, at in _KINDS[kind][1].items()])

    def _rows(self, kind: str, df: DataFrame) -> DataFrame:
        key, columns = _KINDS[kind]
        stored = {at: F.col(c) for c, at in columns.items()}
        fields = [stored.get(f.split()[0], F.lit(None)).cast(f.split()[1]).alias(f.split()[0]) for f in _STORED.split(", ")]
        return df.select(*fields, F.lit(kind).alias("kind"), self._bucket(key).alias("bucket"))

    def _write(self, rows: DataFrame, level: int) -> dict:
        name = uuid.uuid4().hex[:12]
        path = f"{self.folder}/generations/gen={name}"
        rows.hint("rebalance", "kind", "bucket").write.partitionBy("kind", "bucket").parquet(path)
        fs, hadoop = _fs(self.spark, path)
        kinds = [s.getPath().getName().split("=")[1] for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("kind=")]
        return {"name": name, "level": level, "kinds": kinds}

    def _write_order(self, tokens: DataFrame) -> str:
        name = uuid.uuid4().hex[:12]
        order = token_order(tokens).withColumn("bucket", self._bucket("token"))
        order.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/orders/{name}")
        return name

    def _release(self, rows: int) -> None:
        """Free the disk of the shuffles behind a step over many rows."""
        if rows >= SPLIT_FROM:
            release(self.spark)

    # -- batches -----------------------------------------------------------------------------------

    def create(self, first: DataFrame) -> Batch:
        """Start an empty folder with a first batch, which is returned as ``prepare`` does."""
        number, state = self._versions.latest()
        if state:
            raise ValueError("there is an index already")
        self._versions.put(number + 1, {"generations": [], "order": self._write_order(first), "rows": 0, "sets": 0, "ordered": 0})
        batch = self.prepare(first)
        self.append(batch, unknown=True)
        return batch

    def _prefixes(self, rows: DataFrame, order: str, count: int, largest: int | None = None) -> DataFrame:
        ranks = self.spark.read.schema("token long, freq long, bucket int").parquet(f"{self.folder}/orders/{order}")
        ranks = ranks.where(F.col("bucket").isin(self._buckets(rows, "token", size=count)[0])).drop("bucket")
        heavy = heavy_keys(token_order(rows), "token", "freq", count) if count >= SPLIT_FROM else None
        return rare_prefixes(rows, ranks, self.threshold, self.large, heavy, largest, sketch=True)

    def prepare(self, batch: DataFrame) -> Batch:
        """Find the class of each set of a batch, and the prefixes of its classes by the index's order."""
        digest = batch.groupBy("set").agg(
            F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("token")).alias("x"), F.bit_xor(F.xxhash64("token", F.lit(1))).alias("y")
        )
        digest = materialize(digest, "digests")
        touched = digest.agg(F.collect_set(self._bucket("x")), F.collect_set(self._bucket("set")), F.sum("size"), F.count(F.lit(1)), F.max("size")).first()
        size, many = touched[2] or 0, max(self.piece, (touched[3] or 0) // HEAVY_PARTS)
        same = ["size", "x", "y"]
        groups = digest.groupBy(*same).agg(F.min("set").alias("head"), F.count(F.lit(1)).alias("copies"))
        known = self.read("heads", touched[0]).withColumnRenamed("set", "old").join(groups.select(*same), same)
        named = materialize(groups.join(known, same, "left").select(*same, "head", "copies", F.coalesce("old", "head").alias("class"), F.col("old").isNull().alias("new")), "classes")
        # A class of many copies meets its sets in a broadcast; there are fewer than HEAVY_PARTS of these.
        hot = F.broadcast(named.where(F.col("copies") > many))
        few = digest.join(hot.select(*same), same, "left_anti").join(named.where(F.col("copies") <= many), same)
        members = materialize(digest.join(hot, same).unionByName(few).select("set", "class", "head", "new", *same), "members")
        discard(digest, named)
        heads = members.where(F.col("set") == F.col("head")).select("set", "class", "new")
        large = members.where((F.col("set") == F.col("head")) & (F.col("size") > max(self.piece, size // HEAVY_PARTS))).select("set")
        rows = lookup_join(batch.select("set", "size", "token"), heads, "set", "inner", large)
        rows = materialize(rows.select(F.col("class").alias("set"), "size", "token", "new"), "class-tokens")
        self._release(size)
        prefixes = materialize(self._prefixes(rows, self._versions.latest()[1]["order"], size, touched[4] or 0), "prefixes")
        self._release(size)
        return Batch(members, rows, prefixes, size, touched[3] or 0, touched[4] or 0, sorted(touched[1]))

    def probe(self, batch: Batch) -> DataFrame:
        """Pairs (accepted, new) of classes of likeness at or above the threshold; a class may repeat itself."""
        postings = self.read("postings", self._buckets(batch.prefixes, "token", size=batch.size // 2)[0])
        most = max(batch.sets, self._versions.latest()[1]["sets"])
        pairs = materialize(meet(postings, batch.prefixes, self.threshold, self.piece, most), "candidates")
        batch.candidates.append(pairs)
        self._release(batch.size)
        (touched,) = self._buckets(pairs, "a")
        sets = self.read("sets", touched).join(pairs.select(F.col("a").alias("set")).distinct(), "set", "left_semi")
        mine = as_arrays(batch.rows.join(pairs.select(F.col("b").alias("set")).distinct(), "set", "left_semi"), self.large)
        return verify(pairs, sets, mine, self.threshold, self.large, batch.largest).select(F.col("a").alias("accepted"), F.col("b").alias("new"))

    def within(self, batch: Batch) -> DataFrame:
        """Pairs (a, b), a below b, of different classes of the batch itself of likeness at or above the threshold."""
        pairs = materialize(meet(batch.prefixes, batch.prefixes, self.threshold, self.piece, batch.sets).where("a < b"), "candidates")
        batch.candidates.append(pairs)
        self._release(batch.size)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        sets = as_arrays(batch.rows.join(ends, "set", "left_semi"), self.large)
        return verify(pairs, sets, sets, self.threshold, self.large, batch.largest)

    def members(self, classes: DataFrame) -> DataFrame:
        """The accepted sets of classes: (class, set). ``classes`` has a column class; only its buckets are read."""
        (touched,) = self._buckets(classes, "class")
        return self.read("members", touched).join(classes.select("class").distinct(), "class", "left_semi")

    def set_pairs(self, found: DataFrame, batch: Batch) -> DataFrame:
        """The pairs of sets (accepted, new) that pairs of classes stand for. Call it before the batch is appended."""
        found = materialize(found, "class-pairs")
        old = self.members(found.select(F.col("accepted").alias("class"))).select(F.col("class").alias("accepted"), F.col("set").alias("_old"))
        met = materialize(many_join(found, old, ["accepted"], self.piece).select("_old", "new"), "old-members")
        mine = batch.members.select(F.col("class").alias("new"), F.col("set").alias("_new"))
        return many_join(met, mine, ["new"], self.piece).select(F.col("_old").alias("accepted"), F.col("_new").alias("new"))

    def append(self, batch: Batch, unknown: bool = False) -> None:
        """Add a batch as one generation, by one commit.

        A set id that is there already is refused; with ``unknown`` it is taken to be certain that there is none.
        """
        number, state = self._versions.latest()
        if not unknown and not self.read("ids", batch.id_buckets).join(batch.members.select("set"), "set", "left_semi").isEmpty():
            raise ValueError("a set of the batch has been added before")
        fresh = batch.members.where(F.col("new") & (F.col("set") == F.col("head")))
        parts = {
            "postings": batch.prefixes.where("new"), "sets": as_arrays(batch.rows.where("new"), self.large),
            "heads": fresh.select("x", "y", "size", "set"), "members": batch.members, "ids": batch.members,
        }
        rows = None
        for kind, df in parts.items():
            rows = self._rows(kind, df) if rows is None else rows.unionByName(self._rows(kind, df))
        added = self._write(rows, 0)
        self._release(batch.size)
        size = state["rows"] + batch.size
        state = state | {"generations": [*state["generations"], added], "rows": size, "sets": state["sets"] + batch.sets, "ordered": state["ordered"] or max(1, size)}
        self._versions.put(number + 1, state)
        if state["rows"] >= self.growth * state["ordered"]:
            self._reorder(number + 2, state)
        else:
            self._merge(number + 2, state)

    def _merge(self, number: int, state: dict) -> None:
        """Merge the generations of a level into one of the next where there are ``fan`` of them."""
        for level in sorted({g["level"] for g in state["generations"]}):
            old = [g for g in state["generations"] if g["level"] == level]
            if len(old) >= self.fan:
                merged = self._write(self._stored(old).drop("gen"), level + 1)
                state = state | {"generations": [*[g for g in state["generations"] if g["level"] != level], merged]}
                self._versions.put(number, state)
                number += 1

    def _reorder(self, number: int, state: dict) -> None:
        """Count anew how rare tokens are, and form all postings by the new order."""
        tokens = materialize(self.read("sets").select("set", "size", F.explode("tokens").alias("token")), "all-tokens")
        order = self._write_order(tokens)
        self._release(state["rows"])
        postings = self._rows("postings", self._prefixes(tokens, order, state["rows"]))
        rest = self._stored(state["generations"]).where("kind <> 'postings'").drop("gen")
        level = max(g["level"] for g in state["generations"])
        self._versions.put(number, state | {"generations": [self._write(postings.unionByName(rest), level)], "order": order, "ordered": state["rows"]})
        release(self.spark, tokens)

    def vacuum(self) -> None:
        """Delete generations, orders and manifests that the latest manifest does not name."""
        number, state = self._versions.latest()
        named = {f"gen={g['name']}" for g in state["generations"]} | {state["order"]} | {str(n) for n in self._versions.numbers() if n >= number}
        for part in ("generations", "orders", "manifests"):
            fs, path = _fs(self.spark, f"{self.folder}/{part}")
            for s in fs.listStatus(path):
                if s.getPath().getName() not in named:
                    fs.delete(s.getPath(), True)


def rounds(sizes: list[tuple[int, int]], share: float) -> list[list[int]]:
    """Consecutive batches, given with their sizes, in rounds: the first alone, each later one of at least one batch,
    and of more while it stays within ``share`` of all before it."""
    out: list[list[int]] = []
    before = held = 0
    for batch, size in sizes:
        if len(out) > 1 and held + size <= share * before:
            out[-1].append(batch)
            held += size
        else:
            out.append([batch])
            before, held = before + held, size
    return out


def repeats_between_batches(tokens: DataFrame, batches: DataFrame, index: HistoryIndex, share: float = 2.0, spend: bool = False) -> DataFrame:
    """All pairs (first, second) of set ids of the index's likeness or more, the batch of the first below that of the second.

    An empty ``index`` is created from the lowest batch. The others are prepared, probed and appended in turn, in
    rounds: a round is one batch, or several in a row that together hold no more than ``share`` of what the
    index holds, which are also compared with one another. So a long backlog takes a number of rounds that grows with its
    logarithm; with ``share`` 0 every batch is a round. The result is the same. Pairs of classes become pairs of sets at
    the end. ``tokens`` has rows (set, token), each token once per set; ``batches`` has one row (set, batch) per
    set. Sets with a null batch, and sets missing on one side, take part in nothing. What is written on the way is
    deleted as soon as it has been read for the last time; with ``spend`` also ``tokens``, if ``materialize`` wrote it.
    """
    spark = index.spark
    sizes = materialize(tokens.groupBy("set").agg(F.count(F.lit(1)).alias("size")).join(batches.where("batch is not null and set is not null"), "set"), "sizes")
    held = [tuple(r) for r in sizes.groupBy("batch").agg(F.sum("size")).orderBy("batch").collect()]  # one row per batch ever taken in
    if not held:
        return tokens.select(F.col("set").alias("first"), F.col("set").alias("second")).where(F.lit(False))
    turns = rounds(held, share)
    at = F.create_map(*[F.lit(x) for i, turn in enumerate(turns) for b in turn for x in (b, i)])[F.col("batch")]
    rows = lookup_join(tokens, sizes, "set", "inner", heavy_keys(sizes, "set", "size", sum(n for _, n in held)))
    rows = materialize(rows.withColumn("round", at), "batch-tokens", by="round")
    release(spark, *[tokens] * spend)
    found = []
    for i in range(len(turns)):
        turn = rows.where(F.col("round") == i).select("set", "size", "token")
        if i == 0:
            ready = index.create(turn)
            discard_part(rows, "round", i)
        else:
            ready = index.prepare(turn)
            discard_part(rows, "round", i)
            near = index.probe(ready).toDF("a", "b")
            found.append(materialize(near.unionByName(index.within(ready)) if len(turns[i]) > 1 else near, "repeats"))
            index._release(ready.size)
            index.append(ready, unknown=True)
            index.vacuum()
        ready.discard()
    everyone = materialize(index.read("members").join(sizes.select("set", "batch"), "set"), "all-members")
    pairs = everyone.groupBy("class").agg(F.min("batch").alias("lo"), F.max("batch").alias("hi")).where("lo < hi").select(F.col("class").alias("a"), F.col("class").alias("b"))
    if found:
        pairs = pairs.unionByName(reduce(DataFrame.unionByName, found).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, right = everyone.select(F.col("class").alias("a"), F.col("set").alias("s"), F.col("batch").alias("bs")), everyone.select(F.col("class").alias("b"), F.col("set").alias("t"), F.col("batch").alias("bt"))
    met = materialize(many_join(materialize(pairs, "class-pairs"), left, ["a"], index.piece), "first-members")
    both = many_join(met, right, ["b"], index.piece).where("bs <> bt and (a <> b or bs < bt)")
    earlier = F.col("bs") < F.col("bt")
    return both.select(F.when(earlier, F.col("s")).otherwise(F.col("t")).alias("first"), F.when(earlier, F.col("t")).otherwise(F.col("s")).alias("second"))


def spell(name: str | None) -> str | None:
    """The path that a name spells, in one spelling.

    Letter case, Unicode composition, outer blanks and tabs, ``\\`` for ``/``, repeated separators and ``.``
    segments make no difference; a trailing separator does. Null stays null.
    """
    if name is None:
        return None
    # The two small forms of sigma share a capital; no other letters do without being spelt differently.
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFD", name).lower()).replace("\u03c2", "\u03c3").strip(" \t").replace("\\", "/")
    parts = [p for p in re.split("/+", s) if p not in ("", ".")]
    return ("/" if s.startswith("/") else "") + "/".join(parts) + ("/" if parts and s.endswith("/") else "")


def spelled(column: str) -> Column:
    """``spell`` of a column of names; only names beyond ASCII are handed to Python."""

    def work(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None or x != x else spell(x))

    beyond = F.pandas_udf(work, "string")(F.when(~F.col(column).rlike(r"^[\x00-\x7F]*$"), F.col(column)))
    s = F.translate(F.regexp_replace(F.lower(column), r"^[ \t]+|[ \t]+$", ""), "\\", "/")
    parts = F.filter(F.split(s, "/+"), lambda p: (p != "") & (p != "."))
    slash, none = F.lit("/"), F.lit("")
    plain = F.concat(F.when(s.startswith("/"), slash).otherwise(none), F.array_join(parts, "/"), F.when((F.size(parts) > 0) & s.endswith("/"), slash).otherwise(none))
    return F.coalesce(beyond, plain)


def same_path(files: DataFrame, key: str, name: str, batch: str) -> DataFrame:
    """Pairs (first, second) of files whose names spell the same path, the batch of the first below that of the second."""
    rows = files.where(F.col(key).isNotNull() & F.col(name).isNotNull() & F.col(batch).isNotNull())
    rows = materialize(rows.select(F.col(key).alias("k"), F.col(batch).alias("b"), spelled(name).alias("p")).distinct(), "paths")
    shared = rows.groupBy("p").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("p")
    rows = materialize(rows.join(shared, "p", "left_semi").select("k", "b", "p"), "shared-paths")
    pairs = many_join(rows.toDF("first", "b1", "p"), rows.toDF("second", "b2", "p"), ["p"]).where("b1 < b2")
    return pairs.select("first", "second")


def whole_seconds(gap: Column) -> Column:
    """A finite number rounded down, as a double; numbers of 2^52 or more are whole already."""
    return F.when(F.abs(gap) < float(1 << 52), F.floor(gap).cast("double")).otherwise(gap)


def integer_token(parts: list[Column]) -> Column:
    """One long for three whole numbers: exact from 0 to 2^21 - 1, a negative hash beyond."""
    fits = F.lit(True)
    for p in parts:
        fits = fits & p.between(0, (1 << 21) - 1)
    small = [F.when(fits, p).cast("long") for p in parts]
    packed = F.shiftleft(small[0], 42).bitwiseOR(F.shiftleft(small[1], 21)).bitwiseOR(small[2])
    return F.when(fits, packed).otherwise(F.lit(-1) - F.xxhash64(*parts).bitwiseAND(F.lit((1 << 62) - 1)))
