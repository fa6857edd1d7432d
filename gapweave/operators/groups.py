"""From neighbours of windows to groups of duplicate files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.runtime import discard, in_parts, materialize, release


def neighbour_reps(pairs: DataFrame, items: DataFrame, file: str = "filename_id", frame: str = "frame") -> DataFrame:
    """The files in the neighbourhood of each query: (q, file, item, frame).

    ``pairs`` has rows (q, item), ``items`` rows (item, file, frame), an item once; ``pairs`` may have file and frame
    already. A file is represented by its lowest item, not its nearest. Neighbourhoods of a single file have no rows.
    """
    known = pairs if {file, frame} <= set(pairs.columns) else pairs.join(items.select("item", file, frame), "item")
    # All that follows is done where the rows of a neighbourhood are.
    known = known.select("q", file, "item", frame).repartition("q")
    reps = known.groupBy("q", file).agg(F.min("item").alias("item"), F.min_by(frame, "item").alias(frame))
    return reps.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("q"))).where("_n > 1").drop("_n")


def written_reps(pairs: DataFrame, items: DataFrame, file: str = "filename_id") -> DataFrame:
    """``neighbour_reps`` as a written table, made in parts if ``pairs`` tells of many rows; it is deleted."""
    out = in_parts(pairs, "q", getattr(pairs, "_gapweave_rows", 0), "representatives", lambda part: neighbour_reps(part, items, file))
    release(pairs.sparkSession, pairs)
    return out


def file_pairs(reps: DataFrame, file: str = "filename_id", frame: str | None = None) -> DataFrame:
    """Pairs of different files in a neighbourhood: (q, file1, file2, item1, item2), file1 below file2.

    A neighbourhood holds only what lies within the radius of one window. With ``frame`` both frames come too.
    """
    extra = [frame] if frame else []
    a = reps.select("q", F.col(file).alias("file1"), F.col("item").alias("item1"), *[F.col(c).alias(f"{c}1") for c in extra])
    b = reps.select("q", F.col(file).alias("file2"), F.col("item").alias("item2"), *[F.col(c).alias(f"{c}2") for c in extra])
    return a.join(b, "q").where("file1 < file2")


def without_whitelisted(pairs: DataFrame, whitelist: DataFrame, id1: str = "id1", id2: str = "id2") -> DataFrame:
    """Pairs that the whitelist lacks, whichever way round it holds them; null ids in it allow nothing."""
    allowed = whitelist.where(F.col(id1).isNotNull() & F.col(id2).isNotNull())
    allowed = allowed.select(F.least(id1, id2).alias("file1"), F.greatest(id1, id2).alias("file2")).distinct()
    return pairs.join(allowed, ["file1", "file2"], "left_anti")


def first_reports(pairs: DataFrame) -> DataFrame:
    """Each pair at the first query that shows it: (q, file1, file2)."""
    return pairs.groupBy("file1", "file2").agg(F.min("q").alias("q")).select("q", "file1", "file2")


#: Rows of neighbourhoods for each task of ``first_pairs``, and the fewest and most tasks. A neighbourhood goes to every
#: task that has a file of it, so few are better.
FIRST_ROWS, FIRST_TASKS = 1_000_000, (12, 2000)


def _firsts(batches: Iterator[pa.RecordBatch], ends: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (q, files, mine) to the first q of each pair of a file in mine and a greater one of the same row.

    With ``ends`` the files of these pairs come instead, once for each q: (q, file).
    """
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    q, files, mine = (table[c].combine_chunks() for c in ("q", "files", "mine"))
    q = q.to_numpy()
    at, mine_at = (np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for x in (files, mine))
    numbers = np.unique(q)
    names, codes = np.unique(files.flatten().to_numpy(), return_inverse=True)
    own = np.searchsorted(names, mine.flatten().to_numpy())
    row = np.repeat(np.arange(len(q)), np.diff(mine_at))
    order = np.lexsort((-q[row], own))
    own, row = own[order], row[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
    # The rows of a file are gone through from the greatest q, so that the least is what stays.
    none = np.iinfo(np.int64).min
    first, out, held = np.full(len(names), none), [], 0
    seen: list[np.ndarray] = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        parts = [codes[at[r] : at[r + 1]] for r in row[lo:hi]]
        for r, part in zip(row[lo:hi], parts, strict=True):
            first[part] = q[r]
        touched = np.flatnonzero(first != none) if 16 * sum(map(len, parts)) > len(names) else np.unique(np.concatenate(parts))
        later = touched[np.searchsorted(touched, own[lo], "right") :]
        out.append((first[later], np.full(len(later), names[own[lo]]), names[later]))
        first[touched] = none
        held += len(later)
        if ends:
            if held > 1_000_000 or hi == len(own):
                at_q, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                at_q = np.searchsorted(numbers, at_q) * len(names)
                seen = [np.unique(np.concatenate([*seen, at_q + np.searchsorted(names, a), at_q + np.searchsorted(names, b)]))]
                out, held = [], 0
        elif held > 50_000 or hi == len(own):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["q", "file1", "file2"])
            out, held = [], 0
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(numbers[seen[0] // len(names)]), pa.array(names[seen[0] % len(names)])], names=["q", "file"])


#: Members of file classes up to this many rows are sent to every task that expands pairs of classes.
MEMBER_ROWS = 1_000_000


def file_classes(rows: DataFrame, file: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files that have the same rows are one class, named by the least of them: (file, class, n, place), and the rows of the classes.

    ``rows`` holds (file, *columns), no row twice; its files are told apart by the number of their rows and two hashes over
    them. Of the rows those of the naming files stay, with the class in place of the file, and n, the files of the class.
    The files of a class have places from 0.
    """
    kind = [F.count(F.lit(1)), F.bit_xor(F.xxhash64(*columns)), F.bit_xor(F.xxhash64(F.lit(1), *columns))]
    kinds = rows.groupBy(file).agg(F.struct(*[x.alias(f"k{i}") for i, x in enumerate(kind)]).alias("_kind"))
    named = kinds.groupBy("_kind").agg(F.min(file).alias("class"), F.collect_list(file).alias("_files"))
    members = materialize(named.select(F.posexplode("_files").alias("place", file), "class", F.size("_files").alias("n")).select(file, "class", "n", "place"), "file-classes")
    heads = members.where(F.col(file) == F.col("class")).select("class", "n")
    return members, rows.withColumnRenamed(file, "class").join(heads, "class").select("class", *columns, "n")


def pairs_of_classes(pairs: DataFrame, members: DataFrame, file: str) -> DataFrame:
    """Pairs of classes (class1, class2, ...), each once in either order, as pairs of their files (file1, file2, ...).

    A pair of a class with itself stands for all pairs of its files.
    """
    rest = [c for c in pairs.columns if c not in ("class1", "class2")]
    small = members.count() <= MEMBER_ROWS
    a, b = (members.select(F.col("class").alias(f"class{i}"), F.col(file).alias(f"_f{i}")) for i in (1, 2))
    a, b = (F.broadcast(a), F.broadcast(b)) if small else (a, b)
    met = pairs.join(a, "class1").join(b, "class2").where("class1 <> class2 or _f1 < _f2")
    return met.select(F.least("_f1", "_f2").alias("file1"), F.greatest("_f1", "_f2").alias("file2"), *rest)


#: Bits of a word of ``hidden_places``, and pairs of files that one task of ``allowed_pairs`` should form.
WORD, PAIRS_PER_TASK = 62, 1_000_000


def hidden_places(whitelist: DataFrame, members: DataFrame, file: str) -> DataFrame:
    """For each file the places in each class that its whitelisted partners have: (a, other, word, bits), a bit per place.

    Pairs count whichever way round the whitelist holds them, once however often; null ids in it allow nothing.
    """
    pairs = whitelist.where("id1 is not null and id2 is not null and id1 <> id2").select(F.col("id1").cast("long").alias("x"), F.col("id2").cast("long").alias("y"))
    known = members.select(F.col(file).alias("y"), F.col("class").alias("other"), "place")
    known = F.broadcast(known) if members.count() <= MEMBER_ROWS else known
    both = pairs.select(F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))))
    placed = both.join(known, "y").select(F.col("x").alias("a"), "other", F.expr(f"place div {WORD}").cast("int").alias("word"), F.expr(f"shiftleft(1L, place % {WORD})").alias("bit"))
    return placed.groupBy("a", "other", "word").agg(F.bit_or("bit").alias("bits"))


def allowed_ends(pairs: DataFrame, members: DataFrame, file: str, whitelist: DataFrame) -> DataFrame:
    """The files (q, file) of the pairs that pairs of classes (q, class1, class2) stand for, without the whitelisted pairs.

    A file stays if fewer of its partners in the other class are whitelisted than there are.
    """
    hidden = hidden_places(whitelist, members, file).groupBy("a", "other").agg(F.sum(F.bit_count("bits")).alias("hidden"))
    both = pairs.select("q", F.col("class1").alias("class"), F.col("class2").alias("other"))
    both = both.unionByName(both.where("class <> other").select("q", F.col("other").alias("class"), F.col("class").alias("other")))
    sizes = members.where(F.col(file) == F.col("class")).select(F.col("class").alias("other"), F.col("n").alias("partners"))
    met = both.join(sizes, "other").join(members.select("class", F.col(file).alias("a")), "class").join(hidden, ["a", "other"], "left")
    return met.where("coalesce(hidden, 0) < partners - if(class = other, 1, 0)").select("q", F.col("a").alias(file)).distinct()


def allowed_pairs(pairs: DataFrame, members: DataFrame, file: str, whitelist: DataFrame) -> DataFrame:
    """Pairs of classes (q, class1, class2) as pairs of their files (q, file1, file2), without the whitelisted ones."""
    hidden = hidden_places(whitelist, members, file).groupBy("a", "other").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("hidden"))
    sizes = members.where(F.col(file) == F.col("class")).select("class", "n")
    sized = pairs.join(sizes.select(F.col("class").alias("class1"), F.col("n").alias("n1")), "class1").join(sizes.select(F.col("class").alias("class2"), F.col("n").alias("n2")), "class2")
    total = sized.agg(F.sum(F.col("n1").cast("long") * F.col("n2"))).first()[0] or 0
    left = pairs.select("q", F.col("class1").alias("class"), F.col("class2").alias("other")).join(members.select("class", F.col(file).alias("a")), "class")
    left = left.join(hidden, ["a", "other"], "left").repartition(int(min(max(12, total // PAIRS_PER_TASK), 20_000)), "a", "other")
    partners = members.select(F.col("class").alias("other"), F.col(file).alias("b"), "place")
    partners = F.broadcast(partners) if members.count() <= MEMBER_ROWS else partners
    met = left.join(partners, "other").where("class <> other or a < b")
    met = met.where(f"coalesce(shiftright(try_element_at(hidden, cast(place div {WORD} as int)), place % {WORD}) & 1, 0) = 0")
    return met.select("q", F.least("a", "b").alias("file1"), F.greatest("a", "b").alias("file2"))


def first_classes(reps: DataFrame, file: str = "filename_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of the same neighbourhoods as classes (file, class, n, place), their rows (q, class, n), and these laid out for ``_firsts``."""
    rows = materialize(reps.where(F.col("q").isNotNull() & F.col(file).isNotNull()).select(F.col("q").cast("long").alias("q"), F.col(file).cast("long").alias("f")).distinct(), "neighbourhoods")
    members, rows = file_classes(rows, "f", ["q"])
    members, rows = members.withColumnRenamed("f", file), materialize(rows.select("q", "class", "n"), "class-neighbourhoods")
    tasks = int(min(max(FIRST_TASKS[0], rows.count() // FIRST_ROWS), FIRST_TASKS[1]))
    lists = rows.groupBy("q").agg(F.array_sort(F.collect_list("class")).alias("files"))
    mine = rows.groupBy("q", F.pmod(F.xxhash64("class"), F.lit(tasks)).cast("int").alias("task")).agg(F.collect_list("class").alias("mine"))
    return members, rows, mine.join(lists, "q").repartitionById(tasks, "task").select("q", "files", "mine")


def first_class_pairs(reps: DataFrame, file: str = "filename_id") -> tuple[DataFrame, DataFrame]:
    """Classes of files (file, class, n, place), and the pairs of classes at their first neighbourhood (q, class1, class2)."""
    members, rows, placed = first_classes(reps, file)
    # The files of one class first meet in the first neighbourhood of the class.
    alike = rows.where("n > 1").groupBy("class").agg(F.min("q").alias("q")).select("q", F.col("class").alias("class1"), F.col("class").alias("class2"))
    found = placed.mapInArrow(_firsts, "q long, file1 long, file2 long").withColumnsRenamed({"file1": "class1", "file2": "class2"})
    return members, found.unionByName(alike)


def first_pairs(reps: DataFrame, file: str = "filename_id", ends: bool = False) -> DataFrame:
    """The result of ``first_reports`` of ``file_pairs``, without forming the pairs of every neighbourhood: (q, file1, file2).

    ``reps`` has rows (q, file), ids being of an integer type. Files of the same neighbourhoods are one class. The pairs of
    a class are all found in the task that it falls to, which marks its partners from the last neighbourhood to the first.
    With ``ends`` the result is that of ``endpoints`` of these pairs: (q, file).
    """
    if ends:
        members, rows, placed = first_classes(reps, file)
        found = placed.mapInArrow(partial(_firsts, ends=True), "q long, file long").withColumnRenamed("file", "class")
        found = found.unionByName(rows.where("n > 1").groupBy("class").agg(F.min("q").alias("q")).select("q", "class")).distinct()
        return found.join(members, "class").select("q", file)
    members, found = first_class_pairs(reps, file)
    return pairs_of_classes(found, members, file).select("q", "file1", "file2")


def endpoints(pairs: DataFrame, file: str = "filename_id") -> DataFrame:
    """The files of the pairs of each query, once each: (q, file)."""
    return pairs.select("q", F.explode(F.array("file1", "file2")).alias(file)).distinct()


def duplicate_groups(reps: DataFrame, pairs: DataFrame, files: DataFrame | None = None, file: str = "filename_id", frame: str = "frame") -> DataFrame:
    """Groups of duplicates: (q, file, item, frame), and offset in seconds if ``files`` (file, fps) is given.

    Each pair is reported once, at its first query; a query's group holds the files of the pairs it reports,
    so a pair that is whitelisted does not keep its files out of pairs with others.
    """
    return grouped(reps, endpoints(first_reports(pairs), file), files, file, frame)


def grouped(reps: DataFrame, members: DataFrame, files: DataFrame | None = None, file: str = "filename_id", frame: str = "frame") -> DataFrame:
    """Groups of duplicates, as ``duplicate_groups`` has them, from the files (q, file) of the pairs each query reports."""
    out = members.join(reps, ["q", file]).select("q", file, "item", frame)
    if files is None:
        return out
    return out.join(files.select(file, "fps"), file).select("q", file, "item", frame, (F.col(frame) / F.col("fps")).alias("offset"))


def component_labels(edges: DataFrame, scope: str, a: str, b: str, node: str = "node") -> DataFrame:
    """Connected components within each scope: (scope, node, label), the label being the least node.

    Labels travel along edges and from label to label until none changes; every round is written out.
    Nodes without an edge have no row; null ends link nothing.
    """
    clean = edges.where(F.col(scope).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(scope).alias("s"), F.col(a).alias("x"), F.col(b).alias("y"))
    links = materialize(clean.unionByName(clean.select("s", F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = materialize(links.groupBy("s", "x").agg(F.min("y").alias("m")).select("s", "x", F.least("x", "m").alias("label")), "labels")
    while True:
        near = links.join(labels.select("s", F.col("x").alias("y"), "label"), ["s", "y"]).groupBy("s", "x").agg(F.min("label").alias("m"))
        jumped = labels.select("s", F.col("x").alias("label"), F.col("label").alias("up"))
        step = labels.join(near, ["s", "x"], "left").join(jumped, ["s", "label"], "left")
        nxt = materialize(step.select("s", "x", F.least("label", "m", "up").alias("label"), (F.least("label", "m", "up") < F.col("label")).alias("moved")), "labels")
        moved = not nxt.where("moved").isEmpty()
        discard(labels)
        path = nxt._gapweave_path
        labels = nxt.drop("moved")
        labels._gapweave_path = path
        if not moved:
            discard(links)
            return labels.select(F.col("s").alias(scope), F.col("x").alias(node), "label")


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (s, x, y) to fewer edges, which connect the same nodes within each s."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    s, x, y = (table[c].combine_chunks().to_numpy() for c in ("s", "x", "y"))
    scopes, s = np.unique(s, return_inverse=True)
    names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    nodes, ends = np.unique(np.concatenate([s, s]) * len(names) + ends, return_inverse=True)
    x, y = ends[: len(s)], ends[len(s) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (scopes[nodes[rest] // len(names)], names[nodes[label[rest]] % len(names)], names[nodes[rest] % len(names)])], names=["s", "x", "y"])


def forest(edges: DataFrame, scope: str, a: str, b: str) -> DataFrame:
    """Fewer edges (scope, a, b) that connect the same nodes within each scope: each task keeps one edge per node that it links.

    Ids are of an integer type; edges with a null are left out.
    """
    clean = edges.where(F.col(scope).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    clean = clean.select(*[F.col(c).cast("long").alias(n) for c, n in ((scope, "s"), (a, "x"), (b, "y"))])
    return clean.mapInArrow(_forests, "s long, x long, y long").select(F.col("s").alias(scope), F.col("x").alias(a), F.col("y").alias(b))


def verified_groups(reps: DataFrame, scored: DataFrame, threshold: float, file: str = "filename_id", frame: str = "frame") -> DataFrame:
    """Groups of pairs whose score reaches the threshold: (q, label, file, item, frame).

    ``scored`` has rows (q, file1, file2, score). An accepted pair counts at the first query that accepts it,
    and a query's pairs fall into connected components; files left single are dropped.
    """
    return labelled_groups(reps, first_reports(scored.where(F.col("score") >= threshold)), file, frame)


def labelled_groups(reps: DataFrame, accepted: DataFrame, file: str = "filename_id", frame: str = "frame") -> DataFrame:
    """Groups as ``verified_groups`` has them, from accepted pairs that occur once, at their first query."""
    links = forest(accepted, "q", "file1", "file2")
    labelled = component_labels(links, "q", "file1", "file2", file)
    return labelled.join(reps, ["q", file]).select("q", "label", file, "item", frame)


def labelled_classes(reps: DataFrame, accepted: DataFrame, classes: DataFrame, file: str = "filename_id", frame: str = "frame") -> DataFrame:
    """Groups as ``labelled_groups`` has them, from accepted pairs of classes (q, class1, class2) and the classes (file, class).

    Every file of one class is linked with every file of the other, so classes fall into components as their files do, and
    as a class is named by its least file, the least class is the least file.
    """
    clean = accepted.where("class1 <> class2")
    labels = component_labels(forest(clean, "q", "class1", "class2"), "q", "class1", "class2", "class")
    alone = accepted.where("class1 = class2").select("q", F.col("class1").alias("class"), F.col("class1").alias("label"))
    labels = labels.unionByName(alone).groupBy("q", "class").agg(F.min("label").alias("label"))
    labelled = labels.join(classes.select(F.col("file").alias(file), "class"), "class").select("q", file, "label")
    return labelled.join(reps, ["q", file]).select("q", "label", file, "item", frame)


def verify_counts(scored: DataFrame, threshold: float) -> DataFrame:
    """How many pair occurrences are checked and rejected: one row.

    A pair is checked at every query up to and including the first that accepts it, and not after.
    """
    w = Window.partitionBy("file1", "file2")
    marked = scored.withColumn("_first", F.min(F.when(F.col("score") >= threshold, F.col("q"))).over(w))
    seen = marked.where(F.col("_first").isNull() | (F.col("q") <= F.col("_first")))
    return seen.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("score") < threshold).alias("rejected"))


def class_verify_counts(scored: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """The result of ``verify_counts`` from pairs of classes (q, file1, file2, score) and the queries of classes (q, class).

    A class is named by its first query, and its other queries show the same pairs with the same scores. Where ``scored``
    has a column n, a row stands for n pairs of files, which occur together at all their queries.
    """
    scored = scored if "n" in scored.columns else scored.withColumn("n", F.lit(1).cast("long"))
    firsts = first_reports(scored.where(F.col("score") >= threshold)).withColumnRenamed("q", "first")
    marked = scored.join(firsts, ["file1", "file2"], "left").where("first is null or q <= first")
    rejected = (F.col("score") < threshold).alias("rejected")
    kinds = materialize(marked.groupBy(F.col("q").alias("class"), "first", rejected).agg(F.sum("n").alias("n")), "verified")
    seen = kinds.join(queries, "class").where("first is null or q <= first")
    out = seen.agg(F.sum("n").alias("checked"), F.sum(F.when(F.col("rejected"), F.col("n"))).alias("rejected"))
    return out.select(F.coalesce("checked", F.lit(0)).cast("long").alias("checked"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


def keep_saved_groups(saved: DataFrame, readable: DataFrame, whitelist: DataFrame, group: str, file: str) -> DataFrame:
    """Saved groups that still matter: members that are readable, in groups of two or more that are not wholly whitelisted.

    ``saved`` has rows (group, file, ...); ``readable`` holds the files that can be read. A group is wholly
    whitelisted if every pair of its files is. Rows that repeat a file count once for this.
    """
    alive = saved.join(readable.select(file).distinct(), file, "left_semi")
    members = alive.select(group, file).distinct()
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # n (n - 1) / 2 pairs against the whitelisted ones among them; the whitelist, not the group, sets the work.
    allowed = whitelist.where("id1 is not null and id2 is not null and id1 <> id2").select(F.least("id1", "id2").alias("x"), F.greatest("id1", "id2").alias("y")).distinct()
    within = (
        allowed.join(members.select(F.col(group), F.col(file).alias("x")), "x")
        .join(members.select(F.col(group), F.col(file).alias("y")), [group, "y"])
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    kept = sizes.join(within, group, "left").where(F.coalesce("_w", F.lit(0)) < F.col("_n") * (F.col("_n") - 1) / 2).select(group)
    return alive.join(kept, group, "left_semi")
