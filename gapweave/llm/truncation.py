"""Texts that stop before their proper end, by a backward character model whose contexts know what markup is open."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gapweave.operators.skew import heavy_keys, lookup_join
from gapweave.runtime import materialize

# ---------------------------------------------------------------------------------------------------
# Text before its stop
# ---------------------------------------------------------------------------------------------------

_DAMAGE = str.maketrans({"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\xa0": " ", "\u200b": "", "\ufeff": "", "\xad": "", "\r": "\n"})
#: Marks without words: broken characters, dots of omission, bare or bracketed, and a line set between two rules.
_MARK = re.compile(
    r"(?:\s|\ufffd|\u2026|\.{3}|[\[(<]\s*(?:\.{2,}|\u2026)\s*[\])>]"
    r"|(?<![^\n])[ \t]*(?<![\w\\&])[-=*_~#]{2,}[ ]?[^\W\d_][^\n]*?[ ]?[-=*_~#]{2,}[ \t]*)\Z",
)
_BRACKET = r"[\[(<][^\[\](){}<>\n\\$]{1,80}[\])>]"
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_DRAFT = re.compile(r"\\iffalse(?![a-zA-Z]).*?(?:\\fi(?![a-zA-Z])|\Z)", re.DOTALL)
_OPEN_DRAFT = re.compile(r"\\iffalse(?![a-zA-Z])((?:(?!\\fi(?![a-zA-Z])).)*)\Z", re.DOTALL)


def without_marks(text: str, notice: bool = False) -> str:
    """The text without white space, omission marks, broken characters and ruled lines after its stop.

    ``notice`` tells that the bracket at its very end is a notice, which goes too.
    """
    t = text.rstrip()
    if notice:
        t = t[: max(t.rfind(c) for c in "[(<")].rstrip()
    while m := _MARK.search(t, t.rfind("\n") + 1):
        t = t[: m.start()].rstrip()
    return t


def parts(text: str, notice: bool = False) -> tuple[str, str, bool]:
    """(text, comments, whether the stop is in a comment) of what stands before the stop.

    The text has neither comments nor drafts; both go to the comments, one to a line.
    """
    t = text.replace("\r\n", "\n")
    t = without_marks(t.replace("\r", "\n") if t.isascii() else t.translate(_DAMAGE), notice)
    if "%" not in t and "\\iffalse" not in t:
        return t, "", False
    notes = [m[0] for m in _COMMENT.finditer(t)]
    inside = _COMMENT.search(t, t.rfind("\n") + 1) is not None
    main = _COMMENT.sub("", t)
    if "\\iffalse" in main:
        draft = _OPEN_DRAFT.search(main)
        notes += [m[0][8:] for m in _DRAFT.finditer(main)]
        if draft and not inside:
            inside = bool(draft[1].strip())
        main = _DRAFT.sub("", main)
    return main.rstrip(), "\n".join(notes).rstrip(), inside and bool(notes)


# ---------------------------------------------------------------------------------------------------
# What is open at each place
# ---------------------------------------------------------------------------------------------------

#: States of a place: nothing open; in the document environment, in another, in a formula, in braces, in braces of an
#: earlier paragraph, in a comment; and with nothing open, right after the end of an environment, of a displayed
#: formula, of a line that is one command, of an entry, or anywhere after the end of the document.
(PLAIN, IN_DOCUMENT, IN_ENVIRONMENT, IN_FORMULA, IN_BRACES, IN_EARLIER_BRACES, IN_COMMENT,
 AFTER_ENVIRONMENT, AFTER_FORMULA, AFTER_COMMAND, AFTER_ENTRY, AFTER_DOCUMENT) = range(12)
_STATES = 12
_TOKEN = re.compile(r"\\(begin|end)\s*\{([^{}\n]*)\}|\\([\[\]()])|(\$\$)|\\[a-zA-Z]+|\\.|([{}$])|(\n[ \t]*\n)", re.DOTALL)
_COMMAND_LINE = re.compile(
    r"^[ \t]*\\(?:(?:re)?newcommand(?![a-zA-Z])[^\n]*\}|DeclareMathOperator(?![a-zA-Z])[^\n]*\}|def\s*\\[^\n]*\}"
    r"|[a-zA-Z]+\*?(?:\[[^\]\n]*\])*(?:\{[^{}\n]*\})+|endinput|fi)[ \t]*$", re.MULTILINE,
)
_INK = re.compile(r"\S")


def place_states(text: str) -> np.ndarray:
    """The state after each character of a text without comments."""
    starts, kinds = [0], [PLAIN]  # from which place on, which state
    stack: list[str] = []
    inner = depth = earlier = 0  # environments but the document's, braces, and braces of earlier paragraphs
    inline = display = entry = False

    def turn(at: int, after: int = PLAIN) -> None:
        """Note the state from a place on; where nothing is open, it is ``after`` up to the next character that shows."""
        if inner:
            state = IN_ENVIRONMENT
        elif inline or display:
            state = IN_FORMULA
        elif depth:
            state = IN_BRACES
        elif earlier:
            state = IN_EARLIER_BRACES
        else:
            state = IN_DOCUMENT if stack else after
        if state != kinds[-1] or starts[-1] > at:
            starts.append(max(at, starts[-1]))
            kinds.append(state)
        if state == after != PLAIN:
            ink = _INK.search(text, at + 1)
            starts.append(ink.start() if ink else len(text))
            kinds.append(PLAIN)

    for m in _TOKEN.finditer(text):
        kind = m.lastindex
        if kind is None:
            continue
        at, after = m.end() - 1, PLAIN
        if kind == 2:
            name = m[2].strip()
            if not (inner or inline or display):
                # A name in its braces; one that breaks off there looks the same.
                starts.append(max(m.start(2) - 1, starts[-1]))
                kinds.append(IN_BRACES)
            if m[1] == "begin":
                stack.append(name)
                inner += name != "document"
            elif name == "document":
                starts.append(max(at, starts[-1]))
                kinds.append(AFTER_DOCUMENT)
                break
            else:
                while name in stack:
                    gone = stack.pop()
                    inner -= gone != "document"
                    if gone == name:
                        break
                inline, depth, after = False, 0, AFTER_ENVIRONMENT
        elif kind == 6:
            # A blank line ends what was left open of an inline formula; braces may go on.
            if not inline and (entry or not depth):
                continue
            inline = False
            if not entry:
                earlier, depth = earlier + depth, 0
        else:
            sign = m[kind]
            if sign == "{":
                if not depth:
                    entry = text[text.rfind("\n", 0, at) + 1 : at].lstrip().startswith("@")
                depth += 1
            elif sign == "}":
                if depth:
                    depth -= 1
                elif earlier:
                    earlier -= 1
                if entry and not depth:
                    entry, after = False, AFTER_ENTRY
            elif sign == "$":
                inline = not inline
            elif sign in ("(", ")"):
                inline = sign == "("
            elif sign == "[" or (sign == "$$" and not display):
                display = True
            else:
                display, after = False, AFTER_FORMULA
        turn(at, after)
    out = np.repeat(np.array(kinds, np.uint8), np.diff(np.array([*starts, len(text)])))
    if "\\" in text:
        for m in _COMMAND_LINE.finditer(text):
            if out[m.end() - 1] in (PLAIN, IN_EARLIER_BRACES):
                ink = _INK.search(text, m.end())
                out[m.end() - 1 : ink.start() if ink else len(text)] = AFTER_COMMAND
    return out


def command_names(text: str, states: np.ndarray) -> list[tuple[int, int, str]]:
    """The stretches of a text that stand after a line that is one command, with the start of the command's name."""
    at = np.flatnonzero(states == AFTER_COMMAND)
    if not len(at):
        return []
    out = []
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        line = text.rfind("\n", 0, int(run[0])) + 1
        out.append((int(run[0]), int(run[-1]) + 1, text[line : run[0] + 1].lstrip()[1 : 1 + LONGEST]))
    return out


# ---------------------------------------------------------------------------------------------------
# The backward character model
# ---------------------------------------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Code points to classes: a-z each, capitals, digits, ASCII signs each, white space, and letters by script."""
    table = np.full(0x10000, 63, np.uint8)
    for i in range(26):
        table[ord("a") + i] = i + 1
    table[ord("A") : ord("Z") + 1] = 27
    table[ord("0") : ord("9") + 1] = 28
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    for i, c in enumerate(signs):
        table[c] = 29 + i
    table[[9, 10, 11, 12, 13]] = 61
    table[[32, 0xA0]] = 62
    table[0xC0:0x250] = 64
    table[0x370:0x530] = 65
    table[0x3040:0xA000] = 66
    table[[0x3002, 0xFF01, 0xFF1F]] = 67
    table[[0x3001, 0xFF0C, 0xFF1B]] = 68
    return table


_CLASS = _classes()
_KINDS = 69
_BARE = np.isin(np.arange(_STATES), [AFTER_ENVIRONMENT, AFTER_FORMULA, AFTER_ENTRY, AFTER_DOCUMENT])
#: A context is the state of a place and the classes of its last characters. Contexts have numbers of their own, one
#: for each, so the model's size is bounded by the alphabet and does not grow with the corpus.
LONGEST = 3
CONTEXTS = _STATES * _KINDS**LONGEST


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CLASS[np.minimum(points, 0xFFFF)]


def contexts(texts: list[str], states: list[np.ndarray]) -> np.ndarray:
    """The number of the longest context of each place of several texts, one after another.

    Divided by the classes it is that of a shorter context. Places before the third of a text have a 0 for what is not there.
    Right after something has been closed, and after the document, the state is all that counts; after a command, the
    start of its name counts instead of the last characters.
    """
    codes = _codes("".join(texts)).astype(np.int32)
    out = np.concatenate([np.zeros(0, np.uint8), *states]).astype(np.int32)
    lengths = np.array([len(x) for x in states], np.int64)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    for k in range(LONGEST):
        out *= _KINDS
        out[k:] += codes[: len(codes) - k]
        for j in range(k):  # what the shift brought over from the text before
            at = starts + j
            at = at[at < len(codes)]
            at = at[lengths[lengths > 0][: len(at)] > j]
            out[at] -= np.where(at >= k, codes[np.maximum(at - k, 0)], 0)
    bare = _BARE[out // _KINDS**LONGEST]
    out[bare] -= out[bare] % _KINDS**LONGEST
    begin = 0
    for text, own in zip(texts, states, strict=True):
        for a, b, name in command_names(text, own) if own.any() else ():
            number = AFTER_COMMAND
            for c in (*_codes(name).tolist(), 0, 0, 0)[:LONGEST]:
                number = number * _KINDS + c
            out[begin + a : begin + b] = number
        begin += len(own)
    return out


def comment_states(comments: str) -> np.ndarray:
    return np.full(len(comments), IN_COMMENT, np.uint8)


def tally(places: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Add the counts of different contexts to a list of (contexts, counts)."""
    if len(places) < CONTEXTS // 4:
        held.append(np.unique(places, return_counts=True))
    else:
        n = np.bincount(places, minlength=CONTEXTS)
        met = np.flatnonzero(n)
        held.append((met, n[met]))
    if sum(len(x) for x, _ in held) > CONTEXTS // 4 and len(held) > 1:
        held[:] = [summed(held)]


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    numbers, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return numbers, np.bincount(of, np.concatenate([n for _, n in held])).astype(np.int64)


def shorter(context: str, order: int) -> Column:
    """The number of the context of ``order`` characters within a longest one."""
    return F.floor(F.col(context) / F.lit(_KINDS ** (LONGEST - order))).cast("int")


#: Characters worked on together; bounds the memory of a task.
AT_ONCE = 2_000_000
#: Ends that the estimate of a shorter context counts for in that of a longer one.
STRENGTH = 2.0
#: Bins of log-odds among which thresholds are sought, and texts' worth of all languages that each language gets.
BIN, LOW, HIGH, SHARED = 0.25, -1.0, 2.0, 50.0
#: Up to so many contexts go to every task; more meet the stops in a join with the hot ones split off.
BROADCAST_ROWS = 500_000


def valley(bins: np.ndarray, counts: np.ndarray) -> float:
    """The middle of the emptiest stretch of a histogram of log-odds between ``LOW`` and ``HIGH``."""
    grid = np.arange(round(LOW / BIN), round(HIGH / BIN) + 1)
    near = np.array([counts[np.abs(bins - g + 0.5) < 3].sum() for g in grid])
    least = np.flatnonzero(near == near.min())
    runs = np.split(least, np.flatnonzero(np.diff(least) > 1) + 1)
    longest = max(runs, key=len)
    return float(grid[longest[0]] + grid[longest[-1]]) / 2 * BIN


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def notices(rows: DataFrame, text: str) -> DataFrame:
    """Bracketed endings of texts that are notices, by their use: (_ending).

    A bracket of words at the very end is one if, digits apart, it ends two or more texts that say different things
    before it, and stands at the end at least as often as elsewhere in the corpus.
    """
    ends = rows.select(ending(text).alias("_ending"), F.xxhash64(F.right(F.rtrim(text, F.lit(" \t\r\n")), F.lit(120))).alias("_before")).where("_ending <> ''")
    often = materialize(ends.groupBy("_ending").agg(F.count(F.lit(1)).alias("_ends"), F.count_distinct("_before").alias("_ways")).where("_ways > 1"), "endings")
    if often.isEmpty():
        return often.select("_ending")
    found = rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(_BRACKET), 0)).alias("_x")).select(plain_ending(F.col("_x")).alias("_ending"))
    places = found.groupBy("_ending").agg(F.count(F.lit(1)).alias("_all"))
    return materialize(often.join(places, "_ending").where("2 * _ends >= _all").select("_ending"), "notices")


def plain_ending(bracket: Column) -> Column:
    return F.regexp_replace(F.lower(bracket), "[0-9]+", "0")


def ending(text: str) -> Column:
    """The bracket with a letter in it that ends a text, or an empty string."""
    tail = F.right(F.rtrim(text, F.lit(" \t\r\n")), F.lit(82))
    return F.when(tail.rlike(r"[\])>]$"), plain_ending(F.regexp_extract(tail, rf"({_BRACKET})$", 1))).otherwise("")


def truncated(documents: DataFrame, key: str, text: str, source: str, language: str) -> DataFrame:
    """One row per text: (key, source, language, odds, threshold, truncated).

    A backward character model is trained on the whole corpus. The context of a place is what markup is open there
    (environment, formula, braces, comment, or what has just been closed) and the last characters, up to three, in
    classes. For every context the model counts how often a text ends there, marks and notices after the stop
    taken off, the text judged left out, and how often there is such a place at all: for shorter contexts over all languages, for the longest also
    within the text's own. The log-odds of an end against going on, above those of any place of the language, are the
    text's ``odds``. Ends of cut texts fall on any place and finished ones on few, so odds come in two heaps; the
    emptiest stretch between them, found for each language with some weight of all, is its ``threshold``, and what
    lies below is truncated. A text that stops in a comment is judged by the comment's end, taken as one or as
    plain text, whichever is likelier, and by the end before it, whichever is less likely; after the end of the document
    a comment does not matter. Markup is read only to know the context; what stands in comments opens and closes
    nothing.

    Every character of every text is counted, in one pass. Counts are formed per partition, and only contexts met are
    passed on, each once: a number bounded by the alphabet, whatever the size of the partition.

    Defined cases: null, empty and blank texts, and texts of marks alone, are not truncated and have null odds. Rows
    without a key are kept; a repeated key has a row each. A null source or language is a group of its own. Other
    columns are ignored.
    """
    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"), F.lower(language).alias("_language"))
    known = notices(rows, "_text")
    if known.isEmpty():
        told = rows.withColumn("_notice", F.lit(False))
    else:
        told = rows.withColumn("_ending", F.coalesce(ending("_text"), F.lit(""))).join(_small(known.withColumn("_notice", F.lit(True))), "_ending", "left")
        told = told.select(*rows.columns, F.coalesce("_notice", F.lit(False)).alias("_notice"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            texts, notice = b.column(1).to_pylist(), b.column(4).to_pylist()
            said = [x or "" for x in b.column(3).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < AT_ONCE:
                    size += len(texts[to] or "")
                    to += 1
                part = b.slice(at, to - at)
                yield rows_of(part.column(0), part.column(2), part.column(3), *block(texts[at:to], notice[at:to], said[at:to], counts))
                at = to
        for language_, held in counts.items():
            numbers, n = summed(held)
            nothing = [None] * len(n)
            yield rows_of(pa.array(nothing, key_type), pa.array(nothing, pa.string()), pa.array([language_] * len(n), pa.string()), n, numbers)

    def block(texts: list[str | None], notice: list[bool], said: list[str], counts: dict) -> tuple[list[int], list[int | None], list[int | None], list[int | None]]:
        """Lengths and contexts of the ends of some texts; the contexts of all their places are added to the counts."""
        lengths: list[int] = []
        ends: list[int | None] = [None] * len(texts)
        notes: list[int | None] = [None] * len(texts)
        plain: list[int | None] = [None] * len(texts)
        of: dict[str, list[tuple[int, str, str, bool]]] = {}
        for i, t in enumerate(texts):
            main, comments, inside = parts(t, notice[i]) if t else ("", "", False)
            lengths.append(len(main) + len(comments))
            if main or comments:
                of.setdefault(said[i], []).append((i, main, comments, inside))
        for name, several in of.items():
            pieces = [x for _, main, comments, _ in several for x in (main, comments)]
            states = [f(x) for _, main, comments, _ in several for f, x in ((place_states, main), (comment_states, comments))]
            places = contexts(pieces, states)
            last = np.cumsum([len(x) for x in pieces]) - 1
            for j, (i, main, comments, inside) in enumerate(several):
                ends[i] = int(places[last[2 * j]]) if main else None
                if inside and not (main and states[2 * j][-1] == AFTER_DOCUMENT):
                    notes[i] = int(places[last[2 * j + 1]])
                    line = comments[comments.rfind("\n") + 1 :].lstrip("% \t")
                    plain[i] = int(contexts([line], [place_states(line)])[-1]) if line else None
            tally(places, counts.setdefault(name, []))
        return lengths, ends, notes, plain

    def rows_of(keys: pa.Array, sources: pa.Array, languages: pa.Array, lengths, ends, notes=None, plain=None) -> pa.RecordBatch:
        """Rows of texts, or without ``notes`` of counts: how many places there are of the context in _end."""
        columns = [pa.array([notes is None] * len(keys)), keys, sources, languages, pa.array(lengths, pa.int64()), pa.array(ends, pa.int32())]
        columns += [pa.array([None] * len(keys) if x is None else x, pa.int32()) for x in (notes, plain)]
        return pa.RecordBatch.from_arrays(columns, names=["_count", "_key", "_source", "_language", "_length", "_end", "_note", "_plain"])

    key_type = to_arrow_type(documents.schema[key].dataType)
    schema = f"_count boolean, _key {kind}, _source string, _language string, _length long, _end int, _note int, _plain int"
    scanned = materialize(told.mapInArrow(scan, schema), "stops")
    stops = scanned.where("not _count").withColumn("_said", F.coalesce("_language", F.lit("")))
    ends = stops.select("_said", F.explode(F.array("_end", "_note")).alias("_context")).where("_context is not null")
    ends = materialize(ends.groupBy("_said", "_context").agg(F.count(F.lit(1)).alias("_ends")), "end-contexts")
    places = scanned.where("_count").groupBy(F.col("_language").alias("_said"), F.col("_end").alias("_context")).agg(F.sum("_length").alias("_all"))
    places = materialize(places, "places")
    # One row per language and longest context, with the counts of all contexts within it.
    model = ends.join(places.withColumnRenamed("_all", "_alls"), ["_said", "_context"], "left")
    model = model.withColumnRenamed("_ends", "_endss")
    for k in range(LONGEST + 1):
        own = ends.groupBy(shorter("_context", k).alias(f"_c{k}")).agg(F.sum("_ends").alias(f"_e{k}"))
        all_ = places.groupBy(shorter("_context", k).alias(f"_c{k}")).agg(F.sum("_all").alias(f"_a{k}"))
        model = model.withColumn(f"_c{k}", shorter("_context", k)).join(own.join(all_, f"_c{k}", "left"), f"_c{k}").drop(f"_c{k}")
    base = stops.where("_end is not null or _note is not null").groupBy("_said").agg(F.count(F.lit(1)).alias("_texts"), F.sum("_length").alias("_places"))
    model = model.join(base.select("_said", (F.col("_texts") / F.greatest(F.col("_places"), F.col("_texts") + 1)).alias("_base")), "_said")
    p = F.col("_base")
    counted = [(f"_e{k}", f"_a{k}") for k in range(LONGEST + 1)] + [("_endss", "_alls")]
    for i, (e, a) in enumerate(counted):
        weight = F.lit(STRENGTH) / F.greatest(p, F.col("_base"))
        # A text's own end is left out of the counts it is judged by.
        model = model.withColumn(f"_p{i}", (F.col(e) - 1 + weight * p) / (F.greatest(F.coalesce(F.col(a), F.lit(0)), F.col(e)) - 1 + weight))
        p = F.col(f"_p{i}")
    odds = F.log(p / (1 - p)) - F.log(F.col("_base") / (1 - F.col("_base")))
    model = materialize(model.select(F.concat_ws(":", "_context", "_said").alias("_at"), odds.alias("_odds")), "model")
    small = model.count() <= BROADCAST_ROWS
    judged = stops
    for place in ("_end", "_note", "_plain"):
        judged = judged.withColumn("_at", F.when(F.col(place).isNotNull(), F.concat_ws(":", place, "_said")))
        if small:
            judged = judged.join(F.broadcast(model), "_at", "left")
        else:
            hot = heavy_keys(judged.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")), "_at", "_n", judged.count())
            judged = lookup_join(judged, model, "_at", "left", hot)
        judged = judged.withColumnRenamed("_odds", f"_odds{place}").drop("_at")
    judged = materialize(judged.select("_key", "_source", "_language", "_said", F.least("_odds_end", F.greatest("_odds_note", "_odds_plain")).alias("_odds")), "odds")
    bins = judged.where("_odds is not null").groupBy("_said", F.floor(F.col("_odds") / BIN).cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    bins = materialize(bins, "odds-bins")
    pooled = bins.groupBy("_bin").agg(F.sum("_n").alias("_n")).toPandas()  # a row per bin that occurs
    share = SHARED / max(1, pooled["_n"].sum())

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([own["_bin"], pooled["_bin"]]), np.concatenate([own["_n"], pooled["_n"] * share])
        return pd.DataFrame({"_said": own["_said"][:1], "_threshold": [valley(*both)]})

    chosen = materialize(bins.groupBy("_said").applyInPandas(choose, "_said string, _threshold double"), "thresholds")
    out = judged.join(_small(chosen), "_said", "left")
    return out.select(
        F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_language").alias("language"), F.col("_odds").alias("odds"), F.col("_threshold").alias("threshold"),
        F.coalesce(F.col("_odds") < F.col("_threshold"), F.lit(False)).alias("truncated"),
    )
