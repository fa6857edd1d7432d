"""Passages of held-out texts inside a training corpus, found by winnowed fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators.skew import many_join
from gapweave.runtime import materialize

_COMMAND = re.compile(r"\\[a-z]*")
_GAP = re.compile(rb"[^a-z0-9]")
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Characters hashed at once; bounds the memory of a task whatever the size of its texts.
AT_ONCE = 1_000_000


def _hash_words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each part, and the part each word is from."""
    buffer = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    word = _WORD[buffer]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    places = np.flatnonzero(word)
    bounds = np.searchsorted(places, starts)
    lengths = np.diff(np.append(bounds, len(places)))
    offset = np.arange(len(places)) - np.repeat(bounds, lengths)
    powers = _powers(_BASE, int(lengths.max()))
    hashes = np.add.reduceat(buffer[places].astype(np.uint64) * powers[offset], bounds)
    return _mix(hashes + lengths.astype(np.uint64)), np.searchsorted(ends, starts, side="right")


def word_hashes(texts: list[str | None], at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, in order, and the text each word is from.

    Words are the runs of a-z and 0-9 in lower case, after every backslash and the letters right after
    it have become a blank. Long texts are hashed piece by piece, cut where no word is.
    """
    found, of, parts, ids, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal size
        if parts:
            h, p = _hash_words(parts)
            found.append(h)
            of.append(np.asarray(ids, np.int64)[p])
        parts.clear()
        ids.clear()
        size = 0

    for i, t in enumerate(texts):
        plain = _COMMAND.sub(" ", t.lower()).encode("ascii", "replace") if t else b""
        at = 0
        while at < len(plain):
            end = at + at_once
            if end < len(plain):
                gap = _GAP.search(plain, end)
                end = gap.start() if gap else len(plain)
            parts.append(plain[at:end])
            ids.append(i)
            size += end - at
            at = end
            if size >= at_once:
                flush()
    flush()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(of)


def fingerprints(words: np.ndarray, text: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints: (hash, place of the first word), the least gram hash of each window.

    A window holds ``span - gram + 1`` successive grams of one text, so any ``span`` words that two
    texts share yield a fingerprint they share.
    """
    n = len(words) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = grams * _STEP + words[j : j + n]
    grams = _mix(grams)
    window = span - gram + 1
    m = n - window + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, at = grams[:m].copy(), np.arange(m)
    for j in range(1, window):
        less = grams[j : j + m] < low
        low[less] = grams[j : j + m][less]
        at[less] = np.flatnonzero(less) + j
    inside = text[:m] == text[span - 1 : span - 1 + m]
    at = np.unique(at[inside])
    return grams[at], at


def contexts(words: np.ndarray, text: np.ndarray, at: np.ndarray, gram: int, span: int) -> np.ndarray:
    """The words around each gram, ``span - gram`` to either side; those beyond the text are unlike all others."""
    reach = span - gram
    index = at[:, None] + np.arange(-reach, gram + reach)[None]
    ok = (index >= 0) & (index < len(words))
    index = np.clip(index, 0, max(len(words) - 1, 0))
    ok &= text[index] == text[at][:, None]
    return np.where(ok, words[index], np.uint64(0))


def spans_match(a: np.ndarray, b: np.ndarray, gram: int, span: int) -> np.ndarray:
    """Whether the words around two equal grams share ``span`` successive words that hold the gram."""
    reach = span - gram
    same = (a == b) & (a != 0)
    middle = same[:, reach : reach + gram].all(1)
    left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(1)
    right = np.cumprod(same[:, reach + gram :], axis=1).sum(1)
    return middle & (left + right >= span - gram)


def _prints(df: DataFrame, key: str, text: str, gram: int, span: int) -> DataFrame:
    """Rows (key, hash, context) of all winnowed fingerprints of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, of = word_hashes(b.column(1).to_pylist())
            hashes, at = fingerprints(words, of, gram, span)
            around = contexts(words, of, at, gram, span)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of[at])), pa.array(hashes.view(np.int64)), pa.array([x.tobytes() for x in around], pa.binary())],
                names=["_key", "_hash", "_around"],
            )

    return df.select(F.col(key).alias("_key"), F.col(text)).mapInArrow(run, f"_key {dict(df.dtypes)[key]}, _hash long, _around binary")


#: Held-out texts up to so many characters in all are sent to every task; more are joined by a shuffle.
BROADCAST_CHARS = 20_000_000


def leaks(
    corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str,
    span: int = 12, gram: int = 8, broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """Pairs (key, item) of a corpus text and a held-out text that share ``span`` successive words.

    Both sides are winnowed alike: of each window of ``span - gram + 1`` successive ``gram``-word grams
    the least hash is kept. Every shared run of ``span`` words then has a fingerprint in common, and each
    hit is extended word by word to either side. Words are compared by 64-bit hashes. The held-out side
    is measured first: up to ``broadcast_chars`` characters its fingerprints go to all tasks, and a corpus
    task passes on hits alone; beyond that the fingerprints of both sides meet in a shuffle join.

    Defined cases: null, empty and short texts (below ``span`` words) match nothing. A pair comes once,
    however many passages it shares and however often its rows repeat. Null keys are left out. Empty
    tables give an empty result; other columns are ignored.
    """
    spark = corpus.sparkSession
    corpus = corpus.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    items = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(item, item_text)
    kind, item_kind = dict(corpus.dtypes)[key], dict(items.dtypes)[item]
    prints = _prints(items, item, item_text, gram, span).withColumnRenamed("_key", "_item")
    if (items.agg(F.sum(F.length(item_text))).first()[0] or 0) > broadcast_chars:
        # Grams that many texts share are cut into pieces; a text's repeated passages count once.
        mine = materialize(_prints(corpus, key, text, gram, span).distinct(), "corpus-prints")
        theirs = materialize(prints.withColumnRenamed("_around", "_other").distinct(), "item-prints")
        pairs = many_join(mine, theirs, ["_hash"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a, o = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, 2 * span - gram) for i in (2, 3))
                ok = spans_match(a, o, gram, span) if b.num_rows else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["_key", "_item"])

        hits = pairs.select("_key", "_item", "_around", "_other").mapInArrow(verify, f"_key {kind}, _item {item_kind}")
    else:
        known = prints.toArrow()
        hashes = known["_hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        around = np.frombuffer(b"".join(known["_around"].to_pylist()), np.uint64).reshape(len(hashes), 2 * span - gram)[order]
        shared = spark.sparkContext.broadcast((hashes[order], around, known["_item"].combine_chunks().take(pa.array(order))))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sought, sought_around, ids = shared.value
            for b in batches:
                words, of = word_hashes(b.column(1).to_pylist())
                found, at = fingerprints(words, of, gram, span)
                low, high = np.searchsorted(sought, found), np.searchsorted(sought, found, side="right")
                hit = np.flatnonzero(high > low)
                n = (high - low)[hit]
                mine = np.repeat(hit, n)
                theirs = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ok = np.zeros(0, bool)
                if len(mine):
                    ok = spans_match(contexts(words, of, at[mine], gram, span), sought_around[theirs], gram, span)
                mine, theirs = mine[ok], theirs[ok]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[at[mine]])), ids.take(pa.array(theirs))], names=["_key", "_item"])

        hits = corpus.mapInArrow(probe, f"_key {kind}, _item {item_kind}")
    return hits.distinct().select(F.col("_key").alias(key), F.col("_item").alias(item))
