"""Token ids of a whole corpus by a public byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.runtime import materialize

#: Fixed value: the public pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A blank or line feed right after a character that is no white space. No alternative of PATTERN
#: matches across such a place, so a pre-token starts there whatever came before.
_RESYNC = re.compile(r"(?<=\S)[ \n]")


def cuts(text: str, size: int, overlap: int | None = None) -> list[int] | None:
    """Places that divide ``text`` into pieces of about ``size`` characters at pre-token boundaries.

    Each piece runs on beyond ``size`` to the first place where boundaries resynchronise. With
    ``overlap`` given, that place must lie within so many characters, else the result is None.
    """
    out, at = [], size
    while at < len(text):
        m = _RESYNC.search(text, at, len(text) if overlap is None else min(len(text), at + overlap))
        if m is None:
            return out if overlap is None or at + overlap >= len(text) else None
        out.append(m.start())
        at = m.start() + size
    return out


def encoder(vocabulary: bytes):
    """A tiktoken encoding of the ranks in ``vocabulary``, without special tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str, size: int) -> np.ndarray:
    """Ids of ``text``, encoded in pieces of about ``size`` characters and joined."""
    if len(text) <= size:
        return enc.encode_to_numpy(text)
    places = [0, *cuts(text, size), len(text)]
    return np.concatenate([enc.encode_to_numpy(text[a:b]) for a, b in zip(places, places[1:], strict=False)])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def token_ids(
    documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY,
    piece_chars: int = 8192, spread_chars: int = 1_000_000, overlap_chars: int = 65_536,
) -> DataFrame:
    """One row (key, ids) per document: the token ids of its text, without special tokens.

    Texts are cut into pieces of ``piece_chars`` or a little more, at the first place where pre-token
    boundaries resynchronise whatever came before; the pieces' ids, joined, are those of the whole text.
    Texts longer than ``spread_chars`` are also spread over tasks: chunks that overlap by
    ``overlap_chars`` are encoded in parallel, each from its first resynchronisation point to the first
    one past its end, and joined in order. If an overlap holds no such point (one unbroken run of
    characters), that document is encoded in a single task instead.

    Defined cases: null and empty texts give an empty list. Strings of special tokens are ordinary text.
    Repeated rows, and rows with a null or repeated key, each give a row, whatever their length: long texts are
    written out with a number of their own, by which their chunks are joined. Other columns are ignored.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            ids = [encode(enc, t, piece_chars) if t else np.zeros(0, np.uint32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=["_key", "ids"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            ids, open_ = [], []
            for at, last, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                # The place shared with the chunk before lies at 1 or later here, so both see the character before it.
                begin = _RESYNC.search(t, 1, overlap_chars) if at else re.match("", t)
                end = re.search(r"\Z", t) if last else _RESYNC.search(t, spread_chars + 1, spread_chars + overlap_chars)
                open_.append(begin is None or end is None)
                ids.append(np.zeros(0, np.uint32) if open_[-1] else encode(enc, t[begin.start() : end.start()], piece_chars))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(open_), _lists(ids)], names=["_row", "_at", "_open", "ids"])

    schema = f"_key {kind}, ids array<int>"
    length = F.coalesce(F.length("_text"), F.lit(0))
    short = rows.where(length <= spread_chars).mapInArrow(whole, schema)
    long = materialize(rows.where(length > spread_chars).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    if long.isEmpty():
        return short.withColumnRenamed("_key", key)
    chunks = (
        long.select("_row", "_text", F.explode(F.sequence(F.lit(0), length - 1, F.lit(spread_chars))).alias("_at"))
        .select(
            "_row", "_at", (F.col("_at") + spread_chars >= length).alias("_last"),
            F.expr(f"substring(_text, _at + 1, {spread_chars + overlap_chars})").alias("_text"),
        )
        .repartition(F.xxhash64("_row", "_at"))
        .mapInArrow(chunk, "_row long, _at int, _open boolean, ids array<int>")
    )
    joined = chunks.groupBy("_row").agg(
        F.max("_open").alias("_open"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "ids"))), lambda x: x["ids"])).alias("ids")
    )
    joined = materialize(joined, "chunked-ids")
    stitched = joined.where("not _open").join(long.select("_row", "_key"), "_row").select("_key", "ids")
    unbroken = long.join(joined.where("_open").select("_row"), "_row", "left_semi").select("_key", "_text").mapInArrow(whole, schema)
    return short.unionByName(stitched).unionByName(unbroken).withColumnRenamed("_key", key)


def decode(ids: DataFrame, key: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (key, text) per row of ids: the raw bytes of the ids joined and read as UTF-8."""
    with open(vocabulary, "rb") as f:
        shared = ids.sparkSession.sparkContext.broadcast(f.read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(read, f"{key} {dict(ids.dtypes)[key]}, text string")
