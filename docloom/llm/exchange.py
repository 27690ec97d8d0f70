"""Counting n-grams of a whole corpus without shuffling a row per occurrence.

Documents are dealt to chunks by a digest of the row. A task hashes the words of one chunk
with numpy and sends, to each of P parts of the hash space, one row with the chunk's
distinct grams packed as byte planes: a gram that every document holds costs each chunk one
entry, so hot grams cannot overload a part, and counts are combined before the shuffle.
A part's answers go back to the chunks in the order of their entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rolling, shuffle_partitions

#: Bytes of text of one chunk, and of entries (8 bytes each) of one part.
CHUNK_BYTES = 8 << 20
PART_BYTES = 8 << 20
#: Rows of a chunk, and bytes of text of the chunks or parts that one shuffle partition holds.
CHUNK_ROWS, PLACE_BYTES = 100_000, 64 << 20


@dataclass(frozen=True)
class Layout:
    chunks: int
    parts: int
    places: int


def layout(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> Layout:
    """Chunks, parts and shuffle partitions for docs by the bytes of their texts."""
    found = docs.agg(F.sum(F.octet_length("text").cast("bigint")), F.count("*")).first()
    total, few = found[0] or 0, shuffle_partitions(docs.sparkSession)
    return Layout(max(1, -(-total // chunk_bytes), -(-found[1] // CHUNK_ROWS)), max(2 * few, -(-total // part_bytes)), max(few, -(-total // PLACE_BYTES)))


def dealt(docs: DataFrame, chunks: int, *keep: str) -> DataFrame:
    """chunk, doc_id, text as bytes (null: empty) and the columns of keep."""
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *keep,
    )


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def split_texts(texts: pa.ChunkedArray | pa.Array) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of each text and where each text's words end in their concatenation."""
    lists = [t.split() for t in texts.to_pylist()]
    return lists, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))


def flat(lists: list[list[bytes]]) -> list[bytes]:
    return [w for words in lists for w in words]


def grams_of(hashes: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and row of each n consecutive words that lie within one text."""
    rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    grams = rolling(hashes, n)
    starts = np.flatnonzero(rows[: len(grams)] == rows[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], starts, rows[starts]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: ascending hashes have ascending parts."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def slices(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of each part with entries in ascending hashes."""
    if len(hashes):
        at = part_of(hashes, parts)
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(at)])).tolist()):
            yield int(at[a]), a, b
