"""Alignment of two tokenizers' tokens over whole texts.

Each text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B), both over
space + text. Tokens of A and B are the nodes of a bipartite graph whose edges are overlaps of
their byte ranges. Union-find joins them: the components are exactly the smallest groups of
whole tokens that cover the same bytes, and the edges of a component are its links.

The pairs that documents hold are counted without a row per occurrence: a task tells, for each
of `parts` parts of the A ids, one row with the distinct pairs of a chunk of documents, packed.
A part's rows are summed some chunks at a time, its last sums tell each A id's highest, and
answer the chunks in the order of their entries; a chunk's documents look their links up
there. A pair that every document holds costs each chunk one entry.

Null and empty texts, and those whose tokens don't spell space + text, have no tokens: zeros
and an empty digest column. Rows that repeat an id or a text are judged each by itself and
count each; a null id is kept. Columns besides doc_id and text are unused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, shuffle_partitions, staged, unpack

FOLDER = "/opt/tokenizers"
#: Characters of the documents that share a chunk and what a document counts besides; pairs that a part holds of a chunk, about; chunks summed at a time.
CHUNK_BYTES, ROW_BYTES, PART_ENTRIES, FAN = 8 << 20, 100, 1 << 14, 256
#: Texts encoded at a time.
BATCH = 128
#: How a byte-level BPE of this kind splits text before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """What both vocabularies say: encoders, and bytes and lengths of each id's token."""

    def __init__(self, bpe: bytes, pieces: bytes):
        told, alphabet = json.loads(bpe), byte_alphabet()
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        n = self.pieces.get_piece_size()
        ids = range(n)
        b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(self.pieces.id_to_piece, ids))]
        a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a[i] = token
        self.bytes_a, self.bytes_b, self.n_b = a, b, n
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of each text; none where their bytes aren't space + text."""
        none = np.zeros(0, np.int64)
        for text, b in zip(texts, self.pieces.encode([t or "" for t in texts], num_threads=1)):
            if not text:
                yield none, none
                continue
            a = self.bpe.encode_ordinary(" " + text)
            whole = b" " + text.encode()
            if b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b]):
                yield np.array(a, np.int64), np.array(b, np.int64)
            else:
                yield none, none


@lru_cache(2)
def _tokens(bpe: bytes, pieces: bytes) -> Tokens:
    return Tokens(bpe, pieces)


def overlaps(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all tokens of A and B that share a byte, in text order."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    first = np.searchsorted(end_b, end_a - length_a, "right")
    n = np.searchsorted(end_b, end_a, "left") - first + 1
    i = np.repeat(np.arange(len(length_a)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def united(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0 to n - 1 with edges (x, y): the least node of each node's component."""
    parent = np.arange(n)
    while len(x):
        a, b = parent[x], parent[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:  # paths are halved until they have one step
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
        apart = parent[x] != parent[y]
        x, y = x[apart], y[apart]
    return parent


_DIGITS = 10 ** np.arange(1, 7)


def spelled(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: decimal ids of A and B by group, in order."""
    n_groups = int(group_a[-1]) + 1
    ends_a, ends_b = np.cumsum(np.bincount(group_a, minlength=n_groups)), np.cumsum(np.bincount(group_b, minlength=n_groups))
    ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.concatenate(([0], ends_b))[group_a]] = a
    ids[np.arange(len(b)) + ends_a[group_b]] = b
    after[ends_a + np.concatenate(([0], ends_b[:-1])) - 1] = ord("|")
    after[ends_a + ends_b - 1] = ord(";")
    n = 1 + np.searchsorted(_DIGITS, ids, "right")
    ends = np.cumsum(n + 1) - 1
    out = np.empty(int(ends[-1]) + 1, np.uint8)
    out[ends] = after
    for k in range(int(n.max())):
        held = n > k
        out[ends[held] - 1 - k] = ids[held] % 10 + ord("0")
        ids //= 10
    return out[:-1].tobytes()


def aligned(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j) and the number of each token's group, by order, for A's and B's tokens."""
    i, j = overlaps(length_a, length_b)
    root = united(len(a) + len(b), i, j + len(a))
    # A group's least node is its first token of A, so groups are numbered in text order.
    number = np.cumsum(root[: len(a)] == np.arange(len(a))) - 1
    return i, j, number[root[: len(a)]], number[root[len(a) :]]


_PART = [("part", pa.int32()), ("chunk", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary()), ("highest", pa.binary())]
_PART_SQL = "part int, chunk bigint, pairs binary, times binary, highest binary"
_DOC = [("kind", pa.int8()), ("chunk", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
_DOC_SQL = "kind tinyint, chunk bigint, part int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def _batch(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    values = list(zip(*rows)) or [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns)], names=[c for c, _ in columns])


def _packed(pairs: np.ndarray) -> bytes:
    return pack(pairs.astype(np.uint32), True)


def _aligned(bpe, pieces, parts: int):
    """Documents -> a row each, with its distinct pairs and how often it links them, and rows of each chunk's pairs by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _tokens(bpe.value, pieces.value)
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, []

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            part = pairs // told.n_b % parts  # all pairs of an A id in one part
            order = np.argsort(part, kind="stable")
            cuts = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
            pairs, n = pairs[order], n[order]
            return _batch(_DOC, [(1, chunk, p, *[None] * 6, _packed(pairs[x:y]), pack(n[x:y])) for p, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if y > x])

        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                some, rows = batch.slice(begin, BATCH), []
                texts = some.column("text").to_pylist()
                for doc_id, text, (a, b) in zip(some.column("doc_id").to_pylist(), texts, told.encode(texts)):
                    if not len(a):
                        rows.append((0, chunk, None, doc_id, 0, 0, 0, 0, "", b"", b""))
                        size += ROW_BYTES
                        continue
                    i, j, group_a, group_b = aligned(a, b, told.length_a[a], told.length_b[b])
                    pairs, times = np.unique(a[i] * told.n_b + b[j], return_counts=True)
                    digest = hashlib.sha256(spelled(a, b, group_a, group_b)).hexdigest()
                    rows.append((0, chunk, None, doc_id, len(a), len(b), int(group_a[-1]) + 1, len(i), digest, _packed(pairs), pack(times.astype(np.uint32))))
                    held.append(pairs)
                    size += ROW_BYTES + len(text)
                yield _batch(_DOC, rows)
                if size > CHUNK_BYTES:
                    if held:
                        yield counted()
                    chunk, size, held = chunk + 1, 0, []
        if held:
            yield counted()

    return run


def _summed(n_b: int, last: bool):
    """Rows (part, chunk, pairs, times) of one part -> one row: its pairs and their sums, at last also which are the highest of their A id."""

    def run(table: pa.Table) -> pa.Table:
        pairs = np.concatenate([unpack(p, np.uint32, True) for p in table.column("pairs").to_pylist()])
        every, at = np.unique(pairs, return_inverse=True)
        n = np.zeros(len(every), np.int64)
        np.add.at(n, at, np.concatenate([unpack(t, np.int64) for t in table.column("times").to_pylist()]))
        own = every // n_b
        begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        best = n == np.repeat(np.maximum.reduceat(n, begins), np.diff(np.append(begins, len(own))))
        row = (table.column("part")[0].as_py(), table.column("chunk")[0].as_py(), _packed(every), pack(n), best.tobytes() if last else None)
        return pa.Table.from_batches([_batch(_PART, [row])])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and salt, each part's sums before its chunks -> each chunk's pairs with their sums."""
    every = n = highest = None
    for batch in batches:
        rows = []
        for chunk, pairs, times, best in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "times", "highest"))):
            if best is not None:
                every, n, highest = unpack(pairs, np.uint32, True), unpack(times, np.int64), np.frombuffer(best, bool)
            else:
                at = np.searchsorted(every, unpack(pairs, np.uint32, True))
                rows.append((None, chunk, pairs, pack(n[at]), highest[at].tobytes()))
        yield _batch(_PART, rows)


def counted(entries: DataFrame, n_b: int) -> DataFrame:
    """entries (part, chunk, pairs, times of the chunk's documents) -> chunk, pairs, times of all documents, highest.

    Chunks' counts are summed FAN at a time, turn by turn, so no task holds all chunks of a part, and
    a part's chunks ask for sums in as many places.
    """
    n = entries.select("chunk").distinct().count()
    sums, left = entries.withColumn("highest", F.lit(None).cast("binary")), n
    while True:
        left = -(-left // FAN)
        place = F.pmod(F.xxhash64("chunk"), F.lit(max(1, left)))
        sums = sums.groupBy("part", place.alias("_place")).applyInArrow(_summed(n_b, left <= 1), _PART_SQL)
        if left <= 1:
            break
        sums = staged(sums, "sums")
    salts = max(1, -(-n // FAN))
    told = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("asks", F.lit(0))
    asked = entries.withColumns({"highest": F.lit(None).cast("binary"), "salt": F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"), "asks": F.lit(1)})
    dealt = told.unionByName(asked).repartition("part", "salt").sortWithinPartitions("part", "salt", "asks")
    return dealt.select("chunk", "pairs", "times", "highest").mapInArrow(_answers, _PART_SQL).drop("part")


_OUT = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
_OUT_SQL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _looked_up(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a chunk with what their links count."""
    join = lambda column, of: np.concatenate([np.zeros(0, of(b"").dtype), *map(of, answers.column(column).to_pylist())])
    pairs = join("pairs", lambda x: unpack(x, np.uint32, True))
    counts, highest = join("times", lambda x: unpack(x, np.int64)), join("highest", lambda x: np.frombuffer(x, bool))
    order = np.argsort(pairs)
    pairs, counts, highest = pairs[order], counts[order], highest[order]
    n_best, count_sum = [], []
    for own, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist()):
        at, times = np.searchsorted(pairs, unpack(own, np.uint32, True)), unpack(times, np.uint32).astype(np.int64)
        n_best.append(int(times[highest[at]].sum()))
        count_sum.append(int((times * counts[at]).sum()))
    out = docs.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.select([c for c, _ in _OUT])


def align(docs: DataFrame, bpe: str = f"{FOLDER}/byte_bpe_50k.json", pieces: str = f"{FOLDER}/piece_bpe_32k.model") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best is of links whose pair is in the most documents of all pairs of its A id, count_sum
    the documents of each link's pair, summed. bpe and pieces are vocabulary files that the
    driver reads; tasks get their bytes, some megabytes at any size of docs.
    """
    spark = docs.sparkSession
    files = []
    for path in (bpe, pieces):
        with open(path, "rb") as f:
            files.append(spark.sparkContext.broadcast(f.read()))
    n_b = sentencepiece.SentencePieceProcessor(model_proto=files[1].value).get_piece_size()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # A chunk tells some hundred thousand pairs, at most one every four characters.
    parts = max(shuffle_partitions(spark), CHUNK_BYTES // 4 // PART_ENTRIES)
    told = staged(texts.mapInArrow(_aligned(*files, parts), _DOC_SQL), "aligned")
    answers = counted(told.filter("kind = 1").select("part", "chunk", "pairs", "times"), n_b)
    rows = told.filter("kind = 0").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_looked_up, _OUT_SQL)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
