"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index.

A text's words, A-Z in lower case, form WIDTH-word shingles, repeats included; a text of
fewer words is one shingle, one without words has fingerprint zero and is linked like any
other. Equal fingerprints are one row from then on.

Two fingerprints of at most `distance` differing bits agree in one of distance + 1 segments,
so each fingerprint is dealt once a segment, with its bits turned so that the segment
leads, and sorted by Gray rank: neighbours then share most bits, and a segment's bucket is
one range, which a range partitioning splits wherever it is large. Ranges are cut in blocks.
A block is searched through a tree: a node holds the bits that all fingerprints below it
share and that its parent doesn't hold yet, a query carries the differences met on the way
down, and a node that takes them over the distance goes with its whole group. Blocks of one
bucket meet in pairs, those of whose groups, then of which themselves, the shared bits
are near enough. Nothing leaves a block but a chain through each group of linked
fingerprints, so thousands of copies cost no square of rows.

Null and empty texts have fingerprint zero. Rows may repeat ids or texts; a null id takes
part but names no component unless all its rows are null. Columns besides doc_id and text
are unused. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, staged

WIDTH, DISTANCE, SEED = 3, 2, 42
#: Fingerprints of a block, children of a node, queries that descend at a time; a group has two to the power of GROUP_BITS blocks.
BLOCK, FAN, QUERIES, GROUP_BITS = 4096, 16, 256, 6
#: Places over which rows of one component are spread when they learn its label.
SALTS = 16
#: A fingerprint of more than this share of the rows is joined apart; there are at most 1 / HOT of them.
HOT, HOT_LEAST = 0.001, 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The SimHash of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        octets = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, print (the 64 bits as a signed number)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id bigint, print bigint")


def gray_rank(x: Column) -> Column:
    """The place of x, read as a Gray code, in Gray order; ranks compare as signed numbers."""
    for by in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, by))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def turned(x: Column, by: int) -> Column:
    """The bits of x turned to the left."""
    return x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def segments(distance: int) -> list[tuple[int, int]]:
    """(turn, width) of each segment: distance + 1 of them hold all 64 bits."""
    cuts = [64 * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Tree:
    """A hierarchical index over fingerprints in Gray order."""

    def __init__(self, prints: np.ndarray):
        # From the leaves up: bits that all of a node's fingerprints share, and their values.
        self.prints, self.ends, levels = prints, [], []
        low, high, end = prints, prints, np.arange(1, len(prints) + 1)
        while True:
            cuts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            end = end[np.minimum(cuts + FAN, len(end)) - 1]
            levels.append((~(low ^ high), low))
            self.ends.append(end)
            if len(low) == 1:
                break
        # From the root down: what a node adds to the bits of its parents.
        self.own = []
        for k, (shared, value) in enumerate(levels):
            above = np.repeat(levels[k + 1][0], FAN)[: len(shared)] if k + 1 < len(levels) else np.uint64(0)
            self.own.append((shared & ~above, value))
        self.leaf = levels[0][0]

    def within(self, queries: np.ndarray, distance: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place) of at most `distance` differing bits; with `after`, only of later places than that."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        met = np.zeros(len(queries), np.int64)
        for k in range(len(self.own) - 1, -1, -1):
            own, value = self.own[k]
            met = met + np.bitwise_count((queries[query] ^ value[node]) & own[node])
            keep = met <= distance
            if after is not None:
                keep &= self.ends[k][node] > after[query] + 1
            query, node, met = query[keep], node[keep], met[keep]
            size = len(self.own[k - 1][0]) if k else len(self.prints)
            first = node * FAN
            n = np.minimum(first + FAN, size) - first
            query, met = np.repeat(query, n), np.repeat(met, n)
            above = np.repeat(node, n)
            node = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        met = met + np.bitwise_count((queries[query] ^ self.prints[node]) & ~self.leaf[above])
        keep = met <= distance
        if after is not None:
            keep &= node > after[query]
        return query[keep], node[keep]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes label, the least place of each group, hold after places a and b are joined."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def chains(prints: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours along a chain through each group of two or more."""
    order = np.argsort(label, kind="stable")
    same = np.flatnonzero(label[order][1:] == label[order][:-1])
    return prints[order[same]], prints[order[same + 1]]


def linked_within(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains through the groups that fingerprints in Gray order form among themselves."""
    tree, label, places = Tree(prints), np.arange(len(prints)), np.arange(len(prints))
    for at in range(0, len(prints), QUERIES):
        query, place = tree.within(prints[at : at + QUERIES], distance, places[at : at + QUERIES])
        join_labels(label, query + at, place)
    return chains(prints, label)


def linked_between(queries: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains through the groups that queries form with fingerprints in Gray order."""
    tree, label = Tree(prints), np.arange(len(queries) + len(prints))
    for at in range(0, len(queries), QUERIES):
        query, place = tree.within(queries[at : at + QUERIES], distance)
        join_labels(label, query + at, place + len(queries))
    return chains(np.concatenate((queries, prints)), label)


def _back(prints: np.ndarray, turn: int) -> np.ndarray:
    return prints if not turn else (prints >> np.uint64(turn)) | (prints << np.uint64(64 - turn))


_NAMES = ["a", "b", "segment", "bucket", "block", "shared", "value", "prints"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_FOUND = "a bigint, b bigint, segment int, bucket bigint, block bigint, shared bigint, value bigint, prints binary"


def _links(a: np.ndarray, b: np.ndarray, turn: int) -> list[pa.Array]:
    return [pa.array(_back(x, turn).view(np.int64)) for x in (a, b)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(segment, up to BLOCK fingerprints) of rows sorted by segment and rank."""
    at, held = -1, np.zeros(0, np.uint64)
    for batch in batches:
        segment, prints = batch.column("segment").to_numpy(), batch.column("print").to_numpy().view(np.uint64)
        for s in np.unique(segment).tolist():
            if s != at and len(held):
                yield at, held
            held = np.concatenate((held if s == at else held[:0], prints[segment == s]))
            at = s
            while len(held) > BLOCK:
                yield at, held[:BLOCK]
                held = held[BLOCK:]
    if len(held):
        yield at, held


def _searched(distance: int):
    """Sorted rows (segment, print) -> links within blocks; buckets that may go on in another block come as packed rows."""
    cuts = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        blocks = _blocks(batches)
        before, now = (-1, -1), next(blocks, None)
        while now is not None:
            then = next(blocks, None)
            segment, prints = now
            turn, width = cuts[segment]
            links = _links(*linked_within(prints, distance), turn)
            yield pa.RecordBatch.from_arrays([*links, *[pa.nulls(len(links[0]), t) for t in _TYPES[2:]]], names=_NAMES)
            bucket = prints >> np.uint64(64 - width)
            first, last = int(bucket[0]), int(bucket[-1])
            ahead = None if then is None else int(then[1][0] >> np.uint64(64 - width))
            open_ = {first} if before[0] != segment or before[1] == first else set()
            if then is None or then[0] != segment or ahead == last:
                open_.add(last)
            for key in sorted(open_):
                part = prints[bucket == key]
                low, high = np.bitwise_and.reduce(part, keepdims=True), np.bitwise_or.reduce(part, keepdims=True)
                shared, value = (x.view(np.int64)[0] for x in (~(low ^ high), low))
                row = (None, None, segment, key, number, shared, value, part.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)
                number += 1
            before, now = (segment, last), then

    return run


def _met(distance: int):
    """Rows (segment, x, y) of packed blocks -> links between the two."""
    cuts = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, x, y in zip(*(batch.column(c).to_pylist() for c in ("segment", "x", "y"))):
                links = linked_between(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), distance)
                yield pa.RecordBatch.from_arrays(_links(*links, cuts[segment][0]), names=["a", "b"])

    return run


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (print, distinct) -> a, b: chains through fingerprints whose groups `distance` or fewer differing bits form."""
    x = F.col("print")
    sides = [F.struct(F.lit(k).cast("int").alias("segment"), turned(x, turn).alias("print")) for k, (turn, _) in enumerate(segments(distance))]
    dealt = prints.select(F.explode(F.array(*sides)).alias("s")).select("s.*").withColumn("rank", gray_rank(F.col("print")))
    rows = dealt.repartitionByRange("segment", "rank").sortWithinPartitions("segment", "rank").select("segment", "print")
    found = staged(rows.mapInArrow(_searched(distance), _FOUND), "found")
    near = found.filter("a IS NOT NULL").select("a", "b")
    blocks = found.filter("prints IS NOT NULL").select("segment", "bucket", "block", "shared", "value").withColumn("part", F.shiftright("block", GROUP_BITS))
    at = ["segment", "bucket"]
    blocks = blocks.join(blocks.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), at)
    # What a group of blocks shares: bits that all of them share with one value.
    low, high = F.bit_and("value"), F.bit_or("value")
    groups = blocks.groupBy(*at, "part").agg(F.bit_and("shared").bitwiseAND(F.bitwise_not(low.bitwiseXOR(high))).alias("shared"), low.alias("value"))

    def meet(table: DataFrame, key: str, pairs: DataFrame | None = None) -> DataFrame:
        """Pairs x, y of table's rows of one bucket that shared bits leave near enough, of `pairs` of groups if given."""
        side = lambda s: table.select(*at, F.col(key).alias(s), F.col("shared").alias(f"m{s}"), F.col("value").alias(f"v{s}"), *([F.col("part").alias(f"part{s}")] if pairs is not None else []))
        both = side("x").join(side("y"), at) if pairs is None else pairs.join(side("x"), [*at, "partx"]).join(side("y"), [*at, "party"])
        apart = F.bit_count(F.col("vx").bitwiseXOR(F.col("vy")).bitwiseAND(F.col("mx")).bitwiseAND(F.col("my")))
        return both.filter((apart <= distance) & (F.col("x") <= F.col("y") if pairs is None else F.col("x") < F.col("y"))).select(*at, "x", "y")

    pairs = meet(blocks, "block", meet(groups, "part").withColumnsRenamed({"x": "partx", "y": "party"}))
    packed = lambda s: found.filter("prints IS NOT NULL").select(F.col("block").alias(f"at_{s}"), F.col("prints").alias(s))
    pairs = pairs.withColumnsRenamed({"x": "at_x", "y": "at_y"}).join(packed("x"), "at_x").join(packed("y"), "at_y").select("segment", "x", "y")
    out = staged(near.unionByName(pairs.mapInArrow(_met(distance), "a bigint, b bigint")).distinct(), "links")
    dropped(found)
    return out


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with table, whose key is unique; rows of one key meet it in SALTS places, dealt by `by`."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, label of every node with an edge: the least node of its component.

    Labels shrink to those of neighbours and jump to their label's label until none changes.
    Nodes have few edges, being links of chains; a label may have any number of nodes.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "label")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("jump")).join(label.select("label").distinct(), "label", "left_semi")
        turn = staged(spread_join(label, jump, "label", "node").join(near, "node").select("node", "label", F.least("near", "jump").alias("to")), "label")
        dropped(label)
        label = turn.select("node", F.col("to").alias("label"))
        if turn.filter("`to` < label").isEmpty():
            dropped(both)
            return label


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, print, component_id: the least doc_id that links of `distance` or fewer bits reach."""
    rows = staged(fingerprints(docs), "prints")
    prints = staged(rows.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    label = components(links(prints.select("print"), distance)).withColumnRenamed("node", "print")
    linked = staged(label.join(prints.select("print", "least_id"), "print"), "linked")
    least = linked.groupBy("label").agg(F.min("least_id").alias("component_id"))
    told = spread_join(linked.select("print", "label"), least, "label", "print").select("print", "component_id")
    told = staged(prints.join(told, "print", "left").select("print", "n", F.coalesce("component_id", "least_id").alias("component_id")), "told")
    dropped(linked, prints)
    # At most 1 / HOT fingerprints have more rows than this, so their table is small at every size.
    most = max(HOT_LEAST, int((told.agg(F.sum("n")).first()[0] or 0) * HOT))
    hot = F.broadcast(told.filter(F.col("n") > most).select("print", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot")))
    marked = rows.join(hot, "print", "left")
    few = marked.filter("_is_hot IS NULL").select("doc_id", "print").join(told.filter(F.col("n") <= most).select("print", "component_id"), "print")
    many = marked.filter("_is_hot").select("doc_id", "print", F.col("_hot").alias("component_id"))
    return few.select("doc_id", "print", "component_id").unionByName(many)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
