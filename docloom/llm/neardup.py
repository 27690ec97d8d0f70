"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's words form 5-word grams, each labelled with its occurrence number. Each of SKETCHES
hash functions picks the least labelled gram and the least of those at least APART of the
text away from it; their hashes in text order are a bucket key. That two texts agree falls
with their edit distance, as moved passages change the order, and a passage shorter than
APART of the texts that share it brings none of them together. Equal texts are one class
before that. A candidate is kept if the word edit distance, in the band of diagonals that
the threshold allows, is at most 1 - SIMILARITY of the longer text; groups are connected
components of what is kept.

Every pair of a bucket is compared unless its texts come to lie in one group before, their
lengths differ too much, or the texts agree in fewer than AGREE of their fifths: two fifths
agree if one of PER_FIFTH least grams is equal. Words replaced at random at the threshold,
20 %, leave a fifth of the grams; of such pairs of 200 words and more some 19 in 20 are
compared, of 60 words three in four, and nearly all with up to 16 % (tests/llm/ measures it).
To save comparisons each text first meets the text that it shares most buckets with, then
in turns one pair of each two groups that meet in a bucket; in most buckets that leaves one
group.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, mix, rolling, squeezed, staged, unsqueezed
from .exchange import word_hashes

K = 5
SKETCHES = 96
SIMILARITY = 0.8
#: The share of a text that lies at least between a key's two grams.
APART = 0.4
#: Fifths of a text that must agree before texts are aligned; least grams of each, a byte each, as two words of seven bytes.
FIFTHS, PER_FIFTH, AGREE = 5, 14, 3
#: Pieces of a group of equal texts when its rows learn their class.
SALTS = 64
#: Texts of a bucket that one task compares with as many others.
BLOCK = 256
#: Links a compared pair below which a turn over the rest takes all pairs that are open.
FEW = 0.1
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_ODD = mix(np.arange(101, SKETCHES + 101, dtype=np.uint64))[:, None] | np.uint64(1)


def sketch(words: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of a text of at least one word, and the least grams of its fifths, packed."""
    hashes = word_hashes(words)
    grams = rolling(hashes, min(k, len(hashes)))
    inorder = np.sort(grams)
    if (inorder[1:] == inorder[:-1]).any():
        order = np.argsort(grams, kind="stable")
        same = grams[order]
        begins = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
        number = np.empty(len(grams), np.uint64)
        number[order] = np.arange(len(grams)) - np.repeat(begins, np.diff(np.append(begins, len(grams))))
        grams = mix(grams + number * np.uint64(0xD1B54A32D192ED03))
    n, places = len(grams), np.arange(len(grams))
    first, second = np.empty(SKETCHES, np.int64), np.empty(SKETCHES, np.int64)
    fifth = np.zeros((PER_FIFTH, FIFTHS), np.uint64)
    held = np.unique(places * FIFTHS // n)
    begins = np.searchsorted(places * FIFTHS // n, held)
    step = max(1, (1 << 20) // n)  # a long text takes few functions at a time
    for a in range(0, SKETCHES, step):
        value = (grams[None, :] ^ _SEEDS[a : a + step]) * _ODD[a : a + step]
        if a < PER_FIFTH:
            fifth[a : a + step][:, held] = np.minimum.reduceat(value[: PER_FIFTH - a], begins, axis=1)
        at = first[a : a + step] = value.argmin(1)
        if n > 1:
            value[np.abs(places[None, :] - at[:, None]) < max(1, int(APART * n))] = np.iinfo(np.uint64).max
            second[a : a + step] = value.argmin(1)
        else:
            second[a : a + step] = at
    low, high = np.minimum(first, second), np.maximum(first, second)
    keys = mix(mix(grams[low] + _SEEDS[:, 0]) ^ grams[high])  # of its own function alone: seeds differ
    octets = (fifth & np.uint64(0xFF)).T.reshape(-1, 7) << (np.arange(7, dtype=np.uint64) * np.uint64(8))
    return keys.view(np.int64), octets.sum(1, dtype=np.uint64).view(np.int64)


def bag(words: list[bytes]) -> bytes:
    """The codes, of two bytes and ascending, of a text's words, each labelled with its occurrence number; squeezed, as most differences take one byte."""
    order = np.argsort(hashes := word_hashes(words), kind="stable")
    same = hashes[order]
    begins = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    number = (np.arange(len(same)) - np.repeat(begins, np.diff(np.append(begins, len(same))))).astype(np.uint64)
    return squeezed(np.unique((mix(same + number * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(48)).astype("<u2")), True)


def least_distances(x: list[bytes], y: list[bytes], n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """What the word edit distances of texts with bags x and y and of n_x and n_y words are at least, as a matrix.

    An edit makes at most one word of the longer text differ. Words that fall on one code only raise what
    seems common, so no pair is judged too far apart.
    """
    codes = [[unsqueezed(b, "<u2", True) if b else np.zeros(0, "<u2") for b in bags] for bags in (x, y)]
    shared = np.zeros(1 << 16, bool)
    shared[np.concatenate(codes[0])] = True
    other = np.zeros(1 << 16, bool)
    other[np.concatenate(codes[1])] = True
    shared &= other
    place = np.cumsum(shared) - 1

    def matrix(side: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(side), int(shared.sum())), np.float32)
        for row, held in zip(out, side):
            row[place[held[shared[held]]]] = 1
        return out

    common = (matrix(codes[0]) @ matrix(codes[1]).T).astype(np.int64)
    slack = [n - np.array([len(c) for c in side]) for n, side in zip((n_x, n_y), codes)]
    return np.maximum(n_x[:, None], n_y) - common - np.minimum(slack[0][:, None], slack[1])


def agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """agreeing for each of the packed least grams x and y, as a matrix."""
    octets = [a.astype("<i8").view(np.uint8).reshape(len(a), 2 * FIFTHS, 8)[:, :, :7].reshape(len(a), FIFTHS, PER_FIFTH) for a in (x, y)]
    out = np.zeros((len(x), len(y)), np.int32)
    for q in range(FIFTHS):
        equal = np.zeros(out.shape, bool)
        for k in range(PER_FIFTH):
            equal |= octets[0][:, q, k, None] == octets[1][:, q, k]
        out += equal
    return out


def agreeing(a: Column, b: Column) -> Column:
    """In how many fifths two texts' packed least grams have an equal one, by arithmetic that Spark compiles."""
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)

    def unequal(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        return F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high))

    return sum((unequal(2 * q) + unequal(2 * q + 1) < PER_FIFTH).cast("int") for q in range(FIFTHS))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            out: dict[str, list] = {"doc_id": part.column("doc_id").to_pylist(), "digest": [], "n_words": [], "keys": [], "least": [], "bag": []}
            for text in part.column("text").to_pylist():
                words = text.split()
                keys, least = sketch(words) if words else (np.zeros(0, np.int64), np.zeros(2 * FIFTHS, np.int64))
                out["digest"].append(hashlib.md5(text).hexdigest())
                out["n_words"].append(len(words))
                out["keys"].append(keys)
                out["least"].append(least)
                out["bag"].append(bag(words) if words else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["digest"], pa.string()), pa.array(out["n_words"], pa.int32()), pa.array(out["keys"], pa.list_(pa.int64())), pa.array(out["least"], pa.list_(pa.int64())), pa.array(out["bag"], pa.binary())],
                names=list(out),
            )


def _common(a: list, b: list, i: int, j: int) -> int:
    """How many words from i and j on are equal."""
    n, start = min(len(a) - i, len(b) - j), i
    if n <= 0:
        return 0
    size, step = 0, 8
    while size < n:  # slices compare in C
        step = min(step, n - size)
        if a[start + size : start + size + step] == b[j + size : j + size + step]:
            size += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return size


def distance(a: list, b: list) -> int:
    """The word edit distance, a column of differences at a time as the bits of two numbers (Myers, Hyyrö)."""
    at: dict = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, told = every, 0, len(a)  # where the column rises, where it falls, and its last value
    for word in b:
        equal = at.get(word, 0)
        across = (((equal & up) + up) ^ up) | equal
        rises, falls = down | every & ~(across | up), up & across
        if rises & last:
            told += 1
        elif falls & last:
            told -= 1
        rises, kept = rises << 1 | 1, equal | down
        up, down = (falls << 1 | ~(kept | rises)) & every, rises & kept & every
    return told


def distance_within(a: list, b: list, most: int) -> int | None:
    """The word edit distance if it is at most `most`: by furthest points on the band of diagonals, or column by column where it is large."""
    head = _common(a, b, 0, 0)
    a, b = a[head:], b[head:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
        n = min(len(a), len(b), 64)
        while n and a[-n:] == b[-n:]:
            a, b = a[:-n], b[:-n]
            n = min(len(a), len(b), 64)
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return max(n, m)
    if max(n, m) - sum((Counter(a) & Counter(b)).values()) > most:
        return None
    goal, far = m - n, {0: _common(a, b, 0, 0)}
    if far[0] == n and goal == 0:
        return 0
    for e in range(1, most + 1):
        if e * e > n + m:  # as many steps as there are columns
            found = distance(a, b)
            return found if found <= most else None
        turn = {}
        # Diagonals from which the goal can still be reached with the edits left.
        for k in range(max(-e, goal - (most - e)), min(e, goal + (most - e)) + 1):
            i = max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            if i < n and i + k < m and a[i] == b[i + k]:
                i += _common(a, b, i, i + k)
            turn[k] = i
        if turn.get(goal, -1) >= n:
            return e
        far = turn
    return None


def most_edits(longer, similarity: float = SIMILARITY):
    """The edits that texts which are alike need at most, by the words of the longer one, or of several."""
    return np.int64((1 - similarity) * longer + 1e-9)


def alike(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    return distance_within(a, b, int(most_edits(max(len(a), len(b)), similarity))) is not None


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("text_a"), batch.column("text_b")):
            keep.append(alike(a.as_py().split(), b.as_py().split()))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield kept.select(["a", "b"])


def _bands(classes: DataFrame, *more: str) -> DataFrame:
    """rep, key and the columns of more, a row for each bucket of a text; a key holds its band."""
    return classes.select("rep", *more, F.explode("keys").alias("key"))


def _pairs(rep: Column, other: Column) -> list[Column]:
    return [F.least(rep, other).alias("a"), F.greatest(rep, other).alias("b")]


def weighed(classes: DataFrame) -> DataFrame:
    """classes (rep, keys) -> rep, key, weight of the texts that share a bucket.

    The weight of a text is the summed size of its buckets. A text in the middle of a group
    of copies is in more of their buckets than any copy, so it weighs most.
    """
    rows = _bands(classes)
    sizes = staged(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    return rows.join(sizes, "key").select("rep", "key", F.sum("n").over(Window.partitionBy("rep")).alias("weight"))


def nearest(met: DataFrame) -> DataFrame:
    """What weighed returns -> one pair a < b for each text: of its buckets' heaviest texts the one that it meets most often."""
    centres = met.groupBy("key").agg(F.max_by("rep", F.struct(F.col("weight"), -F.col("rep"))).alias("centre"))
    counts = met.join(centres, "key").filter("rep <> centre").groupBy("rep", "centre").agg(F.count("*").alias("n"))
    best = counts.groupBy("rep").agg(F.max_by("centre", F.struct(F.col("n"), -F.col("centre"))).alias("centre"))
    return best.select(*_pairs(F.col("rep"), F.col("centre"))).distinct()


def candidates(met: DataFrame, label: DataFrame, tried: DataFrame) -> DataFrame:
    """What weighed returns and label (rep, label) -> pairs a < b to compare, one of each two labels that meet and not in tried (a, b).

    In a bucket of several labels each text meets the heaviest text and one that is drawn by one
    of four orders. Of the pairs of two labels that with the heaviest texts is taken, so a
    large group costs as many comparisons as there are groups around it, not texts in it.
    """
    rows = met.join(label, "rep")
    of = F.struct("rep", "label", "weight")
    heaviest = F.max_by(of, F.struct(F.col("weight"), -F.col("rep"))).alias("centre")
    drawn = F.min_by(of, F.xxhash64("rep", F.pmod("key", F.lit(4)))).alias("drawn")
    buckets = staged(rows.groupBy("key").agg(heaviest, drawn, F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").drop("lo", "hi"), "buckets")
    pairs = rows.join(buckets, "key").select("rep", "label", "weight", F.explode(F.array("centre", "drawn")).alias("o")).filter("label <> o.label")
    pairs = pairs.select(*_pairs(F.col("rep"), F.col("o.rep")), F.least("label", "o.label").alias("lo"), F.greatest("label", "o.label").alias("hi"), (F.col("weight") + F.col("o.weight")).alias("w"))
    pairs = pairs.groupBy("a", "b", "lo", "hi").agg(F.max("w").alias("w")).join(tried, ["a", "b"], "left_anti")
    return pairs.groupBy("lo", "hi").agg(F.max_by(F.struct("a", "b"), F.struct("w", "a", "b")).alias("p")).select("p.a", "p.b")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by turn, side 0 before 1 -> a, b, agree: the pairs of the two sides, or of the one there is."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        turn = batch.column("turn").to_numpy()
        cuts = np.flatnonzero(turn[1:] != turn[:-1]) + 1
        if held and batch.num_rows and held[-1].column("turn")[0].as_py() != turn[0]:
            cuts = np.concatenate(([0], cuts))
        begin = 0
        for cut in cuts.tolist():
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            yield from _met(held)
            held, begin = [], cut
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    yield from _met(held)


def _met(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_meeting for the rows of one turn."""
    if not held:
        return
    rows = pa.Table.from_batches(held)
    rep, label, n, side = (rows.column(c).to_numpy() for c in ("rep", "label", "n_words", "side"))
    least = rows.column("least").combine_chunks().flatten().to_numpy().reshape(len(rep), 2 * FIFTHS)
    y = np.flatnonzero(side == side[-1])
    x = np.flatnonzero(side == 0) if side[-1] else y
    longer = np.maximum(n[x][:, None], n[y])
    open_ = (label[x][:, None] != label[y]) & (np.minimum(n[x][:, None], n[y]) >= SIMILARITY * longer)
    if not side[-1]:
        open_ &= rep[x][:, None] < rep[y]
    if not open_.any():
        return
    agree = agreements(least[x], least[y])
    open_ &= agree >= AGREE
    x_held, y_held = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(x_held):
        return
    bags = rows.column("bag").to_pylist()
    some = np.ix_(x_held, y_held)
    least_ = least_distances([bags[i] for i in x[x_held]], [bags[i] for i in y[y_held]], n[x[x_held]], n[y[y_held]])
    i, j = np.nonzero(open_[some] & (least_ <= most_edits(longer[some])))
    i, j = x_held[i], y_held[j]
    # A pair that shares several buckets is a row in the first of them alone.
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rep), SKETCHES)
    first = keys[x[i], (keys[x[i]] == keys[y[j]]).argmax(1)] == rows.column("key")[0].as_py()
    i, j = i[first], j[first]
    one, two = rep[x[i]], rep[y[j]]
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(agree[i, j])], names=["a", "b", "agree"])


def rest(met: DataFrame, label: DataFrame, classes: DataFrame) -> DataFrame:
    """met (rep, key), label (rep, label), classes (rep, n_words, keys, least, bag) -> a, b, agree: all pairs a < b of a bucket whose labels differ and that lengths, sketches and bags of words admit.

    A bucket is dealt in blocks, and each two blocks meet in one place. A label of more than
    BLOCK texts has blocks of its own, which don't meet one another. Only pairs that their
    words don't show to lie too far apart become rows: where many texts of one
    origin lie just beyond the threshold, these are few of all their pairs.
    """
    rows = met.select("rep", "key").join(label, "rep")
    kinds = staged(rows.groupBy("key", "label").agg(F.count("*").alias("n")), "kinds")
    several = kinds.groupBy("key").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)).alias("pooled"))
    several = several.filter("labels > 1").drop("labels")
    kinds = kinds.join(several, "key")
    own = F.when(F.col("n") > BLOCK, F.col("label"))  # null for the pooled labels
    parts = F.ceil(F.when(F.col("n") > BLOCK, F.col("n")).otherwise(F.col("pooled")) / BLOCK)
    kinds = staged(kinds.select("key", "label", own.alias("own"), parts.alias("parts")), "kinds")
    place = F.struct(F.col("own"), F.pmod(F.xxhash64(F.coalesce("own", F.lit(-1)), F.when(F.col("own").isNull(), F.col("label")).otherwise(F.col("rep"))), F.col("parts")).alias("part"))
    dealt = staged(rows.join(kinds, ["key", "label"]).select("key", place.alias("block"), "rep", "label"), "dealt")
    blocks = staged(dealt.select("key", "block").distinct(), "blocks")
    turns = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "key")
    turns = turns.filter((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    turns = staged(turns.select(F.monotonically_increasing_id().alias("turn"), "key", "x", "y"), "turns")
    at = lambda block, side: F.struct(F.col(block).alias("block"), F.lit(side).alias("side"))
    sides = turns.select("turn", "key", F.inline(F.when(F.col("x") == F.col("y"), F.array(at("x", 0))).otherwise(F.array(at("x", 0), at("y", 1)))))
    meet = dealt.join(sides, ["key", "block"]).select("turn", "side", "key", "rep", "label").join(classes.select("rep", "n_words", "least", "bag", "keys"), "rep")
    return meet.repartition("turn").sortWithinPartitions("turn", "side").select("turn", "side", "key", "rep", "label", "n_words", "least", "bag", "keys").mapInArrow(_meeting, "a bigint, b bigint, agree int")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike: by length and sketches first, then by alignment of the whole texts."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_words").alias(f"n_{x}"), F.col("least").alias(f"l_{x}"))
    agree = agreeing(F.col("l_a"), F.col("l_b"))
    pairs = pairs.join(side("b"), "b").join(side("a"), "a")
    pairs = pairs.filter((F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")) & (agree >= AGREE)).select("a", "b")
    pairs = staged(pairs, "candidates")
    texts = texts_of(pairs, docs)
    links = aligned(pairs, texts)
    dropped(pairs, texts)
    return links


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text of the pairs (a, b), a row each. All texts are shuffled once, however few the pairs are."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    # A shuffle at every size: the ids grow with the input, so small inputs shall not be joined otherwise than large ones.
    return staged(docs.join(involved.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")


def aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts are alike; texts are what texts_of returns for these pairs, or for more."""
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    return staged(pairs.join(text("b"), "b").join(text("a"), "a").mapInArrow(_verified, "a bigint, b bigint"), "links")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (rep), edges (a, b) -> rep, group_id: the least rep of the component. Labels shrink and jump until none changes."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "rep"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jump = label.select(F.col("rep").alias("label"), F.col("label").alias("jump"))
        turn = (
            label.join(near.withColumnRenamed("a", "rep"), "rep")
            .join(jump, "label")
            .select("rep", F.least("label", "near", "jump").alias("to"), "label")
        )
        turn = staged(turn, "labels")
        dropped(label)
        changed = turn.filter("`to` < label").limit(1).count()
        label = turn.select("rep", F.col("to").alias("label"))
        if not changed:
            dropped(both)
            break
    return nodes.join(label, "rep", "left").select("rep", F.coalesce("label", "rep").alias("group_id"))


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (rep, label) after links (a, b) have joined labels; the least stays."""
    end = lambda x: label.select(F.col("rep").alias(x), F.col("label").alias(f"l_{x}"))
    between = links.join(end("a"), "a").join(end("b"), "b").filter("l_a <> l_b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b")).distinct()
    grouped = components(label.select(F.col("label").alias("rep")).distinct(), between).withColumnRenamed("rep", "label")
    return staged(label.join(grouped, "label").select("rep", F.col("group_id").alias("label")), "label")


def settled(label: DataFrame, met: DataFrame, classes: DataFrame, docs: DataFrame, tried: DataFrame) -> DataFrame:
    """label (rep, label) after all pairs of rest() have been compared or come to lie in one group; tried are compared ones.

    A turn takes one pair of each two groups. When a turn hardly joins any, the last takes all that are open.
    The texts of all open pairs are taken out of docs once, so what is shuffled doesn't grow with the turns.
    """
    open_ = staged(rest(met, label, classes).join(tried, ["a", "b"], "left_anti"), "open")
    last, read, texts = False, [open_], None  # read: tables that the next turn's open pairs follow from
    while True:
        end = lambda x: label.select(F.col("rep").alias(x), F.col("label").alias(f"l_{x}"))
        open_ = staged(open_.join(end("a"), "a").join(end("b"), "b").filter("l_a <> l_b").select("a", "b", "agree", F.least("l_a", "l_b").alias("lo"), F.greatest("l_a", "l_b").alias("hi")), "open")
        dropped(*read)
        read = [open_]
        if not last:
            turn = open_.groupBy("lo", "hi").agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b")
            turn = staged(turn, "turn")
            read.append(turn)
        else:
            turn = open_.select("a", "b")
        n = turn.count()
        if not n:
            dropped(*read, *([] if texts is None else [texts]))
            return label
        if texts is None:
            texts = texts_of(open_, docs)
        links = aligned(turn, texts)
        joined = links.count()
        if joined:
            before, label = label, relabelled(label, links)
            dropped(before)
        dropped(links)
        if last:
            dropped(*read, texts)
            return label
        open_ = open_.join(turn, ["a", "b"], "left_anti").select("a", "b", "agree")
        last = joined < FEW * n


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id (least id with an equal text), group_id, kept.

    Each text is first compared with the one that it meets most often, which joins most
    groups; then one pair of each two groups that meet, until hardly any joins; then all pairs of
    buckets that still lie in different groups are compared. kept marks the row of each group whose doc_id is group_id. Null and empty texts are equal
    texts and resemble no other; texts under five words are one gram. Rows that repeat an id
    with an equal text are all marked; rows without an id are left out.
    """
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sketched = staged(texts.mapInArrow(_sketches, "doc_id bigint, digest string, n_words int, keys array<bigint>, least array<bigint>, bag binary"), "sketches")
    # A text that a third of the rows repeat meets its class in SALTS pieces.
    rows = sketched.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    pieces = staged(rows.groupBy("digest", "salt").agg(F.min("doc_id").alias("least_id")), "pieces")
    reps = pieces.select("digest", "salt").join(pieces.groupBy("digest").agg(F.min("least_id").alias("class_id")), "digest")
    members = staged(rows.join(reps, ["digest", "salt"]).select("doc_id", "class_id"), "members")
    alone = members.filter("doc_id = class_id").select(F.col("class_id").alias("rep")).distinct()
    classes = staged(sketched.withColumnRenamed("doc_id", "rep").join(alone, "rep", "left_semi").dropDuplicates(["rep"]).select("rep", "n_words", "keys", "least", "bag"), "classes")
    dropped(sketched, pieces)
    met = staged(weighed(classes), "met")
    first = staged(nearest(met), "nearest")
    label = staged(components(classes.select("rep"), verified(first, classes, texts)).withColumnRenamed("group_id", "label"), "label")
    tried = first
    while True:
        turn = staged(candidates(met, label, tried), "turn")
        n = turn.count()
        if not n:
            break
        links = verified(turn, classes, texts)
        joined = links.count()
        if joined:
            label = relabelled(label, links)
        tried = staged(tried.unionByName(turn), "tried")
        if joined <= FEW * n:
            break
    label = settled(label, met, classes, texts, tried)
    dropped(classes, met, tried)
    told = label.withColumnRenamed("rep", "class_id").withColumnRenamed("label", "group_id")
    return members.join(told, "class_id").select("doc_id", "class_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when each group keeps one; rows without an id stay."""
    goes = near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct()
    return docs.join(staged(goes, "dropped"), "doc_id", "left_anti").select(*docs.columns)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
