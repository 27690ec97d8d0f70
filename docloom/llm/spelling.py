"""Groups of spelling variants: words one edit apart by a positional q-gram index with a count filter.

Words are maximal runs of letters, A-Z in lower case, of at least LEAST_LENGTH code points and
LEAST_COUNT occurrences in the corpus. A word's padded q-grams of Q code points are its entries
in an inverted index, with their places. One inserted, deleted or replaced code point spoils at
most Q of them, so two near words share all but Q of the longer one's grams (the bound), at
the same place, or one further in the longer word where lengths differ.

The index is dealt by gram and length. Two near words share one of the Q + 1 rarest grams of
each, so a word goes to the postings of its own rarest grams only, as an entry under its length
and as a query under its length and one more. A gram's words beyond BLOCK are dealt to blocks,
which each query visits. Within a block a query's postings, taken under those limits of length
and place, are merged by a heap that skips what can't reach the bound any more; what does is
verified by comparing the two words.

Null texts hold no words, a null id counts as empty text in the planted edits, and rows that
repeat an id or a text count each. Columns besides doc_id and text are unused. An empty table
has no words.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, staged

Q, LEAST_LENGTH, LEAST_COUNT = 3, 5, 3
#: A run of one document in so many has a code point deleted: planted misspellings.
PLANTED = 97
#: Words that one block of a posting holds, and distinct words that a task counts before it tells them.
BLOCK, HELD = 8192, 400_000
#: A word's form occurs at least so many times as often as the word.
FORM_RATIO = 2
#: Each Latin-1 character as a letter in lower case, or a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_HEAD, _TAIL = "\x02" * (Q - 1), "\x03" * (Q - 1)


def corrupted(prefix: int, run: str) -> str:
    """The run, or for one in PLANTED the run without one code point; prefix is the crc32 of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % PLANTED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs(text: str) -> Counter:
    """The runs of letters of a text, lower-cased, as Latin-1: all letters are, and what isn't becomes a mark."""
    return Counter(text.encode("latin-1", "replace").translate(_LETTERS).split(b" "))


def words_of(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """The words of one document and their numbers; a word may come twice."""
    prefix = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs(text).items():
        if len(run) >= LEAST_LENGTH:
            word = corrupted(prefix, run.decode("latin-1"))
            if len(word) >= LEAST_LENGTH:
                yield word, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            for word, n in words_of(doc_id.as_py(), text.as_py()):
                held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield told()
                held.clear()
    yield told()


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, n."""
    texts = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    """The padded q-grams of a word by their place."""
    padded = _HEAD + word + _TAIL
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def merged(postings: list[list[int]], bound: int) -> Iterator[int]:
    """What stands in at least `bound` of the sorted lists, in order: a heap of their heads, which skips what can't."""
    if len(postings) < bound:
        return
    at = [0] * len(postings)
    heads = [(p[0], k) for k, p in enumerate(postings)]
    heapq.heapify(heads)
    while len(heads) >= bound:
        least, moved = heads[0][0], []
        while heads and heads[0][0] == least:
            moved.append(heapq.heappop(heads)[1])
        if len(moved) >= bound:
            yield least
            to = least + 1
        else:
            # bound - 1 lists may be ahead of the others: nothing before the next head is in enough of them.
            while len(moved) < bound - 1:
                moved.append(heapq.heappop(heads)[1])
            to = heads[0][0]
        for k in moved:
            at[k] = bisect_left(postings[k], to, at[k])
            if at[k] < len(postings[k]):
                heapq.heappush(heads, (postings[k][at[k]], k))


class Index:
    """Words of one length, sorted, with the postings of their grams by place."""

    def __init__(self, words: list[str]):
        self.words, self.postings = words, {}
        for i, word in enumerate(words):
            for entry in enumerate(grams(word)):
                self.postings.setdefault(entry, []).append(i)

    def near(self, word: str) -> Iterator[int]:
        """Places of the words one edit from `word`, which is as long or one shorter; of those as long the later ones."""
        longer = len(self.words[0]) - len(word)
        bound, postings = len(self.words[0]) + Q - 1 - Q, []
        begin = 0 if longer else bisect_right(self.words, word)
        if begin == len(self.words):
            return
        own = grams(word)
        spare = len(own) - bound  # grams that a near word may lack
        for place, gram in enumerate(own):
            missing = True
            for p in range(place, place + longer + 1):
                held = self.postings.get((p, gram))
                if held and held[-1] >= begin:
                    postings.append(held[bisect_left(held, begin) :] if begin else held)
                    missing = False
            if missing:
                spare -= 1
                if spare < 0:
                    return
        for i in merged(postings, bound):
            if one_edit(word, self.words[i]):
                yield i


def _routed(order: dict[str, int]):
    """word, n -> gram, length, own, word, n: where the word is an entry (own) or a query of one less code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                # A gram that repeats counts each time, as its occurrences are shared one by one. A longer word lacks Q of
                # its grams, the shorter one of the two Q - 1.
                rarest = sorted(grams(word), key=lambda g: (order[g], g))[: Q + 1]
                for longer in (0, 1):
                    for gram in set(rarest[: Q + 1 - longer]):
                        for column, value in zip(out, (gram, len(word) + longer, not longer, word, n)):
                            column.append(value)
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["gram", "length", "own", "word", "n"])

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, length, part, entries before mere queries, and word -> pairs (a, n_a, b, n_b) of near words."""
    at, entries, counts, index = None, [], [], None

    def queried(word: str, n: int) -> Iterator[tuple]:
        for i in index.near(word):
            yield word, n, index.words[i], counts[i]

    def finish(queried_alone: int) -> Iterator[tuple]:
        """Builds the index where there is more than `queried_alone` entries, and tells the pairs among them."""
        nonlocal index
        if len(entries) > queried_alone and index is None:
            index = Index(entries)
            for word, n in zip(entries, counts):
                yield from queried(word, n)

    for batch in batches:
        found: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("gram", "length", "part", "entry", "word", "n"))
        for gram, length, part, entry, word, n in zip(*columns):
            if (gram, length, part) != at:
                found += finish(1)
                at, entries, counts, index = (gram, length, part), [], [], None
            if entry:
                entries.append(word)
                counts.append(n)
            elif entries:
                found += finish(0)
                found += queried(word, n)
        yield _pairs(found)
    yield _pairs(list(finish(1)))


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "n_a", "b", "n_b"])


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()  # grams are few at any size
    for batch in batches:
        for word in batch.column("word").to_pylist():
            held.update(grams(word))
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """words (word, n) -> a, n_a, b, n_b: each two words one edit apart, once.

    The grams by rarity, which tell the rarest, go to all tasks: 90 letters and two marks
    make at most 92 ** Q of them.
    """
    counted = words.select("word").mapInArrow(_grams_of, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    order = {r.gram: r.n for r in counted.toLocalIterator()}
    routed = staged(words.mapInArrow(_routed(order), "gram string, length int, own boolean, word string, n bigint"), "postings")
    at = ["gram", "length"]
    # Lists without an entry answer nothing.
    parts = routed.groupBy(*at).agg(F.count_if("own").alias("entries")).filter("entries > 0")
    parts = parts.select(*at, F.ceil(F.col("entries") / BLOCK).cast("int").alias("parts"))
    mine = F.when(F.col("own"), F.pmod(F.xxhash64("word"), F.col("parts"))).otherwise(-1)
    rows = routed.join(parts, at).select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = rows.select(*at, "part", (F.col("part") == F.col("mine")).alias("entry"), "word", "n")
    dealt = rows.repartition(*at, "part").sortWithinPartitions(*at, "part", F.desc("entry"), "word")
    out = staged(dealt.mapInArrow(_paired, "a string, n_a bigint, b string, n_b bigint").dropDuplicates(["a", "b"]), "near")
    dropped(routed)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root: the last of the forms that follow one another. Each turn doubles the steps taken."""
    told = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = told.select(F.col("word").alias("root"), F.col("root").alias("then"))
        turn = staged(told.join(then, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
        dropped(told)
        told = turn.select("word", "root")
        if turn.filter("moved").isEmpty():
            return told


def variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n.

    A word's form is its near word of most occurrences, of equals the least, where those are
    FORM_RATIO times the word's at least. Counts grow along forms, so they end.
    """
    words = staged(vocabulary(docs), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "m"), F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    often = F.col("best.m") >= FORM_RATIO * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, F.col("best.m")).alias("form_n"))
    told = staged(told, "forms")
    dropped(words, pairs)
    ends = roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
