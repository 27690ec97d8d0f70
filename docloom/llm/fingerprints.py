"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's words are hashed once each. The hash of k consecutive words is a cyclic polynomial,
the xor of their hashes rotated by their place, so it rolls: the hash of two neighbouring
runs follows from theirs by one rotation, and k-gram hashes are put together by doubling. Of
each window of w grams the smallest hash is kept, the rightmost one on ties, with its word
position. Two texts that share k + w - 1 consecutive words share a fingerprint. A text of
fewer than k words is one gram; null and empty texts have no fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, words

#: Words of a gram, and grams of a window: shared runs of 12 words are always found.
K, W = 5, 8
#: Windows compare this many low bits of position after the hash's leading bits: a text has under 2^31 characters.
_POSITION_BITS = 30
_LAST = (1 << _POSITION_BITS) - 1


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _joined(values: Column, ahead: Column, by: int, shift: int) -> Column:
    """Of each place the value there, rotated by shift, with what stands `by` places ahead."""
    n = F.greatest(F.size(ahead) - by, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(ahead, by + 1, n), lambda a, b: _rotated(a, shift).bitwiseXOR(b))


def rolled(hashed: Column, k: int) -> Column:
    """The cyclic polynomial of each k consecutive hashes; needs at least k of them."""

    def more(whole: Column, width: int) -> Column:
        if width * 2 <= k:
            return _let(_joined(whole, whole, width, width), lambda x: more(x, width * 2))
        return whole if width == k else _joined(whole, rolled(hashed, k - width), width, k - width)

    return more(hashed, 1)


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The kept grams in text order: (h, p), a hash of 64 bits and the position of its first word."""
    place = lambda i: F.lit(_LAST) - i.cast("bigint")
    # The reversed position in the low bits makes the least value of a window the rightmost of its least hashes.
    packed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, _POSITION_BITS + 1), _POSITION_BITS).bitwiseOR(place(i))

    def minima(gram: Column) -> Column:
        # Of each window the minimum, by doubling: minima of 2, 4, ... grams; short texts are one window.
        def halve(width: int):
            return lambda values: F.zip_with(
                F.slice(values, 1, F.greatest(F.size(values) - width, F.lit(0))),
                F.slice(values, width + 1, F.greatest(F.size(values) - width, F.lit(0))),
                lambda a, b: F.least(a, b),
            )

        out, width = F.transform(gram, packed), 1
        while width * 2 <= w:
            out, width = _let(out, halve(width)), width * 2
        if width < w:
            out = _let(out, halve(w - width))
        kept = F.when(F.size(gram) == 0, F.array().cast("array<bigint>")).when(F.size(gram) <= w, F.array(F.array_min(F.transform(gram, packed)))).otherwise(F.array_distinct(out))
        at = lambda x: (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("int")
        return F.transform(kept, lambda x: F.struct(F.get(gram, at(x)).alias("h"), at(x).alias("p")))

    def grams(word: Column) -> Column:
        hashed = F.transform(word, lambda x: F.xxhash64(x))
        short = F.when(F.size(word) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(word, " "))))
        return F.when(F.size(word) < k, short).otherwise(_let(hashed, lambda h: rolled(h, k)))

    return _let(words(text), lambda word: _let(grams(word), minima))


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: x["h"]))


def shown(kept: Column) -> Column:
    """A fingerprint as text: hash:position pairs in text order, in hexadecimal and decimal."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.hex(x["h"]), F.lit(":"), x["p"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints' hashes, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame, columns: list[str], next_prefix: str = "next_") -> DataFrame:
    """Each row beside the next one in descending doc_id, after the last the first.

    Rows are dealt to ranges of doc_id between quantiles, a bounded list. The row that
    begins a range is also sent to the end of the range before it, so every lead is
    local and the text moves once. Null ids come last; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    found = docs.agg(
        F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q"), F.max("doc_id").alias("top")
    ).first()
    bounds = sorted({*(found["q"] or []), *([] if found["top"] is None else [found["top"]])})
    cuts = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # Range b holds the ids above bound b - 1, up to bound b itself.
    # How many bounds lie below the id, by halving.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))]) if bounds else F.array().cast("array<int>")
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) < F.col("doc_id"), n + step).otherwise(n))
    goes = F.when(
        F.array_contains(cuts, F.col("doc_id")),
        F.array(
            F.struct(F.col("_at").alias("at"), F.lit(0).alias("guest")),
            F.struct(((F.col("_at") + 1) % max(len(bounds), 1)).alias("at"), F.lit(1).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("_at").alias("at"), F.lit(0).alias("guest"))))
    dealt = (
        docs.withColumn("_at", at)
        .withColumn("_to", F.explode(goes))
        .select("*", F.col("_to.at").alias("_range"), F.col("_to.guest").alias("_guest"))
        .drop("_to", "_at")
    )
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    ahead = [F.lead(c).over(order).alias(next_prefix + c) for c in columns]
    return dealt.select("*", *ahead).filter("_guest = 0").drop("_range", "_guest")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Columns of docs and `kept`, the winnowed grams; docs needs a column text, and a column kept is replaced. No shuffle.

    Any text has a result: long ones keep all positions, rows that repeat are treated alike.
    """
    return docs.withColumn("kept", winnow(F.col("text"), k, w))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The last third of the code points is replaced by the beginning of the next document.
    A single document is its own next one. Columns besides doc_id and text are unused.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    ahead = with_next(fingerprints(docs), ["text", "kept"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    both = (
        ahead.withColumn("n_chars", n.cast("bigint"))
        .withColumn("edited", edited)
        .select("doc_id", "n_chars", "kept", F.coalesce("next_kept", F.array().cast("array<struct<h:bigint,p:int>>")).alias("next_kept"), F.sha2("edited", 256).alias("edited_sha256"), winnow(F.col("edited")).alias("edited_kept"))
    )
    own = hashes(F.col("kept"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("kept")).alias("fingerprint"),
        shown(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_kept"))).alias("near_edited"),
        likeness(own, hashes(F.col("next_kept"))).alias("near_next"),
    )
