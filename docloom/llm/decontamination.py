"""Benchmark decontamination by templates, in DataFrame expressions only.

Numbers, numbers with units, and names become typed placeholders, so a question with other
values has the same template. Windows of WINDOW template tokens are joined by hash with
those of the benchmark. A run of matches on one diagonal (position in the document minus
position in the item) is one occurrence; its slots must be consistent: a value of the item
stands for one value of the document and the other way round. Windows whose slots break that
don't count. An occurrence of MIN_WINDOWS windows, 13 words, contaminates the document, and
so does one of all windows of a shorter item. An item of fewer than WINDOW tokens is one
window of its own length; what has under MIN_LITERAL literal tokens says nothing and is not
looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

WINDOW = 8
#: Windows of one occurrence: MIN_WINDOWS + WINDOW - 1 consecutive words.
MIN_WINDOWS = 6
#: Literal tokens a window must hold: all placeholders would match anything.
MIN_LITERAL = 4
#: Benchmark windows up to this number are broadcast, more are joined by a shuffle (about 60 bytes each).
MAX_BROADCAST = 1_000_000
_UNITS = "kg|km|cm|mm|mg|ml|kwh|mph|lbs?|oz|ft|meters?|metres?|miles?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|usd|eur|liters?|litres?|grams?|degrees?|%|€|£|°c|°f"
_MARK = "\x01"


#: A number with its separators. Possessive without groups, so any length of it is matched without recursion.
_NUMBER, _NO_LETTER = r"\d++(?:[.,:]\d++{})*+", r"(?![\p{L}\p{N}])"


def _marked(text: Column) -> Column:
    """The text in lower case with each slot as one token: \\x01, its type (n, u or p) and its value.

    A number's value is the whole number; commas before three digits go, other separators stay.
    """
    out = F.translate(F.coalesce(text, F.lit("")), _MARK, "")
    # Names: a capitalised word after a lower-case one. Sentences may begin with any word.
    out = F.regexp_replace(out, r"(?<=\p{Ll},? )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", "\x01p$1")
    out = F.lower(out)
    slots = F.regexp_replace(out, r"(?<=\d),(?=\d{3}(?!\d))", "")
    slots = F.regexp_replace(slots, rf"(?<![\p{{L}}\p{{N}}]|\d[.,:])[$€£]?({_NUMBER.format("")})\s?(?:{_UNITS})(?![\p{{L}}\p{{N}}])", " \x01u$1 ")
    slots = F.regexp_replace(slots, rf"(?<![\p{{L}}\p{{N}}]|\d[.,:])({_NUMBER.format(_NO_LETTER)})(?![\p{{L}}\p{{N}}])", " \x01n$1 ")
    slots = F.regexp_replace(slots, "(?:[^\\p{L}\\p{N}\x01.,:]|[.,:](?!\\d)|(?<!\\d)[.,:])++", " ")
    return F.btrim(F.when(out.rlike("[0-9]"), slots).otherwise(F.regexp_replace(out, "[^\\p{L}\\p{N}\x01]++", " ")))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(text: Column, sizes: list[int]) -> Column:
    """Array of (size, at, h, s) of all windows of the given sizes: s are a window's marked tokens in order, null without any."""

    def of(marked: Column) -> Column:
        plain = ~marked.contains(_MARK)
        tokens = F.split(marked, " ")

        def build(token: Column) -> Column:
            bare = F.transform(token, lambda t: F.when(t.startswith(_MARK), F.substring(t, 1, 2)).otherwise(t))

            def of_size(size: int, b: Column | None) -> Column:
                last = F.size(token) - size
                steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
                slots = lambda i: F.filter(F.slice(token, i + 1, size), lambda t: t.startswith(_MARK)) if b is not None else F.lit(None).cast("array<string>")
                # Slots take part by type; their values are compared where windows meet.
                rows = F.transform(steps, lambda i: F.struct(
                    F.lit(size).alias("size"), i.alias("at"), F.xxhash64(*[F.get(token if b is None else b, i + j) for j in range(size)]).alias("h"), slots(i).alias("s"),
                ))
                return F.when(last < 0, F.array().cast("array<struct<size:int,at:int,h:bigint,s:array<string>>>")).otherwise(rows)

            light = F.flatten(F.array(*[of_size(n, None) for n in sizes]))
            heavy = _let(bare, lambda b: F.flatten(F.array(*[of_size(n, b) for n in sizes])))
            return F.when(plain, light).otherwise(heavy)

        return _let(tokens, build)

    return _let(_marked(text), of)


def n_tokens(text: Column) -> Column:
    return _let(_marked(text), lambda m: F.when(m == "", 0).otherwise(F.size(F.split(m, " "))))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """items (item_id, text) -> size, h, item_id, at, item_slots, n_windows. Items of under `window` tokens are one window, or none under MIN_LITERAL."""
    n = n_tokens(F.col("text"))
    sizes = list(range(MIN_LITERAL, window + 1))
    out = items.select("item_id", F.least(n, F.lit(window)).alias("n"), F.explode(_windows(F.col("text"), sizes)).alias("w"))
    kept = out.filter((F.col("w.size") == F.col("n")) & (F.size(F.coalesce("w.s", F.array())) <= F.col("n") - MIN_LITERAL))
    counted = kept.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    return kept.join(counted, "item_id").select("w.size", "w.h", "item_id", "w.at", F.col("w.s").alias("item_slots"), "n_windows")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, exact) of each document and item that it holds.

    n_matched is of the best occurrence; exact says whether all its slots have the item's
    values. Null and empty texts hold nothing, rows that repeat an id are judged together,
    and rows of null id are left out. Columns besides the id and text are unused.
    """
    wanted = staged(benchmark_windows(items.select("item_id", "text").filter("item_id IS NOT NULL"), window), "templates")
    sizes = sorted(r.size for r in wanted.select("size").distinct().collect()) or [window]
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    found = docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(_windows(F.col("text"), sizes)).alias("w"))
    found = found.select("doc_id", "w.size", F.col("w.at").alias("pos"), F.col("w.h").alias("h"), F.col("w.s").alias("doc_slots")).join(wanted, ["size", "h"])
    hits = found.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("diagonal"), "at", "n_windows", "doc_slots", "item_slots")
    occurrence = ["doc_id", "item_id", "diagonal"]
    # Few rows are left here. Slots are matched where there are any.
    hits = staged(hits, "hits")
    pairs = hits.filter(F.size(F.coalesce("item_slots", F.array())) > 0).select(*occurrence, "at", F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s"))
    pairs = pairs.select(*occurrence, "at", F.col("s.item_slots").alias("theirs"), F.col("s.doc_slots").alias("ours"))
    kinds = pairs.groupBy(*occurrence, "theirs", "ours").agg(F.count("*").alias("n"))
    one_to_one = (
        kinds.groupBy(*occurrence, "theirs").agg(F.count("*").alias("images"), F.first("ours").alias("ours"))
        .groupBy(*occurrence, "ours").agg(F.max("images").alias("images"), F.count("*").alias("sources"), F.min("theirs").alias("theirs"))
    )
    broken = (
        pairs.join(one_to_one.filter("images > 1 OR sources > 1").select(*occurrence, "ours"), [*occurrence, "ours"], "left_semi").select(*occurrence, "at")
        .union(
            pairs.join(kinds.groupBy(*occurrence, "theirs").agg(F.count("*").alias("images")).filter("images > 1"), [*occurrence, "theirs"], "left_semi").select(*occurrence, "at")
        )
        .distinct()
    )
    sound = hits.join(broken, [*occurrence, "at"], "left_anti")
    same = F.coalesce(F.col("item_slots") == F.col("doc_slots"), F.lit(True))
    found = sound.groupBy(*occurrence).agg(F.countDistinct("at").alias("n_matched"), F.max("n_windows").alias("n_windows"), F.bool_and(same).alias("exact"))
    return (
        found.filter(F.col("n_matched") >= F.least(F.lit(min_windows), F.col("n_windows")))
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("n_matched", "exact"), F.struct("n_matched", "exact")).alias("best"), F.max("n_windows").alias("n_windows"))
        .select("doc_id", "item_id", F.col("best.n_matched").alias("n_matched"), "n_windows", F.col("best.exact").alias("exact"))
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item; rows without an id are kept."""
    found = staged(find_contamination(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
