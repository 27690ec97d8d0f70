"""From planned queries to the text that a model is asked with."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knowledge import KnowledgeBase

HISTORY, QUERIES, REFERENCES = 6, 3, 20


def history(messages: DataFrame, n: int = HISTORY, chars: int = 400) -> DataFrame:
    """conv_id, turn, role, text: the last n user and assistant messages of each conversation, cut at chars."""
    at = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    return spoken.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= n).select("conv_id", "turn", "role", F.substring("text", 1, chars).alias("text"))


def repeated_calls(calls: DataFrame, thread: str = "conv_id", order: str = "turn", on: tuple[str, ...] = ("role", "text")) -> DataFrame:
    """calls and `first_turn`, `repeated`: where an identical call of the thread came before."""
    at = Window.partitionBy(thread, *on).orderBy(order)
    return calls.withColumn("first_turn", F.first(order).over(at)).withColumn("repeated", F.col("first_turn") < F.col(order))


def plan(answers: DataFrame, sources: list[str], most: int = QUERIES) -> DataFrame:
    """answers (id, text) -> id, n, source, q: the queries of strict JSON, else of the first {…} block, else of loose pairs.

    Unknown sources and blank queries go, repeats too; at most `most` stay.
    """
    schema = "struct<queries:array<struct<source:string,q:string>>>"
    block = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    loose = F.zip_with(
        F.regexp_extract_all("text", F.lit(r'"source"\s*:\s*"([^"]+)"'), F.lit(1)), F.regexp_extract_all("text", F.lit(r'"q"\s*:\s*"([^"]+)"'), F.lit(1)),
        lambda s, q: F.struct(s.alias("source"), q.alias("q")),
    )
    found = F.coalesce(F.from_json("text", schema)["queries"], F.from_json(block, schema)["queries"], loose)
    sound = F.filter(F.transform(found, lambda x: F.struct(F.trim(x["source"]).alias("source"), F.trim(x["q"]).alias("q"))), lambda x: x["source"].isin(sources) & (x["q"] != ""))
    return answers.select("id", F.posexplode(F.slice(F.array_distinct(sound), 1, most)).alias("n", "x")).select("id", "n", "x.source", "x.q")


def longest_fragment(q: Column) -> Column:
    """The longest piece between punctuation and spaces; of equals the first."""
    pieces = F.filter(F.split(q, r"[\p{P}\s]+"), lambda p: p != "")
    return F.reduce(pieces, F.lit(""), lambda best, p: F.when(F.char_length(p) > F.char_length(best), p).otherwise(best))


def interleaved(hits: DataFrame, docs: int = 4, ask: str = "ask") -> DataFrame:
    """hits (ask, query_no, rank, source, doc_id, ...) -> n, ...: hits by rank, then query; each document once; at most `docs` an ask."""
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(ask, "source", "doc_id").orderBy("rank", "query_no"))).filter("_n = 1").drop("_n")
    return first.withColumn("n", F.row_number().over(Window.partitionBy(ask).orderBy("rank", "query_no"))).filter(F.col("n") <= docs)


_BLANK = " \t\n\r\f\x0b"


def _strip(x: Column) -> Column:
    return F.btrim(F.coalesce(x, F.lit("")), F.lit(_BLANK))


def context(picked: DataFrame, max_chars: int = 4000, docs: int = 4, short: int = 200) -> DataFrame:
    """picked (ask, n, source, title, opening, body) -> ask, context: `[n] source / title` and text, joined.

    A short opening is followed by the body. A text gets an equal share of max_chars, but no
    more than is left of it, and is stripped after the cut; empty ones take no number.
    picked holds at most some documents an ask, as interleaved leaves.
    """
    opening, body = _strip(F.col("opening")), _strip(F.col("body"))
    whole = F.when((F.char_length(opening) < short) & (body != ""), _strip(F.concat(opening, F.lit("\n"), body))).otherwise(opening)
    rows = F.array_sort(F.collect_list(F.struct("n", "source", "title", whole.alias("text"))))
    start = F.struct(F.lit(max_chars).alias("left"), F.array().cast("array<string>").alias("lines"))

    def turn(at: Column, row: Column) -> Column:
        text = _strip(F.substring(row["text"], F.lit(1), F.least(F.lit(max(1, max_chars // docs)), at["left"])))
        line = F.concat(F.lit("["), (F.size(at["lines"]) + 1).cast("string"), F.lit("] "), row["source"], F.lit(" / "), row["title"], F.lit("\n"), text)
        more = F.struct((at["left"] - F.char_length(text)).alias("left"), F.concat(at["lines"], F.array(line)).alias("lines"))
        return F.when((at["left"] > 0) & (text != ""), more).otherwise(at)

    return picked.groupBy("ask").agg(F.aggregate(rows, start, turn, lambda at: F.array_join(at["lines"], "\n\n")).alias("context"))


def fallback_queries(question: str, sources: list[str], most: int = QUERIES) -> list[tuple[str, str]]:
    """(source, q) when a plan gives none: the question's longest piece, asked of each source."""
    pieces = [p for p in re.split(r"[^\w]+", question) if p]
    piece = max(pieces, key=len, default=question.strip())
    return [(s, piece) for s in sources][:most]


def gather(queries: list[tuple[str, str]], sources: dict[str, KnowledgeBase], docs: int = 4, per_query: int = 5, max_chars: int = 4000) -> DataFrame:
    """context for the planned queries (source, q), at most QUERIES: each one's best hits, interleaved, then their texts."""
    hits = None
    for n, (source, q) in enumerate(queries[:QUERIES]):
        found = sources[source].search(q, limit=per_query)
        # per_query rows at most
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.lit(1)))).select(F.lit(1).alias("ask"), F.lit(n).alias("query_no"), "rank", F.lit(source).alias("source"), "doc_id")
        hits = ranked if hits is None else hits.unionByName(ranked)
    picked = [(r.ask, r.n, r.source, r.doc_id) for r in interleaved(hits, docs).collect()]  # `docs` rows at most
    told = None
    for source in sorted({p[2] for p in picked}):
        own = hits.sparkSession.createDataFrame([p for p in picked if p[2] == source], "ask int, n int, source string, doc_id bigint")
        kb = sources[source]
        texts = kb.docs.filter(F.col("doc_id").isin([p[3] for p in picked if p[2] == source])).select("doc_id", "title", "opening", "body").join(F.broadcast(own), "doc_id")
        told = texts if told is None else told.unionByName(texts)
    if told is None:
        return hits.sparkSession.createDataFrame([], "ask int, context string")
    return context(told, max_chars, docs)


def references(hits: DataFrame, most: int = REFERENCES, thread: str = "ask") -> DataFrame:
    """hits (ask, seq, source, title) -> ask, n, source, title: numbered by first occurrence, at most `most`."""
    first = hits.groupBy(thread, "source", "title").agg(F.min("seq").alias("seq"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(thread).orderBy("seq"))).filter(F.col("n") <= most).drop("seq")
