"""Text files whose line numbers matter, and documents from lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.build import last_wins
from ..schema import DOC_SCHEMA


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines counted), value: the physical lines of text files.

    Blocks of a file are read by separate tasks. Only their line counts are summed, one row a
    block, so no task sees a whole file unless its codec can't be split.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")
    )
    blocks = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # A row a block of the input, some of 128 MB; else all lines would be shuffled, those of a block to one task.
    return lines.join(F.broadcast(blocks), ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def header(spark: SparkSession, path: str, today: str) -> dict:
    """dump_date, min_docs and sample_titles of a first line {"meta": {...}}, with defaults for what is missing or out of form."""
    meta = F.from_json("value", "meta struct<dump_date:string, min_docs:bigint, sample_titles:array<string>>").meta
    row = numbered(spark, path).filter("line = 1").select(meta.alias("m")).filter("m IS NOT NULL").first()
    m = row.m if row else None
    date = m.dump_date if m and m.dump_date and len(m.dump_date) == 8 and m.dump_date.isdigit() else today
    return {"dump_date": date, "min_docs": max(1, (m and m.min_docs) or 1), "sample_titles": list((m and m.sample_titles) or [])}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the uniform model, one a line of JSON; of lines with one doc_id the last stays.

    Blank lines and a first line of meta are skipped. A missing doc_id is the line's number.
    A line that is no JSON object or has no title stops the read with its number.
    """
    told = numbered(spark, path).filter("trim(value) <> ''")
    told = told.filter((F.col("line") > 1) | F.get_json_object("value", "$.meta").isNull())
    told = told.withColumn("d", F.from_json("value", DOC_SCHEMA))
    wrong = F.raise_error(F.concat(F.lit("no title in line "), F.col("line").cast("string")))
    none = F.array().cast("array<string>")
    extra = F.get_json_object("value", "$.extra")
    docs = told.select(
        F.coalesce("d.doc_id", "line").alias("doc_id"), F.when(F.trim("d.title") != "", F.col("d.title")).otherwise(wrong).alias("title"), "d.opening", "d.body",
        *[F.coalesce(F.col(f"d.{c}"), none).alias(c) for c in ("tags", "links", "aliases")],
        "d.updated_at", F.coalesce("d.rank_score", F.lit(0.0)).alias("rank_score"), F.when(extra.startswith("{"), extra).alias("extra"), F.struct("file", "line").alias("seq"),
    )
    return last_wins(docs).drop("seq")
