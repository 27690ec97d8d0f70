"""The benchmark tables as a source of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build
from ..operators.knowledge import KnowledgeBase
from ..storage import scratch

#: The same corpus for an engine that reads SQL.
SQL = r"""
b AS (SELECT doc_id, text, lang, source, n_chars,
  substr(trim(split_part(ltrim(text, chr(32)||chr(9)||chr(10)||chr(13)), chr(10), 1), chr(32)||chr(9)||chr(13)), 1, 60) AS base FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS rn FROM b),
docs AS (SELECT r.doc_id,
  CASE WHEN rn = 1 THEN base ELSE base || ' (' || CAST(r.doc_id AS VARCHAR) || ')' END AS title,
  substr(text, 1, 240) AS opening, text AS body, lang, source,
  round(least(1.0, log10(1 + n_chars) / 7.0), 4) AS rank_score, n.n_name AS area, 'lang=' || lang AS feature,
  CASE WHEN r.doc_id % 2 = 0 THEN 'Q' || CAST(r.doc_id AS VARCHAR) END AS wikidata,
  round(CAST(e.embedding[1] AS DOUBLE) * 90, 7) AS lat, round(CAST(e.embedding[2] AS DOUBLE) * 180, 7) AS lon,
  '2026-' || lpad(CAST(1 + r.doc_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + r.doc_id % 28 AS VARCHAR), 2, '0') || 'T00:00:00' AS updated_at,
  [lang, source] AS tags, 'doc-' || CAST(r.doc_id % 50 AS VARCHAR) AS alias
  FROM r LEFT JOIN embeddings e ON e.vec_id = r.doc_id LEFT JOIN nation n ON n.n_nationkey = r.doc_id % 25)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, embeddings and nation as documents with coordinates and areas; ids are assumed unique."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blank = F.lit(" \t\n\r")
    line = F.btrim(F.split_part(F.ltrim(F.col("text"), blank), F.lit("\n"), F.lit(1)), F.lit(" \t\r"))
    named = build.first_seen_titles(raw.select("doc_id", F.substring(line, 1, 60).alias("title")), "doc_id", F.col("doc_id"), F.col("doc_id").cast("string"))
    where = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("doc_id"),
        F.round(F.get("embedding", F.lit(0)).cast("double") * 90, 7).alias("lat"), F.round(F.get("embedding", F.lit(1)).cast("double") * 180, 7).alias("lon"),
    )
    areas = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("_k"), F.col("n_name").alias("area"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        raw.join(named.select("doc_id", "title"), "doc_id")
        .select(
            "doc_id", "title",
            F.substring("text", 1, 240).alias("opening"), F.col("text").alias("body"), "lang", "source",
            F.round(F.least(F.lit(1.0), F.log10(1 + F.col("n_chars")) / 7.0), 4).alias("rank_score"), F.concat(F.lit("lang="), "lang").alias("feature"),
            F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Q"), F.col("doc_id").cast("string"))).alias("wikidata"),
            F.concat(F.lit("2026-"), two(1 + F.col("doc_id") % 12), F.lit("-"), two(1 + F.col("doc_id") % 28), F.lit("T00:00:00")).alias("updated_at"),
            F.array("lang", "source").alias("tags"), F.array(*[F.concat(F.lit("doc-"), ((F.col("doc_id") + i) % 50).cast("string")) for i in (0, 1)]).alias("links"),
            F.array(F.concat(F.lit("doc-"), (F.col("doc_id") % 50).cast("string"))).alias("aliases"), (F.col("doc_id") % 25).alias("_k"),
        )
        .join(where, "doc_id", "left")
        .join(areas, "_k", "left")
        .drop("_k")
    )


_OPENED: dict[tuple[str, str], KnowledgeBase] = {}


def knowledge(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """The corpus as a published source, built by the first query of an application and read by all."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPENED:
        _OPENED[key] = build.opened(spark, build.build(documents(spark, sf_dir), scratch(spark, "corpus"), "corpus", "bench"))
    return _OPENED[key]
