"""Registered queries over tool results: conversations' turns as what tools return, of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import toolresults

REGISTRY: dict = {}


def _register(name: str, sql: str | None = None):
    def add(run):
        REGISTRY[name] = (run, sql)
        return run

    return add


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, seq, source, ok, payload: a result a turn, whose shape goes by conversation and turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k, turn, text = (F.col("conv_id") + F.col("turn")) % 6, F.col("turn").cast("bigint"), F.coalesce("text", F.lit(""))
    title = lambda n: F.substring(text, 1, n).alias("title")
    shapes = [
        F.struct(F.col("role").alias("error")), F.struct(turn.alias("total"), F.array().cast("array<string>").alias("results")),
        F.struct(F.array(F.struct(F.col("role").alias("title"), turn.alias("doc_id")), F.struct(title(20), F.lit(None).cast("bigint").alias("doc_id"))).alias("results")),
        F.struct(title(12)), F.struct(F.array("role", F.lit("b")).alias("tags")),
        F.struct(F.lit("notes").alias("source"), F.array(F.struct(F.concat(F.lit("note/"), turn.cast("string")).alias("title"), F.lit("x").alias("doc_id"))).alias("notes")),
    ]
    told = F.coalesce(*[F.when(k == i, F.to_json(s)) for i, s in enumerate(shapes)])
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("web pages").alias("source"), (F.col("turn") % 5 != 0).alias("ok"), toolresults.payload(told).alias("payload"))


_SHAPES = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 6 AS k FROM conversations)"


@_register("tool_result_summaries", f"""WITH {_SHAPES} SELECT conv_id, turn AS seq,
  CASE k WHEN 0 THEN 'エラー: ' || role WHEN 1 THEN 'total=' || CAST(turn AS VARCHAR) WHEN 2 THEN '2 件' WHEN 3 THEN CASE WHEN text = '' THEN '取得' ELSE substr(text, 1, 12) END WHEN 4 THEN '2 件' ELSE '1 件' END AS summary,
  turn % 5 <> 0 AND CASE k WHEN 0 THEN FALSE WHEN 1 THEN turn > 0 WHEN 3 THEN text <> '' ELSE TRUE END AS evidence FROM t""")
def tool_result_summaries(spark, sf_dir):
    """Every result in one line, and whether it is evidence."""
    rows = _results(spark, sf_dir)
    return rows.select("conv_id", "seq", toolresults.summary(F.col("payload")).alias("summary"), toolresults.evidence(F.col("ok"), F.col("payload")).alias("evidence"))


@_register("tool_result_references", f"""WITH {_SHAPES}, f AS (
  SELECT conv_id, turn AS seq, 0 AS pos, 'web pages' AS source, role AS title, CAST(turn AS BIGINT) AS doc_id FROM t WHERE k = 2
  UNION ALL SELECT conv_id, turn, 1, 'web pages', substr(text, 1, 20), NULL FROM t WHERE k = 2
  UNION ALL SELECT conv_id, turn, 0, 'web pages', substr(text, 1, 12), NULL FROM t WHERE k = 3
  UNION ALL SELECT conv_id, turn, 0, 'notes', 'note/' || CAST(turn AS VARCHAR), NULL FROM t WHERE k = 5),
g AS (SELECT conv_id, source, title, min((seq, pos)) AS place, arg_min(coalesce(doc_id, -1), (seq, pos)) AS doc_id FROM f WHERE title <> '' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, source, title) AS n FROM g)
SELECT conv_id, n, source, title, nullif(doc_id, -1) AS doc_id,
  '/search/' || replace(source, ' ', '%20') || '/' || CASE WHEN doc_id >= 0 THEN 'doc/' || CAST(doc_id AS VARCHAR) ELSE '?q=' || replace(url_encode(title), '%2F', '/') END AS url FROM n WHERE n <= 20""")
def tool_result_references(spark, sf_dir):
    """The documents that a conversation's results show, numbered."""
    return toolresults.numbered(toolresults.named(_results(spark, sf_dir), "conv_id"), "conv_id")


@_register("web_result_rows", """WITH p AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'brave' ELSE 'searxng' END AS provider FROM pages)
SELECT page_id, provider, 1 AS n, provider AS title, substr(coalesce(html, ''), 1, 500) AS snippet, url FROM p WHERE url <> ''
UNION ALL SELECT page_id, provider, 3, '', '', 'http://c.example/' FROM p WHERE page_id % 3 = 0""")
def web_result_rows(spark, sf_dir):
    """Pages as answers of two providers: normalised rows, of at most three, those without a url left out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("provider", F.when(F.col("page_id") % 2 == 0, "brave").otherwise("searxng"))
    none = F.lit(None).cast("string")

    def rows(snippet: str):
        row = lambda title, text, url: F.struct(title.alias("title"), text.alias(snippet), url.alias("url"))
        third = F.when(F.col("page_id") % 3 == 0, F.lit("http://c.example/"))
        return F.array(row(F.col("provider"), F.col("html"), F.col("url")), row(none, none, F.lit("")), row(none, none, third), row(none, none, F.lit("http://d.example/"))).alias("results")

    told = F.when(F.col("provider") == "brave", F.to_json(F.struct(F.struct(rows("description")).alias("web")))).otherwise(F.to_json(F.struct(rows("content"))))
    return toolresults.web_rows(pages.select("page_id", "provider", toolresults.payload(told).alias("payload")), 3)
