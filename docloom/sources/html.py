"""Web pages: title, links and text by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named characters of HTML that text needs; fixed values.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.when(~html.contains("</title>"), "").otherwise(F.trim(F.regexp_extract(html, "(?s)<title[^>]*>(.*?)</title>", 1)))


def body(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; blocks end lines, runs of blanks are one.

    What is opened and never closed reaches to the end, so no part is searched twice.
    """
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<title\b.*?(?:</title>|\z)", " ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|blockquote|pre)\b[^>]*(?:>|\z)", "\n")
    out = F.regexp_replace(out, r"<[^>]*(?:>|\z)", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, "[ \t\r\x0b\f]+", " ")
    return F.btrim(F.regexp_replace(out, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def documents(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as documents; a page without a title is named by its url."""
    text = body(F.col("html"))
    name = F.coalesce(F.when(title(F.col("html")) != "", title(F.col("html"))), F.col("url"))
    return pages.select(
        F.col("page_id").alias("doc_id"), name.alias("title"), F.substring(text, 1, 240).alias("opening"), text.alias("body"),
        F.array(F.parse_url("url", F.lit("HOST"))).alias("tags"), links(F.col("html")).alias("links"), F.array().cast("array<string>").alias("aliases"),
        F.lit(None).cast("string").alias("updated_at"), F.lit(0.0).alias("rank_score"), F.to_json(F.struct("url")).alias("extra"),
    )
