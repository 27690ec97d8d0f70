"""What tools return, as semi-structured values: summary, whether it is evidence, references and web rows.

Payloads differ by tool, so they are VARIANT and each field is taken from it as the type it must have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import REFERENCES

#: Keys whose list counts as a tool's rows, in this order, and those whose rows are documents; fixed values.
LISTS = ("results", "notes", "tags", "titles", "links", "sources")
DOCUMENTS = ("results", "notes")
#: Texts of a summary; fixed values.
ERROR, ROWS, OTHER = "エラー: ", " 件", "取得"
#: Where a provider's answer has its rows, and its field that becomes the snippet; fixed values.
PROVIDERS = {"brave": ("$.web.results", "description"), "searxng": ("$.results", "content")}
TITLE_CHARS, SNIPPET_CHARS = 200, 500


def payload(text: Column) -> Column:
    """Text of JSON as a VARIANT, null where it is none."""
    return F.try_parse_json(text)


def _field(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _integer(v: Column, key: str) -> Column:
    """The field if it is a whole number; no text and no fraction is taken for one."""
    return F.when(F.schema_of_variant(_field(v, key, "variant")) == "BIGINT", _field(v, key, "bigint"))


def _filled(v: Column, key: str) -> Column:
    """The field as text, null where it is missing, null or empty."""
    return F.nullif(_field(v, key, "string"), F.lit(""))


def _sizes(v: Column) -> list[Column]:
    return [F.size(_field(v, k, "array<variant>")) for k in LISTS]


def summary(v: Column) -> Column:
    """One line: the error, the total, how many rows the first list has, or the title. Null payloads are only 'got'."""
    n = F.coalesce(*_sizes(v))
    total = _integer(v, "total")
    told = F.when(_field(v, "error", "variant").isNotNull(), F.concat(F.lit(ERROR), F.coalesce(_field(v, "error", "string"), F.lit("null"))))
    told = told.when(total.isNotNull(), F.concat(F.lit("total="), total.cast("string"))).when(n.isNotNull(), F.concat(n.cast("string"), F.lit(ROWS)))
    return F.coalesce(told, _filled(v, "title"), F.lit(OTHER))


def evidence(ok: Column, v: Column) -> Column:
    """Whether a result supports an answer: a total above nothing, else any rows, else a title. Never null."""
    total = _integer(v, "total")
    some = F.greatest(F.lit(0), *_sizes(v)) > 0  # greatest passes over nulls
    return F.coalesce(ok, F.lit(False)) & F.when(total.isNotNull(), total > 0).otherwise(some | _filled(v, "title").isNotNull())


def quoted(text: Column) -> Column:
    """Percent encoding of a path or query value; slashes and ~ stay."""
    out = F.url_encode(text)
    for had, has in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(had), F.lit(has))
    return out


def named(results: DataFrame, thread: str = "ask", prefix: str = "/search") -> DataFrame:
    """results (thread, seq, source, payload) -> thread, seq, pos, source, title, doc_id, url: the documents that payloads show.

    The first list of documents counts, or the payload itself if it has a title. A payload's own
    source goes before the tool's; without any there is no link and no row. Documents without
    an id link to a search for their title; other fields of results are left out.
    """
    v = F.col("payload")
    listed = F.coalesce(*[_field(v, k, "array<variant>") for k in DOCUMENTS], F.array(v))
    rows = results.select(thread, "seq", F.coalesce(_filled(v, "source"), F.nullif(F.col("source"), F.lit(""))).alias("source"), F.posexplode(listed).alias("pos", "row"))
    rows = rows.select(thread, "seq", "pos", "source", _filled(F.col("row"), "title").alias("title"), _integer(F.col("row"), "doc_id").alias("doc_id")).filter("source IS NOT NULL AND title IS NOT NULL")
    at = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("?q="), quoted(F.col("title"))))
    return rows.withColumn("url", F.concat(F.lit(f"{prefix}/"), quoted(F.col("source")), F.lit("/"), at))


def numbered(found: DataFrame, thread: str = "ask", most: int = REFERENCES) -> DataFrame:
    """What named returns -> thread, n, source, title, doc_id, url: by first occurrence, each source and title once, at most `most`.

    The number's bound reaches below the shuffle, so a thread of very many rows sends few.
    """
    first = found.groupBy(thread, "source", "title").agg(F.min(F.struct("seq", "pos", "doc_id", "url")).alias("at"))
    n = F.row_number().over(Window.partitionBy(thread).orderBy("at.seq", "at.pos", "source", "title"))
    return first.withColumn("n", n).filter(F.col("n") <= most).select(thread, "n", "source", "title", "at.doc_id", "at.url")


def web_rows(answers: DataFrame, limit: int) -> DataFrame:
    """answers (provider, payload and others) -> the others, provider, n, title, snippet, url of the first `limit` rows that have a url.

    Rows are counted before those without a url go, so n has gaps. Unknown providers are read
    as searxng; an answer without rows gives none.
    """
    v = F.col("payload")
    rows = F.when(F.col("provider") == "brave", F.try_variant_get(v, PROVIDERS["brave"][0], "array<variant>")).otherwise(F.try_variant_get(v, PROVIDERS["searxng"][0], "array<variant>"))
    others = [c for c in answers.columns if c != "payload"]
    out = answers.select(*others, F.posexplode(F.slice(rows, 1, limit)).alias("_pos", "_row"))
    row = F.col("_row")
    snippet = F.when(F.col("provider") == "brave", _field(row, PROVIDERS["brave"][1], "string")).otherwise(_field(row, PROVIDERS["searxng"][1], "string"))
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    out = out.select(*others, (F.col("_pos") + 1).alias("n"), cut(_field(row, "title", "string"), TITLE_CHARS).alias("title"), cut(snippet, SNIPPET_CHARS).alias("snippet"), _filled(row, "url").alias("url"))
    return out.filter("url IS NOT NULL")
