"""Wiki dumps: pages by Spark's XML reader, nested markup to text in Arrow batches, the rest by expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators.spatial import valid
from ..schema import PAGEVIEWS, normalized_popularity

PAGE = "title string, ns int, id bigint, redirect struct<_title: string>, revision struct<timestamp: string, text: string>"
CATEGORY, MEDIA = ("Category:",), ("File:", "Image:")
_LINK = r"\[\[([^\[\]|{}]*)(?:\|[^\[\]]*)?\]\]"


def pages(spark: SparkSession, path: str, redirects: bool = False) -> DataFrame:
    """One row a page element, compressed files included; namespaces of the elements don't matter. `redirects`: only pages that redirect.

    Spark's XML reader gives a file to one task. Here what ends with a page's end is one record
    of the text reader, which splits files by size, also within bzip2; gzip can't be split.
    """
    text = spark.read.option("lineSep", "</page>").text(path)
    if redirects:
        text = text.filter(F.lower("value").contains("redirect"))  # other pages needn't be parsed
    page = F.regexp_extract("value", r"(?s)<page(?:\s[^>]*)?>.*", 0)
    # As a generator's row a page is parsed once; filters would else be pushed below and parse it for each column they name.
    told = text.select(page.alias("page")).filter("page <> ''").select(F.inline(F.array(F.from_xml(F.concat("page", F.lit("</page>")), PAGE))))
    told = told.filter("title IS NOT NULL OR id IS NOT NULL")  # a file may end within a page
    return told.filter("redirect IS NOT NULL") if redirects else told


def _prefixed(prefixes: Sequence[str]) -> str:
    return "(?:" + "|".join(rf"\Q{p}\E" for p in prefixes) + ")"


def _each(change: Callable[[str], str], text: Column) -> Column:
    """A small function of each text, in Arrow batches; null stays null."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(change, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def prose(markup: Column, media: Sequence[str] = MEDIA) -> Column:
    """Markup without comments, footnotes and embedded media."""
    prefixes = tuple(media)
    return _each(lambda t: M.without_media(M.without_notes(t), prefixes), markup)


#: What is done to unfolded text: (a text without any of these has no match, pattern, what replaces it).
_STEPS = (
    (("//",), r"\[(?:https?:)?//[^\s\]]+ ?([^\]]*)\]", "$1"),
    (("{|", "|}", "|-", "|+"), r"(?m)^\s*(?:\{\||\|\}|\|-|\|\+).*$", ""),
    (("=",), r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"),
    (("{{", "}}", "''", "__", "<"), r"\{\{|\}\}|'{2,}|__[A-Z]+__|</?[A-Za-z][^<>]*>", ""),
    (("|", "!"), r"(?m)^[ \t]*[!|]|\|\||!!|\|", " "),
    (("\n", "\r", "\u0085", "\u2028", "\u2029"), r"(?m)^[ \t]+|[ \t]+$", ""),  # the ends of the text itself are trimmed at last
    (("  ", "\t"), "[ \t]{2,}", " "),
    (("\n\n\n",), r"\n{3,}", "\n\n"),
)


def _replaced(text: Column, holds: Sequence[str], pattern: str, by: str) -> Column:
    """regexp_replace of texts that hold one of some strings. An expression tells it far sooner than a pattern; the lambda has the text evaluated once."""
    some = lambda t: reduce(Column.__or__, [t.contains(x) for x in holds])
    return F.get(F.transform(F.array(text), lambda t: F.when(some(t), F.regexp_replace(t, pattern, by)).otherwise(t)), F.lit(0))


def plain(markup: Column, params: bool, category: Sequence[str] = CATEGORY) -> Column:
    """Text of prose markup; of templates the values of their parameters stay, or nothing."""
    prefixes = tuple(category)
    out = _each(lambda t: M.unfolded(t, params, prefixes), markup)
    for holds, pattern, by in _STEPS:
        out = _replaced(out, holds, pattern, by)
    return F.nullif(F.btrim(out, F.lit(" \t\r\n")), F.lit(""))


def link_titles(markup: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(markup, F.lit(_LINK), F.lit(1)), F.trim), lambda t: t != "")


def _degrees(parts: Column, hemisphere: Column) -> Column:
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    sound = F.forall(parts, lambda p: p.try_cast("double").isNotNull()) & (F.size(parts) > 0)
    size = at(0) + at(1) / 60 + at(2) / 3600
    return F.when(sound, F.when(hemisphere.isin("S", "W"), -size).otherwise(size))


#: Names of parameters that hold coordinates: degrees, minutes, seconds and direction of latitude, then of longitude; fixed values.
NAMED = (
    (("緯度度", "緯度分", "緯度秒", "南北"), ("経度度", "経度分", "経度秒", "東西")),
    (("本社緯度度", "本社緯度分", "本社緯度秒", "本社N(北緯)及びS(南緯)"), ("本社経度度", "本社経度分", "本社経度秒", "本社E(東経)及びW(西経)")),
    (("本店緯度度", "本店緯度分", "本店緯度秒", "本店N(北緯)及びS(南緯)"), ("本店経度度", "本店経度分", "本店経度秒", "本店E(東経)及びW(西経)")),
    (("latd", "latm", "lats", "latNS"), ("longd", "longm", "longs", "longEW")),
    (("lat_deg", "lat_min", "lat_sec", "lat_dir"), ("lon_deg", "lon_min", "lon_sec", "lon_dir")),
)
DECIMAL = (("緯度", "経度"), ("latitude", "longitude"), ("lat", "lon"), ("lat", "long"))


def _named(markup: Column) -> Column:
    """Valid coordinates (lat, lon) from named parameters, the first family that is filled in."""
    value = lambda key: F.nullif(F.trim(F.regexp_extract(markup, rf"\|\s*\Q{key}\E\s*=[ \t]*([^|{{}}\n]*)", 1)), F.lit(""))
    side = lambda keys, usual: _degrees(F.array_compact(F.array(*[value(k) for k in keys[:3]])), F.upper(F.coalesce(value(keys[3]), F.lit(usual))))
    pairs = [(side(lat, "N"), side(lon, "E")) for lat, lon in NAMED] + [(value(lat).try_cast("double"), value(lon).try_cast("double")) for lat, lon in DECIMAL]
    pairs = F.array(*[F.struct(F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon")) for lat, lon in pairs])
    return F.get(F.filter(pairs, lambda c: F.coalesce(valid(c["lat"], c["lon"]), F.lit(False))), F.lit(0))


def coordinates(markup: Column) -> Column:
    """Struct (lat, lon), rounded to 7 digits, of the first valid {{coord|...}}, else from named parameters; null without one.

    Degrees, minutes and seconds before a hemisphere letter or two decimal numbers. Named
    parameters are taken from the whole markup, wherever they stand first.
    """
    def read(template: Column) -> Column:
        parts = F.transform(F.filter(F.split(template, r"\|"), lambda p: ~p.contains("=")), lambda p: F.upper(F.trim(p)))
        north = F.greatest(F.array_position(parts, F.lit("N")), F.array_position(parts, F.lit("S"))).cast("int")
        n = F.greatest(north - 1, F.lit(0))
        lettered = F.struct(
            F.round(_degrees(F.slice(parts, F.lit(1), n), F.get(parts, n)), 7).alias("lat"),
            F.round(_degrees(F.slice(parts, n + 2, n), F.get(parts, 2 * n + 1)), 7).alias("lon"),
        )
        decimal = F.struct(F.round(F.get(parts, F.lit(0)).try_cast("double"), 7).alias("lat"), F.round(F.get(parts, F.lit(1)).try_cast("double"), 7).alias("lon"))
        return F.when(north > 1, lettered).otherwise(decimal)

    found = F.transform(F.regexp_extract_all(markup, F.lit(r"(?i)\{\{\s*coord\s*\|([^{}]*)\}\}"), F.lit(1)), read)
    # No family is filled in without a parameter of a latitude, whose names all begin so.
    named = F.when(markup.rlike(r"\|\s*(?:本社|本店)?(?:緯度|lat)[^|{}=]*="), _named(markup))
    return F.coalesce(F.get(F.filter(found, lambda c: valid(c["lat"], c["lon"])), F.lit(0)), named)


def documents(
    dump: DataFrame, views: DataFrame | None = None, items: DataFrame | None = None, category: Sequence[str] = CATEGORY, media: Sequence[str] = MEDIA,
    other: Sequence[str] = (), redirects: DataFrame | None = None,
) -> DataFrame:
    """Documents from pages: articles with text; a redirect's title is an alias of what it points to.

    Tags are the categories of the markup, links the other articles; `other` are prefixes of
    links that are neither. views (page_id, views) and items (page_id, wikidata) are joined by
    id. Prefixes of other languages are parameters. `redirects` are the dump's pages that
    redirect, where they are had without parsing the others.
    """
    own = dump.filter("coalesce(ns, 0) = 0")
    moved = dump if redirects is None else redirects
    names = moved.filter("coalesce(ns, 0) = 0 AND redirect IS NOT NULL").groupBy(F.col("redirect._title").alias("title")).agg(F.array_sort(F.collect_set("title")).alias("aliases"))
    rows = own.filter("redirect IS NULL AND id IS NOT NULL AND title IS NOT NULL AND revision.text <> ''")
    rows = rows.select("id", "title", "revision.timestamp", F.col("revision.text").alias("m"), prose(F.col("revision.text"), media).alias("p"))
    rows = rows.withColumns({"t": link_titles(F.col("p")), "c": coordinates(F.col("m"))}).join(names, "title", "left")
    for told, value in ((views, "views bigint"), (items, "wikidata string")):
        name, kind = value.split()
        rows = rows.withColumn(name, F.lit(None).cast(kind)) if told is None else rows.join(told.withColumnRenamed("page_id", "id"), "id", "left")
    begins = lambda t, prefixes: t.rlike("^" + _prefixed(prefixes)) if prefixes else F.lit(False)
    tags = F.transform(F.filter("t", lambda t: begins(t, category)), lambda t: F.trim(F.regexp_replace(t, "^[^:]*:", "")))
    extra = F.to_json(F.struct(F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"), F.col("views").alias("pageviews_month"), "wikidata"))
    return rows.select(
        F.col("id").alias("doc_id"), "title", plain(F.when(F.col("p").contains("=="), F.regexp_extract("p", r"(?s)^(.*?)(?:(?m:^)==|\z)", 1)).otherwise(F.col("p")), False, category).alias("opening"), plain(F.col("p"), True, category).alias("body"),
        tags.alias("tags"), F.filter("t", lambda t: ~begins(t, (*category, *media, *other))).alias("links"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.col("timestamp").alias("updated_at"), normalized_popularity(F.col("views").cast("double"), PAGEVIEWS).alias("rank_score"), F.when(extra != "{}", extra).alias("extra"),
    )
