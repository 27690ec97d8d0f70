"""Dumps that come as lines of fields: places, their names and dimensions, page views, page properties."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a place file, in its order; fixed values.
PLACE = (
    "id bigint, name string, asciiname string, alternatenames string, lat double, lon double, class string, code string, cc string, cc2 string, "
    "admin1 string, admin2 string, admin3 string, admin4 string, population bigint, elevation string, dem string, timezone string, modified string"
)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of the text file in each zip archive that is named like the archive, some thousand at a time."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            name = path.rsplit("/", 1)[1].removesuffix(".zip") + ".txt"
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive, archive.open(name) as member:
                text = io.TextIOWrapper(member, "utf-8", newline="\n")
                while lines := list(itertools.islice(text, 5000)):
                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in lines], pa.string())], names=["value"])


def _tabbed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated lines without quotes; lines that begin with # are comments, fields out of form are null.

    Of a path that ends in .zip each archive is one task, which reads its text without
    unpacking it to a disk; plain files are split.
    """
    if not path.endswith(".zip"):
        return spark.read.csv(path, schema=schema, sep="\t", quote="", comment="#", mode="PERMISSIVE")
    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_members, "value string").filter("value <> '' AND NOT startswith(value, '#')")
    return lines.select(F.from_csv("value", schema, {"sep": "\t", "quote": "", "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def places(spark: SparkSession, path: str) -> DataFrame:
    """The 19 columns of a place file; places without a sound id, name or coordinates are the reader's to drop."""
    return _tabbed(spark, path, PLACE)


def place_names(spark: SparkSession, path: str, langs: tuple[str, ...] = ("ja", "en")) -> DataFrame:
    """id, name, lang of the languages told (`*` for all) and of item ids (wkdt); links and empty names go."""
    names = _tabbed(spark, path, "row bigint, id bigint, lang string, name string").filter("name <> '' AND id IS NOT NULL")
    lang = F.coalesce("lang", F.lit(""))
    wanted = lang != "link" if "*" in langs else lang.isin(*langs, "wkdt")
    return names.filter(wanted).select("id", "name", lang.alias("lang"))


def countries(spark: SparkSession, path: str) -> DataFrame:
    """cc, country: the first and fifth column."""
    return _tabbed(spark, path, "cc string, iso3 string, number string, fips string, country string").filter("cc IS NOT NULL").select("cc", "country")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """key (`CC.code`), region: the first two columns."""
    return _tabbed(spark, path, "key string, region string").filter("key IS NOT NULL")


def page_views(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """page_id, views: the sum over lines `domain title page_id access total ...` of one domain; ids and totals that are no integers go."""
    at = F.split("value", " ")
    rows = spark.read.text(path).filter(F.col("value").startswith(f"{domain} ")).select(
        F.get(at, F.lit(2)).try_cast("bigint").alias("page_id"), F.get(at, F.lit(4)).try_cast("bigint").alias("n")
    )
    return rows.filter("page_id IS NOT NULL AND n IS NOT NULL").groupBy("page_id").agg(F.sum("n").alias("views"))


def page_items(spark: SparkSession, path: str) -> DataFrame:
    """page_id, wikidata from the INSERT lines of a properties dump; of several items of a page the last in its line counts.

    Of lines, which Spark reads in any order, that with the greater item counts.
    """
    pattern = r"\((\d+),'wikibase_item','(Q\d+)'"
    found = spark.read.text(path).select(F.posexplode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("at", "m"))
    pair = found.select("at", F.regexp_extract("m", pattern, 1).cast("bigint").alias("page_id"), F.regexp_extract("m", pattern, 2).alias("q"))
    return pair.groupBy("page_id").agg(F.max_by("q", F.struct("at", "q")).alias("wikidata"))
