"""Place tables joined to their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CITY, normalized_popularity
from .build import title_owners

CLASSES = ("A", "H", "L", "P", "S", "T", "U", "V")


def places(rows: DataFrame, countries: DataFrame, regions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Documents from rows (id, name, lat, lon, class, code, cc, admin1, population).

    countries (cc, country) and regions (key `CC.admin1`, region) are small dimensions whose
    size Spark checks before it broadcasts. An unknown country shows its code. The most
    populous of a name, then the least id, keeps it; others become `name (CC:id)` and have
    the plain name as alias. names (id, name, lang) adds aliases; lang wkdt is the item id.
    Rows may have timezone, elevation (whole numbers only) and modified as text; extra is JSON
    of what a place has, without what is null, and no population of nobody.
    """
    optional = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    sound = rows.filter(F.col("class").isin(*CLASSES) & (F.col("name") != "") & F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    owners = title_owners(sound, "population", "id", "name")
    joined = (
        sound.join(countries.dropDuplicates(["cc"]), "cc", "left")
        .join(regions.withColumnRenamed("key", "_key").dropDuplicates(["_key"]), F.concat_ws(".", "cc", "admin1") == F.col("_key"), "left")
        .join(owners, "name")
    )
    if names is not None:
        told = names.filter("name <> ''").groupBy("id").agg(
            F.min(F.when(F.col("lang") == "wkdt", F.col("name"))).alias("wikidata"),
            F.array_sort(F.collect_set(F.when(~F.col("lang").isin("wkdt", "link"), F.col("name")))).alias("_names"),
        )
        joined = joined.join(told, "id", "left")
    else:
        joined = joined.withColumns({"wikidata": F.lit(None).cast("string"), "_names": F.array().cast("array<string>")})
    owned = F.col("owner") == F.col("id")
    title = F.when(owned, F.col("name")).otherwise(F.concat("name", F.lit(" ("), "cc", F.lit(":"), F.col("id").cast("string"), F.lit(")")))
    country = F.coalesce("country", "cc")
    plain = F.when(owned, F.array().cast("array<string>")).otherwise(F.array("name"))
    feature, area = F.concat("class", F.lit("="), "code"), F.coalesce("region", country)
    people = F.when(F.col("population") > 0, F.col("population"))
    extra = F.struct(
        "lat", "lon", feature.alias("feature"), F.col("cc").alias("country_code"), area.alias("area"), country.alias("country"), people.alias("population"),
        optional("timezone").alias("timezone"), F.when(optional("elevation").rlike("^-*[0-9]+$"), optional("elevation").try_cast("bigint")).alias("elevation"), "wikidata",
    )
    return joined.select(
        F.col("id").alias("doc_id"), title.alias("title"),
        F.concat_ws(" / ", "name", "region", country).alias("opening"),
        F.array_distinct(F.array_compact(F.array(country, "region"))).alias("tags"),
        F.array_remove(F.array_distinct(F.concat(plain, F.coalesce("_names", F.array().cast("array<string>")))), title).alias("aliases"),
        feature.alias("feature"), area.alias("area"), "lat", "lon", "wikidata", "population",
        normalized_popularity(F.col("population").cast("double"), CITY).alias("rank_score"),
        optional("modified").alias("updated_at"), F.to_json(extra).alias("extra"),
    )
