"""Documents from map data: tables of nodes, ways and relations.

nodes (id, lat, lon, tags, updated_at), ways (id, refs, tags, updated_at), relations (id,
members of (type, ref, role), tags, updated_at); tags are maps, type is n, w or r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CITY, normalized_popularity
from . import build, spatial

# Fixed values of the document model: which features count, their scores and the formats of texts.
PLACE_SCORE = {
    "country": 1.0, "state": 0.9, "province": 0.9, "region": 0.85, "city": 0.85, "county": 0.8, "town": 0.7, "island": 0.6,
    "village": 0.55, "suburb": 0.5, "quarter": 0.45, "neighbourhood": 0.4, "hamlet": 0.35, "islet": 0.3, "locality": 0.25, "square": 0.25,
}
KEY_SCORE = {
    "aeroway": 0.65, "railway": 0.6, "public_transport": 0.55, "aerialway": 0.5, "highway": 0.5, "tourism": 0.45, "historic": 0.45, "healthcare": 0.4,
    "amenity": 0.4, "man_made": 0.35, "leisure": 0.35, "shop": 0.3, "office": 0.25, "craft": 0.25,
}
LIMITED = {
    "natural": ("peak", "volcano", "hot_spring", "spring", "bay", "cape", "beach", "island", "islet", "peninsula", "isthmus", "strait", "water", "wetland", "glacier", "dune", "cliff"),
    "railway": ("station", "halt", "tram_stop"),
    "aeroway": ("aerodrome", "terminal", "helipad", "heliport"),
    "aerialway": ("station",),
    "public_transport": ("station",),
    "highway": ("services", "rest_area", "motorway_junction", "toll_gate"),
    "man_made": ("bridge", "lighthouse", "pier", "tower"),
}
ANY_VALUE = ("amenity", "shop", "tourism", "leisure", "historic", "craft", "office", "healthcare")
NAMES = ("name:ja", "name:en", "name:ja-Hira", "name:ja_kana", "name:ja_rm", "alt_name", "official_name", "short_name", "old_name", "int_name", "loc_name", "nat_name")
ADDRESS = ("addr:postcode", "addr:city", "addr:street", "addr:housenumber")
CONTACT = {"phone": ("phone", "contact:phone"), "website": ("website", "contact:website", "url"), "opening_hours": ("opening_hours",)}
KINDS = ("node", "way", "relation")
OTHER_PLACE, OTHER_KEY, NO_LEVEL = 0.3, 0.4, 11
#: References of a way that its centre is the mean of; of a relation's ways; and how many of its ways count.
WAY_NODES, MEMBER_NODES, MEMBER_WAYS = 50, 10, 30
AREA_LEVEL = 4


def tag(tags: Column, key: str | Column) -> Column:
    """The value of a tag, null where it is empty."""
    return F.nullif(F.try_element_at(tags, F.lit(key) if isinstance(key, str) else key), F.lit(""))


def number_of(tags: Column, key: str) -> Column:
    """The digits of a tag as a number."""
    return F.regexp_replace(tag(tags, key), r"[^\d]", "").try_cast("bigint")


def feature(tags: Column) -> Column:
    """(key, value) of what a named thing is, by the first key that counts; null for what makes no document."""
    sorts = [("place", None), ("boundary", ("administrative",)), *LIMITED.items(), *((key, None) for key in ANY_VALUE)]
    value = lambda k: F.try_element_at(tags, F.lit(k))
    # One condition a sort: as a filter of an array of sorts each row took some fifty times as long.
    key = F.coalesce(*[F.when(value(k).isin(*values) if values else value(k) != "", F.lit(k)) for k, values in sorts])
    return F.when((value("name") != "") & key.isNotNull(), F.struct(key.alias("key"), F.try_element_at(tags, key).alias("value")))


def rank(kind: Column, tags: Column) -> Column:
    """The score of a feature: by the sort of place, the level of a boundary or the key; people can raise it."""
    table = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    level = number_of(tags, "admin_level")
    score = (
        F.when(kind["key"] == "place", F.coalesce(F.try_element_at(table(PLACE_SCORE), kind["value"]), F.lit(OTHER_PLACE)))
        .when(kind["key"] == "boundary", spatial.admin_level_score(F.coalesce(F.when(level != 0, level), F.lit(NO_LEVEL))))
        .otherwise(F.coalesce(F.try_element_at(table(KEY_SCORE), kind["key"]), F.lit(OTHER_KEY)))
    )
    return F.round(F.greatest(score, normalized_popularity(number_of(tags, "population").cast("double"), CITY)), 4)


def relation_centres(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, lat, lon: the label node, else the admin_centre, else the mean of member nodes and of the centres of outer ways."""
    members = relations.select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", "m.type", "m.ref", "m.role")
    points = members.filter("type = 'n'").join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    outer = F.filter("members", lambda m: (m["type"] == "w") & m["role"].isin("outer", ""))
    outer = relations.select("id", F.explode(F.slice(F.transform(outer, lambda m: m["ref"]), 1, MEMBER_WAYS)).alias("ref"))
    wanted = ways.join(outer.select(F.col("ref").alias("id")).distinct(), "id", "left_semi")
    centres = outer.join(spatial.means(wanted, nodes, MEMBER_NODES).withColumnRenamed("id", "ref"), "ref")
    preferred = lambda role: F.min_by(F.when(F.col("role") == role, F.struct("lat", "lon")), F.when(F.col("role") == role, F.col("pos")))
    named = points.groupBy("id").agg(F.coalesce(preferred("label"), preferred("admin_centre")).alias("at"))
    means = points.select("id", "lat", "lon").unionByName(centres.select("id", "lat", "lon")).groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return means.join(named, "id", "left").select("id", F.coalesce("at.lat", "lat").alias("lat"), F.coalesce("at.lon", "lon").alias("lon"))


def area_edges(relations: DataFrame, ways: DataFrame, nodes: DataFrame, level: int = AREA_LEVEL) -> DataFrame:
    """area, lat1, lon1, lat2, lon2: the edges of all member ways of administrative boundaries of a level.

    Rings needn't be put together, and holes need no other treatment: crossings are counted.
    """
    tags = F.col("tags")
    areas = relations.filter((tag(tags, "boundary") == "administrative") & (tag(tags, "admin_level") == str(level)) & tag(tags, "name").isNotNull())
    borders = areas.select(tag(tags, "name").alias("area"), F.explode("members").alias("m")).filter("m.type = 'w' AND m.role IN ('outer', 'inner', '')").select("area", F.col("m.ref").alias("id"))
    steps = ways.join(borders.select("id").distinct(), "id", "left_semi").select("id", F.posexplode("refs").alias("pos", "ref"))
    located = steps.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    lines = located.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("line")).filter(F.size("line") > 1)
    edges = lines.select("id", F.explode(F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("p"), F.slice("line", 2, F.size("line") - 1).alias("q"))).alias("e"))
    return borders.join(edges, "id").select("area", F.col("e.p.lat").alias("lat1"), F.col("e.p.lon").alias("lon1"), F.col("e.q.lat").alias("lat2"), F.col("e.q.lon").alias("lon2"))


def features(nodes: DataFrame, ways: DataFrame, relations: DataFrame, level: int = AREA_LEVEL) -> DataFrame:
    """doc_id, kind, id, tags, key, value, lat, lon, area, updated_at of everything that makes a document."""
    own = lambda df: df.withColumn("f", feature(F.col("tags"))).filter("f IS NOT NULL")
    columns = ["id", "tags", "f", "lat", "lon", "updated_at"]
    far, areas = own(ways), own(relations)
    told = [
        own(nodes).filter("lat IS NOT NULL AND lon IS NOT NULL").select(*columns),
        far.join(spatial.means(far, nodes, WAY_NODES), "id", "left").select(*columns),
        areas.join(relation_centres(areas, ways, nodes), "id", "left").select(*columns),
    ]
    rows = [df.withColumns({"kind": F.lit(kind), "doc_id": F.col("id") * 4 + code}) for code, (kind, df) in enumerate(zip(KINDS, told))]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2])
    located = spatial.points_in_edges(found.select("doc_id", "lat", "lon"), area_edges(relations, ways, nodes, level))
    return found.join(located, "doc_id", "left").select("doc_id", "kind", "id", "tags", "f.key", "f.value", "lat", "lon", "area", "updated_at")


def documents(found: DataFrame, lang: str | None = None, labels: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """What features returns as documents; labels name sorts of features, which else show as key=value.

    Of equal names nodes come before ways before relations, then the least id keeps the title.
    """
    tags, kind = F.col("tags"), F.struct("key", "value")
    named = build.first_seen_titles(found.withColumn("title", tag(tags, "name")), "doc_id", F.struct(F.col("doc_id") % 4, "id"), F.concat("kind", F.lit(":"), F.col("id").cast("string")))
    spelled = F.flatten(F.transform(F.array(*map(F.lit, NAMES)), lambda k: F.transform(F.split(F.coalesce(tag(tags, k), F.lit("")), ";"), lambda x: F.trim(x))))
    aliases = F.filter(F.array_distinct(F.concat(F.array_compact(F.array("alias")), spelled)), lambda x: (x != "") & (x != F.col("title")))
    pair = F.concat("key", F.lit("="), "value")
    label = F.coalesce(*[F.when((F.col("key") == k) & (F.col("value") == v), F.lit(name)) for (k, v), name in (labels or {}).items()], pair)
    street = F.concat_ws(" ", *[tag(tags, k) for k in ADDRESS])
    address = F.coalesce(tag(tags, "addr:full"), F.when(street != "", street))
    shown = lambda text, value, end="": F.concat(F.lit(text), value, F.lit(end))
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.format_string("座標 %.4f, %.4f", "lat", "lon"))
    details = F.array_compact(F.array(shown("所在 ", F.col("area")), shown("admin_level=", tag(tags, "admin_level")), shown("標高 ", tag(tags, "ele"), "m"), shown("人口 ", tag(tags, "population")), shown("住所 ", address), place))
    contact = {k: F.coalesce(*[tag(tags, x) for x in keys]) for k, keys in CONTACT.items()}
    wiki = F.coalesce(tag(tags, "wikipedia"), *([tag(tags, f"wikipedia:{lang}")] if lang else []))
    lines = F.concat(
        F.array(tag(tags, "name")), F.filter("aliases", lambda x: x != tag(tags, "name")), F.array(F.concat(F.lit("種別: "), "label", F.lit(" ("), pair, F.lit(")"))), "details",
        F.array_compact(F.array(shown("is_in: ", tag(tags, "is_in")), *[shown(f"{k}: ", v) for k, v in contact.items()])),
    )
    extra = F.to_json(F.struct(
        F.col("kind").alias("osm_type"), F.col("id").alias("osm_id"), pair.alias("feature"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "area", number_of(tags, "admin_level").alias("admin_level"),
        number_of(tags, "population").alias("population"), tag(tags, "wikidata").alias("wikidata"), wiki.alias("wikipedia"), address.alias("address"), *[v.alias(k) for k, v in contact.items()], "tags",
    ))
    told = named.withColumns({"aliases": aliases, "label": label, "details": details})
    return told.select(
        "doc_id", "title",
        F.concat(F.lit("OpenStreetMap の地物: "), "label", F.when(F.size("details") > 0, F.concat(F.lit("("), F.array_join("details", "、"), F.lit(")"))).otherwise("")).alias("opening"),
        F.array_join(lines, "\n").alias("body"), F.array_compact(F.array(pair, shown("admin_level=", tag(tags, "admin_level")))).alias("tags"),
        F.array_compact(F.array(F.regexp_replace(wiki, "^[^:]*:", ""))).alias("links"), "aliases", "updated_at", rank(kind, tags).alias("rank_score"), extra.alias("extra"),
    )
