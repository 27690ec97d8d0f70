"""The registered queries: each a function of (spark, sf_dir) and, where SQL can say it, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build, context, gazetteer, jobs, mapfeatures, notes, spatial
from ..operators.knowledge import pool_size
from ..schema import normalized_popularity, with_extra_columns
from ..sources import tables
from ..storage import scratch
from .corpus import SQL as CORPUS
from .corpus import documents, knowledge

REGISTRY: dict = {}


def _register(name: str, sql: str | None = None):
    def add(run):
        REGISTRY[name] = (run, sql)
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What blank text is stripped of.
_B = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# --- search ---------------------------------------------------------------------------------


def _search_sql(q: str, limit: int = 10, offset: int = 0, where: str = "TRUE", pool: int | None = None) -> str:
    """Ranked search. Terms must not overlap themselves: occurrences are counted by replacing."""
    terms = T.match_terms(q)
    count = lambda c, t: f"((length(lower({c})) - length(replace(lower({c}), '{t}', ''))) / {len(t)})"
    tf = ", ".join(f"5.0 * {count('title', t)} + {count('body', t)} AS f{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(terms)))
    idf = [f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6)" for i in range(len(terms))]
    score = " - ".join(["0.0", *[f"{idf[i]} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms))]])
    exact = f"CASE WHEN lower(title) = '{q.lower()}' THEN 0 ELSE 1 END"
    t = terms[0]
    start = f"greatest(0, least(strpos(lower(body), '{t}') - 1 - {(40 - (len(t) - 2)) // 2}, length(body) - 42))"
    window = windows = ""
    if len(terms) > 1:
        # Of the windows of 40 places that begin with an occurrence: most terms, most occurrences, the earliest.
        at = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, {len(x)} AS n, unnest(list_filter(range(length(body)), lambda i: substr(b, i + 1, {len(x)}) = '{x}')) AS p FROM (SELECT doc_id, body, lower(body) AS b FROM page)" for k, x in enumerate(terms))
        windows = f""",
hit AS ({at}),
w AS (SELECT x.doc_id, x.p AS f, count(DISTINCT y.k) AS terms, count(DISTINCT (y.p, y.k)) AS hits, max_by(y.p + y.n - 2, y.p * 100 + y.k) AS l FROM hit x JOIN hit y ON x.doc_id = y.doc_id AND y.p BETWEEN x.p AND x.p + 39 GROUP BY x.doc_id, x.p),
best AS (SELECT doc_id, f, l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY terms DESC, hits DESC, f) AS r FROM w) WHERE r = 1)"""
        window = " LEFT JOIN best USING (doc_id)"
        start = "coalesce(greatest(0, least(f - CAST(trunc((40 - (l - f)) / 2) AS BIGINT), length(body) - 42)), 0)"
    picked = "m" if pool is None else f"(SELECT * FROM m WHERE doc_id IN (SELECT doc_id FROM m ORDER BY s, doc_id LIMIT {max(pool, limit + offset)}) OR doc_id IN (SELECT doc_id FROM (SELECT * FROM m WHERE starts_with(title, '{q}') ORDER BY title, doc_id LIMIT 20) WHERE title = '{q}' OR starts_with(title, '{q} (')))"
    return f"""WITH {CORPUS},
t AS (SELECT *, {tf}, greatest(length(title) - 2, 0) + greatest(length(body) - 2, 0) AS len FROM docs),
c AS (SELECT count(*) AS n, avg(len) AS mean, {stats} FROM t),
m AS (SELECT t.*, {score} AS s FROM t, c WHERE {' AND '.join(f'f{i} > 0' for i in range(len(terms)))} AND {where}),
page AS (SELECT doc_id, title, body, updated_at, round(s * (1 + 0.4 * greatest(0.0, least(1.0, coalesce(rank_score, 0.0)))), 6) AS score,
  row_number() OVER (ORDER BY {exact}, s * (1 + 0.4 * greatest(0.0, least(1.0, coalesce(rank_score, 0.0)))), doc_id) AS place FROM {picked} ORDER BY place LIMIT {limit} OFFSET {offset}){windows}
SELECT doc_id, title,
  CASE WHEN {start} > 0 THEN '…' ELSE '' END || substr(body, CAST({start} + 1 AS BIGINT), 42) || CASE WHEN {start} + 42 < length(body) THEN '…' ELSE '' END AS snippet,
  updated_at, score, 'fts' AS mode FROM page{window} ORDER BY place"""


def _searches() -> None:
    def add(name: str, q: str, where: str = "TRUE", pool: int | None = None, limit: int = 10, offset: int = 0, **filters):
        _register(name, _search_sql(q, limit, offset, where, None if filters else pool or pool_size(offset, limit)))(lambda s, d: knowledge(s, d).search(q, limit, offset, pool, **filters))

    add("search_single_term", "ther")
    add("search_multi_term_and", "ther ing")
    add("search_offset_page", "ther", limit=7, offset=20)
    add("search_pooled", "ther", pool=20)
    add("search_drops_short_terms", "ther of")
    add("search_filtered_tag", "ther", where="list_contains(tags, 'en')", tag="en")
    add("search_filtered_area", "ther", where="area = 'NATION_7'", area="NATION_7")
    add("search_filtered_bbox", "ther", where="lat BETWEEN -5 AND 10 AND lon BETWEEN -20 AND 20", bbox="-5,-20,10,20")


_searches()

_PREFIX = f"""WITH {CORPUS} SELECT doc_id, title, substr(coalesce(opening, body), 1, 120) AS snippet, updated_at, CAST(0.0 AS DOUBLE) AS score, 'title_prefix' AS mode
FROM docs WHERE starts_with(title, '@prefix') ORDER BY CASE WHEN lower(title) = '@exact' THEN 0 ELSE 1 END, rank_score DESC NULLS LAST, title, doc_id LIMIT 10"""


@_register("search_short_prefix_fallback", _PREFIX.replace("@prefix", "Th").replace("@exact", "th"))
def search_short_prefix_fallback(spark, sf_dir):
    return knowledge(spark, sf_dir).search("Th")


@_register("search_blank_query", _PREFIX.replace("@prefix", "").replace("@exact", ""))
def search_blank_query(spark, sf_dir):
    return knowledge(spark, sf_dir).search(" ")


@_register("search_exact_title_first", f"""WITH {CORPUS}, one AS (SELECT title AS q FROM docs WHERE doc_id = 3)
SELECT doc_id, title FROM docs, one WHERE lower(title) = lower(q)""")
def search_exact_title_first(spark, sf_dir):
    """The first hit of a search by a whole title is that document."""
    kb = knowledge(spark, sf_dir)
    title = kb.docs.filter("doc_id = 3").select("title").first()[0]
    return kb.search(title, limit=1).select("doc_id", "title")


@_register("search_by_postings", f"WITH {CORPUS} SELECT doc_id, title FROM docs WHERE contains(lower(title), 'ther') OR contains(lower(body), 'ther')")
def search_by_postings(spark, sf_dir):
    """All matches of a term, found by its trigrams' places alone."""
    return knowledge(spark, sf_dir).matches("ther").select("doc_id", "title")


# --- documents and filters ------------------------------------------------------------------


@_register("doc_by_id", f"WITH {CORPUS} SELECT doc_id, title, substr(body, 1, 200) AS body FROM docs WHERE doc_id = 7")
def doc_by_id(spark, sf_dir):
    return knowledge(spark, sf_dir).doc_by_id(7, "doc_id,title,body", 200)


@_register("doc_by_title", f"WITH {CORPUS} SELECT doc_id, title, area FROM docs WHERE title = (SELECT title FROM docs WHERE doc_id = 11)")
def doc_by_title(spark, sf_dir):
    kb = knowledge(spark, sf_dir)
    return kb.doc(kb.docs.filter("doc_id = 11").select("title").first()[0]).select("doc_id", "title", "area")


@_register("doc_alias", f"WITH {CORPUS} SELECT doc_id, title, rank_score, 1 AS stage FROM docs WHERE alias = 'doc-7' ORDER BY rank_score DESC, doc_id LIMIT 5")
def doc_alias(spark, sf_dir):
    return knowledge(spark, sf_dir).doc("doc-7").select("doc_id", "title", "rank_score", "stage")


@_register("doc_alternatives", f"WITH {CORPUS} SELECT doc_id, title, feature, area, lat, lon FROM docs WHERE alias = 'doc-7' AND feature = 'lang=en' ORDER BY rank_score DESC, doc_id LIMIT 5")
def doc_alternatives(spark, sf_dir):
    return knowledge(spark, sf_dir).doc("doc-7", feature="lang=en").select("doc_id", "title", "feature", "area", "lat", "lon")


@_register("doc_candidates_404", f"WITH {CORPUS} SELECT doc_id, title FROM docs WHERE starts_with(title, 'Th') ORDER BY rank_score DESC, title LIMIT 5")
def doc_candidates_404(spark, sf_dir):
    return knowledge(spark, sf_dir).candidates("Th")


_FILTERS = {
    "filter_feature": ({"feature": "lang=fr, lang=de"}, "feature IN ('lang=fr', 'lang=de')"),
    "filter_area": ({"area": "NATION_7"}, "area = 'NATION_7'"),
    "filter_bbox": ({"bbox": "-5,-20,10,20"}, "lat BETWEEN -5 AND 10 AND lon BETWEEN -20 AND 20"),
    "filter_wikidata": ({"wikidata": "Q42"}, "wikidata = 'Q42'"),
    "filter_tag_or": ({"tag": "es,fr"}, "(list_contains(tags, 'es') OR list_contains(tags, 'fr'))"),
    "filter_conjunction": ({"tag": "en", "bbox": "-20,-40,20,40", "feature": "lang=en"}, "list_contains(tags, 'en') AND feature = 'lang=en' AND lat BETWEEN -20 AND 20 AND lon BETWEEN -40 AND 40"),
}
for _name, (_filters, _where) in _FILTERS.items():
    _register(_name, f"WITH {CORPUS} SELECT doc_id, title, feature, area, lat, lon FROM docs WHERE {_where} ORDER BY rank_score DESC, title, doc_id LIMIT 50")(
        lambda s, d, f=_filters: knowledge(s, d).filter(**f)
    )
_register("filter_total", f"WITH {CORPUS} SELECT count(*) AS total FROM docs WHERE list_contains(tags, 'en') AND area = 'NATION_7'")(lambda s, d: knowledge(s, d).filter_total(tag="en", area="NATION_7"))
_register("filter_paged", f"WITH {CORPUS} SELECT doc_id, title, substr(body, 1, 50) AS body FROM docs WHERE list_contains(tags, 'en') ORDER BY rank_score DESC, title, doc_id LIMIT 20 OFFSET 40")(
    lambda s, d: knowledge(s, d).filter(limit=20, offset=40, fields="doc_id,title,body", max_chars=50, tag="en")
)

_TAGS = f"WITH {CORPUS}, dt AS (SELECT DISTINCT tag, doc_id FROM (SELECT doc_id, unnest(tags) AS tag FROM docs) WHERE tag <> ''), tc AS (SELECT tag, count(*) AS docs FROM dt GROUP BY tag)"
_register("doc_tags", f"{_TAGS} SELECT tag, doc_id FROM dt")(lambda s, d: build.doc_tags(documents(s, d)))
_register("tag_counts", f"{_TAGS} SELECT tag, docs FROM tc")(lambda s, d: build.tag_counts(build.doc_tags(documents(s, d))))
_register("tags_prefix", f"{_TAGS} SELECT tag, docs FROM tc WHERE starts_with(tag, 'e') ORDER BY docs DESC, tag LIMIT 50")(lambda s, d: knowledge(s, d).tags(prefix="e"))
_register("tags_contains", f"{_TAGS} SELECT tag, docs FROM tc WHERE contains(tag, 'e') ORDER BY docs DESC, tag LIMIT 5 OFFSET 2")(lambda s, d: knowledge(s, d).tags(contains="e", limit=5, offset=2))
_register("titles_prefix", f"WITH {CORPUS} SELECT doc_id, title FROM docs WHERE starts_with(title, 'The') ORDER BY rank_score DESC, title LIMIT 20")(lambda s, d: knowledge(s, d).titles("The"))
_register("browse_page", f"WITH {CORPUS} SELECT doc_id, title, substr(coalesce(opening, body), 1, 160) AS snippet, TRUE AS has_next FROM docs WHERE doc_id > 50 ORDER BY doc_id LIMIT 100")(lambda s, d: knowledge(s, d).browse(50))
_register("random_docs")(lambda s, d: knowledge(s, d).random(5))
_register("doc_coords", f"WITH {CORPUS} SELECT lat, lon, doc_id FROM docs WHERE lat IS NOT NULL AND lon IS NOT NULL")(lambda s, d: build.doc_coords(documents(s, d)))
_register("existence_probe", f"WITH {CORPUS} SELECT bool_or(feature IS NOT NULL) AS has_feature, bool_or(lat IS NOT NULL) AS has_coords, TRUE AS has_links FROM docs")(lambda s, d: knowledge(s, d).has_attributes())
_register("alias_table", f"WITH {CORPUS} SELECT alias, doc_id FROM docs")(lambda s, d: build.aliases(documents(s, d)))


@_register("rank_clamp", f"WITH {CORPUS} SELECT doc_id, greatest(0.0, least(1.0, rank_score * 30 - 10)) AS rank FROM docs")
def rank_clamp(spark, sf_dir):
    from ..schema import clamp01

    return documents(spark, sf_dir).select("doc_id", clamp01(F.col("rank_score") * 30 - 10).alias("rank"))


@_register("rank_refresh", "SELECT doc_id, CASE WHEN n_chars > 0 THEN round(least(1.0, log10(1.0 + n_chars) / 7.0), 4) ELSE 0.0 END AS rank_score FROM documents")
def rank_refresh(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0.5).alias("rank_score"), F.to_json(F.struct(F.col("n_chars").alias("pageviews_month"))).alias("extra"))
    return build.refreshed_rank(docs).select("doc_id", "rank_score")


@_register("cross_source_wikidata", f"WITH {CORPUS} SELECT a.doc_id AS doc_id, b.doc_id AS other_id, a.wikidata AS wikidata FROM docs a JOIN docs b ON a.wikidata = b.wikidata WHERE a.lang = 'en'")
def cross_source_wikidata(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return build.linked(docs.filter("lang = 'en'"), docs)


_SAMPLES = ["doc-7", "no such title"]


@_register("validation_checks", f"""WITH {CORPUS}, names AS (SELECT title AS t FROM docs UNION SELECT alias FROM docs)
SELECT 'min_docs' AS "check", count(*) >= 500 AS ok FROM docs UNION ALL SELECT 'unique_titles', count(*) = count(DISTINCT title) FROM docs
UNION ALL SELECT 'samples', (SELECT count(*) FROM names WHERE t IN ('doc-7', 'no such title')) = 2 UNION ALL SELECT 'doc_tags', NOT bool_or(len(tags) > 0) OR count(*) > 0 FROM docs""")
def validation_checks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return build.validation(docs, build.doc_tags(docs), 500, _SAMPLES, build.aliases(docs))


@_register("healthz_counts", "SELECT source, count(*) AS docs FROM documents GROUP BY source")
def healthz_counts(spark, sf_dir):
    return build.counts(_table(spark, sf_dir, "documents"), "source")


@_register("tag_largest_of_sample", f"WITH {CORPUS}, s AS (SELECT unnest(tags) AS tag FROM (SELECT tags FROM docs ORDER BY doc_id LIMIT 500)) SELECT tag FROM s WHERE tag <> '' GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1")
def tag_largest_of_sample(spark, sf_dir):
    return build.top_tag(documents(spark, sf_dir), 500)


@_register("text_lengths", f"WITH {CORPUS} SELECT count(*) AS docs, CAST(sum(length(body)) AS BIGINT) AS chars, CAST(sum(length(opening)) AS BIGINT) AS opening_chars FROM docs")
def text_lengths(spark, sf_dir):
    return build.text_lengths(documents(spark, sf_dir))


@_register("links_out", f"WITH {CORPUS}, q AS (SELECT title FROM docs WHERE doc_id = 11) SELECT d.doc_id, CAST(i AS INTEGER) AS pos, 'doc-' || CAST((d.doc_id + i) % 50 AS VARCHAR) AS link FROM docs d JOIN q USING (title), (VALUES (0), (1)) AS v(i)")
def links_out(spark, sf_dir):
    kb = knowledge(spark, sf_dir)
    return kb.links(kb.docs.filter("doc_id = 11").select("title").first()[0])


_CATALOGS: dict = {}


def _published(spark: SparkSession, sf_dir: str) -> str:
    """Each language published as a source, English twice: the catalog shows what the pointers name."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        root, texts = scratch(spark, "catalog"), scratch(spark, "texts")
        docs = _table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
        # Whole texts by language, so that a source reads its own alone; the prefix keeps names that are empty or look like numbers.
        docs = docs.select("doc_id", F.col("doc_id").cast("string").alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags"), F.concat(F.lit("l_"), "lang").alias("part"))
        docs.write.option("compression", "zstd").partitionBy("part").parquet(texts)
        docs = spark.read.schema(docs.schema).parquet(texts)
        for r in docs.select("part").distinct().collect():
            own, lang = docs.filter(F.col("part") == r.part).drop("part"), r.part[2:]
            for generation in ("g1", "g2") if lang == "en" else ("g1",):
                build.build(own, root, f"src_{lang}", generation)
        _CATALOGS[key] = root
    return _CATALOGS[key]


_register("catalog_sources", "SELECT 'src_' || lang AS source, '4' AS schema_version, CASE WHEN lang = 'en' THEN 'g2' ELSE 'g1' END AS dump_date, count(*) AS doc_count FROM documents WHERE lang IS NOT NULL GROUP BY lang")(
    lambda s, d: build.catalog(s, _published(s, d)).select("source", "schema_version", "dump_date", "doc_count")
)
_register("catalog_hints", "SELECT 'src_' || lang AS source, count(*) AS doc_count, FALSE AS has_feature, FALSE AS has_coords, FALSE AS has_links, lang AS tag FROM documents WHERE lang IS NOT NULL GROUP BY lang")(
    lambda s, d: build.hints(s, _published(s, d)).drop("dump_date")
)
_register("catalog_grouped", "SELECT 'src' AS kind, count(DISTINCT lang) AS sources, CAST(count(*) AS BIGINT) AS docs, CASE WHEN bool_or(lang = 'en') THEN 'g2' ELSE 'g1' END AS newest FROM documents WHERE lang IS NOT NULL")(
    lambda s, d: build.grouped_catalog(build.catalog(s, _published(s, d)))
)


# --- build rules ----------------------------------------------------------------------------


@_register("dedupe_last_wins", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def dedupe_last_wins(spark, sf_dir):
    return build.last_wins(_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "event_id", "user_id")


@_register("title_first_seen", """SELECT c_custkey, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || CAST(c_custkey AS VARCHAR) || ')' END AS title, CASE WHEN n > 1 THEN c_mktsegment END AS alias
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)""")
def title_first_seen(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("title"))
    return build.first_seen_titles(rows, "c_custkey", F.col("c_custkey"), F.col("c_custkey").cast("string"))


@_register("title_owner_argmax", "SELECT c_nationkey, c_custkey AS owner FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def title_owner_argmax(spark, sf_dir):
    return build.title_owners(_table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", "c_nationkey")


@_register("pageviews_sum", "SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS views FROM events WHERE event_type = 'view' OR event_type = 'click' GROUP BY user_id")
def pageviews_sum(spark, sf_dir):
    """Page views from lines of a dump that other domains and broken lines share."""
    events = _table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click"))
    n = F.get_json_object("props", "$.k")
    path = scratch(spark, "views")
    lines = events.select(F.concat(F.lit("xx.site Page "), F.col("user_id").cast("string"), F.lit(" desktop "), n, F.lit(" A1")).alias("value"))
    lines.union(events.limit(50).select(F.concat(F.lit("yy.site Page "), F.col("user_id").cast("string"), F.lit(" desktop 7 A1")))).union(events.limit(5).select(F.lit("xx.site Page none desktop 7"))).write.text(path)
    return tables.page_views(spark, path, "xx.site").select(F.col("page_id").alias("user_id"), "views")


@_register("page_items_last", """SELECT l_orderkey AS page_id, 'Q' || CAST(l_partkey AS VARCHAR) AS wikidata
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS n FROM lineitem) WHERE n = 1""")
def page_items_last(spark, sf_dir):
    """Items from INSERT lines, several for most pages: the last one counts."""
    path = scratch(spark, "props")
    tuples = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("("), F.col("l_orderkey").cast("string"), F.lit(",'wikibase_item','Q"), x["l_partkey"].cast("string"), F.lit("',NULL)")))
    _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("INSERT INTO `page_props` VALUES (1,'other','x',NULL),"), F.array_join(tuples, ","), F.lit(";")).alias("value")).select("value").write.text(path)
    return tables.page_items(spark, path)


@_register("argmax_language_share", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS n FROM documents GROUP BY source, lang) WHERE n = 1")
def argmax_language_share(spark, sf_dir):
    return build.most_frequent(_table(spark, sf_dir, "documents"), "source", "lang")


@_register("multimap_gather", "SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_custkey) AS names FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey")
def multimap_gather(spark, sf_dir):
    rich = _table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    return build.gathered(rich, "c_nationkey", "c_custkey", "c_name").select("c_nationkey", F.array_join("values", ",").alias("names"))


@_register("redirect_invert", f"WITH {CORPUS} SELECT alias, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS sources FROM docs GROUP BY alias")
def redirect_invert(spark, sf_dir):
    pairs = build.aliases(documents(spark, sf_dir)).withColumn("source", F.col("doc_id").cast("string"))
    return build.gathered(pairs, "alias", "doc_id", "source").select("alias", F.array_join("values", ",").alias("sources"))


@_register("json_extract_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, sf_dir):
    return with_extra_columns(_table(spark, sf_dir, "events"), {"k": "bigint"}, "props").select("event_id", "k")


@_register("json_array_explode", "SELECT doc_id, unnest([lang, source]) AS tag FROM documents")
def json_array_explode(spark, sf_dir):
    stored = _table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.array("lang", "source")).alias("tags"))
    return stored.select("doc_id", F.explode(F.from_json("tags", "array<string>")).alias("tag"))


@_register("popularity", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(least(1.0, log10(1.0 + c_acctbal) / 8.0), 4) ELSE 0.0 END AS score FROM customer")
def popularity(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", normalized_popularity(F.col("c_acctbal"), 8.0).alias("score"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as places of their nations."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("id"), F.concat(F.lit("Place "), (F.col("s_suppkey") % 40).cast("string")).alias("name"),
        F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), F.lit("P").alias("class"), F.lit("PPL").alias("code"), F.col("s_nationkey").cast("string").alias("cc"),
        F.lit("r").alias("admin1"), F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal")).otherwise(F.lit(0)).cast("bigint").alias("population"),
        F.concat(F.lit("Zone/"), F.col("s_nationkey").cast("string")).alias("timezone"), F.when(F.col("s_suppkey") % 3 == 0, (F.col("s_suppkey") - 20).cast("string")).otherwise("4.5").alias("elevation"), F.lit("2026-01-01").alias("modified"),
    )
    countries = nation.select(F.col("n_nationkey").cast("string").alias("cc"), F.col("n_name").alias("country"))
    regions = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".r")).alias("key"), F.col("r_name").alias("region"))
    return gazetteer.places(rows, countries, regions)


@_register("gazetteer_build", """WITH p AS (SELECT s_suppkey AS id, 'Place ' || CAST(s_suppkey % 40 AS VARCHAR) AS name, s_nationkey, s_acctbal FROM supplier WHERE s_name <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS BIGINT) ELSE 0 END DESC, id) AS n FROM p)
SELECT id AS doc_id, CASE WHEN n = 1 THEN name ELSE name || ' (' || CAST(s_nationkey AS VARCHAR) || ':' || CAST(id AS VARCHAR) || ')' END AS title,
  name || coalesce(' / ' || r_name, '') || ' / ' || coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS opening, coalesce(r_name, n_name) AS area,
  CASE WHEN s_acctbal >= 1 THEN round(least(1.0, log10(1.0 + floor(s_acctbal)) / 8.0), 4) ELSE 0.0 END AS rank_score
FROM o LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def gazetteer_build(spark, sf_dir):
    return _places(spark, sf_dir).select("doc_id", "title", "opening", "area", "rank_score")


@_register("gazetteer_extra", """SELECT s_suppkey AS doc_id, '2026-01-01' AS updated_at, CAST(s_nationkey AS VARCHAR) AS country_code, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS country, 'Zone/' || CAST(s_nationkey AS VARCHAR) AS timezone,
  CASE WHEN s_acctbal >= 1 THEN CAST(floor(s_acctbal) AS BIGINT) END AS population, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS BIGINT) - 20 END AS elevation
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_name <> ''""")
def gazetteer_extra(spark, sf_dir):
    """What places keep besides the document model, read back from their JSON."""
    told = F.from_json("extra", "country_code string, country string, timezone string, population bigint, elevation bigint").alias("e")
    return _places(spark, sf_dir).select("doc_id", "updated_at", told).select("doc_id", "updated_at", "e.*")


# --- places ---------------------------------------------------------------------------------

_RINGS = {"north": [(0.0, -60.0), (30.0, -60.0), (32.5, 10.0), (20.0, 60.0), (0.0, 60.0)], "south": [(-0.0, -60.0), (-30.0, -45.5), (-12.25, 0.0), (-33.0, 50.0), (5.0, 60.0)], "wedge": [(-10.0, -10.0), (15.0, 0.5), (-10.0, 11.0)]}


def _polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, [{"lat": a, "lon": b} for a, b in ring]) for k, ring in _RINGS.items()], "area string, ring array<struct<lat:double,lon:double>>")


_EDGES = ", ".join(f"('{k}', {ring[i][0]}::DOUBLE, {ring[i][1]}::DOUBLE, {ring[(i + 1) % len(ring)][0]}::DOUBLE, {ring[(i + 1) % len(ring)][1]}::DOUBLE)" for k, ring in _RINGS.items() for i in range(len(ring)))


@_register("point_in_polygon", f"""WITH {CORPUS}, e(area, lat1, lon1, lat2, lon2) AS (VALUES {_EDGES}),
h AS (SELECT d.doc_id, e.area FROM docs d JOIN e ON d.lat IS NOT NULL AND ((e.lat1 > d.lat) <> (e.lat2 > d.lat)) AND d.lon < (e.lon2 - e.lon1) * (d.lat - e.lat1) / (e.lat2 - e.lat1) + e.lon1),
i AS (SELECT doc_id, area FROM h GROUP BY doc_id, area HAVING count(*) % 2 = 1)
SELECT doc_id, min(area) AS area FROM i GROUP BY doc_id""")
def point_in_polygon(spark, sf_dir):
    return spatial.points_in_areas(documents(spark, sf_dir).select("doc_id", "lat", "lon"), _polygons(spark))


@_register("bbox_of_area", f"WITH e(area, lat1, lon1, lat2, lon2) AS (VALUES {_EDGES}) SELECT area, min(lat1) AS min_lat, min(lon1) AS min_lon, max(lat1) AS max_lat, max(lon1) AS max_lon FROM e GROUP BY area")
def bbox_of_area(spark, sf_dir):
    return spatial.bounding_boxes(_polygons(spark))


@_register("centroid_mean", """SELECT l_orderkey AS id, round(avg(p_retailprice / 100), 7) AS lat, round(avg(p_size + 0.5), 7) AS lon FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE n <= 3 GROUP BY l_orderkey""")
def centroid_mean(spark, sf_dir):
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    ways = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(refs.alias("refs"))
    nodes = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("lat"), (F.col("p_size") + 0.5).alias("lon"))
    return spatial.centroids(ways, nodes, 3)


@_register("dms_to_decimal", "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * (p_size + (p_partkey % 60) / 60.0 + (p_partkey % 59) / 3600.0), 7) AS lat FROM part")
def dms_to_decimal(spark, sf_dir):
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", spatial.dms_to_decimal(F.col("p_size"), k % 60, k % 59, F.when(k % 2 == 0, "S").otherwise("N")).alias("lat"))


@_register("coord_validity", f"WITH {CORPUS} SELECT doc_id, lat * 4 BETWEEN -90 AND 90 AND lon * 4 BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AS ok FROM docs WHERE lat IS NOT NULL")
def coord_validity(spark, sf_dir):
    return documents(spark, sf_dir).filter("lat IS NOT NULL").select("doc_id", spatial.valid(F.col("lat") * 4, F.col("lon") * 4).alias("ok"))


@_register("admin_level_score", "SELECT p_partkey, greatest(0.2::DOUBLE, 1 - 0.06::DOUBLE * p_size) AS score FROM part")
def admin_level_score(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", spatial.admin_level_score(F.col("p_size")).alias("score"))


# --- map data -------------------------------------------------------------------------------


def _map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, some with tags of all sorts."""
    k = F.col("p_partkey")
    sorts = [("place", "city"), ("place", "odd"), ("boundary", "administrative"), ("railway", "station"), ("railway", "rail"), ("shop", "books"), ("natural", "peak")]
    kind = F.coalesce(*[F.when(k % 7 == i, F.create_map(F.lit(a), F.lit(b))) for i, (a, b) in enumerate(sorts)])
    more = F.create_map(F.lit("name"), F.concat(F.lit("N"), (k % 50).cast("string")), F.lit("population"), F.concat((k * 1000).cast("string"), F.lit(" people")), F.lit("admin_level"), (k % 12).cast("string"))
    return _table(spark, sf_dir, "part").select(k.cast("bigint").alias("id"), (F.col("p_retailprice") / 100).alias("lat"), (F.col("p_size") + 0.5).alias("lon"), F.map_concat(kind, more).alias("tags"), F.lit("2026").alias("updated_at"))


def _map_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways over the parts of their lines."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("bigint"))
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("id")).agg(refs.alias("refs"))


@_register("map_relation_centres", """WITH m AS (SELECT o_custkey AS id, o_orderkey AS way FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 30),
w AS (SELECT l_orderkey AS way, avg(p_retailprice / 100) AS lat, avg(p_size + 0.5) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE n <= 10 GROUP BY l_orderkey),
c AS (SELECT id, avg(lat) AS lat, avg(lon) AS lon FROM m JOIN w USING (way) GROUP BY id)
SELECT id, round(CASE WHEN id % 3 = 0 AND p_partkey IS NOT NULL THEN p_retailprice / 100 ELSE lat END + 1e-8, 4) AS lat, round(CASE WHEN id % 3 = 0 AND p_partkey IS NOT NULL THEN p_size + 0.5 ELSE lon END + 1e-8, 4) AS lon
FROM c LEFT JOIN part ON p_partkey = id""")
def map_relation_centres(spark, sf_dir):
    """Customers as relations of their orders; a third of them have a label node."""
    member = lambda t, ref, role: F.struct(F.lit(t).alias("type"), ref.cast("bigint").alias("ref"), F.lit(role).alias("role"))
    outer = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: member("w", x, "outer"))
    label = F.when(F.col("o_custkey") % 3 == 0, F.array(member("n", F.col("o_custkey"), "label"))).otherwise(F.array().cast("array<struct<type:string,ref:bigint,role:string>>"))
    relations = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(outer.alias("w")).select(F.col("o_custkey").cast("bigint").alias("id"), F.concat("w", label).alias("members"))
    found = mapfeatures.relation_centres(relations, _map_ways(spark, sf_dir), _map_nodes(spark, sf_dir))
    return found.select("id", F.round(F.col("lat") + 1e-8, 4).alias("lat"), F.round(F.col("lon") + 1e-8, 4).alias("lon"))


@_register("map_rank", """SELECT p_partkey AS id, key, round(greatest(CASE WHEN key = 'place' THEN CASE WHEN p_partkey % 7 = 0 THEN 0.85 ELSE 0.3 END
  WHEN key = 'boundary' THEN greatest(0.2, 1 - 0.06 * CASE WHEN p_partkey % 12 = 0 THEN 11 ELSE p_partkey % 12 END) WHEN key = 'railway' THEN 0.6 WHEN key = 'shop' THEN 0.3 ELSE 0.4 END,
  round(least(1.0, log10(1.0 + p_partkey * 1000) / 8.0), 4)), 4)::DOUBLE AS rank_score
FROM (SELECT *, CASE p_partkey % 7 WHEN 0 THEN 'place' WHEN 1 THEN 'place' WHEN 2 THEN 'boundary' WHEN 3 THEN 'railway' WHEN 5 THEN 'shop' WHEN 6 THEN 'natural' END AS key FROM part) WHERE key IS NOT NULL""")
def map_rank(spark, sf_dir):
    found = _map_nodes(spark, sf_dir).withColumn("f", mapfeatures.feature(F.col("tags"))).filter("f IS NOT NULL")
    return found.select("id", "f.key", mapfeatures.rank(F.col("f"), F.col("tags")).alias("rank_score"))


def _map_borders(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rings as nodes, two open ways each and boundary relations."""
    nodes, ways, relations = [], [], []
    for a, (name, ring) in enumerate(_RINGS.items()):
        first = 10_000_000 * (a + 1)
        nodes += [(first + i, lat, lon) for i, (lat, lon) in enumerate(ring)]
        ids, cut = [first + i % len(ring) for i in range(len(ring) + 1)], len(ring) // 2
        ways += [(first, ids[: cut + 1]), (first + 1, ids[cut:])]
        relations.append((first, [("w", first, "outer"), ("w", first + 1, ""), ("n", first, "label")], {"boundary": "administrative", "admin_level": "4", "name": name}))
    make = spark.createDataFrame
    return make(nodes, "id bigint, lat double, lon double"), make(ways, "id bigint, refs array<bigint>"), make(relations, "id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>")


@_register("map_documents", f"""WITH e(area, lat1, lon1, lat2, lon2) AS (VALUES {_EDGES}),
p AS (SELECT p_partkey AS id, p_retailprice / 100 AS lat, p_size + 0.5 AS lon, 'N' || CAST(p_partkey % 50 AS VARCHAR) AS name,
  CASE p_partkey % 7 WHEN 0 THEN 'place=city' WHEN 1 THEN 'place=odd' WHEN 2 THEN 'boundary=administrative' WHEN 3 THEN 'railway=station' WHEN 5 THEN 'shop=books' WHEN 6 THEN 'natural=peak' END AS feature FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM p WHERE feature IS NOT NULL),
i AS (SELECT id, area FROM f JOIN e ON ((e.lat1 > f.lat) <> (e.lat2 > f.lat)) AND f.lon < (e.lon2 - e.lon1) * (f.lat - e.lat1) / (e.lat2 - e.lat1) + e.lon1 GROUP BY id, area HAVING count(*) % 2 = 1),
a AS (SELECT id, min(area) AS area FROM i GROUP BY id)
SELECT f.id * 4 AS doc_id, CASE WHEN n = 1 THEN name ELSE name || ' (node:' || CAST(f.id AS VARCHAR) || ')' END AS title, feature, area FROM f LEFT JOIN a USING (id)""")
def map_documents(spark, sf_dir):
    """Nodes as documents, with titles told apart and the boundary that holds them."""
    nodes, ways, relations = _map_borders(spark)
    empty = spark.createDataFrame([], "id bigint, refs array<bigint>, tags map<string,string>, updated_at string")
    relations = relations.withColumns({"updated_at": F.lit(None).cast("string")})
    own = _map_nodes(spark, sf_dir)
    all_nodes = own.unionByName(nodes.withColumns({"tags": F.create_map().cast("map<string,string>"), "updated_at": F.lit(None).cast("string")}))
    found = mapfeatures.features(all_nodes, empty.unionByName(ways, allowMissingColumns=True), relations)
    docs = mapfeatures.documents(found.filter("kind = 'node'"))
    return with_extra_columns(docs, {"feature": "string", "area": "string"}).select("doc_id", "title", "feature", "area")


# --- pages ----------------------------------------------------------------------------------


@_register("html_links_out", """SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) WHERE len(l) > 0""")
def html_links_out(spark, sf_dir):
    from ..sources.html import links

    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(links(F.col("html"))).alias("pos", "link"))


@_register("html_title_text", "SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title_text(spark, sf_dir):
    from ..sources.html import title

    return _table(spark, sf_dir, "pages").select("page_id", title(F.col("html")).alias("title"))


@_register("text_cleanup")
def text_cleanup(spark, sf_dir):
    from ..sources.html import body

    return _table(spark, sf_dir, "pages").select("page_id", body(F.col("html")).alias("body"))


# --- notes and context ----------------------------------------------------------------------


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "title", "opening", "body", "tags", "updated_at")


_RECALL = "SELECT doc_id, title, substr(body, 1, 400) AS text, updated_at, length(body) > 400 AS truncated FROM docs WHERE {} ORDER BY updated_at DESC, doc_id DESC LIMIT {}"
_register("notes_recall_since_until", f"WITH {CORPUS} " + _RECALL.format("updated_at >= '2026-03' AND updated_at <= '2026-07-10'", 20))(
    lambda s, d: notes.recall(_notes(s, d), since="2026-03", until="2026-07-10").drop("tags")
)
_register("notes_recall_tags", f"WITH {CORPUS} " + _RECALL.format("list_contains(tags, 'en') AND list_contains(tags, (SELECT max(source) FROM documents))", 100))(
    lambda s, d: notes.recall(_notes(s, d), tags="en," + _table(s, d, "documents").agg(F.max("source")).first()[0], limit=500).drop("tags")
)
_register("notes_recall_text", f"WITH {CORPUS} " + _RECALL.format("(contains(lower(title), 'ther') OR contains(lower(body), 'ther'))", 20))(lambda s, d: notes.recall(_notes(s, d), q="ther").drop("tags"))
_register("notes_recall_short", f"WITH {CORPUS} " + _RECALL.format("(title LIKE '%zz%' OR body LIKE '%zz%')", 20))(lambda s, d: notes.recall(_notes(s, d), q="zz").drop("tags"))
_register("notes_update", f"WITH {CORPUS} SELECT doc_id, CASE WHEN doc_id = 5 THEN 'new text' ELSE body END AS body, CASE WHEN doc_id = 5 THEN '2026-12-31' ELSE updated_at END AS updated_at FROM docs")(
    lambda s, d: notes.update(_notes(s, d), 5, text="new text", at="2026-12-31").select("doc_id", "body", "updated_at")
)
_register("notes_delete", f"WITH {CORPUS} SELECT doc_id, title FROM docs WHERE doc_id <> 5")(lambda s, d: notes.delete(_notes(s, d), 5).select("doc_id", "title"))


@_register("notes_add", f"WITH {CORPUS}, m AS (SELECT max(doc_id) AS top FROM docs) SELECT doc_id, title FROM docs UNION ALL SELECT top + 1, 'first line' FROM m UNION ALL SELECT top + 2, 'first line (' || CAST(top + 2 AS VARCHAR) || ')' FROM m")
def notes_add(spark, sf_dir):
    batch = spark.createDataFrame([(1, None, "\n first line\nmore", ["x"]), (2, "first line", "other", ["x"])], "seq int, title string, text string, tags array<string>")
    return notes.add(_notes(spark, sf_dir), batch, "2026-12-31").select("doc_id", "title")


_register("history_last6", "SELECT conv_id, turn, role, substr(text, 1, 400) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 6")(
    lambda s, d: context.history(_table(s, d, "conversations"))
)
_register("repeated_call_reuse", "SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, role, text) AS first_turn, min(turn) OVER (PARTITION BY conv_id, role, text) < turn AS repeated FROM conversations")(
    lambda s, d: context.repeated_calls(_table(s, d, "conversations")).select("conv_id", "turn", "first_turn", "repeated")
)
_PLAN = "regexp_replace(substr(text, 1, 30), '[^A-Za-z0-9 ]', '', 'g')"


@_register("plan_parse_rescue", f"SELECT conv_id, turn, 0 AS n, role AS source, trim({_PLAN}) AS q FROM conversations WHERE role IN ('user', 'assistant') AND trim({_PLAN}) <> ''")
def plan_parse_rescue(spark, sf_dir):
    """Every turn as an answer in strict JSON, JSON within prose, or loose pairs, by its number."""
    q = F.regexp_replace(F.substring("text", 1, 30), "[^A-Za-z0-9 ]", "")
    strict = F.concat(F.lit('{"queries":[{"source":"'), "role", F.lit('","q":"'), q, F.lit('"},{"source":"'), "role", F.lit('","q":"'), q, F.lit('"},{"source":"zz","q":"k"}]}'))
    loose = F.concat(F.lit('"source": "'), "role", F.lit('", "q": "'), q, F.lit('" and then broken {'))
    kind = F.col("turn") % 3
    answers = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.when(kind == 0, strict).when(kind == 1, F.concat(F.lit("Sure: "), strict, F.lit(" done"))).otherwise(loose).alias("text"))
    return context.plan(answers, ["user", "assistant"]).select("id.conv_id", "id.turn", "n", "source", "q")


_HITS = """hits AS (SELECT doc_id % 7 AS ask, doc_id % 3 AS query_no, row_number() OVER (PARTITION BY doc_id % 7, doc_id % 3 ORDER BY n_chars DESC, doc_id) AS rank, source, doc_id % 50 AS doc_id, doc_id AS seq FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask, source, doc_id ORDER BY rank, query_no) AS k FROM hits) WHERE k = 1)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ask", "query_no").orderBy(F.desc("n_chars"), "seq"))
    docs = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("ask"), (F.col("doc_id") % 3).alias("query_no"), "source", "n_chars", (F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("seq"))
    return docs.withColumn("rank", rank)


_register("context_interleave", f"WITH {_HITS} SELECT ask, n, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY rank, query_no) AS n FROM f) WHERE n <= 4")(
    lambda s, d: context.interleaved(_hits(s, d)).select("ask", "n", "source", "doc_id")
)


@_register("context_budget", f"""WITH {CORPUS}, p AS (SELECT doc_id % 7 AS ask, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS n, source, title, opening, body FROM docs),
o AS (SELECT *, trim(opening, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS o, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM p WHERE n <= 4),
k AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY ask ORDER BY n) AS n FROM (SELECT *, trim(substr(trim(CASE WHEN length(o) < 200 AND b <> '' THEN o || chr(10) || b ELSE o END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 1000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM o) WHERE t <> '')
SELECT ask, string_agg('[' || CAST(n AS VARCHAR) || '] ' || source || ' / ' || title || chr(10) || t, chr(10) || chr(10) ORDER BY n) AS context FROM k GROUP BY ask""")
def context_budget(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("ask").orderBy("doc_id"))
    return context.context(documents(spark, sf_dir).withColumn("ask", F.col("doc_id") % 7).withColumn("n", n).filter("n <= 4"))


_GATHER = [("corpus", "ther"), ("corpus", "ing")]


@_register("gather_context", f"""WITH h AS (SELECT 0 AS query_no, row_number() OVER () AS rank, doc_id FROM ({_search_sql("ther", 5, 0, "TRUE", 300)})
  UNION ALL SELECT 1, row_number() OVER (), doc_id FROM ({_search_sql("ing", 5, 0, "TRUE", 300)})),
f AS (SELECT doc_id, row_number() OVER (ORDER BY min(rank * 10 + query_no)) AS n FROM h GROUP BY doc_id), {CORPUS},
t AS (SELECT f.n, title, trim(substr(trim(CASE WHEN length(trim(opening, {_B})) < 200 AND trim(body, {_B}) <> '' THEN trim(opening, {_B}) || chr(10) || trim(body, {_B}) ELSE trim(opening, {_B}) END, {_B}), 1, 1000), {_B}) AS t
  FROM f JOIN docs USING (doc_id) WHERE f.n <= 4)
SELECT 1 AS ask, string_agg('[' || CAST(n AS VARCHAR) || '] corpus / ' || title || chr(10) || t, chr(10) || chr(10) ORDER BY n) AS context FROM t""")
def gather_context(spark, sf_dir):
    """Two planned queries, their hits interleaved, and the text that a model would be asked with."""
    return context.gather(_GATHER, {"corpus": knowledge(spark, sf_dir)})


_register("references_cap", "WITH g AS (SELECT doc_id % 7 AS ask, source, lang AS title, min(doc_id) AS seq FROM documents GROUP BY ALL) SELECT ask, n, source, title FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY seq) AS n FROM g) WHERE n <= 20")(
    lambda s, d: context.references(_table(s, d, "documents").select((F.col("doc_id") % 7).alias("ask"), F.col("doc_id").alias("seq"), "source", F.col("lang").alias("title")))
)
_register("retention_top_n", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")(lambda s, d: notes.newest(_table(s, d, "events"), 500, "ts", "event_id").select("event_id", "event_type"))
_register("generations_keep_one", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 2")(
    lambda s, d: notes.newest_of_each(_table(s, d, "events"), 2, "event_type", "ts", "event_id").select("event_type", "event_id")
)


@_register("stale_jobs", "SELECT event_id, CASE WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 2 DAY THEN 'failed' ELSE 'running' END AS state FROM events WHERE event_type = 'click'")
def stale_jobs(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    running = events.filter("event_type = 'click'").select(F.col("event_id").alias("job_id"), F.lit("running").alias("state"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    return jobs.reaped(running, events.agg(F.max("ts")).first()[0], 2).select(F.col("job_id").alias("event_id"), "state")


@_register("job_store", """SELECT event_id AS job_id, CASE WHEN user_id % 4 = 0 THEN 'failed' WHEN user_id % 4 = 1 THEN 'running' ELSE 'done' END AS state, user_id % 4 <> 1 AS ended FROM events WHERE event_type = 'view'""")
def job_store(spark, sf_dir):
    """Jobs started, then ended by reports of which only some come."""
    events = _table(spark, sf_dir, "events").filter("event_type = 'view'")
    started = jobs.started(events.select(F.col("event_id").alias("job_id"), F.col("ts").alias("started_at")))
    reports = events.filter("user_id % 4 <> 1").select(F.col("event_id").alias("job_id"), (F.col("user_id") % 4 != 0).alias("ok"), F.col("ts").alias("finished_at"))
    return jobs.ended(started, reports).select("job_id", "state", F.col("finished_at").isNotNull().alias("ended"))


@_register("stream_notes_upsert", f"WITH {CORPUS} SELECT doc_id, title FROM docs WHERE doc_id % 10 <> 3")
def stream_notes_upsert(spark, sf_dir):
    from ..streaming.changes import replay

    changes = _notes(spark, sf_dir).withColumn("deleted", F.col("doc_id") % 10 == 3)
    return replay(spark, changes).docs().select("doc_id", "title")
