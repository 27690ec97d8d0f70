"""Registered queries over what is read, built and streamed: each writes the given tables in a source's form and reads them back."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build
from ..operators.notestore import NoteStore
from ..sources import adapters, mapfile, wiki
from ..storage import scratch
from ..streaming import jobs as stream_jobs
from ..streaming.catalog import OpenSources
from .corpus import SQL as CORPUS
from .corpus import documents

REGISTRY: dict = {}


def _register(name: str, sql: str | None = None):
    def add(run):
        REGISTRY[name] = (run, sql)
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, value) in runs of equal ids -> a row an id with its values; a run may go on in the next batch."""
    rest = None
    for batch in itertools.chain(batches, (None,)):  # None: the last run is whole
        rows = pa.Table.from_batches([b for b in (rest, batch) if b is not None and b.num_rows]).combine_chunks().to_batches() if batch is not None or rest is not None else []
        if not rows:
            continue
        ids = rows[0].column("id")
        ends = np.flatnonzero(np.diff(ids.to_numpy(zero_copy_only=False))) + 1
        if batch is None:
            ends = np.append(ends, len(ids))
        told = int(ends[-1]) if len(ends) else 0
        begins = np.concatenate(([0], ends))
        if told:
            values = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), rows[0].column("value").slice(0, told))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(begins[:-1])), values], names=["id", "values"])
        rest = rows[0].slice(told)


def _lists(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """id, values: the last of `order` as a list of each key, by the others. Sorted and cut in Arrow batches: lists as aggregates fall back to sorting beyond some keys, after each was kept as an object."""
    *by, value = order
    told = rows.select(F.col(key).cast("bigint").alias("id"), *by, value).repartition("id").sortWithinPartitions("id", *by).select("id", "value")
    return told.mapInArrow(_cut, f"id bigint, values array<{told.schema['value'].dataType.simpleString()}>")


def _map_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, orders as ways through their parts, customers as relations of their orders."""
    nodes = _table(spark, sf_dir, "part").select(
        F.lit("n").alias("kind"), F.col("p_partkey").alias("id"), F.round(F.col("p_partkey") % 18001 / 100 - 90, 7).alias("lat"), F.round(F.col("p_partkey") % 36001 / 100 - 180, 7).alias("lon"),
        F.create_map(F.lit("name"), F.col("p_name"), F.lit("shop"), F.col("p_brand")).alias("tags"),
    )
    ways = _lists(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").cast("bigint").alias("value"))
    ways = ways.select(F.lit("w").alias("kind"), "id", F.col("values").alias("refs"))
    member = F.struct(F.lit("w").alias("type"), F.col("o_orderkey").cast("bigint").alias("ref"), F.col("o_orderstatus").alias("role"))
    relations = _lists(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", member.alias("value"))
    relations = relations.select(F.lit("r").alias("kind"), "id", F.col("values").alias("members"))
    return nodes.unionByName(ways, True).unionByName(relations, True)


@_register("map_file_read", """
SELECT 'n' AS kind, p_partkey AS id, CAST(round((p_partkey % 18001 / 100 - 90) * 10000000) AS BIGINT) AS lat_e7, CAST(round((p_partkey % 36001 / 100 - 180) * 10000000) AS BIGINT) AS lon_e7,
  p_name || '|' || p_brand AS told, 0 AS n FROM part
UNION ALL SELECT 'w', l_orderkey, NULL, NULL, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), count(*) FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'r', o_custkey, NULL, NULL, string_agg('w' || CAST(o_orderkey AS VARCHAR) || o_orderstatus, ',' ORDER BY o_orderkey, o_orderstatus), count(*) FROM orders GROUP BY o_custkey""")
def map_file_read(spark, sf_dir):
    """Parts, orders and customers written as map files and read back by ranges."""
    path = scratch(spark, "mapfile")
    mapfile.write(_map_things(spark, sf_dir), path)
    found = spark.read.format("mapfile").option("splitBytes", 1 << 18).load(path)
    e7 = lambda c: F.round(F.col(c) * 10_000_000).cast("bigint").alias(f"{c}_e7")
    members = F.array_join(F.transform("members", lambda m: F.concat(m["type"], m["ref"].cast("string"), m["role"])), ",")
    told = F.when(F.col("kind") == "n", F.concat_ws("|", F.col("tags")["name"], F.col("tags")["shop"])).when(F.col("kind") == "w", F.array_join("refs", ",")).otherwise(members)
    n = F.coalesce(F.when(F.col("kind") == "w", F.size("refs")).when(F.col("kind") == "r", F.size("members")), F.lit(0)).cast("bigint")
    return found.select("kind", "id", e7("lat"), e7("lon"), told.alias("told"), n.alias("n"))


@_register("map_file_documents", """WITH t AS (SELECT p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k, p_brand FROM part)
SELECT id * 4 AS doc_id, CASE WHEN k = 1 THEN name ELSE name || ' (node:' || CAST(id AS VARCHAR) || ')' END AS title, 'shop=' || p_brand AS feature,
  CAST(round((id % 18001 / 100 - 90) * 10000000) AS BIGINT) AS lat_e7 FROM t""")
def map_file_documents(spark, sf_dir):
    """Map files through their adapter to a published source, and its documents."""
    path, root = scratch(spark, "mapfile"), scratch(spark, "sources")
    mapfile.write(_map_things(spark, sf_dir), path)
    known = adapters.Adapters()
    known.add_family("map", ["map_parts"], lambda source: adapters.map_features(source, path, "g1"))
    docs = build.opened(spark, adapters.run(spark, known, "map_parts", root)).docs
    return docs.select("doc_id", "title", "feature", F.round(F.col("lat") * 10_000_000).cast("bigint").alias("lat_e7"))


@_register("adapters_ingest", """WITH p AS (SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS t, url FROM pages),
b AS (SELECT page_id, CASE WHEN t <> '' THEN t ELSE url END AS base FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM b)
SELECT 'notes' AS source, 'lines' AS kind, '20260102' AS generation, doc_id, 'd' || CAST(doc_id AS VARCHAR) AS title FROM documents
UNION ALL SELECT 'web', 'pages', 'g1', page_id, CASE WHEN n = 1 THEN base ELSE base || ' (' || CAST(page_id AS VARCHAR) || ')' END FROM k""")
def adapters_ingest(spark, sf_dir):
    """Documents as lines of JSON and pages as a table, each through its adapter to a published source."""
    path, root = scratch(spark, "lines"), scratch(spark, "sources")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"))
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.text(path)
    known = adapters.Adapters()
    known.add("notes", lambda: adapters.json_lines(spark, "notes", path, "20260102"))
    known.add("web", lambda: adapters.web_pages("web", f"{sf_dir}/pages.parquet", "g1"))
    out = None
    for source in ("notes", "web"):
        at = adapters.run(spark, known, source, root)
        meta = spark.read.parquet(f"{at}/meta").first()
        rows = spark.read.parquet(f"{at}/docs").select(F.lit(meta.source).alias("source"), F.lit(meta.source_kind).alias("kind"), F.lit(meta.dump_date).alias("generation"), "doc_id", "title")
        out = rows if out is None else out.unionByName(rows)
    return out


@_register("stream_job_expiry", """WITH j AS (SELECT event_id AS job_id, ts, user_id % 4 AS k, user_id % 5 AS days FROM events WHERE event_type = 'view'),
w AS (SELECT max(CASE WHEN k = 1 THEN ts ELSE ts + days * INTERVAL 1 DAY END) AS w FROM j)
SELECT job_id, CASE WHEN k <> 1 AND days <= 2 THEN CASE WHEN k = 0 THEN 'failed' ELSE 'done' END WHEN k <> 1 OR ts + INTERVAL 2 DAY < w THEN 'failed' ELSE 'running' END AS state FROM j, w""")
def stream_job_expiry(spark, sf_dir):
    """Views as jobs; reports come up to four days later, or never: timers end what has run for two days."""
    jobs = _table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").cast("bigint").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), "user_id")
    starts = jobs.select("job_id", F.lit("start").alias("kind"), F.lit(None).cast("boolean").alias("ok"), "at")
    later = F.col("at") + F.make_dt_interval(days=(F.col("user_id") % 5).cast("int"))
    reports = jobs.filter("user_id % 4 <> 1").select("job_id", F.lit("report").alias("kind"), (F.col("user_id") % 4 != 0).alias("ok"), later.alias("at"))
    ended = stream_jobs.replay_jobs(spark, starts.unionByName(reports).coalesce(4), timedelta(days=2))
    return stream_jobs.states(jobs.select("job_id", F.col("at").alias("started_at")), ended).select("job_id", "state")


_CHANGED = f"""WITH {CORPUS}, changed AS (SELECT doc_id, title, CASE WHEN doc_id % 10 = 4 THEN 'other text ' || CAST(doc_id AS VARCHAR) ELSE body END AS body,
  CASE WHEN doc_id % 10 = 4 THEN ['changed', lang] ELSE tags END AS tags, CASE WHEN doc_id % 10 = 4 THEN '2026-12-31' ELSE updated_at END AS updated_at FROM docs WHERE doc_id % 10 <> 3)"""


def _changed(spark: SparkSession, sf_dir: str) -> NoteStore:
    """The corpus as notes, of which a tenth is deleted and a tenth changed afterwards."""
    store, path = NoteStore(spark, scratch(spark, "notes")), scratch(spark, "corpus")
    documents(spark, sf_dir).write.parquet(path)
    docs = spark.read.parquet(path)
    store.apply(docs.select("doc_id", "title", "opening", "body", "tags", "updated_at", F.lit(False).alias("deleted")))
    new = [F.concat(F.lit("other text "), F.col("doc_id").cast("string")).alias("body"), F.array(F.lit("changed"), "lang").alias("tags"), F.lit("2026-12-31").alias("updated_at")]
    store.apply(docs.filter("doc_id % 10 = 4").select("doc_id", "title", "opening", *new, F.lit(False).alias("deleted")))
    store.apply(docs.filter("doc_id % 10 = 3").select("doc_id", "title", "opening", "body", "tags", F.lit("2027").alias("updated_at"), F.lit(True).alias("deleted")))
    return store


@_register("notes_index_recall", f"""{_CHANGED} SELECT doc_id, title, substr(body, 1, 400) AS text, updated_at, length(body) > 400 AS truncated FROM changed
WHERE contains(lower(title), 'ther') OR contains(lower(body), 'ther') ORDER BY updated_at DESC, doc_id DESC LIMIT 100""")
def notes_index_recall(spark, sf_dir):
    """Recall by an index that changes keep up."""
    return _changed(spark, sf_dir).recall(q="ther", limit=100).drop("tags")


@_register("notes_tag_changes", f"{_CHANGED} SELECT tag, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(tags) AS tag FROM changed) WHERE tag <> '' GROUP BY tag")
def notes_tag_changes(spark, sf_dir):
    """Tag counts as sums of signed changes."""
    return _changed(spark, sf_dir).tag_counts()


@_register("catalog_refresh", "SELECT 'g2' AS generation, page_id AS doc_id, 'web' AS source FROM pages UNION ALL SELECT '20260102', doc_id, 'notes' FROM documents")
def catalog_refresh(spark, sf_dir):
    """Documents of sources that are published, one of them twice, while a stream keeps the catalog; a broken one is left out."""
    path, root = scratch(spark, "lines"), scratch(spark, "sources")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"))
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.text(path)
    known = adapters.Adapters()
    known.add("notes", lambda: adapters.json_lines(spark, "notes", path, "20260102"))
    open_ = OpenSources(spark, root)
    stream = open_.start(0)
    try:
        for source, generation in (("web", "g1"), ("notes", None), ("web", "g2")):
            known.add("web", lambda g=generation: adapters.web_pages("web", f"{sf_dir}/pages.parquet", g))
            adapters.run(spark, known, source, root)
            build.replace_text(spark, f"{root}/broken/CURRENT", "nothing")
            stream.processAllAvailable()
    finally:
        stream.stop()
    told = open_.catalog().select("source", F.col("dump_date").alias("generation"))
    docs = [open_.get(s).docs.select(F.lit(s).alias("source"), "doc_id") for s in ("notes", "web")]
    return docs[0].unionByName(docs[1]).join(F.broadcast(told), "source")  # a row a source


@_register("wiki_nested_markup", """WITH w AS (SELECT doc_id, coalesce(lang, 'none') AS tag, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM documents)
SELECT doc_id, nullif(w, '') AS opening, CASE WHEN w <> '' THEN w || ' ' || w END AS body, tag, 'To' AS link, CASE WHEN doc_id % 10 = 0 THEN 'r' || CAST(doc_id AS VARCHAR) END AS alias FROM w""")
def wiki_nested_markup(spark, sf_dir):
    """Documents as a dump of pages: whole texts as captions, footnotes, link labels and values of templates 50 deep, and redirects to some."""
    path = scratch(spark, "dump")
    docs = _table(spark, sf_dir, "documents")
    w = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\P{Alnum}+", " "))  # ASCII's; as ranges Java takes ten times as long
    lit, num = F.lit, F.col("doc_id").cast("string")
    markup = F.concat(
        lit("[[File:a.jpg|thumb|"), w, lit(" [[in]] and [http://a.example b]]]<!-- "), w, lit(" --><ref name=a>"), w, lit("</ref>"), lit("{{box|a=" * 50), w, lit("}}" * 50),
        lit("[[To|"), w, lit("]] [[Category:"), F.coalesce("lang", lit("none")), lit("]]"),
    )
    none = lit(None).cast("struct<_title: string>")
    page = docs.select(F.concat(lit("p"), num).alias("title"), lit(0).alias("ns"), F.col("doc_id").alias("id"), none.alias("redirect"), F.struct(lit("2026-01-01").alias("timestamp"), markup.alias("text")).alias("revision"))
    other = docs.filter("doc_id % 10 = 0").select(F.concat(lit("r"), num), lit(0), -F.col("doc_id") - 1, F.struct(F.concat(lit("p"), num).alias("_title")), F.struct(lit("2026-01-01").alias("timestamp"), lit("#").alias("text")))
    page.union(other).write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    found = wiki.documents(wiki.pages(spark, path), redirects=wiki.pages(spark, path, redirects=True))
    one = lambda c: F.array_join(c, "|")
    return found.select("doc_id", "opening", "body", one("tags").alias("tag"), one("links").alias("link"), F.nullif(one("aliases"), F.lit("")).alias("alias"))
