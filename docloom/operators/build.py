"""From a stream of documents to the tables that retrieval reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CITY, PAGEVIEWS, UnknownSource, normalized_popularity
from ..storage import file_system, read_text, replace_text
from .knowledge import PROBES, KnowledgeBase


def last_wins(docs: DataFrame, seq: str = "seq", key: str = "doc_id") -> DataFrame:
    """Of rows with one key the last by seq, combined before the shuffle."""
    rest = [c for c in docs.columns if c != key]
    return docs.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def first_seen_titles(docs: DataFrame, key: str, order: Column, suffix: Column) -> DataFrame:
    """The first document of a title by order keeps it; later ones get ` (suffix)` and the plain title as alias.

    Owners are found by a combined aggregation and joined by the unique key, so a title that
    many documents share neither meets in one task nor moves whole rows.
    """
    owners = docs.groupBy("title").agg(F.min_by(key, order).alias(key)).select(key, F.lit(True).alias("_owns"))
    plain = F.col("_owns").isNotNull() | F.col("title").isNull()
    return docs.join(owners, key, "left").withColumns({
        "alias": F.when(~plain, F.col("title")),
        "title": F.when(plain, F.col("title")).otherwise(F.concat("title", F.lit(" ("), suffix, F.lit(")"))),
    }).drop("_owns")


def title_owners(docs: DataFrame, size: str, key: str = "doc_id", title: str = "title") -> DataFrame:
    """title -> the key that owns it: most of size, then the least key."""
    return docs.groupBy(title).agg(F.max_by(key, F.struct(F.coalesce(F.col(size), F.lit(0)).alias("s"), -F.col(key))).alias("owner"))


def doc_tags(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag"), "doc_id").filter("tag <> ''").distinct()


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("docs"))


def doc_coords(docs: DataFrame) -> DataFrame:
    return docs.filter("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", "doc_id")


def aliases(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("aliases").alias("alias"), "doc_id")


def counts(rows: DataFrame, by: str) -> DataFrame:
    """by, docs: how many rows each value has."""
    return rows.groupBy(by).agg(F.count("*").alias("docs"))


def most_frequent(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value: the most frequent value of each, of equals the least."""
    shares = rows.groupBy(by, value).agg(F.count("*").alias("_n"))
    return shares.groupBy(by).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(value))


def gathered(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, values: each key's values by order. Keys must have lists that fit a row, as names of a place do."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias("values"))


def linked(docs: DataFrame, others: DataFrame, on: str = "wikidata", key: str = "doc_id") -> DataFrame:
    """doc_id, other_id, on: documents of two sources about one item."""
    return docs.filter(F.col(on).isNotNull()).select(key, on).join(others.select(F.col(key).alias("other_id"), on), on).select(key, "other_id", on)


def top_tag(docs: DataFrame, sample: int) -> DataFrame:
    """The most frequent tag of the first `sample` documents: an example to show, not a count."""
    tags = docs.orderBy("doc_id").limit(sample).select(F.explode("tags").alias("tag")).filter("tag <> ''")
    return counts(tags, "tag").orderBy(F.desc("docs"), "tag").limit(1).select("tag")


def text_lengths(docs: DataFrame) -> DataFrame:
    """One row: documents and the summed characters of their bodies and openings."""
    n = lambda c: F.coalesce(F.sum(F.char_length(c).cast("bigint")), F.lit(0).cast("bigint"))
    return docs.agg(F.count("*").alias("docs"), n("body").alias("chars"), n("opening").alias("opening_chars"))


def n_trigrams(title: Column, body: Column) -> Column:
    """The length by which ranking normalises: trigrams of title and body."""
    n = lambda x: F.greatest(F.char_length(F.coalesce(x, F.lit(""))) - 2, F.lit(0))
    return n(title) + n(body)


#: Characters of the documents that one sorted run of the index covers; a longer document is a run of its own.
RUN_CHARS = 1 << 21


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, str]]]]:
    """Some documents at a time, with (row, field, text) of each."""
    for batch in batches:
        begin, chars, texts = 0, 0, []
        for row, pair in enumerate(zip(batch.column("title"), batch.column("body"))):
            told = [x.as_py() or "" for x in pair]
            n = sum(map(len, told))
            if texts and chars + n > RUN_CHARS:
                yield batch.slice(begin, row - begin), texts
                begin, chars, texts = row, 0, []
            texts += [(row - begin, field, x) for field, x in enumerate(told)]
            chars += n
        if texts:
            yield batch.slice(begin), texts


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> their trigrams, a run at a time: three code points as one number, sorted with their places."""
    names, ints = ["gram", "doc_id", "n_trigrams", "title_at", "body_at"], pa.int32()
    for part, texts in _runs(batches):
        keys, rows, fields, places = ([] for _ in range(4))
        for row, field, text in texts:
            codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            n = len(codes) - 2
            if n > 0:
                keys.append(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])
                rows.append(np.full(n, row, np.int32))
                fields.append(np.full(n, field, np.int8))
                places.append(np.arange(n, dtype=np.int32))
        if not keys:
            continue
        key, row, field, place = (np.concatenate(x) for x in (keys, rows, fields, places))
        order = np.argsort(key, kind="stable")  # keeps a gram's documents in order, titles before bodies, both in text order
        key, row, field, place = key[order], row[order], field[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
        distinct, at = np.unique(key[first], return_inverse=True)
        told = np.stack((distinct >> np.uint64(42), distinct >> np.uint64(21), distinct), 1) & np.uint64(0x1FFFFF)
        text = told.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        grams = pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()).take(pa.array(at))
        lists = []
        for k in (0, 1):
            ends = np.concatenate(([0], np.cumsum(np.add.reduceat(field == k, first, dtype=np.int64)))).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends, ints), pa.array(place[field == k], ints)))
        of = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([grams, part.column("doc_id").take(of), part.column("n_trigrams").take(of), *lists], names=names)


def trigram_index(docs: DataFrame) -> DataFrame:
    """gram, doc_id, n_trigrams, title_at, body_at: where each folded trigram of a document starts.

    A term's occurrences follow from the places of its trigrams, so matching and ranking read
    no text. n_trigrams is the document's length. Rows come in runs sorted by gram and document.
    """
    told = docs.select("doc_id", "title", "body", n_trigrams(F.col("title"), F.col("body")).cast("int").alias("n_trigrams"))
    return told.mapInArrow(_grams, "gram string, doc_id bigint, n_trigrams int, title_at array<int>, body_at array<int>")


def write_trigrams(docs: DataFrame, path: str) -> None:
    """The index of docs as a table. Each task writes its documents' runs as they come, so nothing is shuffled or spilled.

    A run is sorted by gram, so of each run the statistics of pages leave those of the terms.
    """
    trigram_index(docs).write.option("compression", "zstd").parquet(path)


def refreshed_rank(docs: DataFrame) -> DataFrame:
    """docs with rank_score recomputed from extra's pageviews_month or population, and `changed`."""
    views = F.get_json_object("extra", "$.pageviews_month").cast("double")
    people = F.get_json_object("extra", "$.population").cast("double")
    new = F.when(views.isNotNull(), normalized_popularity(views, PAGEVIEWS)).when(people.isNotNull(), normalized_popularity(people, CITY)).otherwise(F.col("rank_score"))
    return docs.withColumn("_new", new).withColumns({"changed": ~F.col("_new").eqNullSafe(F.col("rank_score")), "rank_score": F.col("_new")}).drop("_new")


def validation(docs: DataFrame, tags: DataFrame, min_docs: int, samples: list[str], names: DataFrame | None = None) -> DataFrame:
    """check, ok: enough documents, sample titles found as title or alias, unique titles, tags derived."""
    spark = docs.sparkSession
    figures = docs.agg(F.count("*").alias("n"), F.count_distinct("title").alias("t"), F.bool_or(F.size("tags") > 0).alias("tagged")).first()
    titles = docs.select("title") if names is None else docs.select("title").union(names.select("alias"))
    found = {r.title for r in titles.filter(F.col("title").isin(samples)).distinct().collect()} if samples else set()
    rows = [("min_docs", figures["n"] >= min_docs), ("unique_titles", figures["n"] == figures["t"]), ("samples", set(samples) <= found), ("doc_tags", not figures["tagged"] or not tags.isEmpty())]
    return spark.createDataFrame(rows, "check string, ok boolean")


def build(docs: DataFrame, root: str, source: str, generation: str, meta: dict[str, str] | None = None, min_docs: int = 1, samples: list[str] = ()) -> str:  # noqa: B006
    """Writes all tables of one generation below root/source, checks them, and points the source there.

    Each table is clustered by what its readers filter on, so Parquet statistics prune; the
    trigram index is so within runs of documents. One generation besides the new one is kept.
    """
    spark = docs.sparkSession
    base = f"{root}/{source}"
    path = f"{base}/{generation}-{uuid.uuid4().hex[:8]}"
    # Equal titles and items are looked up by filters that each row group has.
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#title", "true").option("parquet.bloom.filter.enabled#wikidata", "true").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    rank = F.col("rank_score") if "rank_score" in docs.columns else F.lit(None).cast("double").alias("rank_score")
    docs.select("doc_id", "title", rank).repartitionByRange("title").sortWithinPartitions("title").write.parquet(f"{path}/titles")
    write_trigrams(docs, f"{path}/trigrams")
    doc_tags(docs).repartitionByRange("tag", "doc_id").sortWithinPartitions("tag", "doc_id").write.parquet(f"{path}/doc_tags")
    tags = spark.read.parquet(f"{path}/doc_tags")
    tag_counts(tags).sortWithinPartitions(F.desc("docs"), "tag").write.parquet(f"{path}/tag_counts")
    if {"lat", "lon"} <= set(docs.columns):
        doc_coords(docs).repartitionByRange("lat", "lon").sortWithinPartitions("lat", "lon").write.parquet(f"{path}/doc_coords")
    if "aliases" in docs.columns:
        aliases(docs).repartitionByRange("alias").sortWithinPartitions("alias").write.option("parquet.bloom.filter.enabled#alias", "true").parquet(f"{path}/aliases")
    failed = [r.check for r in validation(docs, tags, min_docs, list(samples), spark.read.parquet(f"{path}/aliases") if "aliases" in docs.columns else None).collect() if not r.ok]
    if failed:
        raise ValueError(f"{source} failed: {', '.join(failed)}")
    has = {k: F.coalesce(F.bool_or(F.expr(p)), F.lit(False)) for k, (column, p) in PROBES.items() if column in docs.columns}
    figures = docs.agg(F.count("*").alias("n"), F.avg(n_trigrams(F.col("title"), F.col("body"))).alias("mean"), *[c.alias(k) for k, c in has.items()]).first()
    told = {"source": source, "schema_version": "4", "dump_date": generation, "doc_count": str(figures["n"]), "mean_length": repr(figures["mean"] or 0.0)}
    told |= {f"has_{k}": "true" if k in has and figures[k] else "false" for k in PROBES} | (meta or {})
    spark.createDataFrame([tuple(told.values())], ", ".join(f"{k} string" for k in told)).coalesce(1).write.parquet(f"{path}/meta")
    publish(spark, base, path)
    return path


def opened(spark: SparkSession, path: str) -> KnowledgeBase:
    """The tables of one generation for retrieval."""

    def table(name: str) -> DataFrame | None:
        p, fs = file_system(spark, f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}") if fs.exists(p) else None

    return KnowledgeBase(table("docs"), aliases=table("aliases"), doc_tags=table("doc_tags"), tag_counts=table("tag_counts"), trigrams=table("trigrams"), titles=table("titles"), doc_coords=table("doc_coords"), meta=table("meta"))


def source(spark: SparkSession, root: str, name: str) -> KnowledgeBase:
    """A published source for retrieval; UnknownSource, with the names there are, where it or its columns are missing."""
    names = {r.source: r.path for r in catalog(spark, root).collect()}
    if name not in names:
        raise UnknownSource(f"{name}; there are {', '.join(sorted(names)) or 'none'}")
    return checked(spark, name, names[name])


def checked(spark: SparkSession, name: str, path: str) -> KnowledgeBase:
    """The tables of one generation; UnknownSource where documents lack a column that all have."""
    kb = opened(spark, path)
    if missing := {"doc_id", "title", "body"} - set(kb.docs.columns):
        raise UnknownSource(f"{name} lacks {', '.join(sorted(missing))}")
    return kb


def hints(spark: SparkSession, root: str) -> DataFrame:
    """The catalog with what a source can be asked: has_feature, has_coords, has_links and the tag of most documents, of equals the least. One short job a source and hint."""
    rows = []
    for r in catalog(spark, root).collect():
        kb = opened(spark, r.path)
        docs = with_missing(kb.docs)
        has = KnowledgeBase(docs).has_attributes().first()
        counted = kb.tag_counts if kb.tag_counts is not None else tag_counts(doc_tags(docs))  # older builds store no counts
        tag = counted.orderBy(F.desc("docs"), "tag").select("tag").first()
        rows.append((r.source, r.dump_date, r.doc_count, *has, tag and tag[0]))
    return spark.createDataFrame(rows, "source string, dump_date string, doc_count bigint, has_feature boolean, has_coords boolean, has_links boolean, tag string")


def with_missing(docs: DataFrame) -> DataFrame:
    """docs with null columns for what its source doesn't give."""
    usual = {"feature": "string", "lat": "double", "lon": "double", "links": "array<string>", "tags": "array<string>"}
    return docs.withColumns({c: F.lit(None).cast(t) for c, t in usual.items() if c not in docs.columns})


def grouped_catalog(sources: DataFrame) -> DataFrame:
    """The catalog by the part of a source's name before the first _: kind, sources, docs, newest."""
    kind = F.split_part("source", F.lit("_"), F.lit(1))
    return sources.groupBy(kind.alias("kind")).agg(F.count("*").alias("sources"), F.sum("doc_count").alias("docs"), F.max("dump_date").alias("newest"))


def publish(spark: SparkSession, base: str, path: str) -> None:
    """Replaces the pointer file base/CURRENT in one step, then drops finished generations but this one and the one before."""
    before = current(spark, base)
    replace_text(spark, f"{base}/CURRENT", path.rsplit("/", 1)[1])
    keep = {path.rsplit("/", 1)[1], (before or "").rsplit("/", 1)[-1]}
    p, fs = file_system(spark, base)
    for s in fs.listStatus(p):
        # What has no meta table yet is another build at work.
        if s.isDirectory() and s.getPath().getName() not in keep and fs.exists(file_system(spark, f"{s.getPath()}/meta/_SUCCESS")[0]):
            fs.delete(s.getPath(), True)


def current(spark: SparkSession, base: str) -> str | None:
    """The generation that the pointer names."""
    name = read_text(spark, f"{base}/CURRENT")
    return f"{base}/{name}" if name else None


def fingerprint(spark: SparkSession, root: str) -> str:
    """Changes when a source is added, removed or published anew: compared before a catalog is read again."""
    p, fs = file_system(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    return "|".join(f"{n}={current(spark, f'{root}/{n}')}" for n in names)

CATALOG = "source string, schema_version string, dump_date string, doc_count bigint, path string"


def described(spark: SparkSession, name: str, path: str) -> tuple | None:
    """The catalog's row of one generation; None where it is unfinished, another source's or of an unsupported version."""
    done, fs = file_system(spark, f"{path}/meta/_SUCCESS")
    meta = spark.read.parquet(f"{path}/meta").first().asDict() if fs.exists(done) else {}
    if meta.get("source") == name and meta.get("schema_version") in {"1", "2", "3", "4"}:
        return name, meta["schema_version"], meta["dump_date"], int(meta["doc_count"]), path
    return None


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row a published source of a supported schema version; broken ones are skipped."""
    p, fs = file_system(spark, root)
    rows = []
    for s in fs.listStatus(p) if fs.exists(p) else []:
        name = s.getPath().getName()
        path = current(spark, f"{root}/{name}")
        if path and (row := described(spark, name, path)):
            rows.append(row)
    return spark.createDataFrame(rows, CATALOG)
