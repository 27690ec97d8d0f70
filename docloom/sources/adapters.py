"""Sources by name: what reads each, how it is checked, and the way from there to a published generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, gazetteer, mapfeatures
from ..schema import UnknownSource, with_extra_columns
from ..storage import file_system, scratch
from . import html, lines, mapfile, tables, wiki


@dataclass(frozen=True)
class Adapter:
    """One source: `documents` reads it in the document model; a build must have min_docs and find the samples as titles or aliases.

    `done` removes what documents staged, once nothing reads them.
    """

    source: str
    kind: str
    documents: Callable[[SparkSession], DataFrame]
    generation: str
    lang: str | None = None
    min_docs: int = 1
    samples: tuple[str, ...] = ()
    done: Callable[[SparkSession], None] = lambda spark: None


def wiki_pages(source: str, dump: str, generation: str, views: str | None = None, items: str | None = None, domain: str | None = None, lang: str | None = None, min_docs: int = 1, samples: tuple[str, ...] = ()) -> Adapter:
    """A wiki dump, with page views of a domain and page properties where there are any."""

    def documents(spark: SparkSession) -> DataFrame:
        found = wiki.documents(wiki.pages(spark, dump), tables.page_views(spark, views, domain) if views else None, tables.page_items(spark, items) if items else None, redirects=wiki.pages(spark, dump, redirects=True))
        return with_extra_columns(found, {"lat": "double", "lon": "double", "wikidata": "string"})

    return Adapter(source, "wiki", documents, generation, lang, min_docs, samples)


def map_features(source: str, path: str, generation: str, lang: str | None = None, labels: dict[tuple[str, str], str] | None = None, min_docs: int = 1, samples: tuple[str, ...] = ()) -> Adapter:
    """Map files, decoded once into a staged table."""
    folders: list[str] = []

    def documents(spark: SparkSession) -> DataFrame:
        folders.append(scratch(spark, "mapthings"))
        # Few bytes make a document dearly, so tasks are told by number; by bytes Spark would leave one or two.
        found = mapfeatures.features(*mapfile.staged(spark, path, folders[-1])).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        return with_extra_columns(mapfeatures.documents(found, lang, labels))

    def done(spark: SparkSession) -> None:
        while folders:
            p, fs = file_system(spark, folders.pop())
            fs.delete(p, True)

    return Adapter(source, "map", documents, generation, lang, min_docs, samples, done)


def places(source: str, rows: str, countries: str, regions: str, generation: str, names: str | None = None, langs: tuple[str, ...] = ("ja", "en"), min_docs: int = 1, samples: tuple[str, ...] = ()) -> Adapter:
    """Place files with their dimensions."""

    def documents(spark: SparkSession) -> DataFrame:
        known = tables.place_names(spark, names, langs) if names else None
        docs = gazetteer.places(tables.places(spark, rows), tables.countries(spark, countries), tables.regions(spark, regions), known)
        return docs.withColumn("body", F.col("opening"))

    return Adapter(source, "places", documents, generation, None, min_docs, samples)


def json_lines(spark: SparkSession, source: str, path: str, today: str | None = None) -> Adapter:
    """Lines of JSON, whose first line can name the date, the least number of documents and samples."""
    told = lines.header(spark, path, today or date.today().strftime("%Y%m%d"))
    return Adapter(source, "lines", lambda s: with_extra_columns(lines.documents(s, path)), told["dump_date"], None, told["min_docs"], tuple(told["sample_titles"]))


def web_pages(source: str, path: str, generation: str, min_docs: int = 1) -> Adapter:
    """A table of web pages; of equal titles the least id keeps it, others show their id and have the title as alias."""

    def documents(spark: SparkSession) -> DataFrame:
        docs = html.documents(spark.read.parquet(path))
        named = build.first_seen_titles(docs.select("doc_id", "title"), "doc_id", F.col("doc_id"), F.col("doc_id").cast("string"))
        return docs.drop("title", "aliases").join(named.select("doc_id", "title", F.array_compact(F.array("alias")).alias("aliases")), "doc_id")

    return Adapter(source, "pages", documents, generation, None, min_docs)


class Adapters:
    """Names of sources and what makes their adapter. A name told by itself goes before families, and both before plugins.

    A family is many names of one make, as editions or regions are. Plugins are asked for their
    names only when nobody else knows one, so that one that doesn't answer stops no other source.
    """

    def __init__(self, plugins: Callable[[], dict[str, Callable[[], Adapter]]] | None = None):
        self._own: dict[str, Callable[[], Adapter]] = {}
        self._families: dict[str, tuple[frozenset[str], Callable[[str], Adapter]]] = {}
        self._plugins = plugins or dict

    def add(self, source: str, make: Callable[[], Adapter]) -> None:
        if not source.replace("_", "").isalnum():
            raise ValueError(f"{source!r} isn't made of letters, digits and _")
        self._own[source] = make

    def add_family(self, family: str, sources: Iterable[str], make: Callable[[str], Adapter]) -> None:
        self._families[family] = (frozenset(sources), make)

    def get(self, source: str) -> Adapter:
        """The adapter of a name; UnknownSource says which names there are, families by their size."""
        if source in self._own:
            return self._own[source]()
        for sources, make in self._families.values():
            if source in sources:
                return make(source)
        plugins = self._plugins()
        if source in plugins:
            return plugins[source]()
        known = [*sorted(self._own), *(f"{n} (plugin)" for n in sorted(plugins)), *(f"{f} ({len(s)})" for f, (s, _) in self._families.items())]
        raise UnknownSource(f"{source}; there are {', '.join(known) or 'none'}")


def run(spark: SparkSession, adapters: Adapters, source: str, root: str) -> str:
    """Reads a source through its adapter, builds and checks a generation below root/source, and publishes it."""
    adapter = adapters.get(source)
    meta = {"source_kind": adapter.kind} | ({"lang": adapter.lang} if adapter.lang else {})
    try:
        return build.build(adapter.documents(spark), root, source, adapter.generation, meta, adapter.min_docs, list(adapter.samples))
    finally:
        adapter.done(spark)
