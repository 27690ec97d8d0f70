"""Sources open for retrieval, exchanged while they are published anew."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from ..operators import build
from ..operators.knowledge import KnowledgeBase
from ..schema import UnknownSource
from ..sources import pointers
from ..storage import scratch

LOG = logging.getLogger(__name__)


class OpenSources:
    """The sources below root by name. A stream over their pointers opens what changes and no other source.

    All changes of one look are swapped in at once, so a reader holds the old tables or the new
    ones. A source that can't be opened is none until its pointer changes again; it stops neither
    the stream nor other sources. Published generations stay readable until two newer ones exist.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.sources: dict[str, tuple[tuple, KnowledgeBase]] = {}  # a source's row of the catalog and its tables
        self.broken: dict[str, str] = {}

    def get(self, name: str) -> KnowledgeBase:
        sources = self.sources
        if name not in sources:
            raise UnknownSource(f"{name}; there are {', '.join(sorted(sources)) or 'none'}")
        return sources[name][1]

    def catalog(self) -> DataFrame:
        """What build.catalog returns, of the sources that are open."""
        return self.spark.createDataFrame([row for row, _ in self.sources.values()], build.CATALOG)

    def apply(self, changes: DataFrame) -> None:
        """Opens and drops what changes (source, generation) names; a row for each source."""
        sources, broken = dict(self.sources), dict(self.broken)
        for r in changes.collect():
            sources.pop(r.source, None)
            broken.pop(r.source, None)
            if r.generation is None:
                continue
            path = f"{self.root}/{r.source}/{r.generation}"
            try:
                row = build.described(self.spark, r.source, path)
                if row is None:
                    raise UnknownSource(f"{path} is unfinished, of another source or of another version")
                sources[r.source] = row, build.checked(self.spark, r.source, path)
            except Exception as e:  # noqa: BLE001  whatever is wrong with one source, the others go on
                LOG.warning("source %s is left out: %s", r.source, e)
                broken[r.source] = str(e)
        self.sources, self.broken = sources, broken

    def start(self, seconds: int = 5):
        """Starts the stream, which looks every so many seconds. What is open is in memory alone, so it begins from nothing."""
        stream = pointers.changes(self.spark, self.root).writeStream.foreachBatch(lambda batch, _: self.apply(batch))
        return stream.option("checkpointLocation", scratch(self.spark, "catalog")).trigger(processingTime=f"{seconds} seconds").start()
