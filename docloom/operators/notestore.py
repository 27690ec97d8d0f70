"""Notes on disk with tables that changes keep up: a base, small segments of changes, tombstones.

A segment holds the new rows of one set of changes, their trigram index and tags, the ids
whose older rows it makes void, and signed changes of tag counts. A change writes its own
segment and the pointer, nothing else; reading takes the rows that no later segment voids,
and counts are sums of what the segments say. More than MOST segments of one level become
one of the next, so a note is written anew once a level, not once for each MOST changes.
The pointer names the segments, oldest first, and is replaced in one step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import file_system, read_text, replace_text
from . import build, notes
from .knowledge import KnowledgeBase

MOST = 8
DOCS = "doc_id bigint, title string, opening string, body string, tags array<string>, updated_at string"
_TABLES = {
    "docs": DOCS, "trigrams": "gram string, doc_id bigint, n_trigrams int, title_at array<int>, body_at array<int>",
    "doc_tags": "tag string, doc_id bigint", "tag_changes": "tag string, docs bigint", "void": "doc_id bigint",
}


class NoteStore:
    """Notes below `path`; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def segments(self) -> list[str]:
        """Names `number-...-level`, oldest first."""
        told = read_text(self.spark, f"{self.path}/CURRENT")
        return told.split(",") if told else []

    def _read(self, table: str, segments: list[str] | None = None) -> DataFrame:
        """Rows of a table of all segments, with the segment's place."""
        names = self.segments if segments is None else segments
        frames = [self.spark.read.schema(_TABLES[table]).parquet(f"{self.path}/{s}/{table}").withColumn("segment", F.lit(i)) for i, s in enumerate(names)]
        out = self.spark.createDataFrame([], f"{_TABLES[table]}, segment int")
        for f in frames:
            out = out.unionByName(f)
        return out

    def _live(self, table: str, segments: list[str] | None = None) -> DataFrame:
        """Rows of a table that no later segment voids, of all segments or of some that follow one another."""
        names = self.segments if segments is None else segments
        void = self._read("void", names).groupBy("doc_id").agg(F.max("segment").alias("void"))
        return self._read(table, names).join(void, "doc_id", "left").filter(F.col("void").isNull() | (F.col("void") <= F.col("segment"))).drop("segment", "void")

    def docs(self, segments: list[str] | None = None) -> DataFrame:
        return self._live("docs", segments).select(*[c.split()[0] for c in DOCS.split(", ")])

    def trigrams(self) -> DataFrame:
        return self._live("trigrams")

    def doc_tags(self) -> DataFrame:
        return self._live("doc_tags").select("tag", "doc_id")

    def tag_counts(self) -> DataFrame:
        """tag, docs: the sums of all changes."""
        return self._read("tag_changes").groupBy("tag").agg(F.sum("docs").alias("docs")).filter("docs > 0")

    def apply(self, changes: DataFrame, number: int | None = None) -> None:
        """changes (note columns, `deleted`): the last of an id by updated_at counts, whether or not there is such a note.

        A number that is there already, as of a repeated batch, changes nothing.
        """
        names = self.segments
        taken = [int(n.split("-")[0]) for n in names]
        number = max(taken, default=-1) + 1 if number is None else number
        if number <= max(taken, default=-1):
            return
        at = f"{self.path}/{number}-{uuid.uuid4().hex[:8]}-0"
        columns = [c.split()[0] for c in DOCS.split(", ")]
        # Only rows of ids that come several times meet; the others aren't moved.
        changes = changes.select(*columns, "deleted")
        changes.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("repeated")).write.parquet(f"{at}/repeated")
        repeated = self.spark.read.schema("repeated bigint").parquet(f"{at}/repeated")
        same = F.col("doc_id").eqNullSafe(F.col("repeated"))
        several = changes.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*columns[1:], "deleted"), "updated_at").alias("r")).select("doc_id", "r.*")
        changes.join(repeated, same, "left_anti").unionByName(several).write.parquet(f"{at}/changes")
        last = self.spark.read.schema(f"{DOCS}, deleted boolean").parquet(f"{at}/changes")
        # An id that no segment has voids nothing.
        last.select("doc_id").join(self._read("docs", names).select("doc_id"), "doc_id", "left_semi").write.parquet(f"{at}/void")
        last.filter("NOT deleted").select(*columns).write.parquet(f"{at}/docs")
        gone = self.doc_tags().join(last.select("doc_id"), "doc_id", "left_semi").select("tag", F.lit(-1).cast("bigint").alias("n"))
        self._derive(at, gone)
        replace_text(self.spark, f"{self.path}/CURRENT", ",".join([*names, at.rsplit("/", 1)[1]]))
        self.compact()

    def _index(self, at: str) -> DataFrame:
        """The index and tags of a segment's rows; returns the tags."""
        docs = self.spark.read.schema(DOCS).parquet(f"{at}/docs")
        build.write_trigrams(docs, f"{at}/trigrams")
        build.doc_tags(docs).sortWithinPartitions("tag", "doc_id").write.parquet(f"{at}/doc_tags")
        return self.spark.read.schema(_TABLES["doc_tags"]).parquet(f"{at}/doc_tags")

    def _derive(self, at: str, gone: DataFrame) -> None:
        """The tables that follow from a segment's rows, and from tags that its changes take away."""
        moved = self._index(at).select("tag", F.lit(1).cast("bigint").alias("n")).unionByName(gone)
        moved.groupBy("tag").agg(F.sum("n").alias("docs")).filter("docs <> 0").write.parquet(f"{at}/tag_changes")

    def compact(self) -> None:
        """The newest segments of one level as one of the next while there are more than MOST; what readers hold of them stays until the next compaction."""
        level = lambda n: int(n.split("-")[2]) if n.count("-") > 1 else 0
        gone: list[str] = []
        while True:
            names = self.segments
            begin = len(names)
            while begin and level(names[begin - 1]) == level(names[-1]):
                begin -= 1
            if len(names) - begin <= MOST:
                break
            self._merge(names[:begin], names[begin:], level(names[-1]) + 1)
            gone += names[begin:]
        if gone:
            before = read_text(self.spark, f"{self.path}/BEFORE")
            for s in before.split(",") if before else []:
                p, fs = file_system(self.spark, f"{self.path}/{s}")
                fs.delete(p, True)
            replace_text(self.spark, f"{self.path}/BEFORE", ",".join(gone))

    def _merge(self, older: list[str], merged: list[str], level: int) -> None:
        """Replaces the segments `merged` by one, which voids of older ones what they did."""
        at = f"{self.path}/{merged[-1].split('-')[0]}-{uuid.uuid4().hex[:8]}-{level}"
        self.docs(merged).write.parquet(f"{at}/docs")
        void = self._read("void", merged).select("doc_id").distinct()
        void.join(self._read("docs", older).select("doc_id"), "doc_id", "left_semi").write.parquet(f"{at}/void")
        self._index(at)
        self._read("tag_changes", merged).groupBy("tag").agg(F.sum("docs").alias("docs")).filter("docs <> 0").write.parquet(f"{at}/tag_changes")
        replace_text(self.spark, f"{self.path}/CURRENT", ",".join([*older, at.rsplit("/", 1)[1]]))

    def add(self, batch: DataFrame, at: str | None = None) -> None:
        """batch (title, text, tags, seq), as notes.add."""
        self.apply(notes.added(self.docs(), batch, at).withColumn("deleted", F.lit(False)))

    def update(self, doc_id: int, text: str | None = None, title: str | None = None, tags: str | list[str] | None = None, at: str | None = None) -> None:
        """As notes.update."""
        new = notes.update(self.docs(), doc_id, text, title, tags, at).filter(F.col("doc_id") == doc_id)
        self.apply(new.withColumn("deleted", F.lit(False)))

    def delete(self, doc_id: int) -> None:
        """As notes.delete."""
        notes.known(self.docs(), doc_id)
        self.apply(self.docs().filter(F.col("doc_id") == doc_id).withColumn("deleted", F.lit(True)))

    def recall(self, q: str | None = None, tags: str | None = None, **others) -> DataFrame:
        """As notes.recall; texts are found through the index, and only those of found notes are read."""
        docs = self.docs()
        if q and (terms := T.match_terms(q)) is not None:
            found = KnowledgeBase(docs, trigrams=self.trigrams()).holding(terms)
            docs, q = docs.join(found, "doc_id", "left_semi"), None
        return notes.recall(docs, q=q, tags=tags, **others)
