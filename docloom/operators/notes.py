"""Notes: the one source that is written to. Each change gives a new table; derived tables follow from it."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import BadRequest, NotFound
from .knowledge import clamp, parse_fields, split_list

FIELDS = ("doc_id", "title", "text", "tags", "updated_at", "truncated")
TITLE_CHARS, OPENING_CHARS, MOST = 60, 240, 100


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def titled(batch: DataFrame) -> DataFrame:
    """batch (title?, text, ...) with title: the given one or the first line that isn't blank, cut at 60."""
    first = F.regexp_extract(F.col("text"), r"^\s*([^\n]*)", 1)
    return batch.withColumn("title", F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.substring(F.btrim(first), 1, TITLE_CHARS)))


def added(notes: DataFrame, batch: DataFrame, at: str | None = None) -> DataFrame:
    """batch (title, text, tags, seq) as notes: ids follow the largest, and a title in use gets ` (id)`.

    The batch is numbered by seq in one task: it is what one writer sends at a time.
    """
    top = notes.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    new = titled(batch).withColumn("doc_id", F.row_number().over(Window.partitionBy().orderBy("seq")) + F.lit(top).cast("bigint"))
    taken = notes.select("title").distinct().withColumn("_taken", F.lit(True))
    again = F.row_number().over(Window.partitionBy("title").orderBy("doc_id")) > 1
    new = new.join(taken, "title", "left").withColumn("_again", again | F.coalesce("_taken", F.lit(False)))
    title = F.when(F.col("_again"), F.concat("title", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return new.select("doc_id", title.alias("title"), F.substring("text", 1, OPENING_CHARS).alias("opening"), F.col("text").alias("body"), "tags", F.lit(at or now()).alias("updated_at"))


def add(notes: DataFrame, batch: DataFrame, at: str | None = None) -> DataFrame:
    """notes and what `added` makes of batch."""
    return notes.unionByName(added(notes, batch, at))


def update(notes: DataFrame, doc_id: int, text: str | None = None, title: str | None = None, tags: str | list[str] | None = None, at: str | None = None) -> DataFrame:
    """Only what is given changes, stripped; tags, a list or separated by commas, are replaced as a whole.

    A title that another note has gets ` (id)`, as in add. NotFound without a note of this id.
    """
    if text is None and title is None and tags is None or text is not None and not text.strip() or title is not None and not title.strip():
        raise BadRequest("nothing to change, or blank")
    known(notes, doc_id)
    new = {"updated_at": F.lit(at or now())}
    if text is not None:
        new |= {"body": F.lit(text.strip()), "opening": F.lit(text.strip()[:OPENING_CHARS])}
    if title is not None:
        title = title.strip()
        taken = not notes.filter((F.col("title") == title) & (F.col("doc_id") != doc_id)).limit(1).isEmpty()
        new["title"] = F.lit(f"{title} ({doc_id})" if taken else title)
    if tags is not None:
        new["tags"] = F.array(*[F.lit(t) for t in (split_list(tags) if isinstance(tags, str) else tags)]).cast("array<string>")
    return notes.select(*[F.when(F.col("doc_id") == doc_id, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in notes.columns])


def known(notes: DataFrame, doc_id: int) -> None:
    if notes.filter(F.col("doc_id") == doc_id).limit(1).isEmpty():
        raise NotFound(str(doc_id))


def delete(notes: DataFrame, doc_id: int) -> DataFrame:
    """NotFound without a note of this id."""
    known(notes, doc_id)
    return notes.filter(F.col("doc_id") != doc_id)


def upsert(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """notes with changes (same columns and `deleted`) applied, the last by updated_at winning."""
    last = changes.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "doc_id"]), "updated_at").alias("_r")).select("doc_id", "_r.*")
    kept = notes.join(last.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(last.filter("NOT deleted").select(*notes.columns))


def recall(notes: DataFrame, since: str | None = None, until: str | None = None, tags: str | None = None, q: str | None = None, limit: int = 20, offset: int = 0, max_chars: int = 400, fields: str | None = None) -> DataFrame:
    """Newest first, all of FIELDS unless some are named. Times compare as text; all tags must be there; q matches full text, or, without a term of three characters, LIKE %q%."""
    conditions = []
    if since is not None:
        conditions.append(F.col("updated_at") >= since)
    if until is not None:
        conditions.append(F.col("updated_at") <= until)
    conditions += [F.array_contains("tags", t) for t in split_list(tags or "")]
    if q:
        terms = T.match_terms(q)
        if terms is None:
            conditions.append(F.col("title").like(f"%{q}%") | F.col("body").like(f"%{q}%"))
        else:
            conditions += [F.lower("title").contains(t) | F.lower("body").contains(t) if len(t) >= 3 else F.lit(False) for t in terms]
    rows = reduce(DataFrame.filter, conditions, notes).orderBy(F.desc("updated_at"), F.desc("doc_id")).offset(max(0, offset)).limit(clamp(limit, MOST))
    text = F.substring("body", 1, max_chars) if max_chars > 0 else F.col("body")
    cut = F.char_length("body") > max_chars if max_chars > 0 else F.lit(False)
    shown = rows.select("doc_id", "title", text.alias("text"), "tags", "updated_at", cut.alias("truncated"))
    return shown.select(*parse_fields(fields if fields and split_list(fields) else None, FIELDS, FIELDS))


def newest_of_each(rows: DataFrame, n: int, group: str, *order: str) -> DataFrame:
    """The n newest rows of each group. Each task keeps n a group before the shuffle, so a hot group is cheap."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", best).filter(F.col("_n") <= n).drop("_n")


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n newest rows: what a ring buffer keeps."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)
