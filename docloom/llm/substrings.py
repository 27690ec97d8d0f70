"""Removal of passages that documents share.

A window of N consecutive words is removed from a document when the same words also start
in a document with a smaller id; a word goes if any removed window covers it, so what goes
are the maximal spans of at least N words that match an earlier document.

Suffix automata of reference shards would have to be broadcast, but here every document is
reference to those after it: the automata hold the whole corpus, and each would have to meet
each document. The README gives figures. In their place the windows' 64-bit hashes are
exchanged (see exchange.py): each part of the hash space learns the smallest document of
each window and answers those chunks that hold it in a later one. A document thereby gets
the matching statistics it would get from the automata, clipped at N words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, unpack
from .exchange import CHUNK_BYTES, PART_BYTES, dealt, flat, grams_of, layout, slices, split_texts, word_hashes

#: Words of a window.
N = 13
#: A document without an id is no reference and loses nothing.
_NONE = np.iinfo(np.int64).max


def _first_ids(grams: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with the smallest id of each."""
    order = np.argsort(grams, kind="stable")
    grams, ids = grams[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.minimum.reduceat(ids, first) if len(first) else ids


def _chunk(table: pa.Table, n: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lists, ends = split_texts(table.column("text"))
    grams, starts, rows = grams_of(word_hashes(flat(lists)), ends, n)
    ids = table.column("doc_id").fill_null(int(_NONE)).to_numpy()
    return lists, ends, grams, starts, ids[rows] if len(rows) else np.zeros(0, np.int64)


def remove_repeats(docs: DataFrame, n: int = N, text: bool = True, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, spans, kept_sha256 and, with text, kept.

    spans are the removed ranges of words, as [from, to). kept has the remaining words joined
    by one space. Null and empty texts and those of under n words keep all; rows that repeat
    an id don't remove each other's windows; rows without an id neither give nor lose any.
    Columns besides doc_id and text are unused.
    """
    plan = layout(docs, chunk_bytes, part_bytes)
    rows = dealt(docs.select("doc_id", "text"), plan.chunks)
    parts = plan.parts

    def windows(table: pa.Table) -> pa.Table:
        _, _, grams, _, ids = _chunk(table, n)
        grams, ids = _first_ids(grams, ids)
        out = [(part, pack(grams[a:b], True), pack(ids[a:b])) for part, a, b in slices(grams, parts)]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"part": pa.array([x[0] for x in out], pa.int64()), "chunk": pa.array([chunk] * len(out), pa.int64()), "grams": pa.array([x[1] for x in out], pa.binary()), "ids": pa.array([x[2] for x in out], pa.binary())})

    def answers(table: pa.Table) -> pa.Table:
        grams = [unpack(x, np.uint64, True) for x in table.column("grams").to_pylist()]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        grams = np.concatenate(grams)
        ids = np.concatenate([unpack(x, np.int64) for x in table.column("ids").to_pylist()])
        order = np.argsort(grams, kind="stable")
        same = grams[order]
        begins = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
        least = np.empty(len(grams), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(np.append(begins, len(grams))))
        later = least < ids  # where the chunk itself doesn't hold the smallest document
        out, at = [], 0
        for chunk, size in zip(table.column("chunk").to_pylist(), sizes.tolist()):
            told = later[at : at + size]
            if told.any():
                out.append((chunk, pack(grams[at : at + size][told], True), pack(least[at : at + size][told])))
            at += size
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "grams": pa.array([x[1] for x in out], pa.binary()), "ids": pa.array([x[2] for x in out], pa.binary())})

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string())] + [("kept", pa.string())] * text)

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        lists, ends, grams, starts, ids = _chunk(table, n)
        known, least = _first_ids(
            np.concatenate([grams, *(unpack(x, np.uint64, True) for x in told.column("grams").to_pylist())]),
            np.concatenate([ids, *(unpack(x, np.int64) for x in told.column("ids").to_pylist())]),
        )
        goes = starts[least[np.searchsorted(known, grams)] < np.where(ids == _NONE, np.iinfo(np.int64).min, ids)] if len(grams) else starts
        total = int(ends[-1])
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, goes, 1)
        np.add.at(cover, goes + n, -1)
        gone = np.cumsum(cover[:-1]) > 0
        # A window never crosses texts, but spans of two texts may touch.
        before = np.concatenate(([0], np.cumsum(gone)))
        begins = np.concatenate(([0], ends[:-1]))
        removed = before[ends] - before[begins]
        spans, kept, digests = [], [], []
        for words, a, b, lost in zip(lists, begins.tolist(), ends.tolist(), removed.tolist()):
            if lost:
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                spans.append(edges.reshape(-1, 2).tolist())
                words = [w for w, x in zip(words, own.tolist()) if not x]
            else:
                spans.append([])
            joined = b" ".join(words)
            digests.append(hashlib.sha256(joined).hexdigest())
            if text:
                kept.append(joined.decode())
        columns = {"doc_id": table.column("doc_id"), "n_words": pa.array(ends - begins), "n_removed": pa.array(removed.astype(np.int64)), "spans": pa.array(spans, schema.field("spans").type), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.string())} if text else {}), schema=schema)

    def by(df: DataFrame, column: str):
        return df.repartition(plan.places, column).groupBy(column)

    sent = by(rows, "chunk").applyInArrow(windows, "part bigint, chunk bigint, grams binary, ids binary")
    told = by(sent, "part").applyInArrow(answers, "chunk bigint, grams binary, ids binary")
    out = "doc_id bigint, n_words bigint, n_removed bigint, spans array<array<bigint>>, kept_sha256 string" + ", kept string" * text
    return by(rows, "chunk").cogroup(by(told, "chunk")).applyInArrow(cut, out)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 13 words and more that an earlier one holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 12], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS s FROM t)),
f AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, s + k AS i FROM (
  SELECT x.doc_id, x.s, unnest(range(0, 13)) AS k FROM x JOIN f USING (g) WHERE f.least < x.doc_id)),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END AS kept
  FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
