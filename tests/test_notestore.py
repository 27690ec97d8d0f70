"""Notes kept up by changes: after each, every table equals a rebuild."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import build, notestore
from docloom.schema import NotFound


def _same(spark, store):
    docs = spark.createDataFrame(store.docs().collect(), notestore.DOCS)
    rows = lambda df: sorted(map(repr, df.collect()))
    order = ["gram", "doc_id", "n_trigrams", "title_at", "body_at"]
    assert rows(store.trigrams().select(*order)) == rows(build.trigram_index(docs).select(*order))
    assert rows(store.doc_tags()) == rows(build.doc_tags(docs).select("tag", "doc_id"))
    assert rows(store.tag_counts()) == rows(build.tag_counts(build.doc_tags(docs)))
    return {r.doc_id: (r.title, r.body, r.tags) for r in docs.collect()}


def test_tables_follow_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(notestore, "MOST", 3)
    store = notestore.NoteStore(spark, f"file://{tmp_path}/notes")
    assert store.docs().collect() == [] and store.recall(q="word").collect() == []
    batch = spark.createDataFrame([("T", "first words here", ["a", "b"], 1), (None, "second\nwords", ["a"], 2), ("T", "third", [], 3)], "title string, text string, tags array<string>, seq int")
    store.add(batch, "2026-01-01")
    assert _same(spark, store) == {1: ("T", "first words here", ["a", "b"]), 2: ("second", "second\nwords", ["a"]), 3: ("T (3)", "third", [])}
    store.update(1, text="changed", tags="b, c", at="2026-01-02")
    assert _same(spark, store)[1] == ("T", "changed", ["b", "c"])
    assert [r.doc_id for r in store.recall(q="words").collect()] == [2] and [r.doc_id for r in store.recall(q="ed").collect()] == [1]
    assert [r.doc_id for r in store.recall(q="chang", tags="b", fields="doc_id").collect()] == [1]
    store.delete(2)
    assert set(_same(spark, store)) == {1, 3}
    with pytest.raises(NotFound):
        store.delete(2)
    before = store.segments
    repeated = store.docs().withColumn("deleted", F.lit(True))
    store.apply(repeated, 2)  # a batch that was there already
    assert store.segments == before and len(before) == 3
    store.update(3, title="T", at="2026-01-03")  # the fourth segment makes one of all
    assert len(store.segments) == 1 and store.segments[0].startswith("3-")
    assert _same(spark, store) == {1: ("T", "changed", ["b", "c"]), 3: ("T (3)", "third", [])}
    store.apply(spark.createDataFrame([(9, "gone", None, None, None, "2026", True), (3, "old", "o", "o", ["x"], "2026-01-04", False), (3, "new", "o", "n", ["y"], "2026-01-05", False)], notestore.DOCS + ", deleted boolean"))
    assert _same(spark, store) == {1: ("T", "changed", ["b", "c"]), 3: ("new", "n", ["y"])}


def _change(spark, i):
    told = [(i, f"t{i}", "o", f"body {i}", ["a"], "1", False)] + ([(i - 3, f"t{i - 3}", "o", f"other {i}", ["b"], "2", False), (i - 2, None, None, None, None, "2", True)] if i % 4 == 3 else [])
    return spark.createDataFrame(told, notestore.DOCS + ", deleted boolean")


def test_compaction_leaves_segments_of_a_higher_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(notestore, "MOST", 1)
    store, merges, merge = notestore.NoteStore(spark, f"file://{tmp_path}/notes"), [], notestore.NoteStore._merge
    monkeypatch.setattr(notestore.NoteStore, "_merge", lambda self, older, merged, level: (merges.append(len(merged)), merge(self, older, merged, level)))
    for i in range(7):
        store.apply(_change(spark, i))
    assert [n.rsplit("-", 1)[1] for n in store.segments] == ["2", "1", "0"] and merges == [2, 2, 2, 2]
    want = {i: (f"t{i}", f"body {i}", ["a"]) for i in range(7) if i != 1} | {0: ("t0", "other 3", ["b"])}
    assert _same(spark, store) == want


def test_new_ids_void_nothing(spark, tmp_path):
    store = notestore.NoteStore(spark, f"file://{tmp_path}/notes")
    store.apply(_change(spark, 0))
    store.apply(_change(spark, 0).unionByName(_change(spark, 9)).withColumn("updated_at", F.lit("3")))
    assert [r.doc_id for r in store._read("void").collect()] == [0]
