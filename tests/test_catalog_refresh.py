"""Sources published, replaced, broken and removed while a stream keeps them open."""

import shutil

import pytest

from docloom.operators import build
from docloom.schema import UnknownSource
from docloom.sources import pointers
from docloom.streaming.catalog import OpenSources


def _docs(spark, word):
    return spark.createDataFrame([(i, f"{word} {i}", word, f"{word} body", [word]) for i in (1, 2)], "doc_id bigint, title string, opening string, body string, tags array<string>")


def test_pointers_are_told_once_two_looks_agree(tmp_path):
    reader = pointers.Reader(str(tmp_path / "none"))
    assert list(reader.read(reader.initialOffset())[0]) == []
    reader, at = pointers.Reader(str(tmp_path)), reader.initialOffset()
    for name in ("a", "b", "empty"):
        (tmp_path / name).mkdir()
    (tmp_path / "file").write_text("x")
    (tmp_path / "a" / "CURRENT").write_text("g1\nmore")
    rows, at = reader.read(at)
    assert list(rows) == [] and at["told"] == {}
    (tmp_path / "b" / "CURRENT").write_text("h1")
    rows, at = reader.read(at)
    assert list(rows) == []  # still changing
    before = at
    rows, at = reader.read(at)
    assert list(rows) == [("a", "g1"), ("b", "h1")] == list(reader.readBetweenOffsets(before, at))
    assert reader.read(at)[1] == at and list(reader.read(at)[0]) == []
    (tmp_path / "a" / "CURRENT").unlink()
    (tmp_path / "b" / "CURRENT").write_text("h2")
    at = reader.read(at)[1]
    assert list(reader.read(at)[0]) == [("a", None), ("b", "h2")]


def test_sources_are_exchanged_in_a_stream(spark, tmp_path):
    root = str(tmp_path / "sources")
    open_ = OpenSources(spark, root)
    stream = open_.start(0)
    try:
        stream.processAllAvailable()
        with pytest.raises(UnknownSource, match="none"):
            open_.get("x")
        build.build(_docs(spark, "first"), root, "x", "g1")
        build.build(_docs(spark, "other"), root, "y", "g1")
        stream.processAllAvailable()
        old, y = open_.get("x"), open_.get("y")
        assert [r.title for r in old.doc("first 1").collect()] == ["first 1"]
        build.build(_docs(spark, "second"), root, "x", "g2")
        build.replace_text(spark, f"{root}/z/CURRENT", "missing")
        stream.processAllAvailable()
        assert [r.title for r in open_.get("x").doc("second 2").collect()] == ["second 2"] and set(open_.broken) == {"z"}
        assert open_.get("y") is y and old.docs.count() == 2  # what didn't change isn't opened again; readers keep the old tables
        build.build(_docs(spark, "third"), root, "z", "g1")
        shutil.rmtree(f"{root}/y")
        stream.processAllAvailable()
        assert sorted(open_.sources) == ["x", "z"] and not open_.broken
        assert sorted(map(tuple, open_.catalog().collect())) == sorted(map(tuple, build.catalog(spark, root).collect()))
        with pytest.raises(UnknownSource, match="there are x, z"):
            open_.get("y")
        assert stream.isActive and stream.exception() is None
    finally:
        stream.stop()
