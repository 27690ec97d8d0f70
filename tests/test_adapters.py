"""Sources by name: precedence, unknown names, and the way to a published generation."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import build
from docloom.plans import queries
from docloom.schema import UnknownSource
from docloom.sources import adapters, lines, mapfile


def _named(kind):
    return lambda source="x": adapters.Adapter(source, kind, lambda spark: None, "g1")


def test_own_names_go_before_families_and_those_before_plugins():
    asked = []

    def plugins():
        asked.append(1)
        return {"aawiki": _named("plugin"), "extra": _named("plugin")}

    known = adapters.Adapters(plugins)
    known.add_family("wiki", ["aawiki", "bbwiki"], _named("family"))
    known.add_family("map", (f"map_{i}" for i in range(195)), _named("map"))
    known.add("bbwiki", _named("own"))
    assert [known.get(n).kind for n in ("bbwiki", "aawiki", "map_7")] == ["own", "family", "map"] and not asked
    assert known.get("extra").kind == "plugin" and asked == [1]
    with pytest.raises(UnknownSource, match=r"nothing; there are bbwiki, aawiki \(plugin\), extra \(plugin\), wiki \(2\), map \(195\)"):
        known.get("nothing")
    for name in ("a-b", "a/b", ""):
        with pytest.raises(ValueError):
            known.add(name, _named("own"))
    with pytest.raises(UnknownSource, match="none"):
        adapters.Adapters().get("x")


def test_lines_to_a_published_source(spark, tmp_path):
    rows = [{"meta": {"dump_date": "20260203", "min_docs": 2, "sample_titles": ["One", "Uno"]}}, {"doc_id": 1, "title": "One", "body": "first", "aliases": ["Uno"], "extra": {"lat": 1.5, "feature": "f=1"}}, {"title": "Two", "body": "second"}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    known = adapters.Adapters()
    known.add("notes", lambda: adapters.json_lines(spark, "notes", str(tmp_path / "in.jsonl")))
    path = adapters.run(spark, known, "notes", f"file://{tmp_path}/root")
    assert "20260203" in path
    kb = build.source(spark, f"file://{tmp_path}/root", "notes")
    assert sorted(r.title for r in kb.docs.collect()) == ["One", "Two"] and kb.doc("Uno").first().lat == 1.5
    rows[0]["meta"]["sample_titles"] = ["Three"]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    with pytest.raises(ValueError, match="samples"):
        adapters.run(spark, known, "notes", f"file://{tmp_path}/root")
    assert build.source(spark, f"file://{tmp_path}/root", "notes").docs.count() == 2  # what was published stays


def test_wiki_map_and_place_adapters(spark, tmp_path):
    (tmp_path / "dump.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><timestamp>t</timestamp><text>'''A''' is [[B]]. {{coord|10|20}}</text></revision></page></mediawiki>")
    root = f"file://{tmp_path}/root"
    known = adapters.Adapters()
    known.add("aawiki", lambda: adapters.wiki_pages("aawiki", str(tmp_path / "dump.xml"), "g1", lang="aa", samples=("A",)))
    mapfile.write(spark.createDataFrame([("n", 1, 1.0, 2.0, {"name": "Cafe", "amenity": "cafe"}, None, None, None)], mapfile.SCHEMA), f"{tmp_path}/map")
    known.add("map_x", lambda: adapters.map_features("map_x", f"{tmp_path}/map", "g1", samples=("Cafe",)))
    (tmp_path / "rows.txt").write_text("\t".join(["7", "Town", "Town", "", "3.5", "4.5", "P", "PPL", "XX", "", "01", "", "", "", "900", "", "", "", "2026-01-01"]) + "\n")
    (tmp_path / "countries.txt").write_text("#c\nXX\tXXX\t1\tXX\tExland\n")
    (tmp_path / "regions.txt").write_text("XX.01\tRegion\tRegion\t1\n")
    known.add("places", lambda: adapters.places("places", str(tmp_path / "rows.txt"), str(tmp_path / "countries.txt"), str(tmp_path / "regions.txt"), "g1", samples=("Town",)))
    for name in ("aawiki", "map_x", "places"):
        adapters.run(spark, known, name, root)
    assert {r.source: r.doc_count for r in build.catalog(spark, root).collect()} == {"aawiki": 1, "map_x": 1, "places": 1}
    assert [tuple(r) for r in build.source(spark, root, "map_x").docs.select("title", "feature", "lat").collect()] == [("Cafe", "amenity=cafe", 1.0)]
    assert [tuple(r) for r in build.source(spark, root, "places").docs.select("title", "area", "lat").collect()] == [("Town", "Region", 3.5)]
    assert [tuple(r) for r in build.source(spark, root, "aawiki").docs.select("title", "lat", "links").collect()] == [("A", 10.0, ["B"])]


def test_lines_are_numbered_without_a_shuffle_of_their_text(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"title": f"t{i}"}) for i in range(50)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = lines.numbered(spark, str(tmp_path / "in.jsonl"))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.line for r in numbered.collect()) == list(range(1, 51))


def test_published_languages_read_no_whole_texts(spark, monkeypatch):
    built = []
    monkeypatch.setattr(queries.build, "build", lambda docs, root, source, generation: built.append((source, docs.columns, docs.inputFiles())))
    queries._published(spark, sf := "/root/testdata/./sf0.001")
    queries._CATALOGS.pop((spark.sparkContext.applicationId, sf))
    assert len(built) > 2 and all(columns == ["doc_id", "title", "body", "tags"] for _, columns, _ in built)
    assert not any("documents.parquet" in f for _, _, files in built for f in files)


def test_published_languages_hold_whole_texts(spark):
    root = queries._published(spark, sf := "/root/testdata/././sf0.001")
    queries._CATALOGS.pop((spark.sparkContext.applicationId, sf))
    given = spark.read.parquet(f"{sf}/documents.parquet").filter("lang IS NOT NULL")
    told = [build.opened(spark, r.path).docs.select(F.lit(r.source).alias("source"), "doc_id", "body") for r in build.catalog(spark, root).collect()]
    found = {tuple(r) for docs in told for r in docs.collect()}
    assert found == {(f"src_{r.lang}", r.doc_id, r.text) for r in given.collect()} and max(len(x[2] or "") for x in found) > 50


def test_hints_count_the_tags_of_all_documents(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(i, f"t{i}", "text", ["first"] if i < 500 else ["later", ""]) for i in range(1100)]
    for source in ("new", "old"):
        path = build.build(spark.createDataFrame(rows, "doc_id bigint, title string, body string, tags array<string>"), root, source, "g1")
    (tmp_path / path.removeprefix(f"{root}/") / "tag_counts").rename(tmp_path / "counts")  # older builds have none
    assert {(r.source, r.doc_count, r.tag) for r in build.hints(spark, root).collect()} == {("new", 1100, "later"), ("old", 1100, "later")}
