"""Readers of dumps against small files written here."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import gazetteer
from docloom.sources import lines, tables, wiki

DUMP = """<mediawiki xmlns="http://example.org/export/">
<page><title>Kyoto</title><ns>0</ns><id>7</id><revision><timestamp>2026-06-02T00:00:00Z</timestamp><text xml:space="preserve">{{Coord|35|0|36|N|135|46|12|E|type:city}}'''Kyoto''' is a city in [[Japan|the country]].&lt;ref name="a"&gt;A [[Book]] note&lt;/ref&gt;
[[File:K.jpg|thumb|A [[temple]] view]]

== Map ==
{{hidden begin|title=Breeds}}
{| class="wikitable"
|-
| Shiba || Poodle
|}
{{box|{{inner|deep}}|x=kept}}
[[Category:Cities|Kyoto]] __NOTOC__ [[User:Someone]]</text></revision></page>
<page><title>Miyako</title><ns>0</ns><id>101</id><redirect title="Kyoto" /><revision><timestamp>t</timestamp><text xml:space="preserve">#REDIRECT [[Kyoto]]</text></revision></page>
<page><title>Talk:Kyoto</title><ns>1</ns><id>999</id><revision><timestamp>t</timestamp><text xml:space="preserve">talk</text></revision></page>
<page><title>Project:K</title><ns>4</ns><id>105</id><redirect title="Kyoto" /><revision><timestamp>t</timestamp><text xml:space="preserve">#R</text></revision></page>
<page><title>Empty</title><ns>0</ns><id>9</id><revision><timestamp>t</timestamp><text xml:space="preserve"></text></revision></page>
<page><title>Nara</title><ns>0</ns><id>8</id><revision><timestamp>t</timestamp><text xml:space="preserve">{{coord|95|200}}{{coord|-34.5|135.8}}Plain.</text></revision></page>
</mediawiki>
"""


def test_wiki_dump(spark, tmp_path):
    with gzip.open(tmp_path / "dump.xml.gz", "wt") as f:
        f.write(DUMP)
    (tmp_path / "views").write_text("en.wiki Kyoto 7 desktop 90 A1\nen.wiki Kyoto 7 mobile 9 A1\nen.wiki Null null mobile 9 A1\nde.wiki Kyoto 7 mobile 5 A1\n")
    (tmp_path / "props.sql").write_text("INSERT INTO `page_props` VALUES (7,'wikibase_item','Q34600',NULL),(7,'x','y',NULL),(8,'wikibase_item','Q1',NULL);\n")
    views = tables.page_views(spark, str(tmp_path / "views"), "en.wiki")
    items = tables.page_items(spark, str(tmp_path / "props.sql"))
    assert [tuple(r) for r in views.collect()] == [(7, 99)]
    out = {r.doc_id: r for r in wiki.documents(wiki.pages(spark, str(tmp_path / "dump.xml.gz")), views, items, other=("User:",)).collect()}
    assert sorted(out) == [7, 8]
    k = out[7]
    assert k.opening == "Kyoto is a city in the country."
    assert (k.tags, k.links, k.aliases, k.updated_at, k.rank_score) == (["Cities"], ["Japan"], ["Miyako"], "2026-06-02T00:00:00Z", round(2 / 7, 4))
    assert json.loads(k.extra) == {"lat": 35.01, "lon": 135.77, "pageviews_month": 99, "wikidata": "Q34600"}
    for word in ("Shiba", "Poodle", "deep", "kept", "Breeds", "Map"):
        assert word in k.body, word
    for word in ("[", "{", "|", "x=", "note", "temple", "NOTOC", "Category", "'''"):
        assert word not in k.body, word
    assert json.loads(out[8].extra) == {"lat": -34.5, "lon": 135.8, "wikidata": "Q1"}
    assert (out[8].opening, out[8].aliases, out[8].rank_score) == ("Plain.", [], 0.0)


def test_place_files(spark, tmp_path):
    row = lambda i, name, cc, a1, people, lat="48.8", cls="P": "\t".join([str(i), name, name, "", lat, "2.3", cls, "PPL", cc, "", a1, "", "", "", str(people), "", "", "tz", "2026-01-01"])
    places = [row(1, "Paris", "FR", "11", 2000000), row(2, "Paris", "US", "TX", 25000), row(3, 'Say "Hi"', "CA", "08", 0), row(4, "Road", "FR", "11", 0, cls="R"), row(5, "Nowhere", "FR", "11", 0, lat="n/a")]
    (tmp_path / "all.txt").write_text("\n".join(places) + "\n")
    (tmp_path / "alt.txt").write_text("1\t1\tja\tパリ\n2\t1\twkdt\tQ90\n3\t1\tlink\thttps://x\n4\t1\tru\tПариж\n5\t1\ten\t\n")
    (tmp_path / "countries.txt").write_text("# comment\nFR\tFRA\t250\tFR\tFrance\tParis\nUS\tUSA\t840\tUS\tUnited States\t\n")
    (tmp_path / "admin.txt").write_text("FR.11\tÎle-de-France\tx\t1\nUS.TX\tTexas\tx\t2\n")
    at = lambda n: str(tmp_path / n)
    names = tables.place_names(spark, at("alt.txt"))
    assert sorted(tuple(r) for r in names.collect()) == [(1, "Q90", "wkdt"), (1, "パリ", "ja")]
    assert tables.place_names(spark, at("alt.txt"), ("*",)).count() == 3
    out = {r.doc_id: r for r in gazetteer.places(tables.places(spark, at("all.txt")), tables.countries(spark, at("countries.txt")), tables.regions(spark, at("admin.txt")), names).collect()}
    assert {i: r.title for i, r in out.items()} == {1: "Paris", 2: "Paris (US:2)", 3: 'Say "Hi"'}
    assert (out[1].wikidata, out[1].aliases, out[1].tags, out[2].aliases, out[3].area) == ("Q90", ["パリ"], ["France", "Île-de-France"], ["Paris"], "CA")


def test_zip_members_and_last_items(spark, tmp_path):
    import zipfile

    text = "# comment\n" + "".join(f"{i}\tP{i}\tP\t\t1.5\t2.5\tP\tPPL\tFR\t\t11\t\t\t\t{i}\t\t\ttz\tm\n" for i in range(1, 12001))
    with zipfile.ZipFile(tmp_path / "FR.zip", "w") as archive:
        archive.writestr("readme.txt", "no place")
        archive.writestr("FR.txt", text)
    (tmp_path / "FR.txt").write_text(text)
    zipped, plain = (tables.places(spark, str(tmp_path / n)) for n in ("FR.zip", "FR.txt"))
    assert zipped.schema == plain.schema and zipped.exceptAll(plain).isEmpty() and zipped.count() == plain.count() == 12000
    (tmp_path / "p.sql").write_text("INSERT INTO `page_props` VALUES (7,'wikibase_item','Q9',NULL),(7,'wikibase_item','Q10',NULL),(7,'wikibase_item','Q1',NULL);\n")
    assert [tuple(r) for r in tables.page_items(spark, str(tmp_path / "p.sql")).collect()] == [(7, "Q1")]


def test_named_coordinates(spark):
    company = "{{Info\n|本社緯度度 = {}|本社緯度分 = {}|本社緯度秒 = {}|本社N(北緯)及びS(南緯) = {}\n|本社経度度 = {}|本社経度分 = {}|本社経度秒 = {}|本社E(東経)及びW(西経) = {}\n"
    fill = lambda *x: company.replace("{{", "\0").replace("{}", "%s").replace("\0", "{{") % x
    cases = [
        (fill(35, 10, 4.5, "N", 136, 56, 9.5, "E") + "}}", (35.16791667, 136.9359722)),
        (fill(*[""] * 8) + "| 本店緯度度 =35 |本店緯度分 =18 |本店緯度秒 =58.9 |本店経度度 =139 |本店経度分 =10 |本店経度秒 =18.5 }}", (35.3163611, 139.1718056)),
        ("{{x|latd=1|latm=30|latNS=S|longd=2|longEW=W}}", (-1.5, -2.0)), ("{{x|lat = 10.25 |long= -20.5}}", (10.25, -20.5)), ("{{x|lat=0|lon=0}}{{y|latitude=99|longitude=1}}", None),
        ("{{coord|1|2}}{{x|lat=5|lon=6}}", (1.0, 2.0)), ("latin prose without any", None), (None, None),
    ]
    out = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m string").select("i", wiki.coordinates(F.col("m")).alias("c")).collect()
    for r in out:
        want = cases[r.i][1]
        assert (None if r.c is None else (r.c.lat, r.c.lon)) == (want and pytest.approx(want, abs=1e-6))


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" if i % 7 else "\n" for i in range(1, 4001)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        out = lines.numbered(spark, str(tmp_path / "a.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((r.line, r.value) for r in out) == [(i, str(i) if i % 7 else "") for i in range(1, 4001)]


def test_json_lines(spark, tmp_path):
    rows = ['{"meta": {"dump_date": "20260131", "min_docs": 0, "sample_titles": ["A"]}}', '{"title": "A", "tags": ["x"], "extra": {"lat": 1}}', "", '{"title": "B", "doc_id": 9, "extra": [1]}', '{"title": "C", "doc_id": 9, "rank_score": 0.5}']
    path = str(tmp_path / "p.ndjson")
    (tmp_path / "p.ndjson").write_text("\n".join(rows) + "\n")
    assert lines.header(spark, path, "20990101") == {"dump_date": "20260131", "min_docs": 1, "sample_titles": ["A"]}
    out = sorted((r.doc_id, r.title, r.tags, r.rank_score, r.extra) for r in lines.documents(spark, path).collect())
    assert out == [(2, "A", ["x"], 0.0, '{"lat":1}'), (9, "C", [], 0.5, None)]
    (tmp_path / "bad.ndjson").write_text('{"title": "A"}\n{"title": " "}\n')
    with pytest.raises(Exception, match="no title in line 2"):
        lines.documents(spark, str(tmp_path / "bad.ndjson")).collect()
    assert lines.header(spark, str(tmp_path / "bad.ndjson"), "20990101")["dump_date"] == "20990101"


def test_one_dump_is_read_by_several_tasks(spark, tmp_path):
    page = lambda i: f"<page>\n<title>P{i}</title><ns>0</ns><id>{i}</id><revision><timestamp>t</timestamp><text xml:space=\"preserve\">&lt;page&gt; {'word ' * 50}{i}</text></revision>\n</page>\n"
    (tmp_path / "dump.xml").write_text("<mediawiki>\n<siteinfo><pages>x</pages></siteinfo>\n" + "".join(map(page, range(400))) + "<page><title>Cut</title><ns>0</ns><revi")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        found = wiki.pages(spark, str(tmp_path / "dump.xml"))
        assert found.rdd.getNumPartitions() > 5
        rows = [r for r in found.collect() if r.title != "Cut"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted((r.id, r.title, r.revision.text.split()[-1]) for r in rows) == [(i, f"P{i}", str(i)) for i in range(400)]


def test_pages_are_parsed_once_and_redirects_alone(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP.replace('<redirect title="Kyoto" /><revision><timestamp>t</timestamp><text xml:space="preserve">#R<', '<x:redirect xmlns:x="e" title="Kyoto" /><revision><timestamp>t</timestamp><text xml:space="preserve">#R<'))
    found, moved = wiki.pages(spark, str(tmp_path / "dump.xml")), wiki.pages(spark, str(tmp_path / "dump.xml"), redirects=True)
    assert sorted(moved.collect()) == sorted(found.filter("redirect IS NOT NULL").collect()) and {r.title for r in moved.collect()} >= {"Miyako"}
    docs = wiki.documents(found, redirects=moved)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 2  # the pages and, below a filter of the text, those that redirect
    assert {(r.title, *r.aliases) for r in docs.collect()} == {(r.title, *r.aliases) for r in wiki.documents(found).collect()} == {("Kyoto", "Miyako"), ("Nara",)}


def test_patterns_that_a_text_cannot_match_are_skipped(spark):
    rng = random.Random(4)
    parts = ["a", "B c", " ", "  ", "\t", "\n", "\n\n\n", "\r", "\u0085", "\u2028", "=", "==", "|", "||", "!", "!!", "{|", "|}", "|-", "{{", "}}", "''", "'''", "__TOC__", "<br>", "<", ">", "[//x.y z]", "[http://x.y]", "[", "]", "é"]
    texts = ["", " ", "\n", *parts, *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(1500))]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    guarded = whole = F.col("t")
    for holds, pattern, by in wiki._STEPS:
        guarded, whole = wiki._replaced(guarded, holds, pattern, by), F.regexp_replace(whole, pattern, by)
    trimmed = lambda x: F.btrim(x, F.lit(" \t\r\n"))
    assert rows.filter(~trimmed(guarded).eqNullSafe(trimmed(whole))).collect() == []


def test_named_coordinates_are_found_across_lines(spark):
    rows = spark.createDataFrame([("later |x=1",), ("{{a|lat\n = 1.5 | lon = 2}}",), ("{{a|\n緯度度=35|経度度=139}}",), ("{{a|本社緯度度=35|本社経度度=139}}",), ("{{a|latd=1|longd=2|latNS=S}}",)], "m string")
    found = rows.select(wiki.coordinates(F.col("m")).alias("c")).select("c.lat", "c.lon").collect()
    assert [tuple(r) for r in found] == [(None, None), (1.5, 2.0), (35.0, 139.0), (35.0, 139.0), (-1.0, 2.0)]
