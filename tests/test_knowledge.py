"""Retrieval on small hand-made sources, and all registered queries against their SQL."""

import json

import duckdb
import pytest

from docloom import registry
from docloom.functions import text as T
from docloom.operators import build, context, gazetteer, mapfeatures, notes, spatial
from docloom.operators.deadline import DeadlineExceeded, deadline
from docloom.operators.knowledge import KnowledgeBase, parse_bbox, parse_fields, pool_size
from docloom.schema import BadRequest, NotFound, UnknownSource
from docloom.sources import html
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SCHEMA = "doc_id bigint, title string, opening string, body string, tags array<string>, links array<string>, aliases array<string>, rank_score double, feature string, area string, lat double, lon double, wikidata string"
ROWS = [
    (1, "Tokyo", "capital", "capital of the east", ["city", "east"], ["Kyoto", "Osaka", "Kyoto"], ["Edo"], 0.9, "place=city", "Kanto", 35.7, 139.7, "Q1490"),
    (2, "Kyoto", "old capital", "old capital of the west", ["city"], [], [], 0.8, "place=city", "Kansai", 35.0, 135.8, None),
    (3, "capital", "a word", "a word for a seat", ["word"], [], [], 0.1, None, None, None, None, None),
    (4, "Dog", None, "an animal", [""], [], [], 30000000.0, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def kb(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return KnowledgeBase(docs, build.aliases(docs), build.doc_tags(docs), trigrams=build.trigram_index(docs))


def titles(df):
    return [r.title for r in df.collect()]


def test_search(kb):
    assert titles(kb.search("capital"))[0] == "capital" and set(titles(kb.search("CAPITAL"))) == {"capital", "Tokyo", "Kyoto"}
    assert titles(kb.search("capital", limit=1, pool=1)) and titles(kb.search("capital west of")) == ["Kyoto"]
    assert titles(kb.search("Do")) == ["Dog"] and kb.search("Do").first().mode == "title_prefix"
    assert titles(kb.search('cap"')) and titles(kb.search('ab" x')) == [] and titles(kb.search("capital", area="Kanto")) == ["Tokyo"]
    with pytest.raises(BadRequest):
        kb.search("")


def test_documents_filters_tags_links(kb):
    assert titles(kb.doc("Edo")) == ["Tokyo"] and [r.link for r in kb.links("Edo").orderBy("pos").collect()] == ["Kyoto", "Osaka", "Kyoto"]
    with pytest.raises(NotFound) as e:
        kb.doc_or_raise("T")
    assert e.value.candidates == ["Tokyo"]
    assert titles(kb.filter(tag="city, none", bbox="35.5,139,36,140")) == ["Tokyo"] and kb.filter_total(tag="city").first().total == 2
    with pytest.raises(BadRequest):
        kb.filter()
    with pytest.raises(BadRequest):
        parse_fields("title,nope", ("title",))
    for bad in ("1,2,3", "a,b,c,d", "3,0,1,0"):
        with pytest.raises(BadRequest):
            parse_bbox(bad)
    assert [tuple(r) for r in kb.tags().collect()] == [("city", 2), ("east", 1), ("word", 1)]
    assert titles(kb.titles("", limit=-1)) == ["Dog"] and [r.has_next for r in kb.browse(size=3).collect()] == [True] * 3


def test_rank_is_clamped(spark, kb):
    high = KnowledgeBase(kb.docs.withColumn("rank_score", F.lit(3e7)), trigrams=kb.trigrams)
    one = KnowledgeBase(kb.docs.withColumn("rank_score", F.lit(1.0)), trigrams=kb.trigrams)
    assert [r.score for r in high.search("capital").collect()] == [r.score for r in one.search("capital").collect()]


def test_occurrences_from_places(spark):
    """Against counting with overlaps, for terms of three characters and more."""
    import random

    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("ab.") for _ in range(rnd.randrange(12))), "".join(rnd.choice("aab.A") for _ in range(rnd.randrange(80)))) for i in range(40)] + [(40, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, body string")
    kb = KnowledgeBase(docs, trigrams=build.trigram_index(docs))
    n = lambda text, t: sum((text or "").lower().startswith(t, i) for i in range(len(text or "")))
    for terms in (["aab"], ["aaaa", "a.a"], ["baaba"], ["ab"]):
        got = {r.doc_id: r[2:] for r in kb._counted(terms).collect()} if terms != ["ab"] else {}
        for i, title, body in rows:
            want = tuple(5.0 * n(title, t) + n(body, t) for t in terms) if terms != ["ab"] else ()
            assert got.get(i, (0.0,) * len(want)) == want
    assert T.match_terms("ab c　Defg") == ["defg"] and T.match_terms("ab") is None


def test_pool_and_missing_attributes(spark, kb):
    assert [pool_size(0, 10), pool_size(0, 100), pool_size(5000, 10)] == [300, 500, 5010]
    bare = KnowledgeBase(kb.docs.withColumn("feature", F.lit(None).cast("string")))
    assert tuple(bare.has_attributes().first()) == (False, True, True)
    with pytest.raises(BadRequest):
        bare.require(feature="a=b")
    bare.require(bbox="1,1,2,2")


def test_build_publishes_and_keeps_one_generation_more(spark, kb, tmp_path):
    root = f"file://{tmp_path}"
    paths = [build.build(kb.docs, root, "src", f"2026010{i}", samples=["Tokyo", "Edo"]) for i in range(3)]
    assert build.current(spark, f"{root}/src") == paths[-1] and build.catalog(spark, root).first().doc_count == 4
    assert len([p for p in (tmp_path / "src").iterdir() if p.is_dir()]) == 2
    with pytest.raises(ValueError):
        build.build(kb.docs, root, "src", "20260109", min_docs=5)


def test_sources_are_known_by_name(spark, kb, tmp_path):
    root = f"file://{tmp_path}"
    before = build.fingerprint(spark, root)
    build.build(kb.docs, root, "src", "g1")
    assert before != build.fingerprint(spark, root) == build.fingerprint(spark, root)
    assert titles(build.source(spark, root, "src").search("capital west")) == ["Kyoto"]
    with pytest.raises(UnknownSource, match="src"):
        build.source(spark, root, "nope")


def test_deadline(spark):
    with deadline(spark, 60):
        assert spark.range(10).count() == 10
    slow = spark.range(0, 200, 1, 50).select(F.expr("reflect('java.lang.Thread', 'sleep', 100L)"))
    with pytest.raises(DeadlineExceeded):
        with deadline(spark, 1.0):
            slow.collect()
    assert spark.range(10).count() == 10


def test_answers_keep_the_deadline(spark, kb):
    assert [r.title for r in kb.answer("search", "capital west of", seconds=60)] == ["Kyoto"] == [r.title for r in kb.answer("filter", area="Kansai", seconds=60)]
    slow = spark.range(0, 400, 1, 50).select(F.col("id").alias("doc_id"), F.expr("concat('t', reflect('java.lang.Thread', 'sleep', 100L))").alias("title"), F.lit("b").alias("body"), F.lit(1.0).alias("rank_score"))
    with pytest.raises(DeadlineExceeded):
        KnowledgeBase(slow).answer("titles", "t", seconds=1.0)
    with pytest.raises(BadRequest):
        kb.answer("matches", "capital")


def test_places_extra(spark):
    rows = spark.createDataFrame([(1, "A", 1.5, 2.5, "P", "PPL", "JP", "01", 10, "Asia/Tokyo", "-3", "2026-01-01"), (2, "B", 1.0, 2.0, "T", "MT", "XX", "", 0, "", "3.5", "")], "id bigint, name string, lat double, lon double, class string, code string, cc string, admin1 string, population bigint, timezone string, elevation string, modified string")
    names = spark.createDataFrame([(1, "Q7", "wkdt")], "id bigint, name string, lang string")
    out = gazetteer.places(rows, spark.createDataFrame([("JP", "Japan")], "cc string, country string"), spark.createDataFrame([("JP.01", "North")], "key string, region string"), names)
    got = {r.doc_id: (r.updated_at, json.loads(r.extra)) for r in out.collect()}
    assert got[1] == ("2026-01-01", {"lat": 1.5, "lon": 2.5, "feature": "P=PPL", "country_code": "JP", "area": "North", "country": "Japan", "population": 10, "timezone": "Asia/Tokyo", "elevation": -3, "wikidata": "Q7"})
    assert got[2] == (None, {"lat": 1.0, "lon": 2.0, "feature": "T=MT", "country_code": "XX", "area": "XX", "country": "XX"})
    bare = gazetteer.places(rows.drop("timezone", "elevation", "modified"), spark.createDataFrame([], "cc string, country string"), spark.createDataFrame([], "key string, region string"))
    assert bare.filter("updated_at IS NULL AND extra NOT LIKE '%elevation%'").count() == 2


def test_notes(spark):
    empty = spark.createDataFrame([], "doc_id bigint, title string, opening string, body string, tags array<string>, updated_at string")
    batch = spark.createDataFrame([(1, None, "\n first \nmore", ["a", "b"]), (2, "first", "x" * 500, ["a"])], "seq int, title string, text string, tags array<string>")
    rows = notes.add(empty, batch, "2026-07-31T00:00:00")
    assert sorted(titles(rows)) == ["first", "first (2)"]
    assert notes.recall(rows, until="2026-07-31").count() == 0 and notes.recall(rows, tags="a,b").first().doc_id == 1
    assert [r.truncated for r in notes.recall(rows, limit=-5).collect()] == [True] and notes.recall(rows, max_chars=0, tags="a").count() == 2
    assert notes.recall(notes.update(rows, 1, tags=[]), tags="b").count() == 0 and notes.delete(rows, 1).count() == 1
    assert sorted(titles(notes.update(rows, 1, title=" first (2) "))) == ["first (2)", "first (2) (1)"]
    changed = notes.recall(notes.update(rows, 1, text="  new \n", tags="x, y"), tags="x").first()
    assert (changed.text, changed.tags) == ("new", ["x", "y"]) and notes.recall(rows, fields="title,doc_id").columns == ["title", "doc_id"]
    with pytest.raises(BadRequest):
        notes.update(rows, 1)
    with pytest.raises(BadRequest):
        notes.recall(rows, fields="nope")
    for change in (lambda: notes.update(rows, 99, text="x"), lambda: notes.delete(rows, 99)):
        with pytest.raises(NotFound):
            change()


def test_context_of_a_running_budget(spark):
    rows = [(1, 1, "s", "A", " " * 30, "  \n"), (1, 2, "s", "B", "b" * 300, "x"), (1, 3, "s", "C", "short", "body of c"), (1, 4, "s", "D", "d" * 50 + " " * 60, "y")]
    picked = spark.createDataFrame(rows, "ask int, n int, source string, title string, opening string, body string")
    told = context.context(picked, max_chars=220, docs=2).first().context.split("\n\n")
    assert told == ["[1] s / B\n" + "b" * 110, "[2] s / C\nshort\nbody of c", "[3] s / D\n" + "d" * 50 + "\ny"]
    assert context.fallback_queries("what, is the-mountain?", ["a", "b"]) == [("a", "mountain"), ("b", "mountain")]


def test_map_features_become_documents(spark):
    text = "map<string,string>"
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {}, None), (2, 0.0, 2.0, {}, None), (3, 2.0, 2.0, {}, None), (4, 2.0, 0.0, {}, None), (5, 1.0, 1.0, {"name": "Inn", "shop": "books", "name:en": "The Inn; Inn", "phone": "1", "addr:city": "X"}, "2026"), (6, 9.0, 9.0, {"name": "Inn", "place": "town", "population": "10,000"}, None), (7, 1.0, 1.0, {"shop": "x"}, None)], f"id bigint, lat double, lon double, tags {text}, updated_at string")
    ways = spark.createDataFrame([(1, [1, 2, 3], {}, None), (2, [3, 4, 1, 99], {"name": "Path", "tourism": "trail"}, None)], f"id bigint, refs array<bigint>, tags {text}, updated_at string")
    border = {"name": "Land", "boundary": "administrative", "admin_level": "4", "wikipedia": "xx:Land"}
    relations = spark.createDataFrame([(1, [("w", 1, "outer"), ("w", 2, ""), ("n", 5, "admin_centre")], border, None)], f"id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags {text}, updated_at string")
    docs = {r.doc_id: r for r in mapfeatures.documents(mapfeatures.features(nodes, ways, relations)).collect()}
    assert sorted(docs) == [6, 9, 20, 24]
    inn, other, path, land = docs[20], docs[24], docs[9], docs[6]
    assert (inn.title, inn.aliases, inn.rank_score, inn.updated_at) == ("Inn", ["The Inn"], 0.3, "2026") and '"area":"Land"' in inn.extra and "phone: 1" in inn.body
    assert (other.title, other.aliases, other.rank_score) == ("Inn (node:6)", ["Inn"], 0.7) and path.tags == ["tourism=trail"]
    assert (land.links, land.rank_score, land.tags) == (["Land"], 0.76, ["boundary=administrative", "admin_level=4"]) and '"lat":1.0' in land.extra


def test_context_fragment_and_html(spark):
    row = spark.range(1).select(context.longest_fragment(F.lit("what, is the-mountain?")).alias("f"), html.body(F.lit("<title>t</title><p>a&amp;b</p><script>x</script><b>c</b>")).alias("b")).first()
    assert (row.f, row.b) == ("mountain", "a&b\nc")


def test_point_on_both_sides_of_a_square(spark):
    square = spark.createDataFrame([("s", [{"lat": a, "lon": b} for a, b in ((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0))])], "area string, ring array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 3.0), (3, 5.0, 1.0), (4, None, 1.0)], "doc_id bigint, lat double, lon double")
    assert [tuple(r) for r in spatial.points_in_areas(points, square).collect()] == [(1, "s")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else list(map(_plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda it: sorted(repr([_plain(v) for v in r]) for r in it)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())
