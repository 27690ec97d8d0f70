"""Long texts of one repeated piece through readers of markup and pages."""

import time

import pytest
from pyspark.sql import functions as F

from docloom.sources import html, wiki

MARKUP = {
    "caption": "[[File:a.jpg|thumb|" + "word " * 10_000 + "[[link|shown]] and [http://x y]]] after", "open": "[[" * 50_000, "braces": "{{a|" * 20_000, "close": "]]" * 50_000,
    "comment": "<!--" * 20_000 + "x", "notes": "<ref>" * 50_000, "levels": "{{box|a=" * 50 + "kept" + "}}" * 50, "quotes": "''" * 50_000, "equals": "=" * 50_000 + "\n", "pipes": "|" * 50_000,
}
PAGES = {"script": "<script" * 20_000, "tags": "<a " * 60_000, "comments": "<!-- " * 40_000, "titles": "<title>" * 20_000, "entities": "&amp;" * 50_000, "breaks": "<br>" * 50_000, "blanks": " \n" * 50_000, "word": "x" * 2_000_000}


@pytest.mark.parametrize("name", MARKUP)
def test_markup(spark, name):
    began = time.time()
    df = spark.createDataFrame([(MARKUP[name],)], "m string")
    row = df.select(wiki.plain(wiki.prose(F.col("m")), True).alias("t"), F.size(wiki.link_titles(F.col("m"))).alias("n"), wiki.coordinates(F.col("m")).alias("c")).first()
    assert row.c is None and time.time() - began < 60
    if name == "caption":
        assert row.t == "after"
    if name == "levels":
        assert row.t == "kept"


@pytest.mark.parametrize("name", PAGES)
def test_pages(spark, name):
    began = time.time()
    row = spark.createDataFrame([(1, "http://a.example/", PAGES[name])], "page_id bigint, url string, html string")
    found = html.documents(row).first()
    assert found.doc_id == 1 and time.time() - began < 60


def test_what_stays_open_reaches_to_the_end(spark):
    texts = ["a <b>b</b> <script>x</script> c", "a <script>x", "a <!-- x", "a <b", "<title>t</title>a", "a<script>x</script><script>y"]
    assert [r.t for r in spark.createDataFrame([(t,) for t in texts], "h string").select(html.body(F.col("h")).alias("t")).collect()] == ["a b c", "a", "a", "a", "a", "a"]
