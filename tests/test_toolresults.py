"""Payloads of odd shapes: summaries, evidence, references and web rows."""

import json

from pyspark.sql import functions as F

from docloom.operators import toolresults as T

CASES = [
    ({"error": "x", "total": 3}, "エラー: x", True), ({"total": 0, "results": [1]}, "total=0", False), ({"total": "7", "notes": [1, 2]}, "2 件", True), ({"total": 1.5}, "取得", False),
    ({"results": [], "tags": ["a"]}, "0 件", True), ({"results": {}, "links": []}, "0 件", False), ({"title": "t"}, "t", True), ({"title": ""}, "取得", False), ([1, 2], "取得", False), ("text", "取得", False), (None, "取得", False), ({"error": None}, "エラー: null", False),
]


def test_summary_and_evidence(spark):
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _, _) in enumerate(CASES)] + [(90, "{broken"), (91, None), (92, "")], "i int, t string").withColumn("v", T.payload(F.col("t")))
    got = {r.i: (r.s, r.e, r.never) for r in rows.select("i", T.summary(F.col("v")).alias("s"), T.evidence(F.lit(True), F.col("v")).alias("e"), T.evidence(F.lit(None).cast("boolean"), F.col("v")).alias("never")).collect()}
    assert got == {i: (s, e, False) for i, (_, s, e) in enumerate(CASES)} | {i: ("取得", False, False) for i in (90, 91, 92)}


def test_references(spark):
    payloads = [
        (1, 2, "a", {"results": [{"title": "A", "doc_id": 5}, {"title": "A", "doc_id": 6}, {"title": ""}, 7, {"title": "x/y z~*", "doc_id": "5"}]}), (1, 1, "a", {"notes": [{"title": "N", "doc_id": True}], "source": "notes"}),
        (1, 3, "", {"title": "lost"}), (1, 4, None, {"title": "lost"}), (1, 5, "a", {"title": "A", "doc_id": 9}), (2, 1, "a", {"results": []}), (3, 1, "a", {"title": "T", "doc_id": 1, "results": None}),
    ]
    df = spark.createDataFrame([(a, s, src, json.dumps(p), "more") for a, s, src, p in payloads], "ask int, seq int, source string, t string, title string")
    found = T.named(df.withColumn("payload", T.payload(F.col("t"))))
    got = [tuple(r) for r in T.numbered(found).orderBy("ask", "n").collect()]
    assert got == [(1, 1, "notes", "N", None, "/search/notes/?q=N"), (1, 2, "a", "A", 5, "/search/a/doc/5"), (1, 3, "a", "x/y z~*", None, "/search/a/?q=x/y%20z~%2A"), (3, 1, "a", "T", 1, "/search/a/doc/1")]
    assert T.numbered(found, most=1).count() == 2 and T.numbered(found.limit(0)).count() == 0


def test_a_long_thread_sends_few_rows(spark):
    hits = spark.range(20_000).select((F.col("id") >= 0).cast("int").alias("ask"), F.col("id").alias("seq"), F.lit(0).alias("pos"), F.lit("s").alias("source"), F.col("id").cast("string").alias("title"), F.col("id").alias("doc_id"), F.lit("u").alias("url"))
    out = T.numbered(hits)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in out.orderBy("n").collect()] == list(range(20))


def test_web_rows(spark):
    rows = [{"title": "a" * 300, "content": "b" * 600, "description": "d", "url": "u1"}, "no", {"title": None, "url": "u3"}, {"title": "t", "url": ""}, {"url": "u5"}]
    answers = [("searxng", {"results": rows}), ("brave", {"web": {"results": rows}}), ("brave", {"results": rows}), ("other", {"results": "x"}), ("brave", {"web": None})]
    df = spark.createDataFrame([(i, p, json.dumps(a)) for i, (p, a) in enumerate(answers)], "id int, provider string, t string").select("id", "provider", T.payload(F.col("t")).alias("payload"))
    got = [tuple(r) for r in T.web_rows(df, 4).orderBy("id", "n").collect()]
    assert got == [(0, "searxng", 1, "a" * 200, "b" * 500, "u1"), (0, "searxng", 3, "", "", "u3"), (1, "brave", 1, "a" * 200, "d", "u1"), (1, "brave", 3, "", "", "u3")]
