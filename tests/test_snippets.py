"""Snippets of several terms, stored figures, refusals, and what lookups read."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import build
from docloom.operators.knowledge import KnowledgeBase
from docloom.schema import BadRequest


def plain_window(body, terms):
    """The best window by trying all of them."""
    low = body.lower()
    hits = sorted((i, k) for k, t in enumerate(terms) for i in range(len(low)) if low.startswith(t, i))
    best = None
    for p, _ in hits:
        held = [(q, k) for q, k in hits if p <= q < p + 40]
        score = (len({k for _, k in held}), len(held))
        if best is None or score > best[0]:
            best = (score, p, held[-1][0] + len(terms[held[-1][1]]) - 2)
    start = max(0, min(best[1] - int((40 - (best[2] - best[1])) / 2), len(body) - 42)) if best else 0
    return ("…" if start else "") + body[start : start + 42] + ("…" if start + 42 < len(body) else "")


def test_snippets_show_most_terms(spark):
    rng = random.Random(8)
    terms = ["abc", "cab", "bcab"]
    bodies = ["".join(rng.choice("abc xyz\né") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["abc " * 300 + "x" * 100 + "abc bcab", "no hit", "", "ABC" + "." * 39 + "CAB", "ABC" + "." * 36 + "CAB"]
    docs = spark.createDataFrame([(i, f"t{i}", b) for i, b in enumerate(bodies)], "doc_id bigint, title string, body string")
    kb = KnowledgeBase(docs, trigrams=build.trigram_index(docs))
    found = {r.doc_id: r.s for r in docs.join(kb._first_shown(terms, list(range(len(bodies)))), "doc_id", "left").select("doc_id", T.window(F.col("body"), F.col("first"), F.col("last")).alias("s")).collect()}
    assert found == {i: plain_window(b, terms) for i, b in enumerate(bodies)}


def _built(spark, path, **columns):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.format_string("title %05d", F.col("id")).alias("title"), F.concat(F.lit("body "), F.col("id").cast("string")).alias("body"), F.array().cast("array<string>").alias("tags"), F.array(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("aliases"), (F.col("id") / 4000).alias("rank_score"), *[v.alias(k) for k, v in columns.items()])
    return build.opened(spark, build.build(docs, f"file://{path}", "s", "g1"))


def test_conditions_on_what_a_source_lacks_are_refused(spark, tmp_path):
    none = F.lit(None)
    kb = _built(spark, tmp_path, feature=none.cast("string"), area=F.lit("x"), lat=none.cast("double"), lon=none.cast("double"))
    assert kb.filter(area="x", limit=3).count() == 3 and kb.figures == (4000, kb.docs.agg(F.avg(build.n_trigrams(F.col("title"), F.col("body")))).first()[0])
    for condition in ({"feature": "a"}, {"bbox": "0,0,1,1"}):
        for ask in (lambda **c: kb.filter(**c), lambda **c: kb.search("body", **c), lambda **c: kb.doc("title 00001", **c), lambda **c: kb.filter_total(**c)):
            with pytest.raises(BadRequest, match="has no"):
                ask(**condition)
    plain = KnowledgeBase(kb.docs.drop("area"))
    with pytest.raises(BadRequest, match="no area"):
        plain.filter(area="x")
    assert kb.filter(wikidata=None, area="y").count() == 0


def test_title_prefixes_read_the_table_by_title(spark, tmp_path):
    kb = _built(spark, tmp_path, lat=F.col("id") / 100, lon=F.col("id") / 100)
    found = kb.titles("title 00012")
    plan = found._jdf.queryExecution().toString()
    assert all("/titles/" in f for f in found.inputFiles()) and "PushedFilters: [IsNotNull(title), StringStartsWith(title,title 00012)]" in plan
    assert [r.title for r in kb.titles("title 0001", 3).collect()] == ["title 00019", "title 00018", "title 00017"]
    assert any("/doc_coords/" in f for f in kb.filter(bbox="1,1,2,2").inputFiles()) and kb.filter_total(bbox="1,1,2,2").first().total == 101
    import glob

    import pyarrow.parquet as pq

    ranges = []
    for f in glob.glob(f"{tmp_path}/s/*/titles/*.parquet"):
        stats = pq.ParquetFile(f).metadata.row_group(0).column(1).statistics
        ranges.append((stats.min, stats.max))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # a prefix lies in one file or in neighbours
