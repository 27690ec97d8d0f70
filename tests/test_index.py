"""The trigram index against places found one by one."""

import random

from docloom.operators import build, knowledge


def test_trigrams_and_their_places(spark):
    rng = random.Random(3)
    texts = ["", None, "ab", "abc", "ABCabc", "aaaa", "日本語の日本語", "😀😀😀😀", "İstanbul İ", "Straße ẞ", "x" * 5000, "line\nbreak \x00 nul", "é́ combining"] + ["".join(rng.choice("abAB é日😀\n") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, rng.choice(texts), t) for i, t in enumerate(texts)] + [(3, "again", "abc"), (None, "no id", "abc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, body string").coalesce(2)
    want = []
    for doc_id, title, body in rows:
        n = sum(max(len(t or "") - 2, 0) for t in (title, body))
        fields = [(t or "").lower() for t in (title, body)]
        for gram in {t[i : i + 3] for t in fields for i in range(len(t) - 2)}:
            want.append((gram, doc_id, n, *[[i for i in range(len(t) - 2) if t[i : i + 3] == gram] for t in fields]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in build.trigram_index(docs).collect())
    assert build.trigram_index(docs.limit(0)).collect() == []


def test_the_index_is_written_in_sorted_runs_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "RUN_CHARS", 3000)
    docs = spark.createDataFrame([(i, f"title {i}", f"some words {i} " * (i % 7)) for i in range(200)], "doc_id bigint, title string, body string").coalesce(1)
    tracker, path = spark.sparkContext.statusTracker(), f"file://{tmp_path}/trigrams"
    spark.sparkContext.setJobGroup("trigrams", "")
    build.write_trigrams(docs, path)
    jobs = tracker.getJobIdsForGroup("trigrams")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(tracker.getJobInfo(j).stageIds) for j in jobs] == [1]
    rows = [(r.gram, r.doc_id) for r in spark.read.parquet(path).collect()]
    falls = [i for i, (a, b) in enumerate(zip(rows, rows[1:])) if a > b]
    assert 1 < len(falls) < 10 and len(set(rows)) == len(rows)
    assert sorted(map(repr, spark.read.parquet(path).collect())) == sorted(map(repr, build.trigram_index(docs).collect()))


def test_covering_trigrams_find_what_all_would(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["abcdefghijklmnopqrstuvwxyz", "abc def ghi jkl mno pqr stu vwx yz"]
    docs = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id bigint, title string, body string")
    kb = knowledge.KnowledgeBase(docs, trigrams=build.trigram_index(docs))
    for term in ("aba", "abab", "aabba", "abbabaab", "cdefghijklmnopqrst", "abcdefghijklmnopqrsxyz"):
        assert all(sum(term[i : i + 3] == term[j : j + 3] for j in range(len(term))) for i in knowledge.covering(term))
        assert len(knowledge.covering(term)) == -(-len(term) // 3)
        assert {r.doc_id for r in kb.holding([term]).collect()} == {i for i, t in enumerate(texts) if term in t}
    both = kb._counted(["abbabaab", "bcdefghijklmnop"]).collect()
    count = lambda t, x: sum(t.startswith(x, i) for i in range(len(t)))
    told = {r.doc_id: (r._tf0, r._tf1) for r in both if r._tf0 or r._tf1}
    assert told == {i: (count(t, "abbabaab"), count(t, "bcdefghijklmnop")) for i, t in enumerate(texts) if "abbabaab" in t or "bcdefghijklmnop" in t}
