"""Spelling variants against all pairs of words in plain Python."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from docloom.llm import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and distance(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.mark.parametrize("block", [3, 8192])
def test_variants_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(block)
    base = ["".join(rng.choice("abÀéß÷z") for _ in range(rng.randint(3, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "abaaa", "abcdefgh" * 6]
    words = set(base)
    for w in base:
        for _ in range(6):
            at = rng.randrange(len(w))
            words |= {w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]}
    words = sorted(w for w in words if w)
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words[: 1 + int(len(words) * rng.random() ** 3)]).capitalize() + rng.choice([" ", "1", ", ", "Ā", "-"]) for _ in range(60))
        rows.append((i, text, "x", 1))
    rows += [(None, "Waaaa waaaa waaaa wxaaa", "x", 1), (5, None, "x", 1), (6, "", "x", 1), (7, "1 2 3 \n ,", "x", 1), (8, rows[0][1], "y", 2), (8, rows[0][1], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, word string, n int").repartition(3)
    found = told(spelling.variants(docs))
    want = plain_variants([r[:2] for r in rows])
    assert found == want and sum(bool(r[1]) for r in want) > 50


def test_one_very_long_word_and_no_rows(spark):
    long = "ab" * 100_000
    rows = [(1, f"{long} {long} {long}"), (2, f"{long}a {long}a {long}a {long}a {long}a {long}a {long}a")]
    found = told(spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [(len(r[0]), len(r[1]), r[3:]) for r in found] == [(200_000, 200_001, (3, 1, 7)), (200_001, 0, (7, 1, 0))]
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_merging_skips_only_what_is_under_the_bound():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 25))) for _ in range(rng.randint(1, 9))]
        bound = rng.randint(1, 9)
        counts = Counter(x for p in lists for x in p)
        assert list(spelling.merged(lists, bound)) == sorted(x for x, c in counts.items() if c >= bound)


def test_one_edit():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)
