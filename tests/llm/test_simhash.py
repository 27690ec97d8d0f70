"""SimHash fingerprints and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    """Least print of the component of each distinct print, compared as signed numbers."""
    prints, out = sorted(set(prints)), {}
    for begin in prints:
        if begin in out:
            continue
        todo, out[begin] = [begin], begin
        while todo:
            x = todo.pop()
            for y in prints:
                if y not in out and ((x ^ y) & (2**64 - 1)).bit_count() <= distance:
                    out[y] = begin
                    todo.append(y)
    return out


def test_fingerprint_is_the_majority_of_shingle_bits():
    rng = random.Random(5)
    texts = ["", None, " \t\n", "One", "One two", "One two three", "one  TWO\x0bthree", "É É É É", "a" * 5000, "x y " * 40_000, "word\x00with\x1fcontrols and more"]
    texts += [" ".join(rng.choice("abcde") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_tree_finds_all_pairs_within_the_distance(distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(9)]
    prints = np.unique(np.concatenate((base, *near)))  # the tree is right in any order, quick in Gray order
    query, place = simhash.Tree(prints).within(prints, distance)
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= distance}
    assert set(zip(query.tolist(), place.tolist())) == want and len(query) == len(want)
    query, place = simhash.Tree(prints).within(prints, distance, np.arange(len(prints)))
    assert set(zip(query.tolist(), place.tolist())) == {(i, j) for i, j in want if i < j}


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_links_and_components_against_all_pairs(spark, monkeypatch, block):
    """Small blocks make buckets go on over many blocks and groups of blocks; one bucket holds a third of all rows."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "GROUP_BITS", 1)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    bits = lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    ring = np.cumsum([0] + [1 << k for k in range(0, 60, 3)], dtype=np.uint64)  # one bit to the next
    hot = rng.integers(0, 2**42, 150, dtype=np.uint64)  # equal leading bits
    prints = np.unique(np.concatenate((base, base ^ bits(60), base ^ bits(60) ^ bits(60), base ^ bits(60) ^ bits(60) ^ bits(60), ring, hot))).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in prints], "print bigint").repartition(5)
    found = {r.node: r.label for r in simhash.components(simhash.links(table)).collect()}
    want = plain_components(prints)
    sizes = {}
    for label in want.values():
        sizes[label] = sizes.get(label, 0) + 1
    assert found == {p: label for p, label in want.items() if sizes[label] > 1}


def test_components_of_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_LEAST", 5)  # the empty texts are joined apart
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows, texts = [], []
    for i in range(60):
        text = [rng.choice(words) for _ in range(400)]
        texts.append(" ".join(text))
        text[rng.randrange(400)] = "changed"
        texts.append(" ".join(text))
    texts += ["", None, "  "] * 5 + ["Same text here"] * 6 + ["one"] * 3
    rng.shuffle(texts)
    rows = [(i * 3 % 1009, t, "extra", 0.5) for i, t in enumerate(texts)] + [(None, "", "x", None), (7, "only once with this id", "x", None), (7, "only once with this id", "x", None), (None, "no id at all here", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, print string, component_id double").repartition(4)
    found = sorted(((r.doc_id, r["print"] & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    signed = lambda p: p - 2**64 if p >> 63 else p
    prints = [signed(plain_fingerprint(r[1])) for r in rows]
    label = plain_components(prints)
    least = {}
    for (doc_id, *_), p in zip(rows, prints):
        if doc_id is not None:
            least[label[p]] = min(least.get(label[p], doc_id), doc_id)
    assert found == sorted(((r[0], p & (2**64 - 1), least.get(label[p])) for r, p in zip(rows, prints)), key=str)


def test_empty_table_and_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).collect() == []
    one = spark.createDataFrame([(4, None)], "doc_id int, text string")
    assert [tuple(r) for r in simhash.near_duplicates(one).collect()] == [(4, 0, 4)]
