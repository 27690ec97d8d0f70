import pytest

from docloom.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string"


def brute_targets(sizes: dict, weights=(5.0, 2.0, 1.0), most=3.0) -> dict:
    """Water filling by hand: caps are met one after another, the excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 400, "c": 90, "d": 3, None: 700},
    {"a": 1, "b": 1, "c": 1, "d": 1000},
    {"a": 0, "b": 5},
    {f"s{i:02}": (i * 37) % 101 for i in range(20)},
])
def test_targets_are_filled_by_weight(spark, sizes):
    table = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k])
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_taken_comes_near_targets_and_never_above_three_times_a_size(spark):
    rows = [(i, " ".join(["w"] * (i % 50 + 1)), "hot" if i % 3 else f"s{i % 7}", "x") for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 2000
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(out) == sorted(again)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, "x"), (2, "", "a", "x"), (3, "b c", "a", "x"), (3, "b c", "a", "x"), (None, "d", None, None), (4, "w " * 20000, "b", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, keep=docs.columns)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    got = out.collect()
    assert len(got) == 6
    assert {r.taken for r in got if r.doc_id in (1, 2)} == {0}
    assert len({r.taken for r in got if r.doc_id == 3}) == 1


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
