"""Map files: coding against plain Python, round trips over blocks and ranges, features from a file."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import mapfeatures
from docloom.plans import ingest
from docloom.sources import adapters
from docloom.sources import mapfile as M


def test_numbers():
    rng = random.Random(1)
    values = [0, 1, 127, 128, 300, 2**32, 2**63 - 1, 2**64 - 1] + [rng.getrandbits(rng.randint(1, 64)) for _ in range(200)]
    assert M.varints(b"".join(map(M.varint, values))).tolist() == values
    around = [0, -1, 1, -(2**61), 2**61] + [rng.randint(-(2**40), 2**40) for _ in range(100)]
    assert M.deltas(M._delta(around)).tolist() == around
    assert list(M.fields(M._field(3, 5) + M._field(15, b"ab") + b"\x0d\1\2\3\4")) == [(3, 5), (15, b"ab"), (1, b"\1\2\3\4")]
    with pytest.raises(ValueError):
        list(M.fields(b"\x0a\x09short"))


def test_block_by_hand():
    """Bytes as the format's description has them: plain nodes, other units, lists in pieces, deleted things."""
    strings = M._field(1, b"".join(M._field(1, s) for s in (b"", b"name", "東京".encode(), b"outer")))
    node = M._field(1, M._field(1, 2 * 7) + M._field(2, b"\1") + M._field(3, b"\2") + M._field(8, 2 * 356895) + M._field(9, 2 * 50 - 1))
    way = M._field(3, M._field(1, 9) + M._field(8, M._delta([5, 3])) + M._field(8, M._zigzag(4)))
    gone = M._field(3, M._field(1, 10) + M._field(4, M._field(6, 0)))
    relation = M._field(4, M._field(1, 11) + M._field(8, b"\3") + M._field(9, M._delta([9])) + M._field(10, b"\1") + M._field(4, M._field(2, 86400)))
    units = M._field(17, 100_000) + M._field(20, 5_000_000_000)
    rows = list(M.Block(strings + M._field(2, node) + M._field(2, way + gone + relation) + units).rows("nwr"))
    assert rows == [
        ("n", 7, 35.6895, 4.995, [("name", "東京")], None, None, None), ("w", 9, None, None, [], [5, 3, 7], None, None),
        ("r", 11, None, None, [], None, [{"type": "w", "ref": 9, "role": "outer"}], "1970-01-02T00:00:00+00:00"),
    ]
    assert M.body(M._field(1, b"plain")) == b"plain" and M.body(M._field(2, 3) + M._field(3, zlib.compress(b"abc"))) == b"abc"


def _rows(n):
    rng = random.Random(n)
    tags = lambda: {f"k{rng.randint(0, 9)}": rng.choice(["", "v", "日本", "x" * 300]) for _ in range(rng.randint(0, 3))}
    out = [("n", i * 3 - n, round(rng.uniform(-90, 90), 7), round(rng.uniform(-180, 180), 7), tags(), None, None, rng.choice([None, "2026-06-01T00:00:00+00:00"])) for i in range(n)]
    out += [("w", i, None, None, tags(), [rng.randint(1, 10**12) for _ in range(rng.randint(0, 6))], None, None) for i in range(n // 3)]
    out += [("r", 2**40 + i, None, None, tags(), None, [(rng.choice("nwr"), rng.randint(1, 10**10), rng.choice(["", "outer", "label"])) for _ in range(rng.randint(0, 4))], None) for i in range(n // 5)]
    return out


@pytest.mark.parametrize("split", [64, 1000, 1 << 25])
def test_round_trip_over_blocks_and_ranges(spark, tmp_path, monkeypatch, split):
    """Ranges smaller and larger than blocks: each block is read once."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 40)
    rows = _rows(600)
    M.write(spark.createDataFrame(rows, M.SCHEMA).repartition(3, "kind"), f"file://{tmp_path}/map")
    spark.dataSource.register(M.MapFile)
    for path in (f"file://{tmp_path}/map", f"{tmp_path}/map"):
        found = spark.read.format("mapfile").option("splitBytes", split).load(path).collect()
        assert sorted(map(repr, found)) == sorted(map(repr, spark.createDataFrame(rows, M.SCHEMA).collect()))
    assert spark.read.format("mapfile").option("kinds", "w").load(f"{tmp_path}/map").count() == 200


def test_what_is_no_map_file(spark, tmp_path):
    spark.dataSource.register(M.MapFile)
    (tmp_path / "odd").write_bytes(b"\0\0\0\x05nothing of the kind")
    needs = M._blob("OSMHeader", M._field(4, b"OsmSchema-V0.6") + M._field(4, b"LocationsOnEverything"))
    (tmp_path / "new").write_bytes(needs)
    for name, told in (("odd", "no block at 0"), ("new", "LocationsOnEverything"), ("none", "none")):
        with pytest.raises(Exception, match=told):
            spark.read.format("mapfile").load(f"{tmp_path}/{name}").collect()
    with pytest.raises(Exception, match="kinds"):
        spark.read.format("mapfile").option("kinds", "x").load(f"{tmp_path}/odd").collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("mapfile").load(f"{tmp_path}/empty").collect() == []


def test_features_of_a_file(spark, tmp_path):
    rows = [
        ("n", 1, 35.6895, 139.6917, {"place": "city", "name": "Tokyo", "population": "13960000"}, None, None, "2026-06-01T00:00:00+00:00"), ("n", 2, 0.0, 0.0, {}, None, None, None),
        ("n", 3, 2.0, 4.0, {}, None, None, None), ("w", 1, None, None, {"amenity": "cafe", "name": "Corner"}, [2, 3], None, None),
        ("r", 1, None, None, {"place": "island", "name": "Isle"}, None, [("w", 1, "outer"), ("n", 3, "label")], None),
    ]
    M.write(spark.createDataFrame(rows, M.SCHEMA).coalesce(1), f"{tmp_path}/map")
    nodes, ways, relations = M.read(spark, f"{tmp_path}/map")
    assert [tuple(r) for r in mapfeatures.relation_centres(relations, ways, nodes).collect()] == [(1, 2.0, 4.0)]
    assert nodes.filter("tags['name'] = 'Tokyo'").first().updated_at == "2026-06-01T00:00:00+00:00"
    assert np.allclose(M.Block(M.encoded([r.asDict(True) | {"tags": []} for r in spark.createDataFrame(rows[:1], M.SCHEMA).collect()])).degrees(356895000, 0), 35.6895)


def test_short_lists_are_decoded_as_long_ones():
    rng = random.Random(9)
    for _ in range(300):
        values = [rng.choice((1, -1)) * rng.getrandbits(rng.choice((3, 7, 14, 40, 61))) for _ in range(rng.randint(0, 40))]
        data = M._delta(values)
        assert M.places(data) == M.deltas(data).tolist() == values
        assert M.numbers(data) == M.varints(data).tolist()
        assert M.numbers(data + b"\x80") == M.varints(data + b"\x80").tolist()


def test_a_batch_is_read_flat():
    member = lambda i: {"type": "nwr"[i % 3], "ref": i, "role": "inner" * (i % 2)}
    rows = [
        {"kind": "nwr"[i % 3], "id": i, "lat": i / 7 if i % 3 == 0 else None, "lon": 1.0 if i % 3 == 0 else None, "tags": [("k", f"v{i % 4}")] * (i % 3) if i % 5 else None,
         "refs": list(range(i % 4)) if i % 3 == 1 else None, "members": [member(j) for j in range(i % 5)] if i % 3 == 2 else None, "updated_at": None if i % 2 else "2026-01-01T00:00:00+00:00"}
        for i in range(60)
    ]
    batch = pa.RecordBatch.from_pylist(rows, schema=M._ARROW)
    assert M.rows_of(batch) == rows and M.rows_of(batch.slice(7, 20)) == rows[7:27]


def test_a_source_decodes_its_map_files_once(spark, tmp_path):
    rows = [("n", i, 1.0 + i, 2.0, {"name": f"C{i}", "shop": "x"}, None, None, None) for i in range(9)] + [("w", 1, None, None, {"name": "W", "amenity": "cafe"}, [2, 4], None, None)]
    M.write(spark.createDataFrame(rows, M.SCHEMA), f"{tmp_path}/map")
    adapter = adapters.map_features("m", f"{tmp_path}/map", "g1")
    docs = adapter.documents(spark)
    assert "RelationV2" not in docs._jdf.queryExecution().optimizedPlan().toString()  # a scan of map files
    assert sorted((r.doc_id, r.title, r.lat) for r in docs.collect()) == sorted([(4 * i, f"C{i}", 1.0 + i) for i in range(9)] + [(5, "W", 4.0)])
    staged = docs.inputFiles()
    adapter.done(spark)
    assert staged and not any(os.path.exists(f.removeprefix("file://")) for f in staged)


def test_features_go_by_the_first_key_that_counts(spark):
    rng = random.Random(3)
    sorts = {"place": None, "boundary": ("administrative",), **mapfeatures.LIMITED} | dict.fromkeys(k for k in mapfeatures.ANY_VALUE if k not in mapfeatures.LIMITED)
    values = ["", "x", "administrative", *(v for vs in mapfeatures.LIMITED.values() for v in vs)]
    tags = [{k: rng.choice(values) for k in rng.sample([*sorts, "other"], rng.randint(0, 6))} | rng.choice([{}, {"name": ""}, {"name": "N"}, {"name": "N"}]) for _ in range(600)]
    tags += [{"name": "N", k: v} for k, vs in sorts.items() for v in (*(vs or ()), "x", "")]
    told = lambda t: next(((k, t[k]) for k, vs in sorts.items() if t.get(k) and (vs is None or t[k] in vs)), None) if t.get("name") else None
    column = F.col("tags")
    found = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tags map<string,string>").select("i", mapfeatures.feature(column).alias("f")).collect()
    assert {r.i: r.f and tuple(r.f) for r in found} == {i: told(t) for i, t in enumerate(tags)}
    plan = spark.createDataFrame([], "tags map<string,string>").select(mapfeatures.feature(column))._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan  # a filter of an array is evaluated far more slowly


def test_batches_of_a_write_have_no_bound_of_bytes(spark, tmp_path, monkeypatch):
    told, names = [], ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    rows = spark.createDataFrame(_rows(9), M.SCHEMA)
    write = type(rows).write
    monkeypatch.setattr(type(rows), "write", property(lambda df: told.append([spark.conf.get(n) for n in names]) or write.fget(df)))
    M.write(rows, f"{tmp_path}/map")
    assert told == [[str(M.BLOCK_ROWS), str(2**31 - 1)]] and [spark.conf.get(n) for n in names] == before


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_runs_are_cut_across_batches(size):
    rng = random.Random(size)
    rows = [(i, j) for i in sorted(rng.sample(range(-50, 400), 60)) for j in range(rng.choice([1, 1, 2, 5, 12]))]
    table = pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "value": pa.array([{"ref": j, "role": str(j)} for _, j in rows])})
    found = [r for b in ingest._cut(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    assert [(r["id"], v["ref"]) for r in found for v in r["values"]] == rows and len(found) == len({i for i, _ in rows})
    assert list(ingest._cut(iter([]))) == []
