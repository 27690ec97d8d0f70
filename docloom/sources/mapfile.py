"""Map files in the binary block format, as a data source that reads and writes.

A file is a row of blocks: a length, a small header and a compressed body, which holds its own
string table and stands for itself. A read splits files by byte ranges, and each task finds the
first block that begins in its range, so no one walks through a file before. Columns of a
block (ids, places, references) are delta- and varint-coded and decoded with numpy.

    spark.dataSource.register(mapfile.MapFile)
    spark.read.format("mapfile").option("kinds", "n,w").load(path)

Rows: kind (n, w or r), id, lat and lon (7 digits) of nodes, tags, refs of ways, members of
relations, updated_at in seconds of UTC or null. `path` is a file, a folder of files or a URL
that pyarrow.fs reads. Of versions of one thing all are read; deleted ones are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, updated_at string"
KINDS = "nwr"
#: Bytes of a file that one task reads, rows of a written block, bounds of what the format allows.
SPLIT_BYTES, BLOCK_ROWS, MOST_HEADER, MOST_BODY = 32 << 20, 8000, 64 << 10, 32 << 20
#: How the header of a data block begins: its type as field 1.
_DATA, _FIRST = b"\x0a\x07OSMData", b"\x0a\x09OSMHeader"
_UNIT = 1_000_000_000
_MASK = (1 << 64) - 1
_KNOWN = {"OsmSchema-V0.6", "DenseNodes", "HistoricalInformation"}
_ARROW = pa.schema([
    ("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())),
    ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("updated_at", pa.string()),
])


def varints(data: bytes) -> np.ndarray:
    """Packed varints as unsigned 64-bit numbers."""
    octets = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(octets < 0x80)
    if not len(ends):
        return np.zeros(0, np.uint64)
    begins = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(ends[-1] + 1) - np.repeat(begins, ends - begins + 1)
    return np.bitwise_or.reduceat((octets[: ends[-1] + 1] & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), begins)


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag-coded numbers."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def deltas(data: bytes) -> np.ndarray:
    return np.cumsum(signed(varints(data)))


#: Bytes up to which a loop decodes packed numbers faster than numpy's calls: most ways and relations are short.
FEW_BYTES = 96


def numbers(data: bytes) -> list[int]:
    """As varints, as a list."""
    if len(data) > FEW_BYTES:
        return varints(data).tolist()
    out, x, shift = [], 0, 0
    for octet in data:
        x |= (octet & 0x7F) << shift
        if octet < 0x80:
            out.append(x & _MASK)
            x = shift = 0
        else:
            shift += 7
    return out


def places(data: bytes) -> list[int]:
    """As deltas, as a list."""
    if len(data) > FEW_BYTES:
        return deltas(data).tolist()
    out, at = [], 0
    for x in numbers(data):
        at += (x >> 1) ^ -(x & 1)
        out.append(at)
    return out


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: varints as numbers, the rest as bytes."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            octet = data[at]
            at += 1
            out |= (octet & 0x7F) << shift
            if octet < 0x80:
                return out
            shift += 7

    while at < end:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"a field of wire type {kind}")
            size = number()
        if at + size > end:
            raise ValueError("a message ends within a field")
        yield key >> 3, data[at : at + size]
        at += size


def _packed(value: int | bytes) -> bytes:
    """A repeated number that stands alone, as a packed one."""
    return value if isinstance(value, bytes) else varint(value)


def _time(seconds: float | None) -> str | None:
    return datetime.fromtimestamp(seconds, timezone.utc).isoformat() if seconds else None


class Block:
    """One primitive block: its strings, its units and its groups."""

    def __init__(self, data: bytes):
        self.strings: list[str] = []
        self.groups: list[bytes] = []
        self.granularity, self.date_granularity, self.lat, self.lon = 100, 1000, 0, 0
        for k, v in fields(data):
            if k == 1:
                self.strings = [s.decode("utf-8", "replace") for i, s in fields(v) if i == 1]
            elif k == 2:
                self.groups.append(v)
            elif k in (17, 18, 19, 20):
                v = v - (1 << 64) if v >> 63 else v
                name = {17: "granularity", 18: "date_granularity", 19: "lat", 20: "lon"}[k]
                setattr(self, name, v)

    def degrees(self, raw, offset: int):
        return np.round((offset + self.granularity * np.asarray(raw, np.int64)) / _UNIT, 7)

    def seconds(self, raw: int) -> float:
        return raw * self.date_granularity / 1000

    def rows(self, kinds: str) -> Iterator[tuple]:
        for group in self.groups:
            for k, v in fields(group):
                if k == 1 and "n" in kinds:
                    yield from self.thing("n", v)
                elif k == 2 and "n" in kinds:
                    yield from self.dense(v)
                elif k == 3 and "w" in kinds:
                    yield from self.thing("w", v)
                elif k == 4 and "r" in kinds:
                    yield from self.thing("r", v)

    def dense(self, data: bytes) -> Iterator[tuple]:
        told, info = dict(fields(data)), {}
        if isinstance(told.get(5), bytes):
            info = dict(fields(told[5]))
        ids = deltas(told.get(1, b""))
        lat, lon = self.degrees(deltas(told.get(8, b"")), self.lat).tolist(), self.degrees(deltas(told.get(9, b"")), self.lon).tolist()
        when = deltas(info[2]).tolist() if info.get(2) else [0] * len(ids)
        visible = varints(info[6]).tolist() if info.get(6) else [1] * len(ids)
        texts, at = varints(told.get(10, b"")).tolist(), 0
        for i, x in enumerate(ids.tolist()):
            tags = []
            while at < len(texts) and texts[at]:
                tags.append((self.strings[texts[at]], self.strings[texts[at + 1]]))
                at += 2
            at += 1
            if visible[i]:
                yield "n", x, lat[i], lon[i], tags, None, None, _time(self.seconds(when[i]))

    def thing(self, kind: str, data: bytes) -> Iterator[tuple]:
        told: dict[int, int | bytes] = {}
        for k, v in fields(data):
            # Lists may come in pieces.
            told[k] = _packed(told[k]) + _packed(v) if k in told and k in (2, 3, 8, 9, 10) and kind != "n" else v
        get = lambda k: _packed(told.get(k, b""))
        tags = [(self.strings[a], self.strings[b]) for a, b in zip(numbers(get(2)), numbers(get(3)))]
        info = dict(fields(told.get(4, b"")))
        if info.get(6, 1) == 0:
            return
        when, x = _time(self.seconds(info.get(2, 0))), int(told.get(1, 0))
        if kind == "n":
            number = lambda k: int(signed(np.array([told.get(k, 0)], np.uint64))[0])
            yield "n", number(1), float(self.degrees(number(8), self.lat)), float(self.degrees(number(9), self.lon)), tags, None, None, when
        elif kind == "w":
            yield "w", x, None, None, tags, places(get(8)), None, when
        else:
            members = [{"type": KINDS[t], "ref": r, "role": self.strings[s]} for s, r, t in zip(numbers(get(8)), places(get(9)), numbers(get(10)))]
            yield "r", x, None, None, tags, None, members, when


def body(blob: bytes) -> bytes:
    """The bytes of a block's body, uncompressed."""
    told = dict(fields(blob))
    if 1 in told:
        return told[1]
    if 3 in told:
        return zlib.decompress(told[3])
    raise ValueError("a block is neither plain nor compressed by zlib")


def _file(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _header(file, at: int, size: int) -> tuple[str, int, int] | None:
    """(type, where the body begins, its size) of a block at `at`, None where there is none."""
    if at + 4 > size:
        return None
    n = struct.unpack(">I", file.read_at(4, at))[0]
    if not 0 < n <= MOST_HEADER or at + 4 + n > size:
        return None
    try:
        told = dict(fields(file.read_at(n, at + 4)))
        kind, length = told[1].decode(), told[3]
    except (ValueError, IndexError, KeyError, AttributeError):
        return None
    if not isinstance(length, int) or length > MOST_BODY or at + 4 + n + length > size:
        return None
    return kind, at + 4 + n, length


def first_block(file, begin: int, end: int, size: int) -> int | None:
    """Where the first block begins that begins in [begin, end)."""
    if begin == 0:
        return 0
    at, step = begin, 1 << 20
    while at < end:
        piece = file.read_at(min(step, size - at) + 32, at) if at < size else b""
        found = -1
        while (found := piece.find(_DATA, found + 1)) >= 0:
            start = at + found - 4
            told = _header(file, start, size) if start >= begin else None
            # Compressed bytes may look alike: another block or the end must follow.
            if told and start < end and (told[1] + told[2] == size or _header(file, told[1] + told[2], size)):
                return start
        at += step
    return None


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.kinds = "".join(k.strip() for k in options.get("kinds", "n,w,r").split(","))
        if not self.kinds or set(self.kinds) - set(KINDS):
            raise ValueError(f"kinds are of {', '.join(KINDS)}")

    def partitions(self) -> list[Range]:
        fs, path = _file(self.path)
        told = fs.get_file_info(path)
        if told.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [told] if told.is_file else fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
        files = [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        host = self.path.split("://", 1)[1].split("/", 1)[0] if scheme and not path.startswith(self.path.split("://", 1)[1].split("/", 1)[0]) else ""
        return [Range(f"{scheme}{host}{f.path}", at, min(at + self.split, f.size), f.size) for f in files for at in range(0, f.size, self.split)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = _file(partition.path)
        with fs.open_input_file(path) as file:
            at = first_block(file, partition.begin, partition.end, partition.size)
            while at is not None and at < partition.end:
                told = _header(file, at, partition.size)
                if told is None:
                    raise ValueError(f"{partition.path} has no block at {at}")
                kind, begin, length = told
                data = file.read_at(length, begin)
                if kind == "OSMHeader":
                    if odd := {v.decode() for k, v in fields(body(data)) if k == 4} - _KNOWN:
                        raise ValueError(f"{partition.path} needs {', '.join(sorted(odd))}")
                elif kind == "OSMData":
                    rows = list(Block(body(data)).rows(self.kinds))
                    columns = list(zip(*rows)) or [[] for _ in _ARROW]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
                at = begin + length


def varint(x: int) -> bytes:
    out = bytearray()
    x &= (1 << 64) - 1
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def _zigzag(x: int) -> bytes:
    return varint(x << 1 ^ x >> 63)


def _packs(values: list[int]) -> bytes:
    """Numbers as packed varints."""
    return bytes(values) if max(values, default=0) < 128 else b"".join(map(varint, values))


def _field(k: int, value: int | bytes) -> bytes:
    return varint(k << 3) + varint(value) if isinstance(value, int) else varint(k << 3 | 2) + varint(len(value)) + value


def _delta(values: list[int]) -> bytes:
    out, before = bytearray(), 0
    for value in values:
        x, before = value - before, value
        x = (x << 1 ^ x >> 63) & _MASK
        while x > 0x7F:
            out.append(x & 0x7F | 0x80)
            x >>= 7
        out.append(x)
    return bytes(out)


def _blob(kind: str, data: bytes) -> bytes:
    blob = _field(2, len(data)) + _field(3, zlib.compress(data))
    header = _field(1, kind.encode()) + _field(3, len(blob))
    return struct.pack(">I", len(header)) + header + blob


def encoded(rows: list[dict]) -> bytes:
    """A data block of rows in the reader's columns."""
    strings = {"": 0}
    at = lambda s: strings.setdefault(s, len(strings))
    seconds = lambda r: int(datetime.fromisoformat(r["updated_at"]).timestamp()) if r["updated_at"] else 0
    groups = []
    nodes = [r for r in rows if r["kind"] == "n"]
    if nodes:
        texts = b"".join(b"".join(varint(at(x)) for pair in r["tags"] or [] for x in pair) + b"\0" for r in nodes)
        info = _field(1, b"\1" * len(nodes)) + _field(2, _delta([seconds(r) for r in nodes]))
        place = lambda c: _delta([round(r[c] * 10_000_000) for r in nodes])
        groups.append(_field(2, _field(1, _delta([r["id"] for r in nodes])) + _field(5, info) + _field(8, place("lat")) + _field(9, place("lon")) + _field(10, texts)))
    for kind, k in (("w", 3), ("r", 4)):
        told = b""
        for r in (r for r in rows if r["kind"] == kind):
            keys, values = (_packs([at(pair[i]) for pair in r["tags"] or []]) for i in (0, 1))
            thing = _field(1, r["id"]) + _field(2, keys) + _field(3, values) + _field(4, _field(1, 1) + _field(2, seconds(r)))
            if kind == "w":
                thing += _field(8, _delta(r["refs"] or []))
            else:
                members = r["members"] or []
                thing += _field(8, _packs([at(m["role"]) for m in members])) + _field(9, _delta([m["ref"] for m in members])) + _field(10, bytes(KINDS.index(m["type"]) for m in members))
            told += _field(k, thing)
        if told:
            groups.append(told)
    table = b"".join(_field(1, s.encode()) for s in strings)
    return _field(1, table) + b"".join(_field(2, g) for g in groups)


def _strings(column: pa.Array) -> list[str | None]:
    """The strings of a column of which many are equal."""
    if column.null_count:
        return column.to_pylist()
    told = column.dictionary_encode()
    known = told.dictionary.to_pylist()
    return [known[i] for i in told.indices.to_numpy().tolist()]


def _cut(column: pa.Array, flat: list) -> list[list | None]:
    """The lists of a column whose elements are `flat`."""
    ends = column.offsets.to_numpy().tolist()
    out = [flat[a:b] for a, b in zip(ends, ends[1:])]
    if column.null_count:
        out = [x if held else None for x, held in zip(out, column.is_valid().to_pylist())]
    return out


def rows_of(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch in the reader's columns; lists are read flat and cut, which is far faster than one by one."""
    tags, refs, members = (batch.column(c) for c in ("tags", "refs", "members"))
    told = {c: batch.column(c).to_pylist() for c in ("kind", "id", "lat", "lon", "updated_at")}
    told["tags"] = _cut(tags, list(zip(_strings(tags.keys), _strings(tags.items))))
    told["refs"] = _cut(refs, refs.values.to_pylist() if refs.values.null_count else refs.values.to_numpy().tolist())
    kinds, roles = (_strings(members.values.field(c)) for c in ("type", "role"))
    told["members"] = _cut(members, [{"type": t, "ref": ref, "role": role} for t, ref, role in zip(kinds, members.values.field("ref").to_pylist(), roles)])
    return [dict(zip(told, row)) for row in zip(*told.values())]


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceArrowWriter):
    """Each task writes one whole file; what a failed task leaves begins with a dot until it is done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _file(self.path)
        fs.create_dir(folder, recursive=True)
        name, some, any_ = f"part-{uuid.uuid4().hex}.osm.pbf", [], False
        with fs.open_output_stream(f"{folder}/.{name}") as out:
            out.write(_blob("OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes")))
            for batch in batches:
                for begin in range(0, batch.num_rows, BLOCK_ROWS):
                    some = rows_of(batch.slice(begin, BLOCK_ROWS))
                    out.write(_blob("OSMData", encoded(some)))
                    any_ = any_ or bool(some)
        return Written(name)

    def commit(self, messages: list[Written]) -> None:
        fs, folder = _file(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{folder}/.{m.name}", f"{folder}/{m.name}")

    def abort(self, messages: list[Written]) -> None:
        fs, folder = _file(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{folder}/.{m.name}")


class MapFile(DataSource):
    """`mapfile`: options path, kinds (of n, w, r) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "mapfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, ways and relations of map files, in the columns that mapfeatures takes. Each reads the blocks of its kind only once decoded."""
    spark.dataSource.register(MapFile)
    of = lambda k: spark.read.format("mapfile").option("kinds", k).option("splitBytes", split_bytes).load(path)
    return (
        of("n").select("id", "lat", "lon", "tags", "updated_at"),
        of("w").select("id", "refs", "tags", "updated_at"),
        of("r").select("id", "members", "tags", "updated_at"),
    )


def staged(spark: SparkSession, path: str, folder: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As read, from a table by kind below `folder`: what joins things many times decodes the files once."""
    spark.dataSource.register(MapFile)
    told = spark.read.format("mapfile").option("splitBytes", split_bytes).load(path)
    # Small row groups, as many tasks may read a file: what is made of a thing is dearer than reading it.
    told.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("kind").parquet(folder)
    found = spark.read.schema(told.schema).parquet(folder)
    of = lambda k, *columns: found.filter(F.col("kind") == k).select(*columns)
    return of("n", "id", "lat", "lon", "tags", "updated_at"), of("w", "id", "refs", "tags", "updated_at"), of("r", "id", "members", "tags", "updated_at")


@contextmanager
def _settings(spark: SparkSession, told: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what runs inside."""
    before = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write(rows: DataFrame, path: str) -> None:
    """Rows in the reader's columns, those of one kind best together, as a folder of map files."""
    rows.sparkSession.dataSource.register(MapFile)
    whole = {c.split()[0]: c.split(maxsplit=1)[1] for c in SCHEMA.replace("struct<type:string,ref:bigint,role:string>", "struct<type:string;ref:bigint;role:string>").replace("map<string,string>", "map<string;string>").split(", ")}
    rows = rows.select(*[F.col(c).cast(t.replace(";", ",")) if c in rows.columns else F.lit(None).cast(t.replace(";", ",")).alias(c) for c, t in whole.items()])
    # A batch is a block, whose rows the format bounds. A bound on bytes has Spark add up a batch's lists for each row, four times the work of the rest.
    with _settings(rows.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BLOCK_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1)}):
        rows.write.format("mapfile").mode("append").save(path)
