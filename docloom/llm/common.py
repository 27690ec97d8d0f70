"""Helpers that several operators share: tables in the shared folder, words, packed arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, as a Java character class: space and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\f\r"


#: Spark then deletes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; the cluster's own retention takes the files
            pass

    atexit.register(drop)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives its shuffle files back at once: nothing reads them again."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for table in tables:
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            drop_path(table.sparkSession, file)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as byte planes, ascending ones as differences: planes of zeros vanish in compressed shuffles."""
    values = np.ascontiguousarray(values)
    if ascending and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(values, dtype=dtype) if ascending else values


def squeezed(values: np.ndarray, ascending: bool = False) -> bytes:
    """pack, compressed: bytes that differ little cost little."""
    return zstandard.compress(pack(values, ascending), 1)


def unsqueezed(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    return unpack(zstandard.decompress(data), dtype, ascending)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of each n consecutive word hashes, by doubling."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base, width, whole = 0x9E3779B97F4A7C15, 1, hashes
    power = np.array([base], np.uint64)  # an array wraps silently
    pieces: list[tuple[int, np.ndarray]] = [(1, hashes)]
    powers = {1: power}
    while width * 2 <= n:
        whole = whole[: len(whole) - width] * power + whole[width:]
        power, width = power * power, width * 2
        pieces.append((width, whole))
        powers[width] = power
    out, at, size = None, 0, len(hashes) - n + 1
    for width, piece in reversed(pieces):
        if at + width <= n:
            part = piece[at : at + size]
            out = part.copy() if out is None else out * powers[width] + part
            at += width
    return mix(out)
