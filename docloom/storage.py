"""Folders that driver and executors share, and pointer files in them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a local session may leave that unset and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
    return f"{base.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside path and renames it over path, in one step: a reader sees the old text or the new one."""
    jvm = spark._jvm
    p, fs = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, file_system(spark, path)[0], options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The first line of a small file, None where there is none."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return None
    found = spark.read.text(path).first()
    return found[0] if found else ""
