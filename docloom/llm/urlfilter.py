"""URL rules by a sorted array of 64-bit digests.

Rules are (host, path prefix, verdict). A rule fits its host and all subdomains when the
url's path starts with the rule's path; the longest fitting rule decides, and of equally
long ones that with the longer host, then the smaller text.

The index is one file: ascending xxhash64 keys of host + path, then offsets, verdicts and
the full rule strings. It is shipped once to every executor, which maps it into memory.
A url's candidates are its host's suffixes joined with those prefixes of its path that have
the length of some rule's path. They are found by one binary search for a whole batch, and
the stored string confirms each hit, so a collision of digests never decides.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules an index may hold: about 60 bytes each, so at most some 300 MB on an executor's disk.
MAX_RULES = 5_000_000
_MAGIC, _BLOCK, _ALLOW = b"URLRULE1", 0, 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def write_index(rules: Iterable[tuple[str, str]], folder: str) -> str:
    """Writes (rule, verdict) pairs, a rule being host and path like net/, as an index file; returns its path."""
    unique = dict(rules)
    if len(unique) > MAX_RULES:
        raise ValueError(f"{len(unique)} rules; an index holds {MAX_RULES}: use judge_by_join")
    names = [r.encode() for r in unique]
    keys = np.array([xxhash.xxh64_intdigest(r) for r in names], np.uint64)
    order = np.argsort(keys, kind="stable")
    names, verdicts = [names[i] for i in order], [list(unique.values())[i] for i in order]
    ends = np.cumsum([0, *map(len, names)], dtype=np.int64)
    lengths = np.array(sorted({len(r.partition("/")[1] + r.partition("/")[2]) for r in unique}), np.int64)
    path = os.path.join(folder, f"urlrules-{uuid.uuid4().hex}.bin")
    with open(path, "wb") as out:
        depth = max((r.partition("/")[0].count(".") + 1 for r in unique), default=0)
        out.write(_MAGIC + np.array([len(names), len(lengths), depth], np.int64).tobytes())
        out.write(keys[order].tobytes() + ends.tobytes() + lengths.tobytes())
        out.write(np.array([_ALLOW if v == "allow" else _BLOCK for v in verdicts], np.uint8).tobytes())
        out.write(b"".join(names))
    return path


class RuleIndex:
    """A mapped index file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[:8]) != _MAGIC:
            raise ValueError(f"{path} is no index of url rules")
        n, m, self.depth = (int(x) for x in data[8:32].view(np.int64))
        at = 32

        def take(count: int, dtype) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(dtype).itemsize
            at += size
            return np.frombuffer(data, dtype, count, at - size) if count else np.zeros(0, dtype)

        self.keys, self.ends, self.lengths = take(n, np.uint64), take(n + 1, np.int64), take(m, np.int64).tolist()
        self.verdicts, self.names = take(n, np.uint8), data[at:]

    def rule(self, i: int) -> bytes:
        return bytes(self.names[self.ends[i] : self.ends[i + 1]])

    def probe(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        """The deciding rule and its verdict of each url, None where no rule fits."""
        candidates: list[bytes] = []
        owners: list[int] = []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            labels = host.split(".")
            starts = [path[:n] for n in self.lengths if n <= len(path)]
            for i in range(max(0, len(labels) - self.depth), len(labels)):  # no rule's host has more labels
                suffix = ".".join(labels[i:])
                candidates += [(suffix + s).encode() for s in starts]
                owners += [row] * len(starts)
        best: list = [None] * len(hosts)
        verdict: list = [None] * len(hosts)
        if not candidates or not len(self.keys):
            return best, verdict
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        found = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero((found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] == digests))
        rank: list = [None] * len(hosts)
        for hit in hits:
            i = int(found[hit])
            while i < len(self.keys) and self.keys[i] == digests[hit]:  # digests may collide
                name = self.rule(i)
                if name == candidates[hit]:
                    text, row = name.decode(), owners[hit]
                    mine = (-len(text), -len(text.partition("/")[0]), text)
                    if rank[row] is None or mine < rank[row]:
                        rank[row], best[row], verdict[row] = mine, text, "allow" if self.verdicts[i] else "block"
                i += 1
        return best, verdict


def judge(urls: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """urls with host, path, rule and verdict; columns of these names are replaced.

    A url that no rule fits gets a null rule and the default verdict. Null urls and those
    without :// have an empty host and path, which no rule fits. Repeated rows stay.
    """
    spark = urls.sparkSession
    folder = tempfile.mkdtemp(prefix="docloom-")  # of the driver, which ships the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    index = write_index(rules, folder)
    spark.sparkContext.addFile(index)
    name = os.path.basename(index)
    rest = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = urls.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    @F.pandas_udf("rule string, verdict string")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = RuleIndex(SparkFiles.get(name))
        for hosts, paths in batches:
            rule, verdict = index.probe(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    out = parsed.withColumn("_hit", probe("host", "path"))
    return out.select(*rest, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))


def judge_by_join(urls: DataFrame, rules: DataFrame, lengths: list[int], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """As judge, for rule tables beyond MAX_RULES: rules (rule, verdict) are joined by a shuffle.

    lengths are the distinct lengths of rule paths; key must be unique among urls.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    fits = urls.select(key, F.explode(candidates).alias("rule")).join(rules.dropDuplicates(["rule"]), "rule")
    order = F.struct((-F.length("rule")).alias("a"), (-F.length(F.split_part("rule", F.lit("/"), F.lit(1)))).alias("b"), F.col("rule").alias("c"))
    best = fits.groupBy(key).agg(F.min_by(F.struct("rule", "verdict"), order).alias("_hit"))
    rest = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return urls.select(*rest, host.alias("host"), path.alias("path")).join(best, key, "left").select(
        *rest, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict")
    )


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by RULES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0
      THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(rule, rhost, rpath, rverdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (
  SELECT p.*, r.rule, r.rverdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM f WHERE n = 1
"""
