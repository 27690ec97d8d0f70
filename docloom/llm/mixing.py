"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

Every document gets an exponential key -ln(u) / quality, u being drawn from a digest of its
id, or of its text without an id, so a rerun takes the same. A source whose target is q times its size and a remainder
takes q whole epochs; the remainder is filled with its documents in ascending key order,
each taken whole, until their summed sizes reach the budget.

A hot source is never sorted in one task: its documents fall into buckets of the key, as many
as keep BUCKET_ROWS rows in one, the buckets' sizes are summed first, and only the bucket in
which the budget ends is ordered. What is decided about sources and about those buckets is
written as small tables, whose size is known when the documents are joined to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5.0, 2.0, 1.0)
#: Times its own size that a source's target may reach.
MOST_EPOCHS = 3
#: Rows of a bucket of keys, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 10_000, 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++"))


def quality(text: Column) -> Column:
    """A weight from 0.25 to 1: the share of letters and spaces in the text, by counting other bytes."""
    n = F.greatest(F.char_length(text), F.lit(1))
    odd = n - F.char_length(F.translate(text, "0123456789!\"#$%&()*+/:;<=>@[\\]^_`{|}~", ""))
    return F.coalesce(F.greatest(F.lit(0.25), F.round(1.0 - odd / n, 2)), F.lit(0.25))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number inside (0, 1) from the digest of the id, of the text where it is null; 48 bits, the same in any engine."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> target: shares of the summed sizes by weight, at most `most` times the source's size.

    Sources come by code point with null last; weights repeat. Excess over a cap is shared
    again by weight among the rest. With sources in the order of cap / weight this has a
    closed form: source i is capped when its cap is below its share of what the sources
    before it leave. The table has one row a source.
    """
    byname = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(byname) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position + 1)).withColumn(
        "cap", F.col("source_size") * float(most)
    )
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = weighed.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    # Levels fall after the first source that isn't capped; that one's level holds for the rest.
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return left.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level)).select(
        "source", "source_size", "target"
    )


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    key = -F.log(uniform(F.col("doc_id"), F.col("text"))) / quality(F.col("text"))
    return docs.select(*keep, n_words(F.col("text")).cast("bigint").alias("size"), key.alias("_key"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the columns of keep, then size, source_size, target, taken.

    A null text has size 0; documents of size 0 take nothing, sources of size 0 have target
    0. Rows with equal ids get equal keys and are ordered by size; rows equal in both are
    taken alike. Columns beyond keep are unused, and those of keep named as a result are
    replaced. Texts are read twice and not shuffled while the table of sources is small
    enough to be broadcast.
    """
    results = ("size", "source_size", "target", "taken")
    keep = [c for c in keep if c not in results]
    slim = ["doc_id", "source"]
    rows = staged(_keyed(docs, slim), "mix")
    # exp(-key) is near uniform, so buckets of it are near equal
    n_buckets = max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS)
    bucket = F.floor((1 - F.exp(-F.col("_key"))) * n_buckets)
    rows = rows.withColumn("_bucket", bucket)
    judged = rows if set(keep) <= {*slim} else _keyed(docs, [*dict.fromkeys([*keep, *slim])]).withColumn("_bucket", bucket)
    buckets = rows.groupBy("source", F.col("_bucket").alias("bucket")).agg(F.sum("size").alias("filled"))
    plan = targets(buckets.groupBy("source").agg(F.sum("filled").alias("source_size")), weights, most)
    # Whole epochs first, then the rest of the target from the buckets in order.
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    inorder = Window.partitionBy("source").orderBy("bucket")
    ends = (
        buckets.withColumn("before", F.sum("filled").over(inorder) - F.col("filled"))
        .join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_ends", (F.col("before") < F.col("budget")) & (F.col("before") + F.col("filled") >= F.col("budget")))
        .groupBy("_s")
        .agg(
            F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("_epochs"), F.first("budget").alias("_budget"),
            F.min(F.when(F.col("_ends"), F.col("bucket"))).alias("_last"), F.min(F.when(F.col("_ends"), F.col("before"))).alias("_before"),
        )
    )
    ends = staged(ends, "ends")
    final = Window.partitionBy("source").orderBy("_key", "doc_id", "size")
    cut = rows.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_last"))).withColumn("_sum", F.col("_before") + F.sum("size").over(final))
    # The document on which the budget ends is taken if that comes nearer to the target.
    cut = cut.filter(F.col("_sum") - F.col("size") / 2 <= F.col("_budget")).select(F.col("_s").alias("_cut"), F.col("_key").alias("_k"), F.col("doc_id").alias("_d"), F.col("size").alias("_n")).distinct()
    cut = staged(cut.withColumn("_in", F.lit(1)), "cut")
    told = judged.join(ends, F.col("source").eqNullSafe(F.col("_s"))).join(
        cut, (F.col("_bucket") == F.col("_last")) & F.col("_s").eqNullSafe(F.col("_cut")) & (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_n")), "left"
    )
    more = F.when(F.col("_bucket") < F.col("_last"), 1).otherwise(F.coalesce("_in", F.lit(0)))
    return told.select(*keep, "size", "source_size", "target", (F.col("size") * (F.col("_epochs") + more)).cast("bigint").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    greatest(0.25, round(1.0 - CAST(length(text) - length(translate(text, '0123456789!"#$%&()*+/:;<=>@[\]^_`{|}~', '')) AS DOUBLE) / greatest(length(text), 1), 2)) AS q,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT *, -ln(CAST(u AS DOUBLE)) / CAST(coalesce(q, 0.25) AS DOUBLE) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM k GROUP BY source),
w AS (SELECT *, 3.0 * source_size AS cap,
    [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
c AS (SELECT *, cap <= w * lvl AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * max(CASE WHEN NOT capped THEN lvl END) OVER () END AS target FROM c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size) AS run
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN budget > 0 AND run - size / 2.0 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
