"""Background jobs as a table (job_id, state, started_at, finished_at): running, done or failed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def started(rows: DataFrame) -> DataFrame:
    """rows (job_id, started_at) as running jobs."""
    return rows.select("job_id", F.lit("running").alias("state"), "started_at", F.lit(None).cast("timestamp").alias("finished_at"))


def ended(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """jobs after reports (job_id, ok, finished_at), the last of a job counting; ended jobs don't change again."""
    last = reports.groupBy("job_id").agg(F.max_by(F.struct("ok", "finished_at"), "finished_at").alias("_r"))
    told = (F.col("state") == "running") & F.col("_r").isNotNull()
    return jobs.join(last, "job_id", "left").select(
        "job_id", F.when(told, F.when(F.col("_r.ok"), "done").otherwise("failed")).otherwise(F.col("state")).alias("state"), "started_at", F.when(told, F.col("_r.finished_at")).otherwise(F.col("finished_at")).alias("finished_at")
    )


def reaped(jobs: DataFrame, now: datetime, days: int) -> DataFrame:
    """jobs, those that have been running for more than `days` failed at `now`."""
    stale = (F.col("state") == "running") & (F.col("started_at") < F.lit(now) - F.make_interval(days=F.lit(days)))
    return jobs.withColumns({"state": F.when(stale, "failed").otherwise(F.col("state")), "finished_at": F.when(stale, F.lit(now)).otherwise(F.col("finished_at"))})
