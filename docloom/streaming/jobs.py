"""Background jobs as a stream: state for each job, and a timer that ends those nobody reports on.

The batch counterpart is operators.jobs: `ended` and `reaped` come to the same states.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import scratch
from .changes import watch

EVENTS = "job_id bigint, kind string, ok boolean, at timestamp"
ENDED = "job_id bigint, state string, started_at timestamp, finished_at timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Jobs(StatefulProcessor):
    """One job a key: a start is kept until a report or the timer ends the job; what has ended stays so.

    An ended job's state is dropped by another timer, `keep` after it ended. Times are
    microseconds since 1970.
    """

    def __init__(self, limit: timedelta, keep: timedelta):
        self.limit, self.keep = (x // timedelta(microseconds=1) for x in (limit, keep))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Each call on state is a message to the JVM, so a job is one value, read and written once a batch.
        self.job = handle.getValueState("job", "started bigint, over boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before, over = self.job.get() or (None, False)
        if over:
            return
        started = before
        for row in sorted(rows, key=lambda r: (r["us"], r["kind"] != "start")):
            if row["kind"] == "start":
                started = row["us"] if started is None else started
            elif started is not None:
                if before is not None:
                    self.handle.deleteTimer((before + self.limit) // 1000)
                # Reports after the limit find a job that has failed by then, however rows fall into batches.
                late = row["us"] > started + self.limit
                yield self.end(key, "done" if row["ok"] and not late else "failed", started, started + self.limit if late else row["us"])
                return
        if started is not None and before is None:
            self.job.update((started, False))
            self.handle.registerTimer((started + self.limit) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        started, over = self.job.get() or (None, True)
        if over:
            self.job.clear()
        else:
            yield self.end(key, "failed", started, started + self.limit)

    def end(self, key, state: str, started: int, finished: int) -> Row:
        self.job.update((started, True))
        self.handle.registerTimer((finished + self.keep) // 1000)
        return Row(job_id=key[0], state=state, started=started, finished=finished)

    def close(self) -> None:
        pass


def ended_jobs(events: DataFrame, limit: timedelta, delay: str = "0 seconds", keep: timedelta = timedelta(days=30)) -> DataFrame:
    """A stream of events (job_id, kind start or report, ok, at) -> job_id, state, started_at, finished_at of jobs as they end.

    A job fails when the watermark, `delay` behind the latest event, passes its start by `limit`.
    Reports on jobs that never started, and all but the first report, change nothing.
    """
    events.sparkSession.conf.set(_STORE, _ROCKS)
    told = events.select("job_id", "kind", "ok", "at", F.unix_micros("at").alias("us")).withWatermark("at", delay)
    ended = told.groupBy("job_id").transformWithState(Jobs(limit, keep), "job_id bigint, state string, started bigint, finished bigint", "Append", "EventTime")
    return ended.select("job_id", "state", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("finished").alias("finished_at"))


def replay_jobs(spark: SparkSession, events: DataFrame, limit: timedelta) -> DataFrame:
    """What a stream of these events has ended when it has seen all."""
    folder = scratch(spark, "jobs")
    events.select(*[c.split()[0] for c in EVENTS.split(", ")]).write.parquet(f"{folder}/in")
    stream = ended_jobs(watch(spark, f"{folder}/in", EVENTS), limit)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(ENDED).parquet(f"{folder}/out")


def states(starts: DataFrame, ended: DataFrame) -> DataFrame:
    """The job table: starts (job_id, started_at) with how they ended, running where they haven't."""
    return starts.join(ended.drop("started_at"), "job_id", "left").select("job_id", F.coalesce("state", F.lit("running")).alias("state"), "started_at", "finished_at")
