"""Jobs as a stream: timers, late reports, restarts between batches."""

from datetime import datetime, timedelta

from docloom.streaming import jobs
from docloom.streaming.changes import watch

T0 = datetime(2026, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame([(j, kind, ok, T0 + timedelta(hours=h)) for j, kind, ok, h in rows], jobs.EVENTS)


def _told(df):
    return sorted((r.job_id, r.state, (r.finished_at - T0) / timedelta(hours=1)) for r in df.collect())


def test_states_survive_restarts_and_timers_fire(spark, tmp_path):
    """Each batch is its own query on the same checkpoint."""
    batches = [
        [(1, "start", None, 0), (2, "start", None, 1), (3, "report", True, 1), (4, "start", None, 2), (4, "report", False, 3), (4, "report", True, 4)],
        [(1, "report", True, 5), (1, "start", None, 6), (5, "start", None, 20)],
        [(2, "report", True, 30), (6, "start", None, 40)],
        [(7, "start", None, 100)],
    ]
    expected = [[(4, "failed", 3.0)], [(1, "done", 5.0), (2, "failed", 11.0)], [(5, "failed", 30.0)], [(6, "failed", 50.0)]]
    told = []
    for batch, new in zip(batches, expected):
        _events(spark, batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.ended_jobs(watch(spark, f"{tmp_path}/in", jobs.EVENTS), timedelta(hours=10))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        told += new
        assert _told(spark.read.schema(jobs.ENDED).parquet(f"{tmp_path}/out")) == sorted(told)


class _Handle:
    """State of one key that counts the messages it would cost."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


def test_a_job_costs_few_messages():
    handle, job = _Handle(), jobs.Jobs(timedelta(seconds=1), timedelta(seconds=9))
    job.init(handle)
    start, report = {"kind": "start", "us": 0, "ok": None}, {"kind": "report", "us": 500_000, "ok": True}
    assert [r["state"] for r in job.handleInputRows((1,), iter([report, start]), None)] == ["done"]
    assert handle.calls <= 3 and handle.timers == {9500}
    assert list(job.handleInputRows((1,), iter([start, report]), None)) == [] and handle.calls <= 4
    assert list(job.handleExpiredTimer((1,), None, None)) == [] and handle.value is None
    handle.timers.clear()
    assert list(job.handleInputRows((1,), iter([start]), None)) == [] and handle.timers == {1000}
    assert [r["state"] for r in job.handleInputRows((1,), iter([report]), None)] == ["done"] and handle.timers == {9500}


def test_replay_and_job_table(spark):
    events = _events(spark, [(1, "start", None, 0), (2, "start", None, 40), (3, "start", None, 1), (3, "report", True, 11), (4, "start", None, 1), (4, "report", True, 12)])
    ended = jobs.replay_jobs(spark, events, timedelta(hours=10))
    assert _told(ended) == [(1, "failed", 10.0), (3, "done", 11.0), (4, "failed", 11.0)]
    starts = events.filter("kind = 'start'").select("job_id", events["at"].alias("started_at"))
    assert sorted((r.job_id, r.state) for r in jobs.states(starts, ended).collect()) == [(1, "failed"), (2, "running"), (3, "done"), (4, "failed")]
