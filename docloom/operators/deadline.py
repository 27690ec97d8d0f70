"""A deadline for what a query runs: its jobs are tagged and interrupted when time is up."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds that a retrieval query may take.
SECONDS = 5.0


class DeadlineExceeded(TimeoutError):
    """The jobs of a query were interrupted."""


@contextmanager
def deadline(spark: SparkSession, seconds: float = SECONDS) -> Iterator[None]:
    """Actions inside that are still running after `seconds` fail with DeadlineExceeded; jobs outside go on."""
    tag, late = f"docloom-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise DeadlineExceeded(f"no result within {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
