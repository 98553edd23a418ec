"""Progress of a running job: tasks count what they have done, a thread of the driver tells of it."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import Accumulator
from pyspark.sql import SparkSession

#: Points after which a report is due, and seconds between looks.
REPORT_POINTS, LOOK_SECONDS = 5_000, 0.05


@contextmanager
def reported(spark: SparkSession, step: str, total: int, on_progress: Callable[[str, int, int], None] | None) -> Iterator[Accumulator | None]:
    """Gives tasks a counter to add to; while the block runs, on_progress(step, done, total) is told as they end, never less than before, and at the block's end of all.

    A task that runs again counts again, so what is told is held below the total until the end. Without on_progress there is no counter. An error of
    on_progress is raised at the end of the block.
    """
    if on_progress is None:
        yield None
        return
    counter, over, failed = spark.sparkContext.accumulator(0), threading.Event(), []

    def look() -> None:
        told = 0
        while not over.wait(LOOK_SECONDS):
            done = min(counter.value, total - 1)
            if done - told >= REPORT_POINTS:
                told = done
                try:
                    on_progress(step, done, total)
                except Exception as error:  # noqa: BLE001  raised again where the load runs
                    failed.append(error)
                    return

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield counter
    finally:
        over.set()
        thread.join()
    if failed:
        raise failed[0]
    on_progress(step, total, total)
