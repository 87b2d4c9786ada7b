"""Runs of whole films one after another in a slot, and their cancellation.

A run is a driver thread whose Spark jobs all carry its tag. Cancelling interrupts the jobs with that tag, again and
again until the thread has ended, since a run that is planning has no job at that moment. Tables of a run are
written beside their place and moved there as a whole, so that a cancelled run leaves none in part.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from cuelake.session import remove_folder


class Cancelled(Exception):
    """The run was cancelled, while it waited or while it ran."""


class Runs:
    """STM-6: at most ``slots`` runs at a time, in the order in which they were started; the others wait. Jobs of a
    run go to the scheduler pool ``pool`` where the cluster has one."""

    def __init__(self, spark: SparkSession, slots: int = 1, pool: str = "runs"):
        self.spark, self.pool = spark, pool
        self._slots, self._turn = slots, threading.Condition()
        self._waiting: list[str] = []
        self._running: set[str] = set()
        self._cancelled: set[str] = set()
        self.stages: dict[str, str] = {}

    def start(self, job_id: str, work: Callable[[], object]) -> Future:
        """Put work in the queue. The future holds what it returns, or raises Cancelled or what it raised. A job_id that
        is already waiting or running is refused."""
        with self._turn:
            if job_id in self._waiting or job_id in self._running:
                raise ValueError(f"{job_id} is under way")
            self._waiting.append(job_id)
            self._cancelled.discard(job_id)
            self.stages[job_id] = "pending"
        out: Future = Future()
        InheritableThread(target=self._run, args=(job_id, work, out), daemon=True).start()
        return out

    def cancel(self, job_id: str, every: float = 0.2) -> None:
        """Stop a run; returns when it has ended. One that has ended already, or never began, is left as it is."""
        with self._turn:
            if job_id not in self._waiting and job_id not in self._running:
                return
            self._cancelled.add(job_id)
            self._turn.notify_all()
        while job_id in self._waiting or job_id in self._running:
            if job_id in self._running:
                self.spark.sparkContext.cancelJobsWithTag(self._tag(job_id))
            time.sleep(every)

    @staticmethod
    def _tag(job_id: str) -> str:
        return f"run-{job_id}"

    def _may_run(self, job_id: str) -> bool:
        return job_id in self._cancelled or self._waiting[0] == job_id and len(self._running) < self._slots

    def _run(self, job_id: str, work: Callable[[], object], out: Future) -> None:
        with self._turn:
            self._turn.wait_for(lambda: self._may_run(job_id))
            self._waiting.remove(job_id)
            if job_id in self._cancelled:
                self.stages[job_id] = "cancelled"
                self._turn.notify_all()
                out.set_exception(Cancelled(job_id))
                return
            self._running.add(job_id)
            self.stages[job_id] = "running"
        result, error = None, None
        try:
            self.spark.sparkContext.addJobTag(self._tag(job_id))
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", self.pool)
            result = work()
        except BaseException as e:  # whatever ends a run must free its slot
            error = e
        finally:
            self.spark.sparkContext.removeJobTag(self._tag(job_id))
        with self._turn:
            # A run that was over before it could be interrupted is done.
            stage = "done" if error is None else "cancelled" if job_id in self._cancelled else "failed"
            self.stages[job_id] = stage
            self._running.discard(job_id)
            self._turn.notify_all()
        if error is None:
            out.set_result(result)
        else:
            out.set_exception(Cancelled(job_id) if stage == "cancelled" else error)


def write_whole(table: DataFrame, path: str, kind: str = "json") -> None:
    """SRC-10: table in a folder that appears as a whole: it is written beside path and moved there, in place of what was
    there. If the writing fails or is cancelled, what was there stays."""
    spark, beside = table.sparkSession, f"{path}-writing-{uuid.uuid4().hex}"
    try:
        table.write.format(kind).save(beside)
        made, to, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, f"{path}-old-{uuid.uuid4().hex}"))
        fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(to):
            fs.rename(to, old)
        if not fs.rename(made, to):
            fs.rename(old, to)
            raise OSError(f"cannot move {beside} to {path}")
        fs.delete(old, True)
    finally:
        remove_folder(spark, beside)
