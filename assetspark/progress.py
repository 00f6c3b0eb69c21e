"""How far a run is, and how to stop it.

A step of a run is a job group: a thread asks Spark's status tracker how many tasks of the group's jobs have ended and
hands (step, done, total) on; all jobs of a run share a job tag, by which they are cancelled from any thread.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Event:
    step: str
    done: int
    total: int


class Cancelled(RuntimeError):
    pass


class Progress:
    """Steps of one run. report is called from a thread of its own with each change, and once when a step ends."""

    def __init__(self, spark: SparkSession, report: Callable[[Event], None] = lambda event: None, every: float = 0.2):
        self.spark, self.report, self.every = spark, report, every
        self.tag = f"run-{uuid.uuid4().hex}"
        self.cancelled = threading.Event()

    def cancel(self) -> None:
        """Stops the jobs of the step under way; later steps don't begin."""
        self.cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _count(self, group: str) -> tuple[int, int]:
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                held = tracker.getStageInfo(stage)
                # A stage of a job that has ended without its tasks was skipped: its output was there.
                if held and (held.numCompletedTasks or info.status == "RUNNING"):
                    done, total = done + held.numCompletedTasks, total + held.numTasks
        return done, total

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        """All jobs begun within count as the step. A cancelled run raises Cancelled in place of Spark's error."""
        if self.cancelled.is_set():
            raise Cancelled(name)
        context, group = self.spark.sparkContext, f"{self.tag}-{name}"
        ended = threading.Event()

        def watch() -> None:
            last = None
            while not ended.wait(self.every):
                now = self._count(group)
                if now != last:
                    self.report(Event(name, *now))
                    last = now

        watcher = threading.Thread(target=watch, daemon=True)
        before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
        context.setJobGroup(group, name, interruptOnCancel=True)
        context.addJobTag(self.tag)
        watcher.start()
        try:
            yield
        except Exception as error:
            if self.cancelled.is_set():
                raise Cancelled(name) from error
            raise
        finally:
            ended.set()
            watcher.join()
            context.removeJobTag(self.tag)
            for k, v in before.items():
                context.setLocalProperty(k, v)  # type: ignore[arg-type]
        self.report(Event(name, *self._count(group)))


class Silent:
    """No steps are told."""

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        yield
