"""What a run took, and how far it is: counters on the plan, the process's resources, a report of one line, a sampler to a file."""

from __future__ import annotations

import json
import os
import resource
import threading
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counters:
    """Rows that pass a place in a plan, known when an action has run: read, partial and aggregate counts are places of this kind."""

    def __init__(self):
        self.observed: dict[str, Observation] = {}

    def count(self, rows: DataFrame, name: str) -> DataFrame:
        self.observed[name] = Observation(name)
        return rows.observe(self.observed[name], F.count(F.lit(1)).alias(name))

    def values(self) -> dict[str, int]:
        return {name: o.get[name] for name, o in self.observed.items()}


class Progress:
    """How many of the chunks have been read, while a plan runs: target, and progress by the tasks done of the stage with a task for each chunk."""

    def __init__(self, spark: SparkSession, target: int):
        self.tracker, self.target, self.done = spark.sparkContext.statusTracker(), target, 0

    def __call__(self) -> dict[str, int]:
        for stage in self.tracker.getActiveStageIds():
            info = self.tracker.getStageInfo(stage)
            if info is not None and info.numTasks == self.target:
                self.done = max(self.done, info.numCompletedTasks)
        return {"target": self.target, "progress": self.done}

    def ended(self, counters: Counters) -> dict[str, int]:
        """All chunks read, and the counters of rows read and of groups."""
        self.done = self.target
        return self() | counters.values()


@dataclass
class Usage:
    user_s: float
    system_s: float
    resident_bytes: int
    virtual_bytes: int
    minor_faults: int
    major_faults: int


def usage() -> Usage:
    """Of this process: the driver's Python."""
    own = resource.getrusage(resource.RUSAGE_SELF)
    pages = [0, 0]
    if os.path.exists("/proc/self/statm"):
        with open("/proc/self/statm") as file:
            pages = [int(x) * resource.getpagesize() for x in file.read().split()[:2]]
    return Usage(own.ru_utime, own.ru_stime, pages[1], pages[0], own.ru_minflt, own.ru_majflt)


@dataclass
class Report:
    strategy: str
    fmt: str
    key_width: int
    n_groups: int
    total_revenue: float
    wall_s: float
    inner_s: float
    usage: Usage

    def line(self) -> str:
        return json.dumps(asdict(self))


class Sampler:
    """Samples of usage and of the progress given by `progress`, one JSON line each, until closed; and one more then, with what `progress` says at the end."""

    def __init__(self, path: str, every: float = 1.0, progress=dict):
        self.path, self.every, self.progress = path, every, progress
        self.ended, self.thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        began = time.monotonic()
        with open(self.path, "w") as file:
            while True:
                last = self.ended.is_set()
                print(json.dumps({"s": round(time.monotonic() - began, 3), **asdict(usage()), **self.progress()}), file=file, flush=True)
                if last:
                    break
                self.ended.wait(self.every)

    def __enter__(self) -> Sampler:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.thread.join()
