"""Numbers of timed runs."""

from __future__ import annotations

import contextlib
import os
import re
import resource
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
_UNITS = {"s": 1.0, "ms": 1e-3, "µs": 1e-6, "us": 1e-6}


def seconds(text: str) -> float | None:
    """The first duration in a text, such as `12.5ms`."""
    m = re.search(r"(\d+(?:\.\d+)?)(ms|µs|us|s)", text)
    return float(m[1]) * _UNITS[m[2]] if m else None


def last_seconds(log: str, marker: str) -> float | None:
    """The duration on the last line of a log that holds the marker."""
    lines = [line for line in log.splitlines() if marker in line]
    return seconds(lines[-1]) if lines else None


def execution_seconds(total: float | None, load: float | None) -> float | None:
    return None if total is None or load is None else max(0.0, total - load)


def ratio(numerator: float | None, denominator: float | None) -> str:
    """Six decimals, or nothing where there is no ratio."""
    return f"{numerator / denominator:.6f}" if numerator is not None and denominator else ""


def mebibytes(kibibytes: int | None) -> str:
    return "N/A" if kibibytes is None else f"{kibibytes / 1024:.2f}"


def median_int(values: list[int]) -> int | None:
    """The median; of an even number the two middle values' mean, cut to an integer."""
    ordered, half = sorted(values), len(values) // 2
    if not ordered:
        return None
    return ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) // 2


def mean_int(values: list[int]) -> int | None:
    return sum(values) // len(values) if values else None


@dataclass(frozen=True)
class Run:
    """One timed run."""

    seconds: float
    peak_kib: int
    value: object = None


def median_run(runs: list[Run]) -> Run:
    """The run of the median time; of an even number the upper of the middle two, which did take place."""
    return sorted(runs, key=lambda r: r.seconds)[len(runs) // 2]


def _children(pid: int) -> list[int]:
    """A process and all that it started, by the kernel's tables."""
    found, waiting = [], [pid]
    while waiting:
        found.append(p := waiting.pop())
        for task in Path(f"/proc/{p}/task").glob("*/children"):
            with contextlib.suppress(OSError):
                waiting += map(int, task.read_text().split())
    return found


def resident_kib(pids: Iterable[int]) -> int:
    """Resident memory of processes; one that has ended holds none."""
    total = 0
    for pid in pids:
        with contextlib.suppress(OSError, IndexError, ValueError):
            total += int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * (resource.getpagesize() // 1024)
    return total


class PeakMemory:
    """The most that the engine holds while a block runs: the JVM and its Python workers.

    On a local master that is all of it; on a cluster it is the driver's share,
    and executors report theirs to Spark's own metrics.
    """

    def __init__(self, spark: SparkSession | None = None, every: float = 0.02):
        active = spark or SparkSession.getActiveSession()
        self.pid = active.sparkContext._jvm.java.lang.ProcessHandle.current().pid() if active is not None else os.getpid()
        self.every, self.kib = every, 0

    def _look(self) -> None:
        self.kib = max(self.kib, resident_kib(_children(self.pid)))

    def _watch(self) -> None:
        while not self._done.wait(self.every):
            self._look()

    def __enter__(self) -> PeakMemory:
        self._done, self._thread = threading.Event(), threading.Thread(target=self._watch, daemon=True)
        self._look()
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._done.set()
        self._thread.join()
        self._look()


def timed(work: Callable[[], T], times: int = 3, spark: SparkSession | None = None) -> list[Run]:
    """Runs of `work`, one after another, each with the engine's peak memory while it ran."""
    out = []
    for _ in range(times):
        with PeakMemory(spark) as peak:
            began = time.perf_counter()
            value = work()
            taken = time.perf_counter() - began
        out.append(Run(taken, peak.kib, value))
    return out
