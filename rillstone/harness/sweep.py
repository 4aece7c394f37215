"""Sweeps over a program's plans, and their summary."""

from __future__ import annotations

import csv
import statistics
import threading
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rillstone.harness.measure import median_run, timed
from rillstone.plans.syntax import Tree, parse
from rillstone.plans.variants import Variant, apply, variants
from rillstone.program import Program

#: Columns of a sweep's file: fixed values of the format.
HEADER = ["Variant", "Kind", "Signature", "Total_s", "PeakRss_MB", "Runs", "VsDefault", "SemanticPreserve"]


@dataclass(frozen=True)
class Outcome:
    variant: Variant
    seconds: float | None
    peak_mib: float | None
    runs: int
    sizes: dict[str, int] | None
    verdict: str


def _cancel(spark: SparkSession, group: str, late: threading.Event) -> None:
    late.set()
    spark.sparkContext.cancelJobGroup(group)


def sweep(spark: SparkSession, text: str | Tree, facts: Mapping[str, DataFrame], times: int = 1, limit: float | None = None, chosen: list[Variant] | None = None) -> list[Outcome]:
    """Runs each variant, the textual one first; sizes must equal its sizes.

    A variant's jobs are cancelled `limit` seconds into its first run, and it isn't
    run again. One whose sizes are missing fails: nothing passes unseen.
    """
    tree = parse(text) if isinstance(text, str) else text
    out: list[Outcome] = []
    for v in chosen or variants(tree):
        program = Program.of(apply(tree, v) if v.kind != "default" else tree)

        def work(program=program) -> dict[str, int]:
            return program.run(spark, facts).sizes()

        group, began = f"sweep-{uuid.uuid4().hex}", time.perf_counter()
        late = threading.Event()
        watch = threading.Timer(limit, _cancel, (spark, group, late)) if limit is not None else None
        try:
            spark.sparkContext.setJobGroup(group, f"plan {v.name}", interruptOnCancel=True)
            if watch is not None:
                watch.start()
            runs = timed(work, 1, spark)
            if limit is not None and (late.is_set() or time.perf_counter() - began > limit):
                raise TimeoutError
            if watch is not None:
                watch.cancel()
            runs += timed(work, times - 1, spark)
        except Exception as e:  # a variant that fails is a row of the result
            beyond = late.is_set() or isinstance(e, TimeoutError)
            out.append(Outcome(v, None, None, 0, None, "TIMEOUT" if beyond else f"FAIL: {type(e).__name__}"))
            continue
        finally:
            if watch is not None:
                watch.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        middle = median_run(runs)
        sizes = middle.value
        first = out[0].sizes if out else sizes
        verdict = "n/a" if first is None else "match" if sizes == first else "MISMATCH"
        out.append(Outcome(v, middle.seconds, middle.peak_kib / 1024, len(runs), sizes, verdict))
    return out


def write_csv(outcomes: list[Outcome], path: str) -> None:
    base = outcomes[0].seconds if outcomes else None
    with Path(path).open("w", newline="") as f:
        rows = csv.writer(f)
        rows.writerow(HEADER)
        for o in outcomes:
            against = f"{o.seconds / base:.6f}" if o.seconds is not None and base else "N/A"
            rows.writerow([o.variant.name, o.variant.kind, o.variant.signature, "N/A" if o.seconds is None else f"{o.seconds:.6f}", "N/A" if o.peak_mib is None else f"{o.peak_mib:.2f}", o.runs, against, o.verdict])


@dataclass(frozen=True)
class Summary:
    """Of the variants that were timed."""

    timed: int
    timeouts: int
    failed: int
    mismatches: int
    default: float | None
    fastest: tuple[str, float]
    slowest: tuple[str, float]
    median: float
    speedup: float | None
    percentile: float | None


def summarise(path: str) -> Summary | None:
    """The summary of a sweep's file; nothing where no variant was timed."""
    with Path(path).open() as f:
        rows = list(csv.DictReader(f))
    counted = [(float(r["Total_s"]), r["Variant"]) for r in rows if r["Total_s"] not in ("N/A", "TIMEOUT") and not r["SemanticPreserve"].startswith(("TIMEOUT", "FAIL"))]
    if not counted:
        return None
    counted.sort()
    default = next((s for s, name in counted if name == "default"), None)
    below = sum(s < default for s, _ in counted) if default is not None else None
    return Summary(
        len(counted),
        sum(r["SemanticPreserve"] == "TIMEOUT" for r in rows),
        sum(r["SemanticPreserve"].startswith("FAIL") for r in rows),
        sum(r["SemanticPreserve"] == "MISMATCH" for r in rows),
        default,
        (counted[0][1], counted[0][0]),
        (counted[-1][1], counted[-1][0]),
        statistics.median(s for s, _ in counted),
        default / counted[0][0] if default else None,
        100 * below / len(counted) if below is not None else None,
    )


def report(folder: str) -> str:
    """A paragraph for each sweep's file in a folder that timed a variant."""
    told = []
    for path in sorted(Path(folder).glob("*.csv")):
        s = summarise(str(path))
        if s is None:
            continue
        lines = [f"{path.stem}: {s.timed} plans timed, {s.timeouts} beyond the limit, {s.failed} failed, {s.mismatches} with other sizes"]
        lines.append(f"  from {s.fastest[1]:.3f} s ({s.fastest[0]}) over {s.median:.3f} s to {s.slowest[1]:.3f} s ({s.slowest[0]})")
        if s.default is not None:
            lines.append(f"  as written {s.default:.3f} s: {s.speedup:.2f} times the fastest, {s.percentile:.0f} % of the plans are faster")
        told.append("\n".join(lines))
    return "\n\n".join(told)
