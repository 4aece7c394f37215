"""A program run for one parameter row after another, held against another engine."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rillstone.harness.verdicts import RowSets, compare_rows, pair_verdict, parameter_verdict
from rillstone.program import Program

HEADER = ["index", "parameter", "ours_ms", "theirs_ms", "ours_rows", "theirs_rows", "verdict"]


@dataclass(frozen=True)
class Line:
    """One parameter row's outcome."""

    parameter: tuple
    ours_ms: int | None
    theirs_ms: int | None
    rows: RowSets | None
    verdict: str

    def cells(self, index: int) -> list[object]:
        count = (lambda own: self.rows.shared + len(own)) if self.rows else (lambda own: 0)
        ours, theirs = (self.rows.only_ours, self.rows.only_theirs) if self.rows else ((), ())
        show = lambda x: "N/A" if x is None else x
        return [index, "|".join(map(str, self.parameter)).replace("\t", " "), show(self.ours_ms), show(self.theirs_ms), count(ours), count(theirs), self.verdict]


def crosscheck(
    spark: SparkSession,
    program: Program,
    facts: Mapping[str, DataFrame],
    relation: str,
    parameters: Iterable[tuple],
    output: str,
    other: Callable[[tuple], Iterable[Iterable[object]]],
) -> tuple[str, list[Line]]:
    """The pair's verdict and a line for each parameter row.

    Each row in turn is the one row of `relation`; the rows of `output` must be
    the set that `other` gives for it. Either side may raise: that is its verdict,
    a TimeoutError a timeout, and the next row goes on.
    """
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(program.analysis.types[relation]))

    def attempt(work: Callable[[], list]) -> tuple[str, int | None, list]:
        began = time.perf_counter()
        try:
            rows = work()
        except TimeoutError:
            return "timeout", None, []
        except Exception:  # the verdict says so
            return "error", None, []
        return "ok", round(1000 * (time.perf_counter() - began)), rows

    lines = []
    for parameter in parameters:
        given = {**facts, relation: spark.createDataFrame([parameter], schema)}
        ours, ours_ms, a = attempt(lambda given=given: [tuple(r) for r in program.run(spark, given).relation(output).toLocalIterator()])
        theirs, theirs_ms, b = attempt(lambda parameter=parameter: [tuple(r) for r in other(parameter)])
        rows = compare_rows(a, b) if ours == theirs == "ok" else None
        lines.append(Line(parameter, ours_ms, theirs_ms, rows, parameter_verdict(ours, theirs, rows)))
    return pair_verdict(line.verdict for line in lines), lines


def write_tsv(lines: list[Line], path: str) -> None:
    with Path(path).open("w", newline="") as f:
        rows = csv.writer(f, delimiter="\t")
        rows.writerow(HEADER)
        rows.writerows(line.cells(i) for i, line in enumerate(lines))
