"""Plug-in detectors: named functions DataFrame -> findings, run together with errors kept apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.findings import limit_findings, min_severity, sort_findings, union_findings
from auditlake.session import write_cut


@dataclass
class Detector:
    """One detector. `applies` is a predicate over the input rows, pushed down before `analyze` runs."""

    name: str
    version: str
    analyze: Callable[[DataFrame], DataFrame]
    applies: Column | None = None
    capabilities: tuple[str, ...] = ()


@dataclass
class DetectorSet:
    """Detectors in order, with a common severity floor and an optional cap on the report."""

    detectors: list[Detector] = field(default_factory=list)
    floor: int = 1
    max_findings: int | None = None

    def register(self, detector: Detector) -> None:
        if any(d.name == detector.name for d in self.detectors):
            raise ValueError(f"detector {detector.name} is registered twice")
        self.detectors.append(detector)

    def run(self, df: DataFrame, seq: str = "seq") -> tuple[DataFrame | None, DataFrame]:
        """(findings, errors). Each detector runs into a table of its own in the shared folder; one that fails, while its plan is built or
        while it runs, is reported and left out."""
        parts, errors = [], []
        for d in self.detectors:
            try:
                rows = df if d.applies is None else df.filter(d.applies)
                found = d.analyze(rows).withColumns({"detector": F.lit(d.name), "detector_version": F.lit(d.version)})
                parts.append(write_cut(found))
            except Exception as e:  # noqa: BLE001 - any failure of a plug-in becomes a row
                errors.append((d.name, d.version, type(e).__name__, str(e)))
        problems = df.sparkSession.createDataFrame(errors, "detector string, detector_version string, error string, message string")
        if not parts:
            return None, problems
        found = min_severity(union_findings(*parts), self.floor)
        if self.max_findings is not None:
            return limit_findings(found, self.max_findings, [F.desc("severity"), F.asc(seq)]), problems
        return sort_findings(found, seq=seq), problems
