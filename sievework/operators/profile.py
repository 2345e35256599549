"""A profile: five inspectors over one frame, and its report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..plans.report import ReportEngine, TitledReport
from .inspect import DatatypeInspector, DuplicateInspector, MemoryInspector, MissingValueInspector, Record, StatisticsInspector, plain


class DatasetProfile(Record):
    def to_dict(self) -> dict[str, Any]:
        return plain({k: v.to_dict() if hasattr(v, "to_dict") else v for k, v in self.items()})

    def health(self) -> dict[str, float]:
        """Completeness, uniqueness, and consistency less 15 for each column whose recommended type is another."""
        other = sum(1 for r in self["dtypes"].reports if r.recommended and r.recommended.lower() != r.dtype)
        return {"completeness": 100 - self["missing"].summary.missing_percent, "uniqueness": 100 - self["duplicates"].summary.percent, "consistency": max(0.0, 100.0 - 15 * other)}


class DatasetProfiler:
    def profile(self, df: DataFrame, accuracy: int | None = None) -> DatasetProfile:
        return DatasetProfile(dtypes=DatatypeInspector().inspect(df), missing=MissingValueInspector().inspect(df), duplicates=DuplicateInspector().inspect(df), memory=MemoryInspector().inspect(df), statistics=StatisticsInspector().inspect(df, accuracy))


def profile_to_report(profile: DatasetProfile, title: str = "Dataset profile") -> TitledReport:
    s = {k: v.to_dict() for k, v in profile.items()}
    overview = {"rows": profile.missing.summary.rows, "columns": profile.missing.summary.columns, "health": profile.health()}
    return ReportEngine().run({"overview": overview, "datatypes": s["dtypes"], "missing_values": s["missing"], "duplicates": s["duplicates"], "memory": s["memory"], "statistics": s["statistics"]}, title)
