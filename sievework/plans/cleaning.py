"""Cleaning engine, plans from a health report, and their replayable form."""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..errors import DeserializationError, SerializationError
from ..functions.kernels import missing
from ..operators.clean import CleaningOperation, DropColumns, DropDuplicates, DropMissingRows, EncodingRepairOperation, FillMissing, MissingTokenOperation, OperationRegistry, OperationResult, TextNormalizationOperation, TypeCoercionOperation, builtin_registry, fill_with, fused_fills
from ..operators.detector import HealthReport, Recommendation
from ..operators.inspect import duplicate_summary, plain
from ..operators.rowid import need_frame


@dataclass(frozen=True)
class CleaningResult:
    data: DataFrame
    operations: tuple[OperationResult, ...]
    audit_log: tuple[dict[str, Any], ...]
    dry_run: bool = False
    duration_seconds: float = 0.0
    health_before: int | None = None
    health_after: int | None = None
    still_needs_attention: tuple[str, ...] = ()

    def summary(self) -> dict[str, Any]:
        return {"operations": len(self.operations), "rows_affected": sum(o.rows_affected for o in self.operations), "dry_run": self.dry_run, "health_before": self.health_before, "health_after": self.health_after}

    def audit(self) -> tuple[dict[str, Any], ...]:
        return self.audit_log

    def to_dict(self) -> dict[str, Any]:
        return plain({k: v for k, v in self.__dict__.items() if k not in ("data", "operations")} | {"operations": [o.to_dict() for o in self.operations]})

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent)


class CleaningEngine:
    """Operations in order. Partitions are Spark's chunks: chunk_size is checked, recorded and needs no other work."""

    def __init__(self, operations: Sequence[CleaningOperation] = ()):
        self.operations = list(operations)

    def add(self, operation: CleaningOperation) -> CleaningEngine:
        self.operations.append(operation)
        return self

    def run(self, df: DataFrame) -> DataFrame:
        need_frame(df)
        for group in self._groups():
            df = fill_with(df, {c: v for some in fused_fills(df, group)[0] for c, v in some.items()}) if len(group) > 1 else group[0].apply(df)
        return df

    def _groups(self) -> list[list[CleaningOperation]]:
        """Operations in order, with runs of fills of different columns together: those take their statistics from the same frame."""
        out: list[list[CleaningOperation]] = []
        for op in self.operations:
            fills = type(op) is FillMissing and op.subset
            seen = {c for x in out[-1] for c in x.subset} if out and type(out[-1][0]) is FillMissing and out[-1][0].subset else None
            if fills and seen is not None and not seen & set(op.subset):
                out[-1].append(op)
            else:
                out.append([op])
        return out

    def run_with_result(self, df: DataFrame, dry_run: bool = False, chunk_size: int | None = None, cumulative: bool = False) -> CleaningResult:
        """A dry run measures each operation against the original frame, or, where cumulative, after those before it."""
        need_frame(df)
        if chunk_size is not None and chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        began, results, log, now = time.perf_counter(), [], [], df
        for k, (op, out, result) in enumerate(self._applied(df, dry_run, cumulative), 1):
            now = out
            results.append(result)
            log.append({"order": k, "operation": op.name, "timestamp": datetime.now(timezone.utc).isoformat(), "parameters": plain(op.describe()), "before_shape": list(result.before_shape), "after_shape": list(result.after_shape), "rows_affected": result.rows_affected, "columns_affected": result.columns_affected, "details": plain(result.details), "chunk_size": chunk_size})
        return CleaningResult(df if dry_run else now, tuple(results), tuple(log), dry_run, time.perf_counter() - began)


    def _applied(self, df: DataFrame, dry_run: bool, cumulative: bool) -> Iterator[tuple[CleaningOperation, DataFrame, OperationResult]]:
        """Each operation with its frame and its result."""
        now = df
        for group in self._groups():
            if len(group) == 1:
                out, result = group[0].apply_with_result(now, dry_run)
                yield group[0], out, result
                now = group[0].apply(now) if dry_run and cumulative else out
                continue
            fills, lost, n = fused_fills(now, group)
            shape = n, len(now.columns)
            for op, some in zip(group, fills):
                cells = {c: lost[c] if c in some else 0 for c in op.subset}
                out = now if dry_run else fill_with(now, some)
                yield op, out, OperationResult(op.name, sum(cells.values()), op.columns_affected(cells), shape, shape, dry_run, {"cells": cells})
                now = fill_with(now, some) if dry_run and cumulative else out


@dataclass
class PlanStep:
    operation: CleaningOperation
    enabled: bool = True
    reason: str = ""


@dataclass(frozen=True)
class ReplayablePlan:
    operations: tuple[dict[str, Any], ...]
    version: str = "1"

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps({"version": self.version, "operations": list(self.operations)}, indent=indent)

    @classmethod
    def from_json(cls, text: str) -> ReplayablePlan:
        try:
            data = json.loads(text)
            return cls(tuple({"name": str(o["name"]), "params": dict(o.get("params", {}))} for o in data["operations"]), str(data.get("version", "1")))
        except (ValueError, KeyError, TypeError) as e:
            raise DeserializationError(f"not a plan: {e}") from None


def _operation(r: Recommendation) -> CleaningOperation | None:
    names = list(r.columns) or None
    if r.action == "REMOVE_DUPLICATES":
        return DropDuplicates(names)
    if r.action == "DROP_COLUMN" and names:
        return DropColumns(names)
    if r.action in ("FILL_MEDIAN", "FILL_MEAN", "FILL_MODE"):
        return FillMissing(r.action[5:].lower(), None, names)
    if r.action == "CONVERT_TYPE" and r.target_dtype and names:
        return TypeCoercionOperation({c: r.target_dtype for c in names})
    if r.action == "DROP_ROWS":
        return DropMissingRows(names)
    return None


class CleaningPlan:
    def __init__(self, steps: Sequence[PlanStep] = ()):
        self.steps = list(steps)

    @classmethod
    def from_report(cls, report: HealthReport) -> CleaningPlan:
        steps, dropped = [], set()
        for r in report.recommendations:
            op = _operation(r)
            if op is None or r.columns and set(r.columns) <= dropped:
                continue
            if isinstance(op, DropColumns):
                dropped |= set(op.columns)
            steps.append(PlanStep(op, True, r.action))
        return cls(steps)

    def _step(self, number: int) -> PlanStep:
        if not 1 <= number <= len(self.steps):
            raise KeyError(number)
        return self.steps[number - 1]

    def enable(self, number: int) -> None:
        self._step(number).enabled = True

    def disable(self, number: int) -> None:
        self._step(number).enabled = False

    def show(self) -> str:
        return "\n".join(f"{i}. [{'x' if s.enabled else ' '}] {s.operation.name} {plain(s.operation.describe())}" for i, s in enumerate(self.steps, 1))

    def operations(self) -> list[CleaningOperation]:
        return [s.operation for s in self.steps if s.enabled]

    def apply(self, df: DataFrame, dry_run: bool = False, chunk_size: int | None = None) -> CleaningResult:
        return CleaningEngine(self.operations()).run_with_result(df, dry_run, chunk_size)

    def serialize(self) -> ReplayablePlan:
        out = []
        for op in self.operations():
            known = inspect.signature(type(op).__init__).parameters
            params = plain({k: v for k, v in op.describe().items() if k in known})
            if any(callable(v) for v in params.values()):
                raise SerializationError(f"operation {op.name!r} has parameters that can't be written")
            out.append({"name": op.name, "params": params})
        return ReplayablePlan(tuple(out))

    @classmethod
    def deserialize(cls, plan: ReplayablePlan, registry: OperationRegistry | None = None) -> CleaningPlan:
        registry, steps = registry or builtin_registry(), []
        for o in plan.operations:
            if o["name"] not in registry:
                raise DeserializationError(f"unknown operation {o['name']!r}")
            try:
                steps.append(PlanStep(registry.get(o["name"])(**o["params"])))
            except (TypeError, ValueError) as e:
                raise DeserializationError(f"bad parameters of {o['name']!r}: {e}") from None
        return cls(steps)


def half_health(df: DataFrame) -> tuple[int, int, int]:
    """(score, missing cells, duplicate rows): completeness and uniqueness in equal parts."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n, cells = row["n"], sum(row[1:])
    dups = duplicate_summary(df).first()["duplicate_rows"]
    a = max(0.0, 100 * (1 - cells / max(1, n * len(df.columns))))
    b = max(0.0, 100 * (1 - dups / max(1, n)))
    return max(0, min(100, int(round(0.5 * a + 0.5 * b)))), cells, dups


def auto_clean_operations() -> list[CleaningOperation]:
    return [MissingTokenOperation(), TextNormalizationOperation(unicode_form="NFKC"), EncodingRepairOperation(error_on_unrepaired=False), DropDuplicates()]


def auto_clean(df: DataFrame, dry_run: bool = False) -> CleaningResult:
    """Tokens, text form and white space, encoding, duplicates; nothing is filled or cast."""
    before = half_health(df)
    r = CleaningEngine(auto_clean_operations()).run_with_result(df, dry_run)
    after = half_health(r.data)
    left = (f"{after[1]:,} missing values remain",) if after[1] else ()
    return CleaningResult(r.data, r.operations, r.audit_log, dry_run, r.duration_seconds, before[0], after[0], left)


@dataclass(frozen=True)
class PipelineStepResult:
    name: str
    rows: int | None
    columns: int
    seconds: float


@dataclass(frozen=True)
class PipelineResult:
    data: DataFrame
    steps: tuple[PipelineStepResult, ...] = field(default=())

    def to_dict(self) -> dict[str, Any]:
        return {"steps": [s.__dict__ for s in self.steps]}


class CallableStep:
    def __init__(self, function, name: str | None = None):
        if not callable(function):
            raise TypeError("a callable is needed")
        self.function, self.name = function, name or getattr(function, "__name__", "step")

    def run(self, df: DataFrame) -> DataFrame:
        out = self.function(df)
        if not isinstance(out, DataFrame):
            raise TypeError(f"step {self.name!r} returned no DataFrame")
        return out


class TransformStep(CallableStep):
    """An object with transform(df)."""

    def __init__(self, transformer, name: str | None = None):
        if not hasattr(transformer, "transform"):
            raise TypeError("an object with transform() is needed")
        super().__init__(transformer.transform, name or type(transformer).__name__)


class PipelineEngine:
    """Named steps in order; rows are counted only where collect_metrics asks for it."""

    def __init__(self, steps: Sequence[CallableStep] = ()):
        self.steps = list(steps)

    def add(self, step: CallableStep) -> PipelineEngine:
        self.steps.append(step)
        return self

    def remove(self, name: str) -> None:
        if all(s.name != name for s in self.steps):
            raise KeyError(name)
        self.steps = [s for s in self.steps if s.name != name]

    def clear(self) -> None:
        self.steps.clear()

    def run(self, df: DataFrame, collect_metrics: bool = False) -> PipelineResult:
        need_frame(df)
        out = []
        for s in self.steps:
            began = time.perf_counter()
            try:
                df = s.run(df)
            except TypeError:
                raise
            except Exception as e:
                raise RuntimeError(f"step {s.name!r} failed: {e}") from e
            out.append(PipelineStepResult(s.name, df.count() if collect_metrics else None, len(df.columns), time.perf_counter() - began))
        return PipelineResult(df, tuple(out))
