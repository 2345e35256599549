"""The simple API: one function a task, with messages that say what to do."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .errors import DataValidationError, DependencyError
from .functions.kernels import col, kind_of, numeric_columns
from .operators import clean as C, features as E, inspect as I
from .operators.profile import DatasetProfile, DatasetProfiler, profile_to_report
from .operators.rowid import need_columns, need_frame
from .operators.rules import RuleEngine, RuleResult
from .plans import cleaning as P
from .plans.report import FileExporter, JSONRenderer, TextRenderer, TitledReport

Names = str | Sequence[str] | None


def _names(x: Names) -> list[str] | None:
    return [x] if isinstance(x, str) else list(x) if x is not None else None


def _friendly(f: Callable) -> Callable:
    """A frame is needed; failures say which columns there are, what to install, or what to call first."""

    @functools.wraps(f)
    def run(df: DataFrame, *args: Any, **kwargs: Any) -> Any:
        need_frame(df)
        try:
            return f(df, *args, **kwargs)
        except KeyError as e:
            raise KeyError(f"Column {e.args[0]!r} not found. Your columns are: {df.columns}") from e
        except DependencyError as e:
            raise DependencyError(f"{e}; install it to use {f.__name__}()") from e
        except DataValidationError as e:
            if "needs numbers" in str(e):
                raise DataValidationError(f"{e}; try fix_types() first") from e
            raise
        except ValueError as e:
            if str(e) == I.EMPTY:
                raise ValueError("DataFrame is empty: load your data first") from e
            raise

    return run


# Inspect


@_friendly
def profile(df: DataFrame) -> DatasetProfile:
    return DatasetProfiler().profile(df)


@_friendly
def inspect(df: DataFrame) -> DatasetProfile:
    return DatasetProfiler().profile(df)


@_friendly
def missing(df: DataFrame, threshold: float | None = None) -> I.Report:
    return I.MissingValueInspector().inspect(df, threshold=threshold)


@_friendly
def duplicates(df: DataFrame, cols: Names = None, keep: str | bool = "first") -> I.Report:
    return I.DuplicateInspector().inspect(df, subset=_names(cols), keep=keep)


@_friendly
def dtypes(df: DataFrame) -> I.Report:
    return I.DatatypeInspector().inspect(df)


@_friendly
def stats(df: DataFrame) -> I.Report:
    return I.StatisticsInspector().inspect(df)


@_friendly
def memory(df: DataFrame) -> I.Report:
    return I.MemoryInspector().inspect(df)


@_friendly
def anomalies(df: DataFrame, method: str = "iqr", seed: int | None = None) -> I.Report:
    if method not in ("iqr", "zscore"):
        raise ValueError(f"method must be one of ['iqr', 'zscore'], got {method!r}")
    return I.AnomalyInspector().inspect(df, method=method, seed=seed)


@_friendly
def near_duplicates(df: DataFrame, cols: Names = None, method: str = "exact_normalized") -> I.Report:
    return I.NearDuplicateDetector().detect(df, subset=_names(cols), method=method)


@_friendly
def text_quality(df: DataFrame, cols: Names = None) -> tuple[I.Record, ...]:
    return I.TextQualityAnalyzer().analyze(df, subset=_names(cols))


# Clean


@_friendly
def clean(df: DataFrame, verbose: bool = True, dry_run: bool = False) -> P.CleaningResult:
    return P.auto_clean(df, dry_run)


@_friendly
def drop_duplicates(df: DataFrame, cols: Names = None, keep: str | bool = "first") -> DataFrame:
    return C.DropDuplicates(_names(cols), keep).apply(df)


@_friendly
def drop_missing_rows(df: DataFrame, cols: Names = None) -> DataFrame:
    return C.DropMissingRows(_names(cols)).apply(df)


@_friendly
def drop_missing_cols(df: DataFrame, cols: Names = None) -> DataFrame:
    return C.DropMissingColumns(_names(cols)).apply(df)


@_friendly
def drop_cols(df: DataFrame, cols: Names) -> DataFrame:
    return C.DropColumns(_names(cols) or []).apply(df)


@_friendly
def fill_missing(df: DataFrame, strategy: str | None = None, value: Any = None, cols: Names = None) -> DataFrame:
    if strategy is not None and strategy not in C.FillMissing.STRATEGIES:
        raise ValueError(f"strategy must be one of {sorted(C.FillMissing.STRATEGIES)}, got {strategy!r}")
    names = _names(cols)
    if names is None:
        return C.auto_fill(df, strategy, value)
    if value is not None:
        return C.FillMissing("constant", value, names).apply(df)
    if strategy is not None:
        return C.FillMissing(strategy, None, names).apply(df)
    numbers = [c for c in need_columns(df, names) if c in numeric_columns(df)]
    rest = [c for c in names if c not in numbers]
    df = C.FillMissing("median", None, numbers).apply(df) if numbers else df
    return C.FillMissing("mode", None, rest).apply(df) if rest else df


@_friendly
def fix_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    return C.fix_types(df, types)


@_friendly
def fix_tokens(df: DataFrame, cols: Names = None, extra: Sequence[str] = ()) -> DataFrame:
    return C.MissingTokenOperation(extra, _names(cols)).apply(df)


@_friendly
def drop_near_duplicates(df: DataFrame, cols: Names = None, keep: str = "first") -> DataFrame:
    return C.NearDuplicateRemoval(_names(cols), keep=keep).apply(df)


# Transform


@_friendly
def dummies(df: DataFrame, col: str | None = None, cols: Names = None) -> DataFrame:
    return E.dummies(df, [col] if col else _names(cols))


@_friendly
def normalize(df: DataFrame, col: str | None = None, cols: Names = None) -> DataFrame:
    return E.normalize(df, [col] if col else _names(cols) or numeric_columns(df))


@_friendly
def standardize(df: DataFrame, col: str | None = None, cols: Names = None) -> DataFrame:
    return E.standardize(df, [col] if col else _names(cols) or numeric_columns(df))


@_friendly
def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


@_friendly
def select(df: DataFrame, cols: Names) -> DataFrame:
    return df.select(*[col(c) for c in need_columns(df, _names(cols) or [])])


@_friendly
def cast(df: DataFrame, types: dict[str, str], errors: str = "coerce") -> DataFrame:
    return C.TypeCoercionOperation(types, errors).apply(df)


# Text


@_friendly
def clean_text(df: DataFrame, cols: Names = None) -> DataFrame:
    """Tokens, encoding, then form and white space: control characters go before they could pass for white space."""
    names = _names(cols)
    return P.CleaningEngine([C.MissingTokenOperation((), names), C.EncodingRepairOperation(names, error_on_unrepaired=False), C.TextNormalizationOperation(names, "NFKC")]).run(df)


@_friendly
def normalize_text(df: DataFrame, cols: Names = None) -> DataFrame:
    return C.TextNormalizationOperation(_names(cols), "NFKC").apply(df)


@_friendly
def lowercase(df: DataFrame, cols: Names = None) -> DataFrame:
    return C.TextNormalizationOperation(_names(cols), case="lower").apply(df)


@_friendly
def uppercase(df: DataFrame, cols: Names = None) -> DataFrame:
    return C.TextNormalizationOperation(_names(cols), case="upper").apply(df)


@_friendly
def titlecase(df: DataFrame, cols: Names = None) -> DataFrame:
    return C.TextNormalizationOperation(_names(cols), case="title").apply(df)


@_friendly
def fix_encoding(df: DataFrame, cols: Names = None, mode: str = "core") -> DataFrame:
    return C.EncodingRepairOperation(_names(cols), mode, error_on_unrepaired=False).apply(df)


# Features


@_friendly
def log(df: DataFrame, col: str, offset: float = 1.0, out: str | None = None) -> DataFrame:
    return E.LogFeature(col, out, offset).fit_transform(df)


@_friendly
def poly(df: DataFrame, col: str, degree: int = 2, include_bias: bool = False) -> DataFrame:
    return E.PolynomialFeature(col, degree, include_bias).fit_transform(df)


@_friendly
def interaction(df: DataFrame, a: str, b: str, out: str | None = None) -> DataFrame:
    return E.ColumnInteraction(a, b, out).fit_transform(df)


@_friendly
def ratio(df: DataFrame, numerator: str, denominator: str, out: str | None = None, zero_division: str = "nan") -> DataFrame:
    return E.RatioFeature(numerator, denominator, out, zero_division).fit_transform(df)


@_friendly
def datetime_features(df: DataFrame, col: str, features: Sequence[str] = ("year", "month", "day", "day_of_week"), prefix: str | None = None) -> DataFrame:
    """Text is read as dates first; what doesn't fit is missing."""
    need_columns(df, [col])
    if kind_of(df, col).simpleString() == "string":
        df = C.TypeCoercionOperation({col: "datetime64[ns]"}).apply(df)
    return E.DatetimeFeatures(col, features, prefix).fit_transform(df)


# Validate, report, replay


@_friendly
def validate(df: DataFrame, rules: Sequence[str] | None = None) -> tuple[RuleResult, ...]:
    return RuleEngine().run(df, rules)


@_friendly
def contract(df: DataFrame, spec: dict[str, Any]) -> tuple[RuleResult, ...]:
    return RuleEngine().validate_contract(df, spec)


@_friendly
def report(df: DataFrame, save: str | Path | None = None) -> TitledReport:
    out = profile_to_report(DatasetProfiler().profile(df))
    if save is not None:
        FileExporter(save).export(out, JSONRenderer() if Path(save).suffix == ".json" else TextRenderer())
    return out


def serialize(plan: P.CleaningPlan) -> str:
    return plan.serialize().to_json()


def replay(plan_json: str, df: DataFrame) -> DataFrame:
    need_frame(df)
    return P.CleaningEngine(P.CleaningPlan.deserialize(P.ReplayablePlan.from_json(plan_json)).operations()).run(df)


SIMPLE = ("inspect profile missing duplicates dtypes stats memory anomalies near_duplicates text_quality clean drop_duplicates drop_missing_rows drop_missing_cols drop_cols fill_missing fix_types fix_tokens drop_near_duplicates dummies normalize standardize rename select cast clean_text normalize_text lowercase uppercase titlecase fix_encoding log poly interaction ratio datetime_features validate contract report serialize replay").split()
__all__ = ["SIMPLE", *SIMPLE]
