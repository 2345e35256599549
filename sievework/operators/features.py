"""Feature operators: added columns as plain projections; fitted literals come from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import col, datetime_columns, is_integral, is_numeric, kind_of, string_columns, value
from .rowid import need_columns, need_frame


class FeatureOperation:
    """fit() checks (and may learn), transform() adds columns; transform before fit is an error."""

    def __init__(self) -> None:
        self._fitted = False

    @property
    def is_fitted(self) -> bool:
        return self._fitted

    def check(self, df: DataFrame) -> None: ...

    def columns(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> FeatureOperation:
        self.check(need_frame(df))
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self._fitted:
            raise RuntimeError(f"{type(self).__name__} must be fitted first")
        self.check(need_frame(df))
        return self.columns(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def get_params(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def _numbers(df: DataFrame, *names: str) -> None:
    for c in need_columns(df, names):
        if not is_numeric(kind_of(df, c)):
            raise TypeError(f"column {c!r} must be numeric")


class ColumnInteraction(FeatureOperation):
    def __init__(self, a: str, b: str, out: str | None = None):
        super().__init__()
        if a == b:
            raise ValueError("two different columns are needed")
        self.a, self.b, self.out = a, b, out or f"{a}_x_{b}"

    def check(self, df: DataFrame) -> None:
        _numbers(df, self.a, self.b)

    def columns(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, F.try_multiply(value(df, self.a), value(df, self.b)))


class RatioFeature(FeatureOperation):
    """zero_division nan makes the ratio missing; raise looks for a zero first (one action)."""

    def __init__(self, numerator: str, denominator: str, out: str | None = None, zero_division: str = "nan"):
        super().__init__()
        if zero_division not in ("nan", "raise"):
            raise ValueError(f"zero_division must be one of ['nan', 'raise'], got {zero_division!r}")
        self.numerator, self.denominator, self.zero_division = numerator, denominator, zero_division
        self.out = out or f"{numerator}_div_{denominator}"

    def check(self, df: DataFrame) -> None:
        _numbers(df, self.numerator, self.denominator)

    def columns(self, df: DataFrame) -> DataFrame:
        below = value(df, self.denominator).cast("double")
        if self.zero_division == "raise" and not df.filter(below == 0).isEmpty():
            raise ZeroDivisionError(f"column {self.denominator!r} has a zero")
        return df.withColumn(self.out, F.try_divide(value(df, self.numerator).cast("double"), below))


class PolynomialFeature(FeatureOperation):
    """Powers from 2 to degree; whole numbers stay whole."""

    def __init__(self, column: str, degree: int = 2, include_bias: bool = False, prefix: str | None = None):
        super().__init__()
        if degree < 2:
            raise ValueError("degree must be at least 2")
        self.column, self.degree, self.include_bias, self.prefix = column, degree, include_bias, prefix or column

    def check(self, df: DataFrame) -> None:
        _numbers(df, self.column)

    def columns(self, df: DataFrame) -> DataFrame:
        x = value(df, self.column)
        x = x.cast("bigint") if is_integral(kind_of(df, self.column)) else x.cast("double")
        new, power = {}, x
        for k in range(2, self.degree + 1):
            power = F.try_multiply(power, x)
            new[f"{self.prefix}^{k}"] = power
        if self.include_bias:
            new[f"{self.prefix}^0"] = F.lit(1.0)
        return df.withColumns(new)


class LogFeature(FeatureOperation):
    """Natural logarithm of column + offset. Values that have none are an error, found by one action at fit and transform."""

    def __init__(self, column: str, out: str | None = None, offset: float = 0.0):
        super().__init__()
        self.column, self.out, self.offset = column, out or f"log_{column}", offset

    def check(self, df: DataFrame) -> None:
        _numbers(df, self.column)
        if not df.filter(value(df, self.column).cast("double") + self.offset <= 0).isEmpty():
            raise ValueError(f"column {self.column!r} has values that are not positive")

    def columns(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, F.ln(value(df, self.column).cast("double") + self.offset))


_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "day_of_week": F.weekday, "day_of_year": F.dayofyear, "week": F.weekofyear,
    "quarter": F.quarter, "hour": F.hour, "minute": F.minute, "second": F.second,
}


class DatetimeFeatures(FeatureOperation):
    """Calendar parts; the week begins on Monday (0) and weeks are ISO's."""

    def __init__(self, column: str, features: Sequence[str] = ("year", "month", "day"), prefix: str | None = None):
        super().__init__()
        unknown = [f for f in features if f not in _PARTS]
        if unknown:
            raise ValueError(f"unknown features {unknown}; there are {sorted(_PARTS)}")
        self.column, self.features, self.prefix = column, list(dict.fromkeys(features)), prefix or column

    def check(self, df: DataFrame) -> None:
        need_columns(df, [self.column])
        if self.column not in datetime_columns(df):
            raise TypeError(f"column {self.column!r} must hold dates or times")

    def columns(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{self.prefix}_{f}": _PARTS[f](col(self.column)) for f in self.features})


class FeatureEngineeringEngine:
    """Operations in order; later ones see the columns of earlier ones."""

    def __init__(self, operations: Sequence[FeatureOperation] = ()):
        self.operations = list(operations)

    def add(self, operation: FeatureOperation) -> FeatureEngineeringEngine:
        if not isinstance(operation, FeatureOperation):
            raise TypeError("a FeatureOperation is needed")
        self.operations.append(operation)
        return self

    def fit(self, df: DataFrame) -> FeatureEngineeringEngine:
        for op in self.operations:
            df = op.fit(df).transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for op in self.operations:
            df = op.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def get_params(self) -> list[dict[str, Any]]:
        return [{"operation": type(op).__name__} | op.get_params() for op in self.operations]


#: Distinct values that dummies() makes columns of, at most.
MAX_DUMMIES = 1000


def dummies(df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_DUMMIES) -> DataFrame:
    """Boolean columns {column}_{value}, sorted by value, in place of the originals; missing is false in all."""
    names = need_columns(df, columns or string_columns(df))
    new = []
    for c in names:
        found = [r[0] for r in df.select(value(df, c).alias("v")).filter("v is not null").distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"column {c!r} has more than {limit} values")
        new += [F.coalesce(value(df, c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in sorted(found)]
    return df.select(*[col(c) for c in df.columns if c not in names], *new)


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant or all-missing column becomes 0 throughout."""
    _numbers(df, *columns)
    row = df.agg(*[f(value(df, c)).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    new = {}
    for i, c in enumerate(columns):
        a, b = row[f"a{i}"], row[f"b{i}"]
        new[c] = F.lit(0.0) if a is None or a == b else (value(df, c).cast("double") - a) / (b - a)
    return df.withColumns(new)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample deviation; a column without one becomes 0 throughout."""
    _numbers(df, *columns)
    row = df.agg(*[f(value(df, c)).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.avg), ("b", F.stddev_samp))]).first()
    new = {}
    for i, c in enumerate(columns):
        a, b = row[f"a{i}"], row[f"b{i}"]
        new[c] = F.lit(0.0) if not b else (value(df, c).cast("double") - a) / b
    return df.withColumns(new)
