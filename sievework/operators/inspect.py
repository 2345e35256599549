"""Inspectors: each has a tabular form (a lazy DataFrame) and a report on the driver made from it.

Reports hold a row a column at most; what may be as large as the data (duplicate rows, anomalous rows, masks) is a
lazy DataFrame in the report's frames.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import DependencyError
from ..functions import kernels as K
from ..functions.kernels import col, finite, kind_of, missing, numeric_columns, string_columns, value
from ..plans import ranks
from ..plans.metrics import distinct_and_mode, per_column
from ..plans.quantiles import exact_quantiles
from .rowid import need_columns, need_frame, order_of, with_row_id

EMPTY = "Cannot inspect an empty DataFrame."


class Record(dict):
    """A read-only row with its fields as attributes."""

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def _refuse(self, *_: Any, **__: Any) -> None:
        raise TypeError("reports can't be changed")

    __setitem__ = __delitem__ = __setattr__ = update = pop = clear = setdefault = popitem = _refuse


def plain(x: Any) -> Any:
    """Values that JSON has: no NaN or infinity, sets in order."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return [plain(v) for v in sorted(x, key=repr)]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if x is None or isinstance(x, (str, int, bool)):
        return x
    return str(x)


class Report(Record):
    """summary, reports, and frames (lazy DataFrames, left out of to_dict)."""

    def __init__(self, summary: dict[str, Any], reports: Sequence[dict[str, Any]] = (), frames: dict[str, DataFrame] | None = None, **more: Any):
        super().__init__(summary=Record(summary), reports=tuple(Record(r) for r in reports), frames=frames or {}, **more)

    def to_dict(self) -> dict[str, Any]:
        return plain({k: v for k, v in self.items() if k != "frames"})

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent)

    def show(self) -> None:
        from ..plans.report import TextRenderer

        print(TextRenderer().render(self.to_dict()))


def severity(percent: float, bounds: tuple[float, float, float]) -> str:
    return next((name for name, b in zip(("LOW", "MEDIUM", "HIGH"), bounds) if percent < b), "CRITICAL")


def percent(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part * 100.0, whole), 4)


def _must_have_rows(df: DataFrame) -> None:
    need_frame(df)
    if not df.columns or df.isEmpty():
        raise ValueError(EMPTY)


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """A table of a row a column, on the driver."""
    return [r.asDict(recursive=True) for r in df.collect()]


# Missing values


def missing_table(df: DataFrame) -> DataFrame:
    """(column, missing, total, percent, complete)."""
    t = per_column(df, df.columns, {"missing": lambda c: F.count_if(missing(df, c))}, {"total": F.count("*")})
    return t.select("column", "missing", "total", percent(F.col("missing"), F.col("total")).alias("percent"), (F.col("missing") == 0).alias("complete"))


def rows_with_missing(df: DataFrame) -> Column:
    any_ = F.lit(False)
    for c in df.columns:
        any_ = any_ | missing(df, c)
    return F.count_if(any_)


class MissingValueInspector:
    BOUNDS = (5.0, 15.0, 35.0)

    def inspect(self, df: DataFrame, *, threshold: float | None = None) -> Report:
        _must_have_rows(df)
        t = per_column(df, df.columns, {"missing": lambda c: F.count_if(missing(df, c))}, {"total": F.count("*"), "any": rows_with_missing(df)})
        rows = _rows(t)
        total, any_ = rows[0]["total"], rows[0]["any"]
        out = []
        for r in rows:
            p = round(r["missing"] / total * 100, 4)
            out.append({"column": r["column"], "missing": r["missing"], "percent": p, "complete": r["missing"] == 0, "severity": severity(p, self.BOUNDS)})
        cells = sum(r["missing"] for r in out)
        p = round(cells / (total * len(out)) * 100, 4)
        summary = {"rows": total, "columns": len(out), "missing_cells": cells, "missing_percent": p, "columns_with_missing": sum(not r["complete"] for r in out), "complete_columns": sum(r["complete"] for r in out), "rows_with_missing": any_, "severity": severity(p, self.BOUNDS)}
        shown = [r for r in out if threshold is None or r["percent"] >= threshold]
        return Report(summary, sorted(shown, key=lambda r: -r["percent"]), {"mask": df.select(*[missing(df, c).alias(c) for c in df.columns])})


# Duplicates


def _keys(df: DataFrame, subset: Sequence[str] | None) -> list[Column]:
    return [value(df, c).alias(f"k{i}") for i, c in enumerate(subset or df.columns)]


def duplicate_summary(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first") -> DataFrame:
    """(total_rows, duplicate_rows, unique_rows, percent) of the mask that keep means."""
    n = F.col("count")
    dups = F.sum(F.when(n > 1, n).otherwise(0)) if keep is False else F.sum(n - 1)
    g = df.groupBy(*_keys(df, subset)).count().agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"), F.coalesce(dups, F.lit(0)).cast("bigint").alias("duplicate_rows"))
    return g.select("total_rows", "duplicate_rows", (F.col("total_rows") - F.col("duplicate_rows")).alias("unique_rows"), percent(F.col("duplicate_rows"), F.col("total_rows")).alias("percent"))


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first", order_by: Sequence[str] | None = None) -> DataFrame:
    """The rows that the mask marks."""
    keys = [value(df, c) for c in subset or df.columns]
    # Keys that repeat, from an aggregate combined before the shuffle; their rows meet them in a join, which may split a hot key.
    place = F.struct(*order_of(df, order_by), *([F.monotonically_increasing_id()] if order_by else []))
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], place.alias("place"))
    names = [f"k{i}" for i in range(len(keys))]
    kept = (F.max if keep == "last" else F.min)("place")
    twice = rows.groupBy(*names).agg(F.count("*").alias("n"), kept.alias("kept")).filter("n > 1").select(*[F.col(k).alias(f"_{k}") for k in names], "kept")
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = rows.join(twice, same)
    return (both if keep is False else both.filter(~F.col("place").eqNullSafe(F.col("kept")))).select("row.*")


class DuplicateInspector:
    BOUNDS = (2.0, 5.0, 15.0)

    def inspect(self, df: DataFrame, *, subset: Sequence[str] | None = None, keep: str | bool = "first", order_by: Sequence[str] | None = None) -> Report:
        _must_have_rows(df)
        need_columns(df, subset or [])
        if keep not in ("first", "last", False):
            raise ValueError("keep must be 'first', 'last' or False")
        s = _rows(duplicate_summary(df, subset, keep))[0]
        s |= {"severity": severity(s["percent"], self.BOUNDS), "subset": tuple(subset) if subset else None}
        return Report(s, [], {"duplicates": duplicate_rows(df, subset, keep, order_by)})

    def has_duplicates(self, df: DataFrame, subset: Sequence[str] | None = None) -> bool:
        return not df.groupBy(*_keys(df, subset)).count().filter("count > 1").isEmpty()

    def duplicate_columns(self, df: DataFrame) -> tuple[str, ...]:
        return tuple(c for c, n in Counter(df.columns).items() if n > 1)

    def duplicate_column_count(self, df: DataFrame) -> int:
        return len(self.duplicate_columns(df))


# Types


def dtypes_table(df: DataFrame) -> DataFrame:
    """(column, dtype, semantic, missing, total, unique, recommended, memory_bytes)."""
    base = per_column(df, df.columns, {"missing": lambda c: F.count_if(missing(df, c)), "memory_bytes": lambda c: F.coalesce(F.sum(cell_bytes(df, c)), F.lit(0)).cast("bigint")}, {"total": F.count("*")})
    unique = distinct_and_mode(df, df.columns).select(F.col("column").alias("_c"), "distinct")
    t = base.join(unique, F.col("column") == F.col("_c"), "left").withColumn("unique", F.coalesce("distinct", F.lit(0)))
    pick = lambda f: F.element_at(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(f(kind_of(df, c))))]), F.col("column"))
    nulls = (F.col("missing") > 0) & (pick(lambda k: K.dtype_name(k)) == "string")
    dtype = F.when(nulls, "object").otherwise(pick(K.dtype_name))
    semantic = F.when(nulls, "object").otherwise(pick(K.semantic_type))
    text = F.when(F.col("unique") / F.greatest("total", F.lit(1)) < 0.5, "category").otherwise("string")
    advice = F.when(pick(K.semantic_type) == "string", text).when(pick(K.semantic_type) == "integer", "Int64").when(pick(K.semantic_type) == "float", "Float64")
    return t.select("column", dtype.alias("dtype"), semantic.alias("semantic"), "missing", "total", "unique", advice.alias("recommended"), "memory_bytes")


class DatatypeInspector:
    def inspect(self, df: DataFrame) -> Report:
        _must_have_rows(df)
        order = {c: i for i, c in enumerate(df.columns)}
        rows = sorted(_rows(dtypes_table(df)), key=lambda r: order[r["column"]])
        rows = [r | {"nullable": r["missing"] > 0} for r in rows]
        groups: dict[str, list[str]] = {}
        for r in rows:
            groups.setdefault(r["semantic"], []).append(r["column"])
        return Report({"columns": len(rows), "groups": {k: tuple(v) for k, v in groups.items()}, "mixed_object_columns": ()}, rows)


# Statistics


def statistics_table(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None, quartiles: dict[str, list[float] | None] | None = None, only: Sequence[str] | None = None, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per numeric column: count, missing, infinite, extremes, moments, quartiles, sum, signs; outlier_count where bounds are given.

    Exact quartiles keep a count per distinct value of a column in one task. Either accuracy bounds that
    (percentile_approx), or quartiles found before, by exact_quantiles(), stand in. only names the fields to compute.
    """
    columns = list(columns or numeric_columns(df))
    x, lost = F.col("x"), F.col("lost")
    # A row a cell first: the aggregates then read plain columns, and their code doesn't grow with the number of columns.
    fields = lambda c: {"x": finite(df, c), "y": K.shapely(finite(df, c)), "lost": missing(df, c), "out": outside(df, c, *bounds[c]) if c in (bounds or {}) else F.lit(False)}
    cells = F.array(*[F.struct(F.lit(i).alias("at"), *[v.alias(k) for k, v in fields(c).items()]) for i, c in enumerate(columns)])
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    metrics = {
        "count": F.count(x), "missing": F.count_if(lost), "infinite_count": F.count_if(~lost & x.isNull()),
        "minimum": F.min(x), "maximum": F.max(x), "mean": F.avg(x), "sum": F.sum(x),
        "variance": F.coalesce(F.var_samp(x), F.lit(0.0)), "standard_deviation": F.coalesce(F.stddev_samp(x), F.lit(0.0)),
        "skewness": K.skewness_of(F.col("y")), "kurtosis": K.kurtosis_of(F.col("y")),
        "zero_count": F.count_if(x == 0), "negative_count": F.count_if(x < 0),
    }
    if bounds is not None:
        metrics["outlier_count"] = F.count_if("out")
    q = F.col("quartiles")
    cut = {"q1": q[0], "q2": q[1], "q3": q[2], "median": q[1], "iqr": q[2] - q[0]}
    names = [*metrics, *cut] if only is None else list(only)
    want = {"count", *names, *(["quartiles"] if set(names) & set(cut) else [])}
    if quartiles is None:
        metrics["quartiles"] = F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy) if accuracy else F.percentile(x, probs)
    t = df.select(F.explode(cells).alias("e")).select("e.*").groupBy("at").agg(*[m.alias(k) for k, m in metrics.items() if k in want])
    t = t.filter("count > 0").repartition(1).sortWithinPartitions("at").withColumn("column", F.array(*map(F.lit, columns))[F.col("at")])
    if quartiles is not None:
        known = F.lit(None).cast("array<double>")
        for i, c in enumerate(columns):
            known = F.when(F.col("at") == i, F.array(*map(F.lit, quartiles[c]))).otherwise(known) if quartiles.get(c) else known
        t = t.withColumn("quartiles", known)
    return t.select("column", *[cut[n].alias(n) if n in cut else F.col(n) for n in names])


def fence(q1: float, q3: float, multiplier: float = 1.5) -> tuple[float, float]:
    return q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)


def fences(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, keep_infinite: bool = False) -> dict[str, tuple[float, float]]:
    """Per column (q1 - m iqr, q3 + m iqr), on the driver: literals that the next pass filters by."""
    if not columns:
        return {}
    f = (lambda c: value(df, c).cast("double")) if keep_infinite else (lambda c: finite(df, c))
    out = {}
    for c, q in exact_quantiles(df, columns, (0.25, 0.75), f).items():
        if q:
            out[c] = fence(*q, multiplier)
    return out


def outside(df: DataFrame, name: str, low: float, high: float) -> Column:
    c = finite(df, name)
    return F.coalesce((c < low) | (c > high), F.lit(False))


def outlier_table(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5) -> DataFrame:
    """(column, lower, upper, outliers): fences in one pass, counts in the next."""
    columns = list(columns or numeric_columns(df))
    bounds = fences(df, columns, multiplier)
    names = [c for c in columns if c in bounds]
    t = per_column(df, names, {"lower": lambda c: F.first(F.lit(bounds[c][0])), "upper": lambda c: F.first(F.lit(bounds[c][1])), "outliers": lambda c: F.count_if(outside(df, c, *bounds[c]))})
    return t


class StatisticsInspector:
    def inspect(self, df: DataFrame, accuracy: int | None = None) -> Report:
        _must_have_rows(df)
        names = numeric_columns(df)
        if not names:
            return Report({"numeric_columns": 0, "constant_columns": (), "analyzed_columns": ()})
        quartiles = None if accuracy else exact_quantiles(df, names, (0.25, 0.5, 0.75), lambda c: finite(df, c))
        bounds = fences(df, names) if quartiles is None else {c: fence(q[0], q[2]) for c, q in quartiles.items() if q}
        rows = {r["column"]: r for r in _rows(statistics_table(df, names, accuracy, quartiles, bounds=bounds))}
        clean = df.select(*[finite(df, c).alias(c) for c in names])
        more = {r["column"]: r for r in _rows(distinct_and_mode(clean, names))}
        reports = []
        for c in names:
            if c in rows:
                u = more[c]["distinct"]
                nan = {k: (float("nan") if rows[c][k] is None else rows[c][k]) for k in ("skewness", "kurtosis")}
                reports.append(rows[c] | nan | {"unique": u, "mode": more[c]["mode_number"], "constant": u == 1})
        summary = {"numeric_columns": len(reports), "constant_columns": tuple(r["column"] for r in reports if r["constant"]), "analyzed_columns": tuple(r["column"] for r in reports)}
        return Report(summary, reports)

    def describe(self, df: DataFrame) -> DataFrame:
        return describe_table(df)

    def correlation(self, df: DataFrame, method: str = "pearson") -> DataFrame:
        return correlation_table(df, method)

    def covariance(self, df: DataFrame) -> DataFrame:
        return covariance_table(df)


def describe_table(df: DataFrame) -> DataFrame:
    """(column, count, unique, top, freq, mean, std, min, 25%, 50%, 75%, max): text fields for text, numbers for numbers."""
    numbers = numeric_columns(df)
    texts = [c for c in df.columns if c not in numbers]
    out = None
    if numbers:
        s = statistics_table(df, quartiles=exact_quantiles(df, numbers, (0.25, 0.5, 0.75), lambda c: finite(df, c)))
        out = s.select("column", "count", F.lit(None).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("freq"), "mean", F.when(F.col("count") > 1, F.col("standard_deviation")).alias("std"), F.col("minimum").alias("min"), F.col("q1").alias("25%"), F.col("q2").alias("50%"), F.col("q3").alias("75%"), F.col("maximum").alias("max"))
    if texts:
        from ..plans.metrics import value_counts

        v = value_counts(df, texts).groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("t"))
        none = [F.lit(None).cast("double").alias(x) for x in ("mean", "std", "min", "25%", "50%", "75%", "max")]
        v = v.select("column", "count", "unique", F.col("t.value").alias("top"), (-F.col("t.k")).alias("freq"), *none)
        out = v if out is None else out.unionByName(v)
    return out


def _pairs(df: DataFrame) -> list[tuple[str, str]]:
    names = numeric_columns(df)
    return [(a, b) for a in names for b in names]


def _pair_table(df: DataFrame, f, name: str) -> DataFrame:
    pairs = _pairs(df)
    half = {(a, b) for i, (a, b) in enumerate(pairs) if df.columns.index(a) <= df.columns.index(b)}
    index = {p: i for i, p in enumerate(sorted(half, key=pairs.index))}
    wide = df.agg(*[f(value(df, a).cast("double"), value(df, b).cast("double")).alias(f"p{i}") for (a, b), i in index.items()])
    rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{index.get((a, b), index.get((b, a)))}").alias(name)) for a, b in pairs]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def correlation_table(df: DataFrame, method: str = "pearson") -> DataFrame:
    """(column_a, column_b, correlation) over all ordered pairs of numeric columns, each over its complete rows."""
    if method == "pearson":
        return _pair_table(df, F.corr, "correlation")
    if method not in ("spearman", "kendall"):
        raise ValueError("method must be one of ['kendall', 'pearson', 'spearman']")
    names, rows, out = numeric_columns(df), df.count(), None
    for i, a in enumerate(names):
        for b in names[i:]:
            x, y = value(df, a), value(df, b)
            t = ranks.spearman(df, x, y, rows) if method == "spearman" else df.sparkSession.createDataFrame([(ranks.kendall(df, x, y, rows),)], "correlation double")
            for p, q in {(a, b), (b, a)}:
                row = t.select(F.lit(p).alias("column_a"), F.lit(q).alias("column_b"), "correlation")
                out = row if out is None else out.unionAll(row)
    return out


def covariance_table(df: DataFrame) -> DataFrame:
    """(column_a, column_b, covariance)."""
    return _pair_table(df, F.covar_samp, "covariance")


# Memory: a logical size model

_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
TEXT_OVERHEAD = 16


def cell_bytes(df: DataFrame, name: str) -> Column:
    kind = kind_of(df, name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col(name)), F.lit(0)) + TEXT_OVERHEAD
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col(name)))), F.lit(0)) + TEXT_OVERHEAD
    return F.lit(_WIDTH.get(kind.simpleString(), 16))


def memory_table(df: DataFrame) -> DataFrame:
    """(column, bytes, total, low, high, narrow, distinct): what the size model and its advice need."""
    number = lambda c: value(df, c).cast("double") if K.is_numeric(kind_of(df, c)) else F.lit(None).cast("double")
    close = lambda c: F.abs(number(c).cast("float").cast("double") - number(c)) <= F.greatest(F.abs(number(c)) * 1e-5, F.lit(1e-8))
    base = per_column(df, df.columns, {"bytes": lambda c: F.coalesce(F.sum(cell_bytes(df, c)), F.lit(0)).cast("bigint"), "low": lambda c: F.min(number(c)), "high": lambda c: F.max(number(c)), "wide": lambda c: F.count_if(~close(c))}, {"total": F.count("*")})
    unique = distinct_and_mode(df, string_columns(df)).select(F.col("column").alias("_c"), "distinct") if string_columns(df) else None
    return base.join(unique, F.col("column") == F.col("_c"), "left").drop("_c") if unique is not None else base.withColumn("distinct", F.lit(None).cast("bigint"))


class MemoryInspector:
    CATEGORY = 0.5

    def inspect(self, df: DataFrame) -> Report:
        _must_have_rows(df)
        rows, whole = _rows(memory_table(df)), 0
        whole = sum(r["bytes"] for r in rows)
        out = []
        for r in rows:
            kind, n = kind_of(df, r["column"]), r["total"]
            after, advice = r["bytes"], None
            if K.is_integral(kind):
                bits = next(b for b in (8, 16, 32, 64) if r["low"] is None or (-(2 ** (b - 1)) <= r["low"] and r["high"] <= 2 ** (b - 1) - 1))
                advice, after = f"int{bits}", n * bits // 8
            elif K.is_fractional(kind):
                advice, after = ("float32", n * 4) if not r["wide"] else ("float64", n * 8)
            elif isinstance(kind, T.StringType):
                few = (r["distinct"] or 0) / max(n, 1) < self.CATEGORY
                advice = "category" if few else "string"
                after = min(after, n * (1 if (r["distinct"] or 0) < 128 else 4) + (r["distinct"] or 0) * (after // max(n, 1))) if few else after
            after = min(after, r["bytes"])
            out.append({"column": r["column"], "dtype": K.dtype_name(kind), "bytes": r["bytes"], "percent": round(r["bytes"] / whole * 100, 4) if whole else 0.0, "recommended": advice, "estimated_bytes": after, "saved_bytes": r["bytes"] - after})
        out.sort(key=lambda r: (-r["bytes"], r["column"]))
        after = sum(r["estimated_bytes"] for r in out)
        return Report({"total_rows": rows[0]["total"], "total_memory_bytes": whole, "estimated_memory_bytes": after, "estimated_saved_bytes": whole - after, "estimated_saved_percentage": round((whole - after) / whole * 100, 4) if whole else 0.0}, out)

    def largest_columns(self, df: DataFrame, n: int = 10) -> list[Record]:
        return list(self.inspect(df).reports[:n])


# Anomalies


def anomaly_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", multiplier: float = 1.5, threshold: float = 3.0) -> dict[str, tuple[float, float]]:
    if method == "iqr":
        return fences(df, columns, multiplier)
    t = per_column(df, columns, {"m": lambda c: F.avg(finite(df, c)), "s": lambda c: F.stddev_samp(finite(df, c))})
    return {r["column"]: (r["m"] - threshold * r["s"], r["m"] + threshold * r["s"]) for r in t.collect() if r["s"]}


def anomaly_rows(df: DataFrame, method: str = "iqr", multiplier: float = 1.5, threshold: float = 3.0, columns: Sequence[str] | None = None, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows with an anomaly, and _anomalies: the names of the columns where."""
    names = list(columns or numeric_columns(df))
    bounds = anomaly_bounds(df, names, method, multiplier, threshold) if bounds is None else bounds
    marks = [F.when(outside(df, c, *bounds[c]), F.lit(c)) for c in names if c in bounds]
    marked = df.withColumn("_anomalies", F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))
    return marked.filter(F.size("_anomalies") > 0)


def anomaly_table(df: DataFrame, method: str = "iqr", multiplier: float = 1.5, threshold: float = 3.0) -> DataFrame:
    """(column, count, anomalies, percent, lower, upper)."""
    names = numeric_columns(df)
    bounds = anomaly_bounds(df, names, method, multiplier, threshold)
    none = (None, None)
    hit = lambda c: outside(df, c, *bounds[c]) if c in bounds else F.lit(False)
    t = per_column(df, names, {"count": lambda c: F.count(finite(df, c)), "anomalies": lambda c: F.count_if(hit(c)), "lower": lambda c: F.first(F.lit(bounds.get(c, none)[0]).cast("double")), "upper": lambda c: F.first(F.lit(bounds.get(c, none)[1]).cast("double"))})
    return t.select("column", "count", "anomalies", F.coalesce(percent(F.col("anomalies"), F.col("count")), F.lit(0.0)).alias("percent"), "lower", "upper")


class AnomalyInspector:
    def inspect(self, df: DataFrame, *, method: str = "iqr", iqr_multiplier: float = 1.5, zscore_threshold: float = 3.0, seed: int | None = None) -> Report:
        _must_have_rows(df)
        rows = _rows(anomaly_table(df, method, iqr_multiplier, zscore_threshold)) if numeric_columns(df) else []
        bounds = {r["column"]: (r["lower"], r["upper"]) for r in rows if r["lower"] is not None}
        total = sum(r["anomalies"] for r in rows)
        return Report({"method": method, "columns": len(rows), "total_anomalies": total}, rows, {"rows": anomaly_rows(df, method, iqr_multiplier, zscore_threshold, bounds=bounds)})


# Near-duplicates by normalised key


def near_duplicate_groups(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """(key, size, first_row): groups of two rows or more."""
    ided = with_row_id(df, order_by)
    key = K.match_key(df, list(subset or df.columns))
    return ided.groupBy(key.alias("key")).agg(F.count("*").alias("size"), F.min("_row_id").alias("first_row")).filter("size > 1")


def near_duplicate_summary(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """(total_rows, groups, duplicate_count)."""
    g = df.groupBy(K.match_key(df, list(subset or df.columns)).alias("key")).count()
    n = F.col("count")
    return g.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"), F.count_if(n > 1).alias("groups"), F.coalesce(F.sum(n - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))


class NearDuplicateDetector:
    METHODS = ("exact_normalized", "similarity")

    def detect(self, df: DataFrame, *, subset: Sequence[str] | None = None, method: str = "exact_normalized", threshold: float = 90, order_by: Sequence[str] | None = None) -> Report:
        """Groups by normalised key. Similarity compares only rows of equal keys, which are wholly similar."""
        _must_have_rows(df)
        need_columns(df, subset or [], ValueError)
        if method not in self.METHODS:
            raise ValueError(f"method must be one of {sorted(self.METHODS)}, got {method!r}")
        if method == "similarity":
            _need("rapidfuzz", "similarity matching")
        groups = near_duplicate_groups(df, subset, order_by)
        if method == "similarity" and threshold > 100:
            return Report({"groups": 0, "duplicate_count": 0, "method": method}, [], {"groups": groups.limit(0)})
        s = _rows(near_duplicate_summary(df, subset))[0]
        return Report(s | {"method": method}, [], {"groups": groups.orderBy("first_row")})


def _need(package: str, what: str) -> None:
    import importlib.util

    if importlib.util.find_spec(package) is None:
        raise DependencyError(f"{what} needs the package {package}, which is not installed")


# Text quality


def text_quality_table(df: DataFrame, subset: Sequence[str] | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Per text column: lengths, token counts, empties, filler, garbage; or only the fields named."""
    names = list(subset or string_columns(df))
    # Lengths and tokens are made once a row: the aggregates read plain columns.
    made = {(what, c): F.col(f"{what}{i}") for i, c in enumerate(names) for what in ("chars", "tokens")}
    zero = lambda x: F.coalesce(x, F.lit(0))
    metrics = {"count": lambda c: F.count(col(c))}
    for what in ("chars", "tokens"):
        f = lambda c, w=what: made[w, c]
        metrics |= {
            f"min_{what}": lambda c, f=f: zero(F.min(f(c))).cast("bigint"), f"max_{what}": lambda c, f=f: zero(F.max(f(c))).cast("bigint"),
            f"mean_{what}": lambda c, f=f: F.coalesce(F.avg(f(c)), F.lit(0.0)), f"median_{what}": lambda c, f=f: F.coalesce(F.percentile(f(c), F.lit(0.5)), F.lit(0.0)),
        }
    metrics |= {"empty_count": lambda c: F.count_if(K.strip(col(c)) == ""), "boilerplate_count": lambda c: F.count_if(K.is_filler(col(c))), "garbage_count": lambda c: F.count_if(K.has_garbage(col(c)))}
    wide = df.select(*[col(c) for c in names], *[{"chars": F.length, "tokens": K.token_count}[what](col(c)).alias(f"{what}{names.index(c)}") for what, c in made])
    return per_column(wide, names, metrics if only is None else {m: metrics[m] for m in only})


class TextQualityAnalyzer:
    def analyze(self, df: DataFrame, *, subset: Sequence[str] | None = None, mode: str = "core") -> tuple[Record, ...]:
        _must_have_rows(df)
        need_columns(df, subset or [])
        if mode != "core":
            raise DependencyError("advanced text quality needs a package that is not installed")
        names = [c for c in subset or df.columns if c in string_columns(df)]
        return tuple(Record(r) for r in _rows(text_quality_table(df, names))) if names else ()
