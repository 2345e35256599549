"""Cleaning operations: lazy DataFrame to DataFrame, with impact metrics counted only where asked for.

apply() builds a plan and runs nothing, but where the output's schema or literals depend on the data (dropping columns
with missing values, fills by statistic, automatic types): those run one aggregate. apply_with_result() adds one
aggregate that compares before and after.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import DataTypeConversionError, DataValidationError, EncodingError, RegistryError
from ..functions import kernels as K
from ..functions.kernels import col, is_numeric, kind_of, missing, string_columns, value
from ..plans.metrics import distinct_and_mode, per_column
from ..plans.quantiles import exact_quantiles, ranges_of
from ..session import ship_package
from .inspect import _need, plain
from .rowid import need_columns, need_frame, order_of


@dataclass(frozen=True)
class OperationResult:
    operation_name: str
    rows_affected: int
    columns_affected: int
    before_shape: tuple[int, int]
    after_shape: tuple[int, int]
    dry_run: bool = False
    details: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return plain(self.__dict__)


class CleaningOperation:
    """One step from a frame to a frame. Subclasses give name and apply(); cell-wise ones list their columns."""

    name = "operation"
    #: Rows are independent of each other: also fit for streams and for any partitioning.
    is_chunk_safe = False
    is_inplace_safe = False

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def describe(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def changed(self, before: DataFrame) -> list[str]:
        """Columns whose changed cells count as the impact; none: rows and columns count."""
        return []

    def cells(self, before: DataFrame, after: DataFrame) -> dict[str, Column]:
        """Changed-cell conditions over a frame that has both: names before as they are, after with a _new_ prefix."""
        return {c: ~F.col(f"_new_{c}").eqNullSafe(col(c)) for c in self.changed(before)}

    def apply_with_result(self, df: DataFrame, dry_run: bool = False) -> tuple[DataFrame, OperationResult]:
        need_frame(df)
        out = self.apply(df)
        names = self.changed(df)
        if names:
            both = self._both(df, out, names)
            row = both.agg(F.count("*").alias("n"), *[F.count_if(x).alias(f"c{i}") for i, x in enumerate(self.cells(df, out).values())]).first()
            counts = dict(zip(names, row[1:]))
            rows, n, after = sum(counts.values()), row["n"], row["n"]
            columns, details = self.columns_affected(counts), {"cells": counts}
        else:
            n, after = df.count(), out.count()
            rows, columns, details = abs(n - after), abs(len(df.columns) - len(out.columns)), {}
        shapes = (n, len(df.columns)), (after, len(out.columns))
        return (df if dry_run else out), OperationResult(self.name, rows, columns, shapes[0], shapes[0] if dry_run else shapes[1], dry_run, details)

    def columns_affected(self, counts: dict[str, int]) -> int:
        return sum(n > 0 for n in counts.values())

    def _both(self, df: DataFrame, out: DataFrame, names: list[str]) -> DataFrame:
        """Before and after side by side, without a join: the operation over a frame with copies."""
        copies = df.select("*", *[col(c).alias(f"_old_{i}") for i, c in enumerate(names)])
        new = self.apply(copies)
        return new.select(*[F.col(f"_old_{i}").alias(c) for i, c in enumerate(names)], *[col(c).alias(f"_new_{c}") for c in names])


class DropMissingRows(CleaningOperation):
    name = "drop_missing_rows"

    def __init__(self, subset: Sequence[str] | None = None):
        self.subset = list(subset) if subset else None

    def apply(self, df: DataFrame) -> DataFrame:
        names = need_columns(df, self.subset or df.columns)
        keep = F.lit(True)
        for c in names:
            keep = keep & ~missing(df, c)
        return df.filter(keep)


class DropMissingColumns(CleaningOperation):
    """Without a subset, every column that has a missing value goes (one aggregate); with one, those columns go anyway."""

    name = "drop_missing_columns"

    def __init__(self, subset: Sequence[str] | None = None):
        self.subset = list(subset) if subset else None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.subset:
            return df.drop(*need_columns(df, self.subset))
        row = df.agg(*[F.count_if(missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
        return df.drop(*[c for c, n in zip(df.columns, row) if n])


class FillMissing(CleaningOperation):
    """strategy constant, mean, median or mode. Statistics come from one aggregate; fills of whole numbers widen to double."""

    name = "fill_missing"
    STRATEGIES = ("constant", "mean", "median", "mode")

    def __init__(self, strategy: str = "constant", value: Any = None, subset: Sequence[str] | None = None):
        if strategy not in self.STRATEGIES:
            raise ValueError(f"strategy must be one of {sorted(self.STRATEGIES)}, got {strategy!r}")
        self.strategy, self.value, self.subset = strategy, value, list(subset) if subset else None

    def changed(self, before: DataFrame) -> list[str]:
        return self.subset or before.columns

    def cells(self, before: DataFrame, after: DataFrame) -> dict[str, Column]:
        return {c: missing(before, c) & F.col(f"_new_{c}").isNotNull() for c in self.changed(before)}

    def fills(self, df: DataFrame) -> dict[str, Any]:
        names = need_columns(df, self.subset or [c for c in df.columns if not c.startswith("_old_")])
        if self.strategy == "constant":
            return {c: self.value for c in names} if self.value is not None else {}
        return fused_fills(df, [FillMissing(self.strategy, None, names)])[0][0]

    def check(self, df: DataFrame, names: Sequence[str]) -> None:
        for c in names if self.strategy in ("mean", "median") else ():
            if not is_numeric(kind_of(df, c)):
                raise DataValidationError(f"{self.strategy} needs numbers; column {c!r} has {kind_of(df, c).simpleString()}")

    def apply(self, df: DataFrame) -> DataFrame:
        return fill_with(df, self.fills(df))


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, Any]:
    """The most frequent present value of each column, the smallest on ties; all columns in one shuffle of counts."""
    found = {r["column"]: r["mode"] for r in distinct_and_mode(df, names).collect()} if names else {}
    plain_kinds = (T.StringType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    odd = [c for c in found if not isinstance(kind_of(df, c), plain_kinds)]
    row = df.agg(*[F.mode(value(df, c), True).alias(f"c{i}") for i, c in enumerate(odd)]).first() if odd else ()
    some = [c for c in found if c not in odd]
    typed = df.sparkSession.range(1).select(*[F.lit(found[c]).cast(kind_of(df, c)).alias(f"c{i}") for i, c in enumerate(some)]).first() if some else ()
    out = dict(zip(odd, row)) | dict(zip(some, typed))
    return {c: out[c] for c in names if out.get(c) is not None}


def fused_fills(df: DataFrame, operations: Sequence[FillMissing]) -> tuple[list[dict[str, Any]], dict[str, int], int]:
    """Fills of several operations on different columns from the same three queries, missing cells by column, and rows."""
    names = [need_columns(df, op.subset) for op in operations]
    flat = [c for some in names for c in some]
    for op, some in zip(operations, names):
        op.check(df, some)
    number = lambda c: value(df, c).cast("double")
    means = [c for op, some in zip(operations, names) if op.strategy == "mean" for c in some]
    medians = [c for op, some in zip(operations, names) if op.strategy == "median" for c in some]
    # The columns alone are kept while several queries read them: what made the frame, such as a deduplication, runs once.
    df = df.select(*[col(c) for c in flat])
    ours = not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    df = df.persist(StorageLevel.MEMORY_AND_DISK) if ours else df
    try:
        edges, read = ranges_of(df, medians, number)
        row = df.agg(*[x.alias(f"x{i}") for i, x in enumerate([F.count("*"), *[F.count_if(missing(df, c)) for c in flat], *[F.avg(number(c)) for c in means], *edges])]).first()
        lost, mean = dict(zip(flat, row[1:])), dict(zip(means, row[1 + len(flat) :]))
        middle = {c: q[0] for c, q in exact_quantiles(df, [c for c in medians if lost[c]], (0.5,), number, (row[0], read(row[1 + len(flat) + len(means) :]))).items() if q}
        most = modes(df, [c for op, some in zip(operations, names) if op.strategy == "mode" for c in some if lost[c]])
    finally:
        if ours:
            df.unpersist()
    out = []
    for op, some in zip(operations, names):
        if op.strategy == "constant":
            out.append({c: op.value for c in some} if op.value is not None else {})
        else:
            known = {"mean": mean, "median": middle, "mode": most}[op.strategy]
            # A column without missing values is left as it is, its type too.
            out.append({c: known[c] for c in some if lost[c] and known.get(c) is not None})
    return out, lost, row[0]


def fill_with(df: DataFrame, fills: dict[str, Any]) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        c, v = f.name, fills.get(f.name)
        if v is None:
            columns.append(col(c))
            continue
        kind = f.dataType
        if isinstance(kind, T.StringType) != isinstance(v, str) or isinstance(v, bool) != isinstance(kind, T.BooleanType):
            if not (is_numeric(kind) and isinstance(v, (int, float)) and not isinstance(v, bool)) and not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise DataValidationError(f"column {c!r} of {kind.simpleString()} can't be filled with {v!r}")
        if K.is_integral(kind) and isinstance(v, float):
            columns.append(F.coalesce(col(c).cast("double"), F.lit(v)).alias(c))
        else:
            columns.append(F.coalesce(value(df, c), F.lit(v).cast(kind)).alias(c))
    return df.select(*columns)


def one_of_each(df: DataFrame, keys: Sequence[Column], keep: str | bool, order_by: Sequence[str] | None) -> DataFrame:
    """The first or last row of each key, or (keep False) those of keys that don't repeat: an aggregate combined before the shuffle."""
    place = F.struct(*order_of(df, order_by), *([F.monotonically_increasing_id()] if order_by else []))
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], place.alias("place"))
    groups = rows.groupBy(*[f"k{i}" for i in range(len(keys))])
    row = (F.max_by if keep == "last" else F.min_by)("row", "place").alias("row")
    if keep is False:
        return groups.agg(F.count("*").alias("n"), row).filter("n = 1").select("row.*")
    return groups.agg(row).select("row.*")


class DropDuplicates(CleaningOperation):
    """keep first or last in the order of order_by (else reading order), or False for none of a group."""

    name = "drop_duplicates"

    def __init__(self, subset: Sequence[str] | None = None, keep: str | bool = "first", order_by: Sequence[str] | None = None):
        if keep not in ("first", "last", False):
            raise ValueError("keep must be 'first', 'last' or False")
        self.subset, self.keep, self.order_by = list(subset) if subset else None, keep, list(order_by) if order_by else None

    def apply(self, df: DataFrame) -> DataFrame:
        names = need_columns(df, self.subset or df.columns)
        if not self.subset and self.keep is not False:
            # Whole rows: any of equal rows is as good as another, so an aggregate does, combined before the shuffle.
            return K.canonical(df).dropDuplicates()
        return one_of_each(df, [value(df, c) for c in names], self.keep, self.order_by)


class DropColumns(CleaningOperation):
    name = "drop_columns"

    def __init__(self, columns: Sequence[str]):
        if not columns:
            raise ValueError("columns must not be empty")
        self.columns = list(columns)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*need_columns(df, self.columns))


_TARGETS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint", "integer": "bigint", "float": "double", "float32": "float", "float64": "double", "str": "string", "object": "string", "string": "string", "category": "string", "bool": "boolean", "boolean": "boolean", "double": "double", "bigint": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint"}
_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "dd/MM/yyyy")


class TypeCoercionOperation(CleaningOperation):
    """Columns to types: text to numbers by the strict decimal grammar, whole numbers truncated, dates by one format.

    error_policy coerce makes what doesn't fit missing; raise looks for the first such value (one action) and fails.
    A whole-number target holds with missing values too, and a text target is a plain cast.
    """

    name = "type_coercion"
    is_chunk_safe = True

    def __init__(self, target_dtypes: dict[str, str], error_policy: str = "coerce", date_format: str | None = None):
        if error_policy not in ("coerce", "raise"):
            raise ValueError(f"error_policy must be one of ['coerce', 'raise'], got {error_policy!r}")
        self.target_dtypes, self.error_policy, self.date_format = dict(target_dtypes), error_policy, date_format

    def changed(self, before: DataFrame) -> list[str]:
        return list(self.target_dtypes)

    def cells(self, before: DataFrame, after: DataFrame) -> dict[str, Column]:
        return {c: ~missing(before, c) & F.col(f"_new_{c}").isNull() for c in self.changed(before)}

    def columns_affected(self, counts: dict[str, int]) -> int:
        return len(counts)

    def converted(self, df: DataFrame, name: str, target: str) -> Column:
        kind, c, low = kind_of(df, name), col(name), target.lower()
        if "datetime" in low or low in ("date", "timestamp", "timestamp_ntz"):
            if not isinstance(kind, T.StringType):
                return c.cast("timestamp_ntz")
            if self.date_format:
                return F.try_to_timestamp(c, F.lit(self.date_format)).cast("timestamp_ntz")
            first = df.filter(c.isNotNull()).select(c.alias("v")).first()
            fit = lambda f: bool(first) and df.sparkSession.range(1).select(F.try_to_timestamp(F.lit(first["v"]), F.lit(f)).isNotNull()).first()[0]
            chosen = next((f for f in _FORMATS if fit(f)), _FORMATS[0])
            return F.try_to_timestamp(c, F.lit(chosen)).cast("timestamp_ntz")
        if low not in {k.lower() for k in _TARGETS}:
            raise DataValidationError(f"unknown type {target!r} for column {name!r}")
        to = _TARGETS[low]
        if to == "string":
            return c.cast("string")
        if to == "boolean":
            return c.try_cast("boolean")
        number = K.to_number(c) if isinstance(kind, T.StringType) else value(df, name)
        if to in ("double", "float"):
            return number.cast(to)
        if is_numeric(kind) and not K.is_fractional(kind):
            return number.try_cast(to)
        whole = F.when(F.abs(number) < 9.3e18, F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
        return whole.try_cast(to)

    def apply(self, df: DataFrame) -> DataFrame:
        need_columns(df, list(self.target_dtypes))
        made = {c: self.converted(df, c, t) for c, t in self.target_dtypes.items()}
        if self.error_policy == "raise":
            for c, x in made.items():
                bad = df.filter(~missing(df, c) & x.isNull()).select(col(c).cast("string")).first()
                if bad is not None:
                    raise DataTypeConversionError(f"column {c!r} can't become {self.target_dtypes[c]}: {bad[0]!r}")
        return df.select(*[made[c].alias(c) if c in made else col(c) for c in df.columns])


class _TextOperation(CleaningOperation):
    is_chunk_safe = True
    subset: list[str] | None

    def changed(self, before: DataFrame) -> list[str]:
        return [c for c in need_columns(before, self.subset or before.columns) if c in string_columns(before) and not c.startswith("_old_")]

    def one(self, c: Column) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        names = set(self.changed(df))
        return df.select(*[self.one(col(c)).alias(c) if c in names else col(c) for c in df.columns])


class MissingTokenOperation(_TextOperation):
    name = "missing_token_normalization"

    def __init__(self, extra_tokens: Iterable[str] = (), subset: Sequence[str] | None = None):
        self.extra_tokens, self.subset = list(extra_tokens), list(subset) if subset else None

    def one(self, c: Column) -> Column:
        return F.when(~K.is_missing_token(c, self.extra_tokens), c)


def _unicode_udf(form: str, title: bool) -> Callable[[Column], Column]:
    """Arrow-batched normalisation and title case, for the texts that need Python's Unicode tables."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            if title:
                t = t.title()
            return unicodedata.normalize(form, t) if form else t

        return s.map(one)

    return run


class TextNormalizationOperation(_TextOperation):
    """Unicode form, white space, case, Unicode form again, and empty as missing.

    ASCII text is a fixed point of the Unicode forms, so only other text is sent to Python, in Arrow batches.
    """

    name = "text_normalization"
    FORMS, CASES = ("NFC", "NFKC", "none"), ("lower", "upper", "title", "none")

    def __init__(self, subset: Sequence[str] | None = None, unicode_form: str = "NFC", normalize_whitespace: bool = True, case: str = "none"):
        for what, got, allowed in (("unicode_form", unicode_form, self.FORMS), ("case", case, self.CASES)):
            if got not in allowed:
                raise ValueError(f"{what} must be one of {sorted(allowed)}, got {got!r}")
        self.subset, self.unicode_form, self.normalize_whitespace, self.case = list(subset) if subset else None, unicode_form, normalize_whitespace, case

    def _form(self, c: Column) -> Column:
        if self.unicode_form == "none":
            return c
        # The UDF gets null for ASCII text, which costs no Python work.
        other = _unicode_udf(self.unicode_form, False)(F.when(c.rlike("[^\\x00-\\x7f]"), c))
        return F.coalesce(other, c)

    def one(self, c: Column) -> Column:
        c = self._form(c)
        if self.normalize_whitespace:
            c = K.collapse(F.replace(c, F.lit("\xa0"), F.lit(" ")))
        if self.case == "title":
            c = _unicode_udf("" if self.unicode_form == "none" else self.unicode_form, True)(c)
        elif self.case != "none":
            c = F.lower(c) if self.case == "lower" else F.upper(c)
            c = self._form(c)
        return F.nullif(c, F.lit(""))

    def apply(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        return super().apply(df)


class EncodingRepairOperation(_TextOperation):
    """Core repair drops control and replacement characters; it can't mend mis-decoded text, and says so when strict."""

    name = "encoding_repair"

    def __init__(self, subset: Sequence[str] | None = None, mode: str = "core", error_on_unrepaired: bool = True):
        if mode not in ("core", "advanced"):
            raise ValueError(f"mode must be one of ['advanced', 'core'], got {mode!r}")
        self.subset, self.mode, self.error_on_unrepaired = list(subset) if subset else None, mode, error_on_unrepaired

    def one(self, c: Column) -> Column:
        return K.repair(c)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.mode == "advanced":
            _need("ftfy", "advanced encoding repair")
            import ftfy

            fix = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else ftfy.fix_text(t)), "string")
            names = set(self.changed(df))
            df = df.select(*[fix(col(c)).alias(c) if c in names else col(c) for c in df.columns])
        out = super().apply(df)
        if self.error_on_unrepaired:
            names = self.changed(df)
            if names:
                row = out.agg(*[F.count_if(K.has_garbage(col(c))).alias(f"c{i}") for i, c in enumerate(names)]).first()
                bad = {c: n for c, n in zip(names, row) if n}
                if bad:
                    raise EncodingError(f"text that core repair can't mend: {bad}")
        return out


class NearDuplicateRemoval(CleaningOperation):
    name = "near_duplicate_removal"

    def __init__(self, subset: Sequence[str] | None = None, method: str = "exact_normalized", threshold: float = 90, keep: str = "first", order_by: Sequence[str] | None = None):
        if method not in ("exact_normalized", "similarity"):
            raise ValueError(f"method must be one of ['exact_normalized', 'similarity'], got {method!r}")
        if keep not in ("first", "last"):
            raise ValueError(f"keep must be one of ['first', 'last'], got {keep!r}")
        self.subset, self.method, self.threshold, self.keep, self.order_by = list(subset) if subset else None, method, threshold, keep, list(order_by) if order_by else None

    def apply(self, df: DataFrame) -> DataFrame:
        names = need_columns(df, self.subset or df.columns, ValueError)
        if self.method == "similarity":
            _need("rapidfuzz", "similarity matching")
            if self.threshold > 100:
                return df
        return one_of_each(df, [K.match_key(df, names)], self.keep, self.order_by)


def auto_fill(df: DataFrame, strategy: str | None = None, fill: Any = None) -> DataFrame:
    """A value wins over a strategy; with neither, numbers take their median and the rest their mode."""
    if fill is not None:
        return FillMissing("constant", fill).apply(df)
    if strategy is not None:
        return FillMissing(strategy).apply(df)
    numbers = [c for c in df.columns if is_numeric(kind_of(df, c))]
    parts = [FillMissing("median", None, numbers)] if numbers else []
    parts += [FillMissing("mode", None, [c for c in df.columns if c not in numbers])] if len(numbers) < len(df.columns) else []
    fills = fused_fills(df, parts)[0]
    return fill_with(df, {c: v for some in fills for c, v in some.items()})


_KEY_NAME = re.compile(r"(^|_)(id|code|phone|zip|postal)($|_)", re.IGNORECASE)


def number_types(df: DataFrame) -> dict[str, str]:
    """Text columns of which over 95 % of present values are numbers, with the type that they take (one aggregate)."""
    names = [c for c in string_columns(df) if not _KEY_NAME.search(c)]
    if not names:
        return {}
    number = lambda c: K.to_number(col(c))
    rows = per_column(df, names, {"n": lambda c: F.count(col(c)), "good": lambda c: F.count(number(c)), "broken": lambda c: F.count_if((number(c) != F.floor(number(c))) | (F.abs(number(c)) == float("inf")))}).collect()
    return {r["column"]: "float64" if r["broken"] else "int64" for r in rows if r["n"] and r["good"] / r["n"] > 0.95}


def fix_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    found = types or number_types(df)
    return TypeCoercionOperation(found).apply(df) if found else df


class OperationRegistry:
    def __init__(self) -> None:
        self._classes: dict[str, type[CleaningOperation]] = {}

    def register(self, operation: type[CleaningOperation], name: str | None = None) -> None:
        name = name or operation.name
        if name in self._classes:
            raise RegistryError(f"operation {name!r} is registered already")
        self._classes[name] = operation

    def unregister(self, name: str) -> None:
        self.get(name)
        del self._classes[name]

    def get(self, name: str) -> type[CleaningOperation]:
        if name not in self._classes:
            raise KeyError(name)
        return self._classes[name]

    def names(self) -> list[str]:
        return list(self._classes)

    def clear(self) -> None:
        self._classes.clear()

    def __contains__(self, name: str) -> bool:
        return name in self._classes

    def __len__(self) -> int:
        return len(self._classes)


BUILTIN = (DropMissingRows, DropMissingColumns, FillMissing, DropDuplicates, DropColumns, TypeCoercionOperation, MissingTokenOperation, TextNormalizationOperation, EncodingRepairOperation, NearDuplicateRemoval)


def builtin_registry() -> OperationRegistry:
    registry = OperationRegistry()
    for operation in BUILTIN:
        registry.register(operation)
    return registry
