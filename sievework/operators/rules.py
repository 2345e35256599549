"""Rules and contracts: pass or fail over a frame, from fused aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import RegistryError, SchemaValidationError
from ..functions import kernels as K
from ..functions.kernels import col, is_numeric, kind_of, missing, numeric_columns, string_columns, value
from ..plans.metrics import distinct_and_mode, per_column
from .inspect import fences, plain, rows_with_missing
from .rowid import need_frame


@dataclass(frozen=True)
class RuleResult:
    rule: str
    passed: bool
    severity: str
    category: str
    message: str
    affected_columns: tuple[str, ...] = ()
    affected_rows: int = 0
    metadata: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return plain(self.__dict__)


class BaseRule:
    """Subclass with a name, a category and evaluate(df); the base passes."""

    name, category, description, priority, enabled = "rule", "custom", "", 100, True

    def evaluate(self, df: DataFrame) -> RuleResult:
        return self.verdict((), 0)

    def verdict(self, columns: Iterable[str], rows: int, failed: bool | None = None, **metadata: Any) -> RuleResult:
        columns = tuple(columns)
        failed = bool(columns) if failed is None else failed
        if not failed:
            return RuleResult(self.name, True, "info", self.category, f"{self.name}: nothing found")
        return RuleResult(self.name, False, "warning", self.category, f"{self.name}: {', '.join(columns) or rows}", columns, int(rows), metadata)


class MissingValuesRule(BaseRule):
    name, category = "missing_values", "completeness"

    def evaluate(self, df: DataFrame) -> RuleResult:
        row = df.agg(rows_with_missing(df).alias("rows"), *[F.count_if(missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
        bad = {c: n for c, n in zip(df.columns, row[1:]) if n}
        return self.verdict(bad, row["rows"], missing_cells=sum(bad.values()))


class DuplicateRowsRule(BaseRule):
    name, category = "duplicate_rows", "uniqueness"

    def evaluate(self, df: DataFrame) -> RuleResult:
        n = F.col("count")
        row = df.groupBy(*[value(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]).count().agg(F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("more")).first()
        return self.verdict(df.columns if row["rows"] else (), row["rows"], redundant_rows=row["more"])


def equal_columns(df: DataFrame) -> dict[str, str]:
    """Later column -> the earlier one whose values it repeats. Pairs that agree in an order-free signature are compared."""
    kinds = {c: "number" if is_numeric(kind_of(df, c)) else kind_of(df, c).simpleString() for c in df.columns}
    v = {c: value(df, c).cast("double") if kinds[c] == "number" else value(df, c) for c in df.columns}
    able = [c for c in df.columns if not kinds[c].startswith("map")]
    if not able:
        return {}
    sums = df.agg(*[F.sum(F.xxhash64(v[c]).cast("decimal(38,0)")).alias(f"c{i}") for i, c in enumerate(able)]).first()
    sign = dict(zip(able, sums))
    pairs = [(a, b) for a, b in combinations(able, 2) if kinds[a] == kinds[b] and sign[a] == sign[b]]
    if not pairs:
        return {}
    row = df.agg(*[F.count_if(~v[a].eqNullSafe(v[b])).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    out: dict[str, str] = {}
    for (a, b), n in zip(pairs, row):
        if not n:
            out.setdefault(b, a)
    return out


class DuplicateColumnsRule(BaseRule):
    name, category = "duplicate_columns", "uniqueness"

    def evaluate(self, df: DataFrame) -> RuleResult:
        twice = [c for i, c in enumerate(df.columns) if c in df.columns[:i]]
        found = {} if twice else equal_columns(df)
        return self.verdict(dict.fromkeys([*twice, *found]), 0, equal_to=found)


class InvalidDtypesRule(BaseRule):
    name, category = "invalid_dtypes", "validity"

    def evaluate(self, df: DataFrame) -> RuleResult:
        names = string_columns(df)
        if not names:
            return self.verdict((), 0)
        number = lambda c: K.to_number(col(c))
        rows = per_column(df, names, {"n": lambda c: F.count(col(c)), "good": lambda c: F.count(number(c))}).collect()
        bad = {r["column"]: r["n"] for r in rows if r["n"] and r["n"] == r["good"]}
        return self.verdict([c for c in names if c in bad], sum(bad.values()))


class OutliersRule(BaseRule):
    name, category = "outliers", "validity"

    def evaluate(self, df: DataFrame) -> RuleResult:
        names = numeric_columns(df)
        bounds = {c: b for c, b in fences(df, names, keep_infinite=True).items() if b[1] - b[0] > 0}
        if not bounds:
            return self.verdict((), 0)
        v = lambda c: value(df, c).cast("double")
        rows = per_column(df, list(bounds), {"n": lambda c: F.count_if((v(c) < bounds[c][0]) | (v(c) > bounds[c][1]))}).collect()
        bad = {r["column"]: r["n"] for r in rows if r["n"]}
        return self.verdict([c for c in names if c in bad], sum(bad.values()), outliers=bad)


def _orderable(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not kind_of(df, c).simpleString().startswith("map")]


class ConstantColumnsRule(BaseRule):
    name, category = "constant_columns", "integrity"

    def evaluate(self, df: DataFrame) -> RuleResult:
        rows = per_column(df, _orderable(df), {"n": lambda c: F.count(value(df, c)), "same": lambda c: F.min(value(df, c)).eqNullSafe(F.max(value(df, c)))}).collect()
        bad = {r["column"] for r in rows if r["n"] and r["same"]}
        return self.verdict([c for c in df.columns if c in bad], 0)


class HighCardinalityRule(BaseRule):
    name, category = "high_cardinality", "consistency"
    LIMIT = 0.9

    def evaluate(self, df: DataFrame) -> RuleResult:
        names = string_columns(df)
        if not names:
            return self.verdict((), 0)
        t = distinct_and_mode(df, names).select("column", "distinct")
        n = {r["column"]: r["n"] for r in per_column(df, names, {"n": lambda c: F.count(col(c))}).collect()}
        bad = {r["column"] for r in t.collect() if n[r["column"]] >= 2 and r["distinct"] / n[r["column"]] > self.LIMIT}
        return self.verdict([c for c in names if c in bad], 0)


class WhitespaceRule(BaseRule):
    name, category = "whitespace", "consistency"

    def evaluate(self, df: DataFrame) -> RuleResult:
        names = string_columns(df)
        rows = per_column(df, names, {"n": lambda c: F.count_if(K.irregular_space(col(c)))}).collect() if names else []
        bad = {r["column"]: r["n"] for r in rows if r["n"]}
        return self.verdict([c for c in names if c in bad], sum(bad.values()))


class StringCaseRule(BaseRule):
    name, category = "string_case", "consistency"

    def evaluate(self, df: DataFrame) -> RuleResult:
        names = string_columns(df)
        if not names:
            return self.verdict((), 0)
        raw = {r["column"]: r["distinct"] for r in distinct_and_mode(df, names).collect()}
        low = {r["column"]: r["distinct"] for r in distinct_and_mode(df.select(*[F.lower(col(c)).alias(c) for c in names]), names).collect()}
        return self.verdict([c for c in names if low.get(c, 0) < raw.get(c, 0)], 0)


class ColumnNamesRule(BaseRule):
    name, category = "column_names", "schema"
    PATTERN = re.compile(r"[a-z0-9]+(_[a-z0-9]+)*")

    def evaluate(self, df: DataFrame) -> RuleResult:
        return self.verdict([c for c in df.columns if not self.PATTERN.fullmatch(c)], 0)


BUILTIN_RULES = (MissingValuesRule, DuplicateRowsRule, DuplicateColumnsRule, InvalidDtypesRule, OutliersRule, ConstantColumnsRule, HighCardinalityRule, WhitespaceRule, StringCaseRule, ColumnNamesRule)


def check_rule(rule: object) -> BaseRule:
    """A rule whose definition holds: a name and a category in words, a text for its description, a whole number for its priority."""
    if not isinstance(rule, BaseRule):
        raise TypeError("a BaseRule is needed")
    for what in ("name", "category"):
        x = getattr(rule, what)
        if not isinstance(x, str):
            raise TypeError(f"a rule's {what} is a text, not {type(x).__name__}")
        if not x.strip():
            raise ValueError(f"a rule's {what} can't be blank")
    if not isinstance(rule.description, str):
        raise TypeError("a rule's description is a text")
    if not isinstance(rule.priority, int):
        raise TypeError("a rule's priority is a whole number")
    if not isinstance(rule.enabled, bool):
        raise TypeError("a rule is enabled or not: a boolean")
    if not callable(rule.evaluate):
        raise TypeError("a rule's evaluate is called with a frame")
    return rule


class RuleRegistry:
    def __init__(self, rules: Iterable[BaseRule] = ()):
        self._rules: dict[str, BaseRule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: BaseRule) -> None:
        check_rule(rule)
        if rule.name in self._rules:
            raise RegistryError(f"rule {rule.name!r} is registered already")
        self._rules[rule.name] = rule

    def unregister(self, name: str) -> None:
        if name not in self._rules:
            raise KeyError(name)
        del self._rules[name]

    def get(self, name: str) -> BaseRule:
        return self._rules[name]

    def rules(self) -> list[BaseRule]:
        """By priority, the smallest first; those of one priority in the order of their registration."""
        return sorted(self._rules.values(), key=lambda r: r.priority)

    def __contains__(self, name: str) -> bool:
        return name in self._rules

    def __len__(self) -> int:
        return len(self._rules)


def builtin_rules() -> RuleRegistry:
    return RuleRegistry(r() for r in BUILTIN_RULES)


@dataclass(frozen=True)
class ColumnContract:
    dtype: str | None = None
    nullable: bool = True
    unique: bool = False
    allowed_values: tuple[Any, ...] | None = None
    min_value: float | None = None
    max_value: float | None = None
    regex: str | None = None

    @classmethod
    def of(cls, spec: dict[str, Any] | ColumnContract) -> ColumnContract:
        if isinstance(spec, ColumnContract):
            return spec
        spec = {{"min": "min_value", "max": "max_value"}.get(k, k): v for k, v in spec.items()}
        unknown = set(spec) - set(cls.__dataclass_fields__)
        if unknown:
            raise SchemaValidationError(f"unknown contract fields {sorted(unknown)}")
        if spec.get("allowed_values") is not None:
            spec["allowed_values"] = tuple(spec["allowed_values"])
        return cls(**spec)


@dataclass(frozen=True)
class DataContract:
    columns: dict[str, ColumnContract]
    name: str = "contract"

    @classmethod
    def of(cls, spec: dict[str, Any] | DataContract) -> DataContract:
        return spec if isinstance(spec, DataContract) else cls({c: ColumnContract.of(s) for c, s in spec.items()})


def _java_pattern(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise SchemaValidationError(f"bad pattern {pattern!r}: {e}") from None
    return K.whole_pattern(pattern.replace("(?P<", "(?<").replace("\\Z", "\\z"))


def contract_checks(df: DataFrame, contract: DataContract) -> list[tuple[str, str, Column | bool]]:
    """(check, column, violating rows as a condition, or whether the check holds by schema), in report order."""
    out: list[tuple[str, str, Column | bool]] = []
    for c in sorted(contract.columns):
        s = contract.columns[c]
        out.append(("column_exists", c, c in df.columns))
        if c not in df.columns:
            continue
        kind, there = kind_of(df, c), ~missing(df, c)
        if s.dtype is not None:
            out.append(("dtype", c, s.dtype in {K.dtype_name(kind), K.dtype_name(kind, True), kind.simpleString()}))
        if not s.nullable:
            out.append(("nullable", c, missing(df, c)))
        if s.allowed_values is not None:
            out.append(("allowed_values", c, there & ~col(c).isin(*s.allowed_values) if s.allowed_values else there))
        if s.min_value is not None or s.max_value is not None:
            if not is_numeric(kind):
                raise SchemaValidationError(f"column {c!r} isn't numeric and has no range")
            if s.min_value is not None and s.max_value is not None and s.min_value > s.max_value:
                raise SchemaValidationError(f"column {c!r}: the least value is above the greatest")
            low = value(df, c) < s.min_value if s.min_value is not None else F.lit(False)
            high = value(df, c) > s.max_value if s.max_value is not None else F.lit(False)
            out.append(("range", c, there & (low | high)))
        if s.regex is not None:
            out.append(("regex", c, there & ~value(df, c).cast("string").rlike(_java_pattern(s.regex))))
        if s.unique:
            out.append(("unique", c, F.lit(None)))
    return out


class RuleEngine:
    def __init__(self, registry: RuleRegistry | None = None):
        self.registry = registry if registry is not None else builtin_rules()

    def run(self, df: DataFrame, names: Sequence[str] | None = None) -> tuple[RuleResult, ...]:
        """Registered rules in their order, or those named."""
        need_frame(df)
        return tuple(r.evaluate(df) for r in self.registry.rules() if r.enabled and (names is None or r.name in names))

    def validate_contract(self, df: DataFrame, contract: dict[str, Any] | DataContract) -> tuple[RuleResult, ...]:
        """All row checks in one aggregate; uniqueness in one more, for all columns together."""
        need_frame(df)
        contract = DataContract.of(contract)
        checks = contract_checks(df, contract)
        conditions = [(i, x) for i, (k, _, x) in enumerate(checks) if not isinstance(x, bool) and k != "unique"]
        counts: dict[int, int] = {}
        if conditions:
            row = df.agg(*[F.count_if(x).alias(f"c{i}") for i, x in conditions]).first()
            counts = {i: row[f"c{i}"] for i, _ in conditions}
        unique = [c for k, c, _ in checks if k == "unique"]
        if unique:
            found = {r["column"]: r["repeated"] for r in distinct_and_mode(df, unique).collect()}
            counts |= {i: found.get(c, 0) for i, (k, c, _) in enumerate(checks) if k == "unique"}
        out = []
        for i, (k, c, x) in enumerate(checks):
            n = counts.get(i, 0)
            good = x if isinstance(x, bool) else n == 0
            more: dict[str, Any] = {}
            if k == "allowed_values" and n:
                more["examples"] = [r[0] for r in df.filter(x).select(col(c)).distinct().orderBy(col(c)).limit(5).collect()]
            out.append(RuleResult(f"contract.{k}[{c}]", good, "info" if good else "error", "contract", f"{k} of {c}: {'holds' if good else f'{n} rows fail' if n else 'fails'}", () if good else (c,), n, more))
        return tuple(out)


def contract_table(df: DataFrame, contract: dict[str, Any] | DataContract) -> DataFrame:
    """(check, column, violations): the row checks as one lazy aggregate."""
    checks = [(k, c, x) for k, c, x in contract_checks(df, DataContract.of(contract)) if not isinstance(x, bool) and k != "unique"]
    wide = df.agg(*[F.count_if(x).alias(f"c{i}") for i, (_, _, x) in enumerate(checks)])
    rows = [F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), F.col(f"c{i}").alias("violations")) for i, (k, c, _) in enumerate(checks)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rules_table(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(rule, passed, affected_columns, affected_rows) of the built-in rules."""
    rows = [(r.rule, r.passed, ",".join(r.affected_columns), r.affected_rows) for r in RuleEngine().run(df, names)]
    return df.sparkSession.createDataFrame(rows, "rule string, passed boolean, affected_columns string, affected_rows bigint")


