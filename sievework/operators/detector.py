"""Issue detection: fused aggregates over a frame, graded issues, recommendations and a health score."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions import kernels as K
from ..functions.kernels import col, finite, is_numeric, kind_of, missing, numeric_columns, string_columns, value
from ..plans.metrics import distinct_and_mode
from ..plans.quantiles import exact_quantiles, ranges_of
from .inspect import outside
from .rowid import need_frame


@dataclass(frozen=True)
class Issue:
    title: str
    severity: str
    category: str
    columns: tuple[str, ...] = ()
    rows: int = 0
    percent: float = 0.0


@dataclass(frozen=True)
class Recommendation:
    action: str
    priority: str
    confidence: float
    columns: tuple[str, ...] = ()
    gain: float = 0.0
    automatic: bool = True
    category: str = ""
    target_dtype: str | None = None


@dataclass(frozen=True)
class HealthReport:
    rows: int
    columns: int
    health_score: int
    scores: dict[str, float]
    issues: tuple[Issue, ...] = ()
    recommendations: tuple[Recommendation, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict)

    def by_severity(self, severity: str) -> tuple[Issue, ...]:
        return tuple(i for i in self.issues if i.severity.upper() == severity.upper())

    @property
    def critical_count(self) -> int:
        return len(self.by_severity("CRITICAL"))

    def table(self, spark) -> DataFrame:
        rows = [(i.title, i.severity, i.category, ",".join(i.columns), i.rows, i.percent) for i in self.issues]
        return spark.createDataFrame(rows, "title string, severity string, category string, columns string, rows bigint, percent double")


class IssueDetector:
    """Five queries whatever the number of columns: cells, patterns and ranges; distinct values, raw and folded; duplicate keys
    of both kinds; quartiles; what lies outside their fences. Dates are looked for in all present texts of a column."""

    DATE_SHARE = 0.7

    def inspect(self, df: DataFrame) -> HealthReport:
        need_frame(df)
        none = {k: 0.0 for k in ("completeness", "uniqueness", "integrity", "consistency", "validity")}
        texts, numbers = string_columns(df), numeric_columns(df)
        number = lambda c: value(df, c).cast("double")
        marked = {c: K.has_mojibake(col(c)).cast("int") + K.has_replacement(col(c)).cast("int") + K.has_control(col(c)).cast("int") for c in texts}
        edges, read = ranges_of(df, numbers, number)
        cells = [F.count("*"), *[F.count_if(missing(df, c)) for c in df.columns], *[F.sum(marked[c]) for c in texts], *[F.avg(col(c).rlike(K.DATE_LIKE).cast("int")) for c in texts], *edges]
        row = df.agg(*[x.alias(f"x{i}") for i, x in enumerate(cells)]).first() if df.columns else (0,)
        n, width, k = row[0], len(df.columns), len(texts)
        if not n:
            return HealthReport(0, width, 0, none, (Issue("Empty DataFrame", "CRITICAL", "structure"),))
        lost = dict(zip(df.columns, row[1 : width + 1]))
        garbage, dates = dict(zip(texts, row[width + 1 :])), dict(zip(texts, row[width + k + 1 :]))
        ranges = read(row[width + 2 * k + 1 :])
        both = df.select(*[col(c).alias(f"r{i}") for i, c in enumerate(df.columns)], *[F.lower(K.strip(col(c))).alias(f"l{df.columns.index(c)}") for c in texts])
        counts = {r["column"]: r["distinct"] for r in distinct_and_mode(both, both.columns).collect()}
        unique, folded = ({c: counts.get(f"{x}{i}", 0) for i, c in enumerate(df.columns)} for x in "rl")
        # Equal rows have equal normalised keys: groups of both kinds come from one chain of aggregates.
        equal = df.groupBy(*[value(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)], K.match_key(df, df.columns).alias("near")).agg(F.count("*").alias("n"))
        groups = equal.groupBy("near").agg(F.count("*").alias("equal"), F.sum("n").alias("n")).agg(F.sum("equal"), F.count("*")).first()
        dups = n - groups[0]
        near = groups[0] - groups[1]
        outliers, anomalies = self._outside(df, numbers, unique, n, lost, ranges)
        issues: list[Issue] = []
        advice: list[Recommendation] = []
        share = dups / n * 100
        if dups:
            bad = share > 10
            issues.append(Issue("Duplicate rows", "CRITICAL" if bad else "WARNING", "duplicates", (), dups, round(share, 4)))
            advice.append(Recommendation("REMOVE_DUPLICATES", "CRITICAL" if bad else "HIGH", 1.0, (), min(20.0, share * 0.8), True, "duplicates"))
        const = empty = date_cols = fold_cols = out_cols = 0
        for c in df.columns:
            m = lost[c]
            p, there = m / n * 100, n - m
            if p == 100:
                empty += 1
                issues.append(Issue("Column is empty", "CRITICAL", "missing_values", (c,), m, 100.0))
                advice.append(Recommendation("DROP_COLUMN", "CRITICAL", 1.0, (c,), 5.0, True, "missing_values"))
            elif m:
                issues.append(Issue("Missing values", "WARNING" if p >= 15 else "INFO", "missing_values", (c,), m, round(p, 4)))
                advice.append(Recommendation("FILL_MEDIAN" if is_numeric(kind_of(df, c)) else "FILL_MODE", "HIGH" if p >= 15 else "MEDIUM", 0.85, (c,), min(10.0, p * 0.3), p <= 50, "missing_values"))
            if unique[c] == 1 and p < 100:
                const += 1
                issues.append(Issue("Constant column", "WARNING", "integrity", (c,), there))
                advice.append(Recommendation("DROP_COLUMN", "MEDIUM", 0.9, (c,), 2.0, True, "feature_selection"))
            if c in texts and there:
                if folded[c] < unique[c]:
                    fold_cols += 1
                    issues.append(Issue("Inconsistent case or white space", "WARNING", "consistency", (c,), unique[c] - folded[c]))
                if (dates[c] or 0.0) > self.DATE_SHARE:
                    date_cols += 1
                    issues.append(Issue("Dates stored as text", "WARNING", "data_types", (c,)))
                    advice.append(Recommendation("CONVERT_TYPE", "HIGH", 0.9, (c,), 3.0, True, "data_types"))
                if garbage[c]:
                    q = garbage[c] / there * 100
                    issues.append(Issue("Encoding artifacts", "CRITICAL" if q > 10 else "WARNING", "encoding_artifacts", (c,), garbage[c], round(q, 4)))
            if c in outliers:
                out_cols += 1
                x, q = outliers[c]
                issues.append(Issue("Outliers", "INFO" if q < 10 else "WARNING", "outliers", (c,), x, round(q, 4)))
        for c, (x, q) in anomalies.items():
            if x:
                issues.append(Issue("Anomalies", "WARNING" if q >= 10 else "INFO", "anomalies", (c,), x, q))
        if near > 0:
            issues.append(Issue("Near-duplicate rows", "WARNING" if near / n > 0.05 else "INFO", "near_duplicates", (), near, round(near / n * 100, 4)))
        scores = {
            "completeness": 100 * (1 - sum(lost.values()) / (n * width)), "uniqueness": 100 * (1 - dups / n),
            "integrity": 100 - 100 * (const + empty) / width, "consistency": 100.0 - (15 * date_cols + 10 * fold_cols), "validity": 100.0 - 8 * out_cols,
        }
        scores = {k: max(0.0, v) for k, v in scores.items()}
        weights = {"completeness": 0.35, "uniqueness": 0.25, "integrity": 0.15, "consistency": 0.15, "validity": 0.10}
        health = max(0, min(100, int(round(sum(weights[k] * v for k, v in scores.items())))))
        return HealthReport(n, width, health, scores, tuple(issues), tuple(advice))

    def _outside(self, df: DataFrame, numbers: list[str], unique: dict[str, int], n: int, lost: dict[str, int], ranges: dict) -> tuple[dict, dict]:
        """column -> (rows, percent): outliers of columns with enough of a spread, infinite values among them; and all anomalies, of finite values."""
        if not numbers:
            return {}, {}
        v = lambda c: value(df, c).cast("double")
        q = exact_quantiles(df, numbers, (0.25, 0.75), v, (n, ranges))
        endless = [c for c in numbers if ranges[c][1] or ranges[c][2]]
        own = q | exact_quantiles(df, endless, (0.25, 0.75), lambda c: finite(df, c))
        span = lambda x: (x[0] - 1.5 * (x[1] - x[0]), x[1] + 1.5 * (x[1] - x[0]))
        able = [c for c in numbers if unique[c] > 5 and n - lost[c] > 10 and q[c] and q[c][1] > q[c][0]]
        ask = {("o", c): F.count_if((v(c) < span(q[c])[0]) | (v(c) > span(q[c])[1])) for c in able}
        ask |= {("a", c): F.count_if(outside(df, c, *span(own[c]))) for c in numbers if own[c]}
        row = dict(zip(ask, df.agg(*[x.alias(f"x{i}") for i, x in enumerate(ask.values())]).first())) if ask else {}
        outliers = {c: (row["o", c], row["o", c] / (n - lost[c]) * 100) for c in able}
        there = {c: ranges[c][0] - ranges[c][1] - ranges[c][2] for c in numbers}
        anomalies = {c: (row["a", c], round(row["a", c] * 100.0 / there[c], 4)) for c in numbers if own[c]}
        return {c: x for c, x in outliers.items() if x[1] > 3.0}, anomalies
