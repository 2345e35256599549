import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from sievework import api
from sievework.errors import DependencyError
from sievework.operators import inspect as I
from sievework.operators.detector import IssueDetector
from sievework.core import Cleaner

RAW = "id bigint, name string, age double, day string, constant_col bigint, empty_col string, flag boolean"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, f"n{i}", None if i in (2, 5) else 20.0 + i, f"2024-01-{i + 1:02d}", 1, None, i % 2 == 0) for i in range(9)]
    return spark.createDataFrame([*rows, rows[3]], RAW)


def test_missing(raw):
    r = I.MissingValueInspector().inspect(raw)
    assert r.summary.missing_cells == 12 and r.summary.rows_with_missing == 10 and r.reports[0].column == "empty_col"
    assert [x.column for x in I.MissingValueInspector().inspect(raw, threshold=50).reports] == ["empty_col"]
    assert r.frames["mask"].filter("age").count() == 2 and "mask" not in r.to_json()
    with pytest.raises(TypeError):
        r.summary["rows"] = 1


def test_duplicates(raw):
    r = I.DuplicateInspector().inspect(raw)
    assert (r.summary.duplicate_rows, r.summary.unique_rows) == (1, 9) and r.frames["duplicates"].count() == 1
    assert I.DuplicateInspector().inspect(raw, keep=False).summary.duplicate_rows == 2
    assert I.DuplicateInspector().has_duplicates(raw) and not I.DuplicateInspector().has_duplicates(raw.dropDuplicates())
    with pytest.raises(KeyError):
        I.DuplicateInspector().inspect(raw, subset=["nope"])
    with pytest.raises(ValueError):
        I.DuplicateInspector().inspect(raw, keep="both")


def test_nan_and_null_are_one_group(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (-0.0,)], "x double")
    assert I.duplicate_summary(df).first().duplicate_rows == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([float("inf"), float("-inf"), float("nan"), 0.0, 1.0])), min_size=1, max_size=40))
def test_statistics_match_pandas(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int")
    r = {x.column: x for x in I.StatisticsInspector().inspect(df).reports}
    s = pd.Series(values, dtype=float).replace([np.inf, -np.inf], np.nan).dropna()
    if s.empty:
        assert "x" not in r
        return
    x = r["x"]
    assert x.count == len(s) and x.unique == s.nunique() and x.mode == pytest.approx(s.mode().iloc[0])
    for got, want in ((x.mean, s.mean()), (x.q1, s.quantile(0.25)), (x.q3, s.quantile(0.75)), (x.median, s.median()), (x.standard_deviation, s.std() if len(s) > 1 else 0.0)):
        assert got == pytest.approx(want, rel=1e-6, abs=1e-6)
    iqr = x.q3 - x.q1
    assert x.outlier_count == ((s < x.q1 - 1.5 * iqr) | (s > x.q3 + 1.5 * iqr)).sum()


def test_dtypes_memory_profile(raw):
    d = {r.column: r for r in I.DatatypeInspector().inspect(raw).reports}
    assert d["name"].semantic == "string" and d["empty_col"].dtype == "object" and d["flag"].semantic == "boolean" and d["id"].recommended == "Int64"
    assert d["name"].recommended == "string" and d["constant_col"].unique == 1
    m = I.MemoryInspector().inspect(raw)
    assert m.summary.estimated_saved_bytes >= 0 and m.reports[0].bytes == max(r.bytes for r in m.reports)
    assert {r.column: r.recommended for r in m.reports}["id"] == "int8"
    assert len(I.MemoryInspector().largest_columns(raw, 2)) == 2
    p = api.profile(raw)
    assert p.missing.summary.rows == 10 and set(p) == {"dtypes", "missing", "duplicates", "memory", "statistics"}
    assert api.report(raw).sections[0].title == "Overview"


def test_anomalies(spark):
    df = spark.createDataFrame([(float(v), "t", True) for v in [1, 2, 3, 2, 1, 2, 3, 1000]] + [(None, "t", False), (float("inf"), "t", False)], "num double, text string, flag boolean")
    r = api.anomalies(df)
    assert [x.column for x in r.reports] == ["num"] and r.summary.total_anomalies == 1 and r.frames["rows"].first()["num"] == 1000
    assert api.anomalies(df, "zscore").summary.total_anomalies == 0
    with pytest.raises(ValueError, match="iqr"):
        api.anomalies(df, "other")


def test_near_duplicates(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b "), (3, None), (4, ""), (5, "  "), (6, "z")], "i int, t string")
    r = api.near_duplicates(df, ["t"])
    assert (r.summary.groups, r.summary.duplicate_count) == (2, 3)
    assert sorted(x["size"] for x in r.frames["groups"].collect()) == [2, 3]
    with pytest.raises(DependencyError):
        api.near_duplicates(df, ["t"], "similarity")
    with pytest.raises(ValueError):
        I.NearDuplicateDetector().detect(df, subset=["nope"])


def test_text_quality(spark):
    df = spark.createDataFrame([("hello world",), ("  ",), ("Lorem  ipsum dolor",), ("caf�",), ("TBD",), (None,)], "t string")
    r = api.text_quality(df)[0]
    assert (r["count"], r.empty_count, r.boilerplate_count, r.garbage_count, r.max_tokens, r.min_chars) == (5, 1, 2, 1, 3, 2)
    with pytest.raises(DependencyError):
        I.TextQualityAnalyzer().analyze(df, mode="advanced")


def test_correlations(spark):
    p = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, 4.0, 9.0], "b": [2.0, 1.0, 3.0, 3.0, 8.0, 7.0]})
    df = spark.createDataFrame(p)
    for m in ("pearson", "spearman"):
        got = {(r.column_a, r.column_b): r.correlation for r in I.correlation_table(df, m).collect()}
        assert got["a", "b"] == pytest.approx((p.rank() if m == "spearman" else p).corr().loc["a", "b"])
    s = [np.sign((x - y) * (u - v)) for i, (x, u) in enumerate(p.values) for y, v in p.values[i + 1 :]]
    ties = [sum(x != y for i, x in enumerate(p[c]) for y in p[c][i + 1 :]) for c in "ab"]
    tau = {(r.column_a, r.column_b): r.correlation for r in I.correlation_table(df, "kendall").collect()}
    assert tau["a", "b"] == pytest.approx(sum(s) / math.sqrt(ties[0] * ties[1]))
    assert {(r.column_a, r.column_b): r.covariance for r in I.covariance_table(df).collect()}["a", "b"] == pytest.approx(p.cov().loc["a", "b"])


def test_empty_frames(spark):
    df = spark.createDataFrame([], "a string, b double")
    for f in (api.missing, api.duplicates, api.dtypes, api.stats, api.memory, api.anomalies, api.near_duplicates, api.text_quality, api.profile):
        with pytest.raises(ValueError, match="empty"):
            f(df)
    r = IssueDetector().inspect(df)
    assert r.health_score == 0 and r.issues[0].severity == "CRITICAL"
    with pytest.raises(TypeError):
        api.missing([1, 2])


def test_detector_and_plan(raw):
    from sievework.config import CleanerConfig

    mine = Cleaner(CleanerConfig(("n3",), 50.0))
    assert [x.column for x in mine.missing(raw).reports] == ["empty_col"] and mine.fix_tokens(raw).filter("name is null").count() == 2
    r = Cleaner().inspect(raw)
    titles = {(i.title, i.columns) for i in r.issues}
    assert ("Column is empty", ("empty_col",)) in titles and ("Constant column", ("constant_col",)) in titles and ("Dates stored as text", ("day",)) in titles
    assert r.scores["uniqueness"] == pytest.approx(90) and 0 < r.health_score < 100 and r.critical_count == len(r.by_severity("critical"))
    plan = Cleaner().plan(r)
    out = Cleaner().clean(raw, plan)
    assert out.data.count() == 9 and "empty_col" not in out.data.columns and "constant_col" not in out.data.columns
    assert out.data.filter("age is null").count() == 0
    again = api.replay(api.serialize(plan), raw)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.data.collect()))


def test_statistics_find_quartiles_once_and_moments_by_cell(spark, monkeypatch):
    """One search of quartiles serves the outliers too; the moments' code does not grow with the columns; groups of numbers hold no text."""
    from sievework.operators import inspect as I
    from sievework.plans.metrics import value_counts

    calls, real = [], I.exact_quantiles
    monkeypatch.setattr(I, "exact_quantiles", lambda *a, **k: calls.append(1) or real(*a, **k))
    df = spark.createDataFrame([(float(i), i % 3, None if i == 5 else [i % 2]) for i in range(20)] + [(1000.0, 2**60 + 1, None), (float("inf"), 2**60, None), (None, None, None)], "x double, n bigint, a array<int>")
    r = {r.column: r for r in I.StatisticsInspector().inspect(df).reports}
    assert calls == [1] and r["x"].outlier_count == 1 and r["x"].infinite_count == 1 and r["x"].missing == 1 and r["x"].unique == 21
    plan = I.statistics_table(df, ["x", "n"], None, {"x": [0.0, 1.0, 2.0], "n": None})._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("skewness(") == I.statistics_table(df, ["x"], None, {})._jdf.queryExecution().executedPlan().toString().count("skewness(")
    assert "as string" not in value_counts(df, ["x", "n"])._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1].split("\n", 1)[1].lower()
    counts = {(v["column"], v["value"]): v["n"] for v in value_counts(df, df.columns).collect()}
    assert counts["n", str(2**60)] == counts["n", str(2**60 + 1)] == 1 and counts["x", "Infinity"] == 1 and sum(n for (c, _), n in counts.items() if c == "a") == 19


def test_tokens_are_counted_once_a_row(spark):
    from pyspark.sql import functions as F

    from sievework.functions import kernels as K
    from sievework.operators import inspect as I

    texts = ["", " ", "a", " a ", "a b", "\ta  bc\n\nd \x1f", "\U0001f600\U0001f600 x", "　", "$1 \\ $", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(K.token_count(F.col("text"))).collect()] == [None if t is None else len(t.split()) for t in texts]
    t = I.text_quality_table(df, ["text"], ["count", "min_tokens", "max_tokens", "mean_tokens", "median_tokens", "max_chars"])
    assert t._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert tuple(t.first())[1:5] == (9, 0, 3, sum(len(x.split()) for x in texts[:-1]) / 9)
