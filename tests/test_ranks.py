"""Rank correlations by ranges, against all pairs of rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators.inspect import correlation_table
from sievework.plans import ranks


def by_pairs(a, b, n):
    return sum(n[i] * n[j] * np.sign(b[j] - b[i]) for i in range(len(a)) for j in range(len(a)) if a[i] < a[j])


def test_concordance():
    rng = np.random.default_rng(1)
    for _ in range(40):
        m = int(rng.integers(0, 40))
        a, b, n = rng.integers(0, 12, m).astype(float), rng.integers(0, 12, m).astype(float), rng.integers(1, 5, m)
        assert ranks.concordance(a, b, n) == by_pairs(a, b, n)


@pytest.mark.parametrize("size", [1_000_000, 15])
def test_correlations_by_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "RANGE_ROWS", size)
    rng = random.Random(3)
    rows = [(0.0 if rng.random() < 0.4 else float(rng.randrange(60)), rng.choice([None, *map(float, range(25))]), rng.gauss(0, 1)) for _ in range(240)]
    rows = [(a, b, c + 0.1 * a) for a, b, c in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    tau = {(r.column_a, r.column_b): r.correlation for r in correlation_table(df, "kendall").collect()}
    rho = {(r.column_a, r.column_b): r.correlation for r in correlation_table(df, "spearman").collect()}
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            u, v = both.T
            one = np.ones(len(u), int)
            free = [sum(p[s] != p[t] for s in range(len(p)) for t in range(s)) for p in (u, v)]
            assert tau[x, y] == pytest.approx(by_pairs(u, v, one) / math.sqrt(free[0] * free[1]))
            rank = [np.array([(p < q).sum() + ((p == q).sum() + 1) / 2 for q in p]) for p in (u, v)]
            assert rho[x, y] == pytest.approx(np.corrcoef(*rank)[0, 1])
    none = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    assert all(r.correlation is None for m in ("kendall", "spearman") for r in correlation_table(none, m).collect())
    assert df.filter(F.lit(False)).count() == 0


def test_detector_runs_few_jobs(spark):
    from sievework.operators.detector import IssueDetector

    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, "x" if i % 2 else "X ", "2024-01-02", float("inf") if i == 3 else 1.0 * i) for i in range(60)], "i int, a double, s string, d string, e double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("detector", "detector")
    report = IssueDetector().inspect(df)
    jobs = tracker.getJobIdsForGroup("detector")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    print(len(jobs))
    assert len(jobs) <= 20 and {"Dates stored as text", "Inconsistent case or white space", "Missing values"} <= {i.title for i in report.issues}
