import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import kernels as K
from sievework.operators.clean import FillMissing
from sievework.plans import quantiles


@pytest.mark.parametrize("few", [2_000, 3])
def test_refined_quantiles_match_pandas(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "EXACT_ROWS", 0)
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 16)
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"a": rng.normal(size=700), "b": np.exp(rng.normal(size=700) * 8), "c": rng.integers(0, 4, 700).astype(float), "d": [5.0] * 700, "e": [None] * 700})
    p.loc[::7, "a"] = None
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "a double, b double, c double, d double, e double")
    got = quantiles.exact_quantiles(df, list(p), (0.25, 0.5, 0.75, 1.0), lambda c: K.finite(df, c))
    for c in "abcd":
        assert got[c] == pytest.approx(p[c].astype(float).quantile([0.25, 0.5, 0.75, 1.0]).tolist(), rel=1e-9)
    assert got["e"] is None
    assert FillMissing("median", None, ["a"]).fills(df)["a"] == pytest.approx(p["a"].median())


@pytest.mark.parametrize("kind", ["infinite", "adjacent", "all infinite", "tiny", "huge", "plain"])
def test_histograms_end_and_match(spark, monkeypatch, kind):
    """Infinite values, NaN, adjacent doubles and great spans: the same as percentile(), whatever the number of rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=200).tolist()
    if kind == "infinite":
        x += [float("inf")] * 30 + [float("-inf")] * 60 + [float("nan"), None]
    elif kind == "adjacent":
        x = [1.0] * 90 + [np.nextafter(1.0, 2)] * 90 + [5e-324, 0.0, -0.0]
    elif kind == "all infinite":
        x = [float("inf")] * 5 + [float("-inf")] * 4
    elif kind == "tiny":
        x = [0.0] * 50 + [5e-324] * 60
    elif kind == "huge":
        x = [-1.7e308, 1.7e308, 0.0, *x]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in x], "x double").repartition(3)
    of = lambda c: F.when(~F.isnan(c), F.col(c))
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    want = quantiles.exact_quantiles(df, ["x"], probs, of)["x"]
    monkeypatch.setattr(quantiles, "EXACT_ROWS", 0)
    monkeypatch.setattr(quantiles, "FEW", 3)
    got = quantiles.exact_quantiles(df, ["x"], probs, of)["x"]
    assert got == pytest.approx(want, rel=1e-12, nan_ok=True)
