import re

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sievework.functions import kernels as K

ALPHABET = "aB \t\n\x0b\x1c\x1f\x85\xa0   　éÃ©�\x01\x7f12.,-:é"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(ALPHABET)), max_size=12), min_size=40, max_size=60))
def test_text_kernels_match_python(spark, texts):
    c = F.col("t")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", K.strip(c).alias("strip"), K.collapse(c).alias("flat"), K.token_count(c).alias("n"), K.irregular_space(c).alias("irr"), K.has_control(c).alias("ctl"), K.has_mojibake(c).alias("moji"), K.repair(c).alias("fix"), K.is_missing_token(c).alias("tok"), K.is_filler(c).alias("fill")).collect()
    moji = re.compile("[\xc0-\xc3][\x80-\xff]|\xc3[^\\s]|\xe2\x80[\x93\x94\x98\x99\x9c\x9d\xa2\xa6\xa0]")
    for r in rows:
        t = texts[r.i]
        assert r.strip == t.strip() and r.flat == " ".join(t.split()) and r.n == len(t.split())
        assert r.irr == bool(re.search(r"^\s|\s$|\s{2,}", t)) and r.moji == bool(moji.search(t))
        assert r.ctl == bool(re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", t))
        assert r.fix == (re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t).replace("�", "") or None)


def test_numbers_match_pandas(spark):
    texts = [" 5 ", "+5", "1.", "-.5", "1e5", "inf", "-Infinity", "nan", "1,000", "0x1A", "1_0", "1d", "1f", "5%", "", " ", "--1", "1e", ".", "١", "12\n", "abc", "0012"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(K.to_number(F.col("t"))).collect()]
    want = pd.to_numeric(pd.Series(texts), errors="coerce")
    for t, g, w in zip(texts, got, want):
        assert (g is None and pd.isna(w)) or g == w, t


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 9.0], [5.0, 5.0, 5.0, 5.0], [1.0, 2.0, 3.0], [1.0, 2.0], [1.0], [1.0, None, float("nan"), 7.0, 8.0, -3.0]])
def test_shape_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    skew, kurt = df.agg(K.corrected_skewness(K.finite(df, "x")), K.corrected_kurtosis(K.finite(df, "x"))).first()
    s = pd.Series(values, dtype=float)
    for got, want in ((skew, s.skew()), (kurt, s.kurt())):
        assert (got is None and pd.isna(want)) or got == pytest.approx(want, abs=1e-9)


def test_missing_and_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (float("inf"), "b"), (None, "c")], "x double, `odd name.x` string")
    assert df.agg(F.count_if(K.missing(df, "x")), F.count_if(K.missing(df, "odd name.x")), F.count(K.finite(df, "x"))).first() == (2, 1, 1)
    assert K.numeric_columns(df) == ["x"] and K.string_columns(df) == ["odd name.x"]


def test_regular_texts_skip_the_costly_patterns(spark):
    from pyspark.sql import functions as F

    parts = ["", " ", "  ", "\t", " ", "\xa0", "a", "N/A", "null", "İ", "\U0001f600", "\n", "\x1f"]
    texts = sorted({a + b + c + d for a in parts for b in parts for c in parts for d in ("", " ", "b")})
    c = F.col("t")
    old_space = F.regexp_replace(F.regexp_replace(c, K.SPACE + "+", " "), "^ | \\z", "")
    old_token = F.lower(K.strip(c)).isin(*sorted(K.MISSING_TOKENS | {"a b"}))
    df = spark.createDataFrame([(t,) for t in [*texts, None, "x" * 100_000, "x " * 50_000]], "t string")
    assert df.filter(~K.collapse(c).eqNullSafe(old_space) | ~K.is_missing_token(c, ["a b"]).eqNullSafe(old_token)).count() == 0
    plan = df.select(K.collapse(c).alias("a"), K.is_missing_token(c).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2
