import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework import api
from sievework.errors import DependencyError, SchemaValidationError
from sievework.operators import features as E, rules as R
from sievework.plans.report import FileExporter, JSONRenderer, ReportEngine, StringExporter
from sievework.sources import files
from sievework.streaming import clean as S
from sievework.operators import clean as C

CASES = {
    "missing_values": ([(1, None), (2, "x")], "a int, b string", [(1, "y")], 1),
    "duplicate_rows": ([(1,), (1,), (2,)], "a int", [(1,), (2,)], 2),
    "duplicate_columns": ([(1, 1.0), (2, 2.0)], "a int, b double", [(1, 2.0)], 0),
    "invalid_dtypes": ([("1",), ("2",), ("3",)], "a string", [("1",), ("x",)], 3),
    "outliers": ([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 1000]], "a double", [(1.0,), (2.0,)], 1),
    "constant_columns": ([(7,), (7,)], "a int", [(7,), (8,)], 0),
    "high_cardinality": ([(f"id-{i}",) for i in range(10)], "a string", [("x",)] * 5, 0),
    "whitespace": ([(" leading",), ("trailing ",), ("two  spaces",), ("ok",)], "a string", [("ok",)], 3),
    "string_case": ([("Yes",), ("yes",), ("no",)], "a string", [("yes",), ("no",)], 0),
    "column_names": ([(1,)], "`First Name` int", None, 0),
}


@pytest.mark.parametrize("rule", CASES)
def test_builtin_rule(spark, rule):
    rows, schema, good, affected = CASES[rule]
    (r,) = api.validate(spark.createDataFrame(rows, schema), [rule])
    assert not r.passed and r.severity == "warning" and r.affected_rows == affected
    if good:
        (r,) = api.validate(spark.createDataFrame(good, schema), [rule])
        assert r.passed and r.severity == "info"


def test_custom_rule(spark):
    class Tall(R.BaseRule):
        name = "tall"

        def evaluate(self, df):
            return self.verdict((), df.count(), df.count() > 2)

    registry = R.builtin_rules()
    registry.register(Tall())
    assert not R.RuleEngine(registry).run(spark.range(5).toDF("a"))[-1].passed


def test_contract(spark):
    df = spark.createDataFrame([(1, "x", "123", 1.0), (5, None, "abc", 3.0), (99, "y", None, 3.0)], "a int, b string, c string, d double")
    got = {r.rule: (r.passed, r.affected_rows) for r in api.contract(df, {"a": {"dtype": "int32", "min": 1, "max": 10}, "b": {"nullable": False, "allowed_values": ["x"]}, "c": {"regex": "[0-9]+"}, "d": {"unique": True}, "z": {}})}
    assert got == {
        "contract.column_exists[a]": (True, 0), "contract.dtype[a]": (True, 0), "contract.range[a]": (False, 1), "contract.column_exists[b]": (True, 0), "contract.nullable[b]": (False, 1),
        "contract.allowed_values[b]": (False, 1), "contract.column_exists[c]": (True, 0), "contract.regex[c]": (False, 1), "contract.column_exists[d]": (True, 0), "contract.unique[d]": (False, 2), "contract.column_exists[z]": (False, 0),
    }
    for bad in ({"b": {"min": 1}}, {"a": {"min": 5, "max": 1}}, {"b": {"regex": "("}}, {"a": {"what": 1}}):
        with pytest.raises(SchemaValidationError):
            api.contract(df, bad)


def test_features(spark):
    p = pd.DataFrame({"a": [1, 2, 3], "b": [2.0, 0.0, 4.0], "t": ["u", None, "v"], "ts": pd.to_datetime(["2023-03-15 10:30:00", "2024-07-04 22:15:45", "2024-12-30 00:00:00"])})
    df = spark.createDataFrame(p)
    assert [r.a_x_b for r in api.interaction(df, "a", "b").collect()] == [2, 0, 12]
    assert [r.a_div_b for r in api.ratio(df, "a", "b").collect()] == [0.5, None, 0.75]
    with pytest.raises(ZeroDivisionError):
        api.ratio(df, "a", "b", zero_division="raise")
    assert api.poly(df, "a", 3).columns[-2:] == ["a^2", "a^3"] and dict(api.poly(df, "a").dtypes)["a^2"] == "bigint"
    assert [r.log_b for r in api.log(df, "b").collect()] == pytest.approx([math.log(3), 0, math.log(5)])
    with pytest.raises(ValueError):
        E.LogFeature("b").fit(df)
    row = api.datetime_features(df, "ts", ["day_of_week", "week", "quarter", "second"]).collect()[1]
    assert (row.ts_day_of_week, row.ts_week, row.ts_quarter, row.ts_second) == (3, 27, 3, 45)
    d = api.dummies(df, "t")
    assert d.columns == ["a", "b", "ts", "t_u", "t_v"] and [r.t_u for r in d.collect()] == [True, False, False]
    assert [r.a for r in api.normalize(df, "a").collect()] == [0, 0.5, 1] and [r.a for r in api.standardize(df, "a").collect()] == [-1, 0, 1]
    with pytest.raises(RuntimeError):
        E.PolynomialFeature("a").transform(df)
    with pytest.raises(TypeError):
        api.interaction(df, "a", "t")
    with pytest.raises(TypeError):
        E.DatetimeFeatures("a").fit(df)
    e = E.FeatureEngineeringEngine([E.ColumnInteraction("a", "b", "x"), E.PolynomialFeature("x")])
    assert "x^2" in e.fit_transform(df).columns and e.get_params()[0]["operation"] == "ColumnInteraction"
    assert api.rename(df, {"a": "z", "no": "x"}).columns[0] == "z" and api.select(df, ["b", "a"]).columns == ["b", "a"]


def test_sources_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    for end in (".parquet", ".orc", ".csv", ".tsv", ".jsonl"):
        files.write(df, str(tmp_path / f"x{end}"))
        assert files.read(spark, str(tmp_path / f"x{end}"), "i int, t string").count() == 2
    import pyarrow.feather as feather

    feather.write_feather(df.toArrow(), str(tmp_path / "x.feather"))
    assert files.read(spark, str(tmp_path / "x.feather")).count() == 2
    with pytest.raises(DependencyError):
        files.read(spark, "x.xlsx")
    with pytest.raises(ValueError):
        files.read(spark, "x.zzz")
    r = ReportEngine().run({"some_part": {"n": 1, "bad": float("nan")}})
    assert '"bad": null' in StringExporter().export(r, JSONRenderer())
    assert FileExporter(tmp_path / "deep" / "r.json").export(r).exists()
    api.report(df, save=tmp_path / "profile.txt")
    assert "Overview" in (tmp_path / "profile.txt").read_text()


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, " N/A " if i % 2 else "Ok  x", f"2024-01-01 00:0{i}:00") for i in range(6)], "i int, t string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = S.drop_duplicates_within(S.clean_stream(stream, [C.MissingTokenOperation((), ["t"])]), "ts", "1 minute", ["i"])
    q = out.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) n, count(t) m from cleaned").first() == (6, 3)
    with pytest.raises(ValueError):
        S.clean_stream(stream, [C.DropDuplicates()])
    assert S.windowed_missing(stream, "ts", "5 minutes", "1 minute").isStreaming
    assert S.observe_contract(stream, {"i": {"min": 0}}).isStreaming
