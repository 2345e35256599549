import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sievework import api
from sievework.errors import DataTypeConversionError, DataValidationError, DependencyError, DeserializationError, EncodingError, RegistryError
from sievework.operators import clean as C
from sievework.plans import cleaning as P


def cells(df, c):
    return [r[c] for r in df.orderBy("i").collect()]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.0, "  Hi ", "5"), (2, None, "n/a", "x"), (3, 3.0, None, "7.0"), (4, float("nan"), "Caf\xc3\xa9", "1d"), (5, 3.0, "a\x01b�", None)]
    return spark.createDataFrame(rows, "i int, x double, t string, n string")


def test_drops(small):
    assert api.drop_missing_rows(small, ["x"]).count() == 3 and api.drop_missing_rows(small).count() == 1
    assert api.drop_missing_cols(small).columns == ["i"] and api.drop_missing_cols(small, ["i"]).columns == ["x", "t", "n"]
    assert api.drop_cols(small, "x").columns == ["i", "t", "n"]
    with pytest.raises(KeyError, match="Your columns are"):
        api.drop_cols(small, ["absent"])
    with pytest.raises(ValueError):
        api.drop_cols(small, [])


def test_fills(small):
    assert cells(C.FillMissing("mean", None, ["x"]).apply(small), "x") == pytest.approx([1, 7 / 3, 3, 7 / 3, 3])
    assert cells(C.FillMissing("median", None, ["x"]).apply(small), "x") == [1, 3, 3, 3, 3]
    assert cells(C.FillMissing("constant", "?", ["t"]).apply(small), "t")[2] == "?"
    assert cells(api.fill_missing(small), "n")[4] == "1d"
    with pytest.raises(DataValidationError, match="fix_types"):
        api.fill_missing(small, "mean", cols=["t"])
    with pytest.raises(DataValidationError):
        C.FillMissing("constant", "text", ["x"]).apply(small)
    with pytest.raises(ValueError):
        api.fill_missing(small, "best")
    _, r = C.FillMissing("mean", None, ["x"]).apply_with_result(small)
    assert (r.rows_affected, r.columns_affected) == (2, 1)


def test_text(spark, small):
    assert cells(api.fix_tokens(small, ["t"]), "t") == ["  Hi ", None, None, "Caf\xc3\xa9", "a\x01b�"]
    assert cells(api.lowercase(small, ["t"]), "t")[0] == "hi" and cells(api.uppercase(small, ["t"]), "t")[0] == "HI"
    assert cells(api.fix_encoding(small, ["t"]), "t")[4] == "ab"
    odd = spark.createDataFrame([(1, "o'neil 3rd"), (2, "Ａ x"), (3, "é"), (4, " "), (5, None)], "i int, t string")
    assert cells(api.titlecase(odd), "t") == ["O'Neil 3Rd", "Ａ X", "\xc9", None, None]
    assert cells(api.normalize_text(odd), "t") == ["o'neil 3rd", "A x", "\xe9", None, None]
    with pytest.raises(EncodingError):
        C.EncodingRepairOperation(["t"]).apply(small)
    with pytest.raises(DependencyError):
        api.fix_encoding(small, mode="advanced")
    _, r = C.MissingTokenOperation(["hi"]).apply_with_result(small, dry_run=True)
    assert r.rows_affected == 2 and r.dry_run


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB \t ééＡﬁn/")), max_size=8), min_size=20, max_size=30))
def test_text_is_idempotent(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for case in ("none", "lower", "upper", "title"):
        op = C.TextNormalizationOperation(["t"], "NFKC", True, case)
        once = op.apply(df)
        assert cells(once, "t") == cells(op.apply(once), "t")


def test_coercion(small):
    assert cells(api.cast(small, {"n": "float64"}), "n") == [5.0, None, 7.0, None, None]
    out = api.cast(small, {"n": "int64", "t": "string"})
    assert cells(out, "n") == [5, None, 7, None, None] and dict(out.dtypes)["n"] == "bigint" and cells(out, "t")[0] == "  Hi "
    with pytest.raises(DataTypeConversionError, match="'x'"):
        api.cast(small.filter("i < 3"), {"n": "float64"}, errors="raise")
    with pytest.raises(DataValidationError):
        api.cast(small, {"n": "complex"})
    _, r = C.TypeCoercionOperation({"n": "float64"}).apply_with_result(small)
    assert (r.rows_affected, r.columns_affected) == (2, 1)


def test_fix_types_and_dates(spark):
    df = spark.createDataFrame([(i, str(i), str(i) + ".5", f"z{i}", str(i), f"2024/01/{i:02d}") for i in range(10, 30)], "i int, a string, b string, c string, zip_code string, d string")
    assert {c: t for c, t in api.fix_types(df).dtypes} == {"i": "int", "a": "bigint", "b": "double", "c": "string", "zip_code": "string", "d": "string"}
    assert str(cells(api.cast(df, {"d": "datetime64[ns]"}), "d")[0]) == "2024-01-10 00:00:00"


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "i int, k string")
    got = lambda keep: sorted(r.i for r in C.DropDuplicates(["k"], keep, ["i"]).apply(df).collect())
    assert got("first") == [1, 3, 4] and got("last") == [2, 3, 5] and got(False) == [3]
    near = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "i int, k string")
    assert sorted(r.i for r in C.NearDuplicateRemoval(["k"], keep="last", order_by=["i"]).apply(near).collect()) == [2, 3]


def test_engine_dry_run_is_against_the_original(small):
    ops = [C.MissingTokenOperation((), ["t"]), C.DropMissingRows(["t"])]
    wet = P.CleaningEngine(ops).run_with_result(small)
    dry = P.CleaningEngine(ops).run_with_result(small, dry_run=True, chunk_size=2)
    assert [a["rows_affected"] for a in wet.audit_log] == [1, 2] and [a["rows_affected"] for a in dry.audit_log] == [1, 1]
    assert dry.data is small and len(dry.audit()) == 2 and "operations" in dry.to_json()
    assert [o.rows_affected for o in P.CleaningEngine(ops).run_with_result(small, True, cumulative=True).operations] == [1, 2]
    with pytest.raises(ValueError):
        P.CleaningEngine(ops).run_with_result(small, chunk_size=0)


def test_auto_clean(spark):
    df = spark.createDataFrame([("a  b", "N/A"), ("a b", None), ("x\x01y", "v")], "t string, u string")
    r = api.clean(df)
    assert r.data.count() == 2 and (r.health_before, r.health_after) == (92, 88) and len(r.operations) == 4
    assert {x.t for x in r.data.collect()} == {"a b", "xy"}
    assert api.clean(df, dry_run=True).data.count() == 3
    assert {x.t for x in api.clean_text(df).collect()} == {"a b", "xy"}


def test_plan_and_registry(small):
    plan = P.CleaningPlan([P.PlanStep(C.DropMissingRows(["x"])), P.PlanStep(C.DropColumns(["n"]))])
    plan.disable(2)
    assert "[ ]" in plan.show() and plan.apply(small).data.columns == small.columns
    with pytest.raises(KeyError):
        plan.enable(3)
    text = plan.serialize().to_json()
    assert P.CleaningPlan.deserialize(P.ReplayablePlan.from_json(text)).operations()[0].subset == ["x"]
    for bad in ("{", '{"operations": [{"name": "zap"}]}', '{"operations": [{"name": "drop_columns", "params": {"columns": []}}]}'):
        with pytest.raises(DeserializationError):
            P.CleaningPlan.deserialize(P.ReplayablePlan.from_json(bad))
    registry = C.builtin_registry()
    assert len(registry) == 10
    with pytest.raises(RegistryError):
        registry.register(C.DropColumns)


def test_pipeline(small):
    r = P.PipelineEngine([P.CallableStep(lambda d: d.filter("i > 1"), "some"), P.CallableStep(lambda d: d.withColumn("y", F.lit(1)), "add")]).run(small, collect_metrics=True)
    assert [s.rows for s in r.steps] == [4, 4] and r.steps[1].columns == 5
    with pytest.raises(TypeError):
        P.PipelineEngine([P.CallableStep(lambda d: 1, "bad")]).run(small)
    with pytest.raises(RuntimeError, match="bad"):
        P.PipelineEngine([P.CallableStep(lambda d: d.select("absent"), "bad")]).run(small)


def test_fills_read_what_made_the_frame_once(spark):
    """Statistics of several fills take one run of the steps before them, and keep nothing afterwards."""
    from pyspark.sql import functions as F

    from sievework.functions import kernels as K
    from sievework.operators import clean as C

    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame([(1, "a"), (3, "b"), (None, "b"), (5, None)], "x int, t string").withColumn("x", counted("x"))
    fills, lost, n = C.fused_fills(df, [C.FillMissing("median", None, ["x"]), C.FillMissing("mode", None, ["t"])])
    assert (fills, lost, n) == ([{"x": 3.0}, {"t": "b"}], {"x": 1, "t": 1}, 4)
    assert seen.value == 4 and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    odd = spark.createDataFrame([(" A\t b ", 1e10, True, None)], "t string, d double, f boolean, e string").select("*", F.lit("2020-01-01 01:02:03").cast("timestamp").alias("at"))
    assert odd.select(K.match_key(odd, odd.columns)).first()[0] == "a b\x1f1.0e10\x1ftrue\x1f\x1f2020-01-01 01:02:03"
