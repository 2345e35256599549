"""Registered queries of the data-quality operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import api
from .core import Cleaner
from .functions import kernels as K
from .operators import clean as C, features as E, inspect as I, rules as R
from .operators.detector import IssueDetector
from .plans import cleaning as P
from .plans.metrics import distinct_and_mode, per_column
from .plans.quantiles import exact_quantiles
from .plans.report import FileExporter, JSONRenderer, ReportEngine, StringExporter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Dirty views, in SQL that both engines read alike.

DIRTY_ORDERS = """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_day, 1 AS constant_col, CAST(NULL AS STRING) AS empty_col, o_orderkey % 2 = 0 AS flag
  FROM {orders})
SELECT * FROM b UNION ALL SELECT * FROM b WHERE o_orderkey % 20 = 0
"""
BAD, ACCENT, CTRL = chr(0xFFFD), "\xc3\xa9", "\x01"
DIRTY_PARTS = f"""
SELECT p_partkey,
  CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('  ', p_name) WHEN 2 THEN concat(p_name, ' ') WHEN 3 THEN replace(p_name, ' ', '   ') ELSE p_name END AS name_variant,
  CASE WHEN p_partkey % 13 = 0 THEN 'N/A' WHEN p_partkey % 17 = 0 THEN ' null ' WHEN p_partkey % 19 = 0 THEN '-' WHEN p_partkey % 29 = 0 THEN '' ELSE p_type END AS type_token,
  CASE WHEN p_partkey % 23 = 0 THEN concat(p_name, '{BAD}') WHEN p_partkey % 31 = 0 THEN concat('Caf{ACCENT} ', p_name) WHEN p_partkey % 37 = 0 THEN '{BAD}{BAD}'
    WHEN p_partkey % 41 = 0 THEN concat('a{CTRL}', p_name) ELSE p_name END AS enc_text,
  CASE WHEN p_partkey % 43 = 0 THEN '1d' WHEN p_partkey % 47 = 0 THEN 'abc' WHEN p_partkey % 53 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS size_text,
  p_retailprice
FROM {{part}}
"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "order_day", "constant_col", "empty_col", "flag"]
PART_TEXTS = ["name_variant", "type_token", "enc_text", "size_text"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "dirty_orders":
        return spark.sql(DIRTY_ORDERS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    if name == "dirty_parts":
        return spark.sql(DIRTY_PARTS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WITH = f"WITH dirty_orders AS ({DIRTY_ORDERS.format(orders='orders')}), dirty_parts AS ({DIRTY_PARTS.format(part='part')})\n"


def add(name: str, source: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir, source))
    if sql:
        ORACLES[name] = (_WITH + sql) if "dirty_" in sql else sql


def each(columns: list[str], template: str) -> str:
    """One SELECT a column, with @ for its name."""
    return " UNION ALL ".join(template.replace("@", c) for c in columns)


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Missing values

_MISS = "SELECT '@' AS \"column\", count(*) - count(@) AS missing, count(*) AS total, round((count(*) - count(@)) * 100.0::DOUBLE / count(*), 3) AS percent, count(*) = count(@) AS complete FROM dirty_orders"
_miss = lambda df: I.missing_table(df).withColumn("percent", F.round("percent", 3))
add("missing_columns", "dirty_orders", _miss, each(ORDER_COLUMNS, _MISS))
add("missing_threshold", "dirty_orders", lambda df: _miss(df).filter("percent >= 8"), f"SELECT * FROM ({each(ORDER_COLUMNS, _MISS)}) WHERE percent >= 8")
_any = " OR ".join(f"{c} IS NULL" for c in ORDER_COLUMNS if c != "empty_col")
add("missing_summary", "dirty_orders", lambda df: df.drop("empty_col").agg(I.rows_with_missing(df.drop("empty_col")).alias("rows_with_missing"), F.count("*").alias("total")), f"SELECT count(*) FILTER (WHERE {_any}) AS rows_with_missing, count(*) AS total FROM dirty_orders")

# Duplicates

_GROUPS = "SELECT count(*) AS n FROM dirty_orders GROUP BY ALL"


def _dup_sql(source: str, keys: list[str], dups: str) -> str:
    k = ", ".join(keys)
    return f"WITH g AS (SELECT {k}, count(*) AS n FROM {source} GROUP BY {k}), s AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(coalesce(sum({dups}), 0) AS BIGINT) AS duplicate_rows FROM g) SELECT total_rows, duplicate_rows, total_rows - duplicate_rows AS unique_rows, round(duplicate_rows * 100.0::DOUBLE / total_rows, 3) AS percent FROM s"


def _inline(sql: str) -> str:
    """Put the dirty views in front of a statement that has its own WITH."""
    return _WITH.rstrip() + ", " + sql.removeprefix("WITH ")


_dup = lambda df, **k: I.duplicate_summary(df, **k).withColumn("percent", F.round("percent", 3))
add("dup_summary_first", "dirty_orders", lambda df: _dup(df))
ORACLES["dup_summary_first"] = _inline(_dup_sql("dirty_orders", ORDER_COLUMNS, "n - 1"))
add("dup_summary_none", "dirty_orders", lambda df: _dup(df, keep=False))
ORACLES["dup_summary_none"] = _inline(_dup_sql("dirty_orders", ORDER_COLUMNS, "CASE WHEN n > 1 THEN n END"))
add("dup_summary_subset", "lineitem", lambda df: _dup(df, subset=["l_orderkey", "l_linenumber"]), _dup_sql("lineitem", ["l_orderkey", "l_linenumber"], "n - 1"))
_SUB, _ORD = ["l_orderkey", "l_linenumber"], "l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax"
_by = _ORD.split(", ")
_row = lambda keep, cond: f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORD if keep == 'first' else ', '.join(x + ' DESC' for x in _by)}) AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE {cond}"
add("dup_rows_first", "lineitem", lambda df: I.duplicate_rows(df, _SUB, "first", _by).select(*LINE_KEY), _row("first", "k > 1"))
add("dup_rows_last", "lineitem", lambda df: I.duplicate_rows(df, _SUB, "last", _by).select(*LINE_KEY), _row("last", "k > 1"))
add("dup_rows_none", "lineitem", lambda df: I.duplicate_rows(df, _SUB, False).select(*LINE_KEY), _row("first", "n > 1"))
add("has_duplicates", "lineitem", lambda df: df.sparkSession.createDataFrame([(I.DuplicateInspector().has_duplicates(df, _SUB),)], "has_duplicates boolean"), "SELECT count(*) > count(DISTINCT (l_orderkey, l_linenumber)) AS has_duplicates FROM lineitem")
add("duplicate_column_names", "part", lambda df: df.sparkSession.createDataFrame([(I.DuplicateInspector().duplicate_column_count(df),)], "n bigint"), "SELECT CAST(0 AS BIGINT) AS n")
for _keep in ("first", "last"):
    add(f"drop_duplicates_{_keep}", "lineitem", lambda df, k=_keep: C.DropDuplicates(_SUB, k, _by).apply(df).select(*LINE_KEY), _row(_keep, "k = 1"))
add("drop_duplicates_none", "lineitem", lambda df: C.DropDuplicates(_SUB, False).apply(df).select(*LINE_KEY), _row("first", "n = 1"))
add("drop_duplicates_rows", "dirty_orders", lambda df: C.DropDuplicates().apply(df).select("o_orderkey", "o_custkey", "order_day", "flag"), "SELECT o_orderkey, o_custkey, order_day, flag FROM (SELECT DISTINCT * FROM dirty_orders)")

# Types

_TYPES = {"o_orderkey": ("int64", "integer"), "o_custkey": ("int64", "integer"), "o_totalprice": ("float64", "float"), "o_orderpriority": ("object", "object"), "order_day": ("string", "string"), "constant_col": ("int32", "integer"), "empty_col": ("object", "object"), "flag": ("bool", "boolean")}
_advice = lambda s: {"integer": "'Int64'", "float": "'Float64'", "boolean": "CAST(NULL AS STRING)"}.get(s, "CASE WHEN count(DISTINCT @) / count(*) < 0.5 THEN 'category' ELSE 'string' END")
add("dtypes_report", "dirty_orders", lambda df: I.dtypes_table(df).drop("memory_bytes"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{d}' AS dtype, '{s}' AS semantic, count(*) - count({c}) AS missing, count(*) AS total, count(DISTINCT {c}) AS \"unique\", {_advice(s).replace('@', c)} AS recommended FROM dirty_orders" for c, (d, s) in _TYPES.items()))
add("memory_model", "dirty_parts", lambda df: I.memory_table(df).select("column", "bytes", "total"), " UNION ALL ".join([f"SELECT '{c}' AS \"column\", CAST(sum(coalesce(strlen({c}), 0) + 16) AS BIGINT) AS bytes, count(*) AS total FROM dirty_parts" for c in PART_TEXTS] + [f"SELECT '{c}' AS \"column\", count(*) * 8 AS bytes, count(*) AS total FROM dirty_parts" for c in ("p_partkey", "p_retailprice")]))
add("memory_largest", "dirty_parts", lambda df: I.memory_table(df).select("column", "bytes").orderBy(F.desc("bytes"), "column").limit(3), "SELECT * FROM (" + " UNION ALL ".join([f"SELECT '{c}' AS \"column\", CAST(sum(coalesce(strlen({c}), 0) + 16) AS BIGINT) AS bytes FROM dirty_parts" for c in PART_TEXTS] + [f"SELECT '{c}' AS \"column\", count(*) * 8 AS bytes FROM dirty_parts" for c in ("p_partkey", "p_retailprice")]) + ") ORDER BY bytes DESC, \"column\" LIMIT 3")

# Statistics

add("stats_moments", "lineitem", lambda df: rounded(I.statistics_table(df, LINE, only=["count", "minimum", "maximum", "mean", "variance", "standard_deviation", "zero_count", "negative_count"]), 3), each(LINE, "SELECT '@' AS \"column\", count(@) AS \"count\", round(min(@), 3) AS minimum, round(max(@), 3) AS maximum, round(avg(@), 3) AS mean, round(var_samp(@), 3) AS variance, round(stddev_samp(@), 3) AS standard_deviation, count(*) FILTER (WHERE @ = 0) AS zero_count, count(*) FILTER (WHERE @ < 0) AS negative_count FROM lineitem"))
add("stats_quantiles", "lineitem", lambda df: rounded(I.statistics_table(df, LINE, quartiles=exact_quantiles(df, LINE, (0.25, 0.5, 0.75), lambda c: K.finite(df, c)), only=["q1", "q2", "q3", "iqr", "median"]), 4), each(LINE, "SELECT '@' AS \"column\", round(quantile_cont(@, 0.25), 4) AS q1, round(quantile_cont(@, 0.5), 4) AS q2, round(quantile_cont(@, 0.75), 4) AS q3, round(quantile_cont(@, 0.75) - quantile_cont(@, 0.25), 4) AS iqr, round(median(@), 4) AS median FROM lineitem"))
add("stats_shape", "events", lambda df: rounded(I.statistics_table(df, ["value"], only=["skewness", "kurtosis"])), "SELECT 'value' AS \"column\", round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis FROM events")
add("stats_mode", "part", lambda df: distinct_and_mode(df, ["p_size", "p_type", "p_name"]).select("column", "distinct", "mode"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM part) AS \"distinct\", (SELECT CAST({c} AS STRING) FROM part GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode" for c in ("p_size", "p_type", "p_name")))
_FENCE = "(SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t})"


def _outlier_sql(t: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers FROM {t}, {_FENCE.format(c=c, t=t)}" for c in columns)


add("stats_outliers", "dirty_orders", lambda df: I.outlier_table(df, ["o_totalprice", "o_custkey"]).select("column", "outliers"), _outlier_sql("dirty_orders", ["o_totalprice", "o_custkey"]))
_QUART = {"25%": "quantile_cont(@, 0.25)", "50%": "quantile_cont(@, 0.5)", "75%": "quantile_cont(@, 0.75)"}
_NUMBERS = {"mean": "avg(@)", "std": "stddev_samp(@)", "min": "min(@)"} | _QUART | {"max": "max(@)"}
add("describe", "part", lambda df: rounded(I.describe_table(df.select("p_size", "p_retailprice", "p_type")), 3), each(["p_size", "p_retailprice"], "SELECT '@' AS \"column\", count(@) AS \"count\", CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, " + ", ".join(f'round(CAST({x} AS DOUBLE), 3) AS "{k}"' for k, x in _NUMBERS.items()) + " FROM part") + " UNION ALL SELECT 'p_type', count(p_type), count(DISTINCT p_type), (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_type)), " + ", ".join(["NULL"] * 7) + " FROM part")
_cols = lambda df: df.select(*LINE)
_pair = lambda f, n: " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({f}({a}, {b}), 3) + 0.0::DOUBLE AS {n} FROM lineitem" for a in LINE for b in LINE)
add("corr_pearson", "lineitem", lambda df: rounded(I.correlation_table(_cols(df)), 3), _pair("corr", "correlation"))
add("covariance", "lineitem", lambda df: rounded(I.covariance_table(_cols(df)), 3), _pair("covar_samp", "covariance"))
_RANKS = "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ("p_size", "p_retailprice")) + " FROM part) "
add("corr_spearman", "part", lambda df: rounded(I.correlation_table(df.select("p_size", "p_retailprice"), "spearman")), _RANKS + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS correlation FROM r" for a in ("p_size", "p_retailprice") for b in ("p_size", "p_retailprice")))
add("corr_kendall", "supplier", lambda df: rounded(I.correlation_table(df.select("s_acctbal", "s_nationkey"), "kendall")), "WITH p AS (SELECT sign(a.s_acctbal - b.s_acctbal) AS x, sign(a.s_nationkey - b.s_nationkey) AS y FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey) " + " UNION ALL ".join(f"SELECT '{n}' AS column_a, '{m}' AS column_b, round(sum({a} * {b}) / sqrt(count(*) FILTER (WHERE {a} <> 0)::DOUBLE * count(*) FILTER (WHERE {b} <> 0)), 4) AS correlation FROM p" for n, a in (("s_acctbal", "x"), ("s_nationkey", "y")) for m, b in (("s_acctbal", "x"), ("s_nationkey", "y"))))

# Anomalies

_events = lambda df: df.select("event_id", "value")
add("anomalies_iqr", "events", lambda df: I.anomaly_table(df.select("value")).select("column", "count", "anomalies"), f"SELECT 'value' AS \"column\", count(value) AS \"count\", count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS anomalies FROM events, {_FENCE.format(c='value', t='events')}")
add("anomalies_zscore", "events", lambda df: I.anomaly_table(df.select("value"), "zscore").select("column", "count", "anomalies"), "SELECT 'value' AS \"column\", count(value) AS \"count\", count(*) FILTER (WHERE abs(value - m) > 3 * s) AS anomalies FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
add("anomaly_rows", "events", lambda df: I.anomaly_rows(df, columns=["value"]).select("event_id", "value"), f"SELECT event_id, value FROM events, {_FENCE.format(c='value', t='events')} WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")

# Normalised near-duplicates

_norm = lambda c: f"coalesce(trim(regexp_replace(lower(CAST({c} AS STRING)), '\\s+', ' ', 'g')), '')"
_NEAR = ["name_variant", "type_token"]
_KEY = " || chr(31) || ".join(map(_norm, _NEAR))
add("neardup_groups", "dirty_parts", lambda df: I.near_duplicate_groups(df, _NEAR, ["p_partkey"]).select("size", F.col("first_row").alias("first_row")), f"SELECT count(*) AS size, min(p_partkey) AS first_row FROM dirty_parts GROUP BY {_KEY} HAVING count(*) > 1")
add("neardup_summary", "dirty_parts", lambda df: I.near_duplicate_summary(df, _NEAR), f"SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (WHERE n > 1) AS \"groups\", CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM dirty_parts GROUP BY {_KEY})")
for _keep, _f in (("first", "min"), ("last", "max")):
    add(f"neardup_removed_{_keep}", "dirty_parts", lambda df, k=_keep: C.NearDuplicateRemoval(_NEAR, keep=k, order_by=["p_partkey"]).apply(df).select("p_partkey"), f"SELECT {_f}(p_partkey) AS p_partkey FROM dirty_parts GROUP BY {_KEY}")

# Text quality

_len = lambda t, c: f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", min(length({c})) AS min_chars, max(length({c})) AS max_chars, round(avg(length({c})), 4) AS mean_chars, round(median(length({c})), 4) AS median_chars FROM {t}"
_tq = lambda df, names, fields: rounded(I.text_quality_table(df, names, fields))
_CH, _TK = ["count", "min_chars", "max_chars", "mean_chars", "median_chars"], ["min_tokens", "max_tokens", "mean_tokens", "median_tokens"]
add("textq_lengths", "documents", lambda df: _tq(df, ["text"], _CH), _len("documents", "text"))
add("textq_tokens", "documents", lambda df: _tq(df, ["text"], _TK), "WITH n AS (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM documents) SELECT 'text' AS \"column\", min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 4) AS mean_tokens, round(median(n), 4) AS median_tokens FROM n")
_GARBAGE = f"contains({{c}}, '{BAD}') OR contains({{c}}, '{CTRL}') OR contains({{c}}, '{ACCENT}')"
add("textq_counts", "dirty_parts", lambda df: I.text_quality_table(df, ["type_token", "enc_text"], ["empty_count", "boilerplate_count", "garbage_count"]), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE trim({c}) = '') AS empty_count, count(*) FILTER (WHERE lower(trim({c})) IN ('n/a', 'na', 'none', 'null', 'nil')) AS boilerplate_count, count(*) FILTER (WHERE {_GARBAGE.format(c=c)}) AS garbage_count FROM dirty_parts" for c in ("type_token", "enc_text")))
add("encoding_classes", "dirty_parts", lambda df: per_column(df, ["enc_text"], {"mojibake": lambda c: F.count_if(K.has_mojibake(F.col(c))), "replacement": lambda c: F.count_if(K.has_replacement(F.col(c))), "control": lambda c: F.count_if(K.has_control(F.col(c)))}), f"SELECT 'enc_text' AS \"column\", count(*) FILTER (WHERE contains(enc_text, '{ACCENT}')) AS mojibake, count(*) FILTER (WHERE contains(enc_text, '{BAD}')) AS replacement, count(*) FILTER (WHERE contains(enc_text, '{CTRL}')) AS control FROM dirty_parts")

# Cleaning

_O = "o_orderkey, o_custkey, o_totalprice"
_take = lambda df: df.select("o_orderkey", "o_custkey", "o_totalprice")
add("drop_missing_rows", "dirty_orders", lambda df: _take(api.drop_missing_rows(df, ["o_custkey", "o_totalprice"])), f"SELECT {_O} FROM dirty_orders WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL")
add("drop_missing_cols", "dirty_orders", api.drop_missing_cols, "SELECT o_orderkey, order_day, constant_col, flag FROM dirty_orders")
add("drop_cols", "dirty_orders", lambda df: api.drop_cols(df, ["empty_col", "flag", "constant_col", "order_day", "o_orderpriority"]), f"SELECT {_O} FROM dirty_orders")
add("fill_constant", "dirty_orders", lambda df: _take(C.FillMissing("constant", -1, ["o_custkey"]).apply(df)), "SELECT o_orderkey, coalesce(o_custkey, -1) AS o_custkey, o_totalprice FROM dirty_orders")
for _s, _sql in (("mean", "avg"), ("median", "median")):
    add(f"fill_{_s}", "dirty_orders", lambda df, s=_s: rounded(_take(C.FillMissing(s, None, ["o_totalprice"]).apply(df)), 3), f"SELECT o_orderkey, o_custkey, round(coalesce(o_totalprice, (SELECT {_sql}(o_totalprice) FROM dirty_orders)), 3) AS o_totalprice FROM dirty_orders")
_MODE = "(SELECT o_orderpriority FROM dirty_orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
add("fill_mode", "dirty_orders", lambda df: C.FillMissing("mode", None, ["o_orderpriority"]).apply(df).select("o_orderkey", "o_orderpriority"), f"SELECT o_orderkey, coalesce(o_orderpriority, {_MODE}) AS o_orderpriority FROM dirty_orders")
add("fill_auto", "dirty_orders", lambda df: rounded(api.fill_missing(df.select("o_orderkey", "o_custkey", "o_orderpriority")), 2), f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, round(coalesce(CAST(o_custkey AS DOUBLE), (SELECT median(o_custkey) FROM dirty_orders)), 2) AS o_custkey, coalesce(o_orderpriority, {_MODE}) AS o_orderpriority FROM dirty_orders")
_TOK = "CASE WHEN lower(trim(type_token)) IN ('', 'na', 'n/a', 'nan', 'null', 'none', 'nil', '?', '-') THEN NULL ELSE type_token END"
add("fix_tokens", "dirty_parts", lambda df: api.fix_tokens(df, ["type_token"]).select("p_partkey", "type_token"), f"SELECT p_partkey, {_TOK} AS type_token FROM dirty_parts")
_FLAT = "nullif(trim(regexp_replace(name_variant, '\\s+', ' ', 'g')), '')"
add("text_whitespace", "dirty_parts", lambda df: api.normalize_text(df, ["name_variant"]).select("p_partkey", "name_variant"), f"SELECT p_partkey, {_FLAT} AS name_variant FROM dirty_parts")
add("text_lower", "dirty_parts", lambda df: api.lowercase(df, ["name_variant"]).select("p_partkey", "name_variant"), f"SELECT p_partkey, lower({_FLAT}) AS name_variant FROM dirty_parts")
add("text_upper", "dirty_parts", lambda df: api.uppercase(df, ["name_variant"]).select("p_partkey", "name_variant"), f"SELECT p_partkey, upper({_FLAT}) AS name_variant FROM dirty_parts")
add("text_title", "dirty_parts", lambda df: api.titlecase(df, ["name_variant"]).select("p_partkey", "name_variant"), f"SELECT p_partkey, array_to_string(list_transform(string_split({_FLAT}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name_variant FROM dirty_parts")
_FIX = f"nullif(replace(replace({{c}}, '{CTRL}', ''), '{BAD}', ''), '')"
add("fix_encoding", "dirty_parts", lambda df: api.fix_encoding(df, ["enc_text"]).select("p_partkey", "enc_text"), f"SELECT p_partkey, {_FIX.format(c='enc_text')} AS enc_text FROM dirty_parts")
_TEXTCLEAN = lambda c: f"nullif(trim(regexp_replace({_FIX.format(c=_TOK.replace('type_token', c))}, '\\s+', ' ', 'g')), '')"
add("clean_text", "dirty_parts", lambda df: api.clean_text(df, ["type_token", "enc_text"]).select("p_partkey", "type_token", "enc_text"), f"SELECT p_partkey, {_TEXTCLEAN('type_token')} AS type_token, {_TEXTCLEAN('enc_text')} AS enc_text FROM dirty_parts")
_NUM = "CASE WHEN regexp_full_match(trim(size_text), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(size_text) AS DOUBLE) END"
add("coerce_float", "dirty_parts", lambda df: api.cast(df, {"size_text": "float64"}).select("p_partkey", "size_text"), f"SELECT p_partkey, {_NUM} AS size_text FROM dirty_parts")
add("coerce_int", "dirty_parts", lambda df: api.cast(df, {"size_text": "int64"}).select("p_partkey", "size_text"), f"SELECT p_partkey, CAST({_NUM} AS BIGINT) AS size_text FROM dirty_parts")
add("coerce_datetime", "dirty_orders", lambda df: api.cast(df, {"order_day": "datetime64[ns]"}).select("o_orderkey", "order_day"), "SELECT o_orderkey, CAST(order_day AS TIMESTAMP) AS order_day FROM dirty_orders")
add("fix_types", "dirty_parts", lambda df: api.fix_types(df).select("p_partkey", "size_text"), f"SELECT p_partkey, CAST({_NUM} AS BIGINT) AS size_text FROM dirty_parts")
_SP = "[\\s\\x{1c}-\\x{1f}]"


def _AUTO(c: str) -> str:  # noqa: N802
    token = _TOK.replace("type_token", c)
    return _FIX.format(c=f"nullif(trim(regexp_replace({token}, '{_SP}+', ' ', 'g')), '')")


add("auto_clean", "dirty_parts", lambda df: api.clean(df).data.select("p_partkey", "type_token", "enc_text"), f"SELECT p_partkey, {_AUTO('type_token')} AS type_token, {_AUTO('enc_text')} AS enc_text FROM dirty_parts")

# Projection and features

add("select_columns", "part", lambda df: api.select(df, ["p_partkey", "p_size"]), "SELECT p_partkey, p_size FROM part")
add("rename_columns", "part", lambda df: api.rename(df, {"p_size": "size", "absent": "x"}).select("p_partkey", "size"), "SELECT p_partkey, p_size AS size FROM part")
add("interaction", "part", lambda df: rounded(api.interaction(df, "p_size", "p_retailprice").select("p_partkey", "p_size_x_p_retailprice")), "SELECT p_partkey, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice FROM part")
add("ratio", "lineitem", lambda df: rounded(api.ratio(df, "l_extendedprice", "l_discount", "r").select("l_orderkey", "r"), 3), "SELECT l_orderkey, round(CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END, 3) AS r FROM lineitem")
add("polynomial", "part", lambda df: api.poly(df, "p_size", 3, True).select("p_partkey", F.col("`p_size^2`").alias("p2"), F.col("`p_size^3`").alias("p3"), F.col("`p_size^0`").alias("p0")), "SELECT p_partkey, CAST(p_size AS BIGINT) * p_size AS p2, CAST(p_size AS BIGINT) * p_size * p_size AS p3, 1.0::DOUBLE AS p0 FROM part")
add("log_feature", "part", lambda df: rounded(api.log(df, "p_retailprice").select("p_partkey", "log_p_retailprice"), 6), "SELECT p_partkey, round(ln(p_retailprice + 1), 6) AS log_p_retailprice FROM part")
_DT = ["year", "month", "day", "day_of_week", "day_of_year", "week", "quarter", "hour", "minute", "second"]
_DTSQL = {"day_of_week": "isodow(o_orderdate) - 1", "day_of_year": "dayofyear(o_orderdate)", "week": "weekofyear(o_orderdate)"}
add("datetime_features", "orders", lambda df: api.datetime_features(df, "o_orderdate", _DT, "d").select("o_orderkey", *[F.col(f"d_{x}").cast("bigint").alias(f"d_{x}") for x in _DT]), "SELECT o_orderkey, " + ", ".join(f"CAST({_DTSQL.get(x, f'{x}(o_orderdate)')} AS BIGINT) AS d_{x}" for x in _DT) + " FROM orders")
add("dummies", "orders", lambda df: api.dummies(df.select("o_orderkey", "o_orderstatus"), "o_orderstatus"), "SELECT o_orderkey, " + ", ".join(f"coalesce(o_orderstatus = '{v}', false) AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM orders")
add("normalize", "part", lambda df: rounded(api.normalize(df, "p_retailprice").select("p_partkey", "p_retailprice"), 6), "SELECT p_partkey, round((p_retailprice - a) / (b - a), 6) AS p_retailprice FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)")
add("standardize", "part", lambda df: rounded(api.standardize(df, "p_retailprice").select("p_partkey", "p_retailprice"), 5), "SELECT p_partkey, round((p_retailprice - m) / s, 5) AS p_retailprice FROM part, (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part)")
add("feature_engine", "part", lambda df: rounded(E.FeatureEngineeringEngine([E.ColumnInteraction("p_size", "p_partkey", "x"), E.RatioFeature("x", "p_retailprice", "y"), E.LogFeature("x", "z", 1.0)]).fit_transform(df).select("p_partkey", "x", "y", "z")), "SELECT p_partkey, p_size * p_partkey AS x, round(p_size * p_partkey / p_retailprice, 4) AS y, round(ln(p_size * p_partkey + 1), 4) AS z FROM part")

# Rules and contracts


def _rule(rule: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: R.rules_table(df, [rule])


def _rule_sql(rule: str, columns: str, rows: str, source: str = "dirty_orders") -> str:
    return f"SELECT '{rule}' AS rule, c = '' AS passed, c AS affected_columns, CAST(n AS BIGINT) AS affected_rows FROM (SELECT {columns} AS c, {rows} AS n FROM {source})"


def _list(tests: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, t in tests.items()) + ")"


add("rule_missing_values", "dirty_orders", lambda df: _rule("missing_values")(df.drop("empty_col")), _rule_sql("missing_values", _list({c: f"count({c}) < count(*)" for c in ORDER_COLUMNS if c != "empty_col"}), f"count(*) FILTER (WHERE {_any})"))
add("rule_duplicate_rows", "dirty_orders", _rule("duplicate_rows"))
ORACLES["rule_duplicate_rows"] = _inline(f"WITH g AS ({_GROUPS.replace('SELECT count(*) AS n FROM dirty_orders GROUP BY ALL', 'SELECT ' + ', '.join(ORDER_COLUMNS) + ', count(*) AS n FROM dirty_orders GROUP BY ' + ', '.join(ORDER_COLUMNS))}) " + _rule_sql("duplicate_rows", f"CASE WHEN max(n) > 1 THEN '{','.join(ORDER_COLUMNS)}' ELSE '' END", "sum(CASE WHEN n > 1 THEN n ELSE 0 END)", "g"))
add("rule_duplicate_columns", "dirty_orders", lambda df: _rule("duplicate_columns")(df.select("o_orderkey", (F.col("o_orderkey") * 1.0).alias("again"), "o_custkey", F.col("order_day").alias("d1"), F.col("order_day").alias("d2"))), _rule_sql("duplicate_columns", "'again,d2'", "0", "(SELECT 1)"))
add("rule_invalid_dtypes", "dirty_parts", lambda df: _rule("invalid_dtypes")(df.select("size_text", F.regexp_replace("size_text", "^(1d|abc)$", "7").alias("all_numbers"))), _rule_sql("invalid_dtypes", "'all_numbers'", "count(size_text)", "dirty_parts"))
add("rule_outliers", "dirty_orders", lambda df: _rule("outliers")(df.select("o_totalprice", "o_custkey")), f"SELECT 'outliers' AS rule, sum(outliers) = 0 AS passed, coalesce(string_agg(CASE WHEN outliers > 0 THEN \"column\" END, ','), '') AS affected_columns, CAST(sum(outliers) AS BIGINT) AS affected_rows FROM ({_outlier_sql('dirty_orders', ['o_totalprice', 'o_custkey'])})")
add("rule_constant_columns", "dirty_orders", _rule("constant_columns"), _rule_sql("constant_columns", _list({c: f"count(DISTINCT {c}) = 1" for c in ORDER_COLUMNS}), "0"))
add("rule_high_cardinality", "documents", _rule("high_cardinality"), _rule_sql("high_cardinality", _list({c: f"count(DISTINCT {c}) / count({c}) > 0.9 AND count({c}) >= 2" for c in ("text", "lang", "source")}), "0", "documents"))
_WS = lambda c: f"regexp_matches({c}, '^\\s|\\s$|\\s\\s')"
add("rule_whitespace", "dirty_parts", lambda df: _rule("whitespace")(df.select("name_variant", "type_token")), _rule_sql("whitespace", _list({c: f"count(*) FILTER (WHERE {_WS(c)}) > 0" for c in _NEAR}), " + ".join(f"count(*) FILTER (WHERE {_WS(c)})" for c in _NEAR), "dirty_parts"))
add("rule_string_case", "dirty_orders", _rule("string_case"), _rule_sql("string_case", _list({c: f"count(DISTINCT lower({c})) < count(DISTINCT {c})" for c in ("o_orderpriority", "order_day", "empty_col")}), "0"))
add("rule_column_names", "region", lambda df: _rule("column_names")(df.withColumnRenamed("r_name", "Region Name")), "SELECT 'column_names' AS rule, false AS passed, 'Region Name' AS affected_columns, CAST(0 AS BIGINT) AS affected_rows")

_CONTRACT = {"o_custkey": {"nullable": False, "min": 1, "max": 1000}, "o_orderpriority": {"allowed_values": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "regex": "[0-9]-[A-Z]+.*"}}
add("contract_checks", "dirty_orders", lambda df: R.contract_table(df, _CONTRACT), "SELECT 'nullable' AS \"check\", 'o_custkey' AS \"column\", count(*) FILTER (WHERE o_custkey IS NULL) AS violations FROM dirty_orders UNION ALL SELECT 'range', 'o_custkey', count(*) FILTER (WHERE o_custkey < 1 OR o_custkey > 1000) FROM dirty_orders UNION ALL SELECT 'allowed_values', 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) FROM dirty_orders UNION ALL SELECT 'regex', 'o_orderpriority', count(*) FILTER (WHERE NOT regexp_full_match(o_orderpriority, '[0-9]-[A-Z]+.*')) FROM dirty_orders")


def _contract(df: DataFrame, spec: dict) -> DataFrame:
    rows = [(r.rule, r.passed, r.affected_rows) for r in api.contract(df, spec)]
    return df.sparkSession.createDataFrame(rows, "rule string, passed boolean, affected_rows bigint")


add("contract_schema", "dirty_orders", lambda df: _contract(df, {"absent": {}, "o_orderkey": {"dtype": "int64", "unique": True}, "flag": {"dtype": "int64"}}), "SELECT 'contract.column_exists[absent]' AS rule, false AS passed, CAST(0 AS BIGINT) AS affected_rows UNION ALL SELECT 'contract.column_exists[flag]', true, 0 UNION ALL SELECT 'contract.dtype[flag]', false, 0 UNION ALL SELECT 'contract.column_exists[o_orderkey]', true, 0 UNION ALL SELECT 'contract.dtype[o_orderkey]', true, 0 UNION ALL SELECT 'contract.unique[o_orderkey]', n = 0, n FROM (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY o_orderkey HAVING count(*) > 1))")

# Detection, plans, engines


def _health(df: DataFrame) -> DataFrame:
    r = IssueDetector().inspect(df)
    rows = [(k, round(v, 3)) for k, v in r.scores.items()] + [("health", float(r.health_score))]
    return df.sparkSession.createDataFrame(rows, "score string, value double")


_MISSING_CELLS = " + ".join(f"count(*) - count({c})" for c in ORDER_COLUMNS)
_TEXTS, _NUMS = ["o_orderpriority", "order_day", "empty_col"], ["o_orderkey", "o_custkey", "o_totalprice", "constant_col"]
_DATES = K.DATE_LIKE
_FOLD = lambda c: f"lower(trim({c}))"
_FACTS = (
    "n AS (SELECT count(*) AS n FROM dirty_orders), m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS c, {c in _NUMS} AS num, count(*) - count({c}) AS m, count({c}) AS there, count(DISTINCT {c}) AS u, "
        + (f"count(DISTINCT {_FOLD(c)}) AS f, coalesce(avg(CASE WHEN {c} IS NOT NULL THEN CAST(regexp_matches({c}, '{_DATES}') AS INT) END), 0) AS d" if c in _TEXTS else f"count(DISTINCT {c}) AS f, 0 AS d")
        + " FROM dirty_orders"
        for c in ORDER_COLUMNS
    )
    + "), q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, a, b, count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS k FROM dirty_orders, {_FENCE.format(c=c, t='dirty_orders')} GROUP BY a, b" for c in _NUMS)
    + "), o AS (SELECT q.*, u > 5 AND there > 10 AND b > a AND k * 100.0::DOUBLE / there > 3 AS odd, k * 100.0::DOUBLE / there AS share FROM q JOIN m ON q.c = m.c)"
    + ", x AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM dirty_orders)), y AS (SELECT count(*) AS d FROM (SELECT DISTINCT "
    + ", ".join(f"coalesce(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '')" if c in _TEXTS else c for c in ORDER_COLUMNS) + " FROM dirty_orders))"
)
_SCORES = (
    "s AS (SELECT 100 * (1 - (SELECT sum(m) FROM m) / (n * 8)) AS completeness, 100 * (1 - (n - d) / n) AS uniqueness, 100 - 100 * (SELECT count(*) FROM m WHERE there = 0 OR u = 1) / 8 AS integrity, "
    "greatest(0, 100 - (SELECT sum(CASE WHEN d > 0.7 THEN 15 ELSE 0 END + CASE WHEN f < u THEN 10 ELSE 0 END) FROM m)) AS consistency, greatest(0, 100 - 8 * (SELECT count(*) FROM o WHERE odd)) AS validity FROM n, x)"
)
_NAMES = ("completeness", "uniqueness", "integrity", "consistency", "validity")
add("health_scores", "dirty_orders", _health)
ORACLES["health_scores"] = _inline(f"WITH {_FACTS}, {_SCORES} " + " UNION ALL ".join(f"SELECT '{k}' AS score, round(CAST({k} AS DOUBLE), 3) AS value FROM s" for k in _NAMES) + " UNION ALL SELECT 'health', CAST(greatest(0, least(100, round_even(0.35 * completeness + 0.25 * uniqueness + 0.15 * integrity + 0.15 * consistency + 0.10 * validity, 0))) AS DOUBLE) FROM s")
add("health_completeness", "dirty_orders", lambda df: _health(df).filter("score IN ('completeness', 'uniqueness')"), f"SELECT 'completeness' AS score, round(100 * (1 - ({_MISSING_CELLS}) / (count(*) * 8)), 3) AS value FROM dirty_orders UNION ALL SELECT 'uniqueness', round(100 * (1 - (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders))) / count(*)), 3) FROM dirty_orders")
_ISSUE = lambda title, severity, category, rows, share, where, source: f"SELECT '{title}' AS title, {severity} AS severity, '{category}' AS category, {'c' if 'c' in source.split('#')[1:] else chr(39) * 2} AS columns, CAST({rows} AS BIGINT) AS rows, round(CAST({share} AS DOUBLE), 4) AS percent FROM {source.split('#')[0]} WHERE {where}"
add("health_issues", "dirty_orders", lambda df: IssueDetector().inspect(df).table(df.sparkSession))
ORACLES["health_issues"] = _inline(
    f"WITH {_FACTS} "
    + " UNION ALL ".join([
        _ISSUE("Duplicate rows", "CASE WHEN (n - d) * 100.0 / n > 10 THEN 'CRITICAL' ELSE 'WARNING' END", "duplicates", "n - d", "(n - d) * 100.0::DOUBLE / n", "n > d", "n, x"),
        _ISSUE("Column is empty", "'CRITICAL'", "missing_values", "m", "100", "there = 0", "m#c"),
        _ISSUE("Missing values", "CASE WHEN m * 100.0 / n >= 15 THEN 'WARNING' ELSE 'INFO' END", "missing_values", "m", "m * 100.0::DOUBLE / n", "m > 0 AND there > 0", "m, n#c"),
        _ISSUE("Constant column", "'WARNING'", "integrity", "there", "0", "u = 1", "m#c"),
        _ISSUE("Inconsistent case or white space", "'WARNING'", "consistency", "u - f", "0", "f < u", "m#c"),
        _ISSUE("Dates stored as text", "'WARNING'", "data_types", "0", "0", "d > 0.7", "m#c"),
        _ISSUE("Outliers", "CASE WHEN share < 10 THEN 'INFO' ELSE 'WARNING' END", "outliers", "k", "share", "odd", "o#c"),
        _ISSUE("Anomalies", "CASE WHEN share >= 10 THEN 'WARNING' ELSE 'INFO' END", "anomalies", "k", "share", "k > 0", "o#c"),
        _ISSUE("Near-duplicate rows", "CASE WHEN (x.d - y.d) / n > 0.05 THEN 'WARNING' ELSE 'INFO' END", "near_duplicates", "x.d - y.d", "(x.d - y.d) * 100.0::DOUBLE / n", "x.d > y.d", "n, x, y"),
    ])
)
add("half_health", "dirty_orders", lambda df: df.sparkSession.createDataFrame([P.half_health(df)], "score int, missing_cells bigint, duplicate_rows bigint").select("missing_cells", "duplicate_rows"), f"SELECT {_MISSING_CELLS} AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicate_rows FROM dirty_orders")


def _plan(df: DataFrame) -> DataFrame:
    """Inspect, plan, write the plan, read it back and run it."""
    plan = P.CleaningPlan.from_report(IssueDetector().inspect(df))
    return api.replay(api.serialize(plan), df).select("o_orderkey", F.round("o_custkey", 2).alias("o_custkey"), "o_orderpriority")


add("plan_replay", "dirty_orders", _plan, f"WITH_D d AS (SELECT DISTINCT * FROM dirty_orders) SELECT o_orderkey, round(coalesce(CAST(o_custkey AS DOUBLE), (SELECT median(o_custkey) FROM d)), 2) AS o_custkey, coalesce(o_orderpriority, {_MODE.replace('dirty_orders', 'd')}) AS o_orderpriority FROM d")
ORACLES["plan_replay"] = _inline(ORACLES["plan_replay"].removeprefix(_WITH).replace("WITH_D ", "WITH "))


def _audit(df: DataFrame) -> DataFrame:
    r = P.CleaningEngine([C.MissingTokenOperation((), ["type_token"]), C.EncodingRepairOperation(["enc_text"], error_on_unrepaired=False), C.DropMissingRows(["type_token"])]).run_with_result(df)
    return df.sparkSession.createDataFrame([(a["operation"], a["rows_affected"]) for a in r.audit_log], "operation string, rows_affected bigint")


_TN = f"count(*) FILTER (WHERE ({_TOK}) IS NULL)"
add("engine_audit", "dirty_parts", _audit, f"SELECT 'missing_token_normalization' AS operation, {_TN} AS rows_affected FROM dirty_parts UNION ALL SELECT 'encoding_repair', count(*) FILTER (WHERE contains(enc_text, '{BAD}') OR contains(enc_text, '{CTRL}')) FROM dirty_parts UNION ALL SELECT 'drop_missing_rows', {_TN} FROM dirty_parts")
add("pipeline_engine", "part", lambda df: P.PipelineEngine([P.CallableStep(lambda d: d.filter("p_size > 10"), "large"), P.TransformStep(E.PolynomialFeature("p_size").fit(df))]).run(df).data.select("p_partkey", F.col("`p_size^2`").alias("p2")), "SELECT p_partkey, CAST(p_size AS BIGINT) * p_size AS p2 FROM part WHERE p_size > 10")
add("profile_columns", "part", lambda df: df.sparkSession.createDataFrame([(r.column, r.unique, r.missing) for r in api.profile(df).dtypes.reports], "column string, unique bigint, missing bigint"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\", count(*) - count({c}) AS missing FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))


# What users call first: reports, the facade, registries


def rows_of(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


_ADVICE = {"p_partkey": "p_partkey", "p_size": "p_size"}
_BITS = "CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'int8' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'int16' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int32' ELSE 'int64' END"
add(
    "memory_advice", "part", lambda df: rows_of(df, [(r.column, r.recommended, r.bytes) for r in I.MemoryInspector().inspect(df.select("p_partkey", "p_size", "p_name", "p_brand")).reports], "column string, recommended string, bytes bigint"),
    " UNION ALL ".join([f"SELECT '{c}' AS \"column\", {_BITS.format(c=c)} AS recommended, CAST(count(*) * {w} AS BIGINT) AS bytes FROM part" for c, w in (("p_partkey", 8), ("p_size", 4))] + [f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) / count(*) < 0.5 THEN 'category' ELSE 'string' END, CAST(sum(coalesce(strlen({c}), 0) + 16) AS BIGINT) FROM part" for c in ("p_name", "p_brand")]),
)
add(
    "statistics_report", "lineitem", lambda df: rounded(rows_of(df, [tuple(r[k] for k in ("column", "count", "minimum", "q1", "median", "q3", "maximum", "unique", "mode", "outlier_count", "constant")) for r in I.StatisticsInspector().inspect(df.select(*LINE)).reports], "column string, count bigint, minimum double, q1 double, median double, q3 double, maximum double, unique bigint, mode double, outlier_count bigint, constant boolean")),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(min({c}), 4) AS minimum, round(any_value(a), 4) AS q1, round(median({c}), 4) AS median, round(any_value(b), 4) AS q3, round(max({c}), 4) AS maximum, count(DISTINCT {c}) AS \"unique\", round((SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 4) AS mode, count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count, count(DISTINCT {c}) = 1 AS constant FROM lineitem, {_FENCE.format(c=c, t='lineitem')}" for c in LINE),
)
_SUPPLIER = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
_seen = lambda rule, columns, rows="0": f"SELECT '{rule}' AS rule, c = '' AS passed, c AS affected_columns, CAST(n AS BIGINT) AS affected_rows FROM (SELECT {columns} AS c, {rows} AS n FROM supplier)"
_NUMERIC = ["s_suppkey", "s_nationkey", "s_acctbal"]
add(
    "validate_rules", "supplier", lambda df: rows_of(df, [(r.rule, r.passed, ",".join(r.affected_columns), r.affected_rows) for r in api.validate(df.select(*_SUPPLIER))], "rule string, passed boolean, affected_columns string, affected_rows bigint"),
    " UNION ALL ".join([
        _seen("missing_values", _list({c: f"count({c}) < count(*)" for c in _SUPPLIER}), "count(*) FILTER (WHERE " + " OR ".join(f"{c} IS NULL" for c in _SUPPLIER) + ")"),
        f"SELECT 'duplicate_rows', max(n) = 1, CASE WHEN max(n) > 1 THEN '{','.join(_SUPPLIER)}' ELSE '' END, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) FROM (SELECT count(*) AS n FROM supplier GROUP BY {', '.join(_SUPPLIER)})",
        "SELECT 'duplicate_columns', c = '', c, CAST(0 AS BIGINT) FROM (SELECT " + _list({b: " OR ".join(f"count(*) FILTER (WHERE CAST({a} AS DOUBLE) IS DISTINCT FROM CAST({b} AS DOUBLE)) = 0" for a in _NUMERIC[:i]) for i, b in enumerate(_NUMERIC) if i}) + " AS c FROM supplier)",
        "SELECT 'invalid_dtypes', c = '', c, CAST(0 AS BIGINT) FROM (SELECT " + _list({"s_name": "count(s_name) > 0 AND count(try_cast(s_name AS DOUBLE)) = count(s_name)"}) + " AS c FROM supplier)",
        f"SELECT 'outliers', sum(outliers) = 0, coalesce(string_agg(CASE WHEN outliers > 0 THEN \"column\" END, ','), ''), CAST(sum(outliers) AS BIGINT) FROM ({_outlier_sql('supplier', _NUMERIC)})",
        _seen("constant_columns", _list({c: f"count(DISTINCT {c}) = 1" for c in _SUPPLIER})),
        _seen("high_cardinality", _list({"s_name": "count(DISTINCT s_name) / count(s_name) > 0.9 AND count(s_name) >= 2"})),
        _seen("whitespace", _list({"s_name": f"count(*) FILTER (WHERE {_WS('s_name')}) > 0"}), f"count(*) FILTER (WHERE {_WS('s_name')})"),
        _seen("string_case", _list({"s_name": "count(DISTINCT lower(s_name)) < count(DISTINCT s_name)"})),
        "SELECT 'column_names', true, '', CAST(0 AS BIGINT)",
    ]),
)


class _InDebt(R.BaseRule):
    name, category, description, priority = "in_debt", "validity", "no balance below zero", 5

    def evaluate(self, df: DataFrame) -> R.RuleResult:
        n = df.filter("s_acctbal < 0").count()
        return self.verdict(["s_acctbal"] if n else (), n)


def _custom(df: DataFrame) -> DataFrame:
    """A rule of one's own beside a built-in one; the smaller priority goes first."""
    engine = R.RuleEngine(R.RuleRegistry([R.WhitespaceRule(), _InDebt()]))
    return rows_of(df, [(i, r.rule, r.passed, r.affected_rows) for i, r in enumerate(engine.run(df.select(*_SUPPLIER)), 1)], "place int, rule string, passed boolean, affected_rows bigint")


add("custom_rule", "supplier", _custom, f"SELECT 1 AS place, 'in_debt' AS rule, count(*) = 0 AS passed, count(*) AS affected_rows FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 2, 'whitespace', count(*) FILTER (WHERE {_WS('s_name')}) = 0, count(*) FILTER (WHERE {_WS('s_name')}) FROM supplier")


def _valid(df: DataFrame) -> DataFrame:
    """Whether definitions of rules are taken: a blank name, a priority in words, a switch that is none, and a good one."""
    out = []
    for what, change in (("good", {}), ("blank name", {"name": " "}), ("name", {"name": 3}), ("description", {"description": None}), ("priority", {"priority": "high"}), ("enabled", {"enabled": 1}), ("callback", {"evaluate": None})):
        try:
            R.check_rule(type("Rule", (R.BaseRule,), change)())
            out.append((what, "taken"))
        except (TypeError, ValueError) as e:
            out.append((what, type(e).__name__))
    return rows_of(df, out, "definition string, verdict string")


add("rule_definitions", "region", _valid, "SELECT * FROM (VALUES ('good', 'taken'), ('blank name', 'ValueError'), ('name', 'TypeError'), ('description', 'TypeError'), ('priority', 'TypeError'), ('enabled', 'TypeError'), ('callback', 'TypeError')) t(definition, verdict)")


def _switched(df: DataFrame) -> DataFrame:
    """The plan of a report with its first step, the duplicates, switched off and one on again, then applied."""
    plan = P.CleaningPlan.from_report(IssueDetector().inspect(df))
    plan.disable(1)
    plan.disable(2)
    plan.enable(2)
    shown = sum(line.split(". ")[1].startswith("[x]") for line in plan.show().splitlines())
    out = plan.apply(df).data
    return out.agg(F.count("*").alias("rows"), F.count_if(F.col("o_custkey").isNull() | F.col("o_orderpriority").isNull()).alias("missing")).withColumn("steps", F.lit(len(plan.steps) - shown).cast("bigint"))


add("plan_switches", "dirty_orders", _switched, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing, CAST(1 AS BIGINT) AS steps FROM dirty_orders")


def _facade(df: DataFrame) -> DataFrame:
    """Inspect, plan and clean by the facade, whose result tells what changed."""
    c = Cleaner()
    r = c.clean(df, c.plan(c.inspect(df)))
    return rows_of(df, [(o.operation_name, o.rows_affected) for o in r.operations] + [("left", r.data.count())], "operation string, rows_affected bigint")


_LOST = {c: f"(SELECT count(*) - count({c}) FROM d)" for c in ("o_custkey", "o_totalprice", "o_orderpriority")}
add("cleaner_facade", "dirty_orders", _facade)
ORACLES["cleaner_facade"] = _inline("WITH d AS (SELECT DISTINCT * FROM dirty_orders) SELECT 'drop_duplicates' AS operation, (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM d) AS rows_affected UNION ALL " + " UNION ALL ".join(f"SELECT 'fill_missing', {x}" for x in _LOST.values()) + " UNION ALL SELECT 'drop_columns', 0 UNION ALL SELECT 'drop_columns', 0 UNION ALL SELECT 'left', (SELECT count(*) FROM d)")


def _chunks(df: DataFrame) -> DataFrame:
    r = P.CleaningEngine([C.FillMissing("constant", -1, ["o_custkey"]), C.FillMissing("mean", None, ["o_totalprice"])]).run_with_result(df, chunk_size=1000)
    return rows_of(df, [(a["order"], a["chunk_size"], a["rows_affected"], r.summary()["rows_affected"]) for a in r.audit_log], "place int, chunk_size int, rows_affected bigint, of bigint")


add("chunked_apply", "dirty_orders", _chunks, "SELECT CAST(1 AS INT) AS place, CAST(1000 AS INT) AS chunk_size, count(*) - count(o_custkey) AS rows_affected, 2 * count(*) - count(o_custkey) - count(o_totalprice) AS \"of\" FROM dirty_orders UNION ALL SELECT 2, 1000, count(*) - count(o_totalprice), 2 * count(*) - count(o_custkey) - count(o_totalprice) FROM dirty_orders")
add("operation_names", "region", lambda df: rows_of(df, [(n,) for n in C.builtin_registry().names()], "name string"), "SELECT * FROM (VALUES ('drop_missing_rows'), ('drop_missing_columns'), ('fill_missing'), ('drop_duplicates'), ('drop_columns'), ('type_coercion'), ('missing_token_normalization'), ('text_normalization'), ('encoding_repair'), ('near_duplicate_removal')) t(name)")


def _profile_report(df: DataFrame) -> DataFrame:
    """A profile as a report, rendered to JSON, exported as text, and read again."""
    import json

    from .operators.profile import profile_to_report

    report = json.loads(StringExporter().export(profile_to_report(api.profile(df.drop("empty_col"))), JSONRenderer()))
    overview = report["sections"][0]["content"]
    rows = [(k, float(overview[k])) for k in ("rows", "columns")] + [(k, round(overview["health"][k], 3)) for k in ("completeness", "uniqueness")] + [("sections", float(len(report["sections"])))]
    return rows_of(df, rows, "measure string, value double")


_SOME = [c for c in ORDER_COLUMNS if c != "empty_col"]
add("profile_report", "dirty_orders", _profile_report)
ORACLES["profile_report"] = _inline(f"WITH d AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM dirty_orders)), s AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in _SOME)} AS m FROM dirty_orders) SELECT 'rows' AS measure, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'columns', 7 UNION ALL SELECT 'sections', 6 UNION ALL SELECT 'completeness', round(100 - round(m * 100.0::DOUBLE / (n * 7), 4), 3) FROM s UNION ALL SELECT 'uniqueness', round(100 - round((n - d) * 100.0::DOUBLE / n, 4), 3) FROM s, d")


def _exported(df: DataFrame) -> DataFrame:
    """The missing values of a frame as a report in a file, and what the file holds."""
    import json
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:
        path = FileExporter(Path(folder) / "report.json").export(ReportEngine().run({"missing_values": api.missing(df).to_dict()}))
        sections = json.loads(path.read_text(encoding="utf-8"))["sections"]
    return rows_of(df, [(s["title"], r["column"], r["missing"], r["severity"]) for s in sections for r in s["content"]["reports"]], "section string, column string, missing bigint, severity string")


add("report_file", "dirty_orders", _exported, each(ORDER_COLUMNS, "SELECT 'Missing Values' AS section, '@' AS \"column\", count(*) - count(@) AS missing, CASE WHEN (count(*) - count(@)) * 100.0 / count(*) < 5 THEN 'LOW' WHEN (count(*) - count(@)) * 100.0 / count(*) < 15 THEN 'MEDIUM' WHEN (count(*) - count(@)) * 100.0 / count(*) < 35 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM dirty_orders"))


def _formats(df: DataFrame) -> DataFrame:
    """A table written and read again by each extension that Spark has a format for."""
    import shutil
    import tempfile

    from .sources import files

    out, folder = None, tempfile.mkdtemp(prefix="sievework-formats-")
    try:
        for kind in ("csv", "json", "parquet", "orc"):
            files.write(df, f"{folder}/t.{kind}")
            one = files.read(df.sparkSession, f"{folder}/t.{kind}").select(F.lit(kind).alias("format"), F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")
            rows = one.collect()
            out = rows if out is None else out + rows
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return rows_of(df, [tuple(r) for r in out], "format string, r_regionkey bigint, r_name string")


add("read_formats", "region", _formats, "SELECT f AS format, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region, (VALUES ('csv'), ('json'), ('parquet'), ('orc')) t(f)")
