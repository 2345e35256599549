"""Metric fusion: many columns' aggregates in one pass, returned as one row a column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kernels import is_fractional, is_integral, is_numeric, kind_of, value

Metric = Callable[[str], Column]


def per_column(df: DataFrame, columns: Sequence[str], metrics: dict[str, Metric], whole: dict[str, Column] | None = None) -> DataFrame:
    """(column, each metric, each whole-table metric): one hash aggregate over df, then one row a column."""
    whole = whole or {}
    aggregates = [m(c).alias(f"m{i}_{k}") for i, c in enumerate(columns) for k, m in enumerate(metrics.values())]
    aggregates += [c.alias(f"w{k}") for k, c in enumerate(whole.values())]
    wide = df.agg(*aggregates)
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"m{i}_{k}").alias(n) for k, n in enumerate(metrics)]) for i, c in enumerate(columns)]
    long = wide.select(F.explode(F.array(*rows)).alias("r"), *[F.col(f"w{k}").alias(n) for k, n in enumerate(whole)])
    return long.select("r.*", *whole)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, number, n) of present values: one shuffle for all columns, combined before.

    Rows are grouped by numbers as they are; the text of a number is made once a group.
    """
    fields: dict[str, str] = {}
    cells, texts, numbers = [], F.col("text"), F.col("real")
    for i, c in enumerate(columns):
        v, kind = value(df, c), kind_of(df, c)
        if is_integral(kind) or kind.simpleString() == "boolean":
            cells.append({"whole": v.cast("bigint")})
        elif is_fractional(kind):
            cells.append({"real": v.cast("double")})
        elif is_numeric(kind):
            cells.append({"real": v.cast("double"), "text": v.cast("string")})
        elif kind.simpleString().startswith(("array", "map", "struct")):
            cells.append({"text": F.when(v.isNotNull(), F.to_json(F.struct(v.alias("v"))))})
        else:
            cells.append({"text": F.base64(v) if kind.simpleString() == "binary" else v.cast("string")})
        fields |= {f: {"whole": "bigint", "real": "double", "text": "string"}[f] for f in cells[-1]}
        if "text" not in cells[-1]:
            f = next(iter(cells[-1]))
            texts = F.when(F.col("at") == i, F.col(f).cast(kind).cast("string")).otherwise(texts)
            if is_integral(kind):
                numbers = F.when(F.col("at") == i, F.col("whole").cast("double")).otherwise(numbers)
    entries = [F.struct(F.lit(i).alias("at"), *[some.get(f, F.lit(None).cast(t)).alias(f) for f, t in fields.items()]) for i, some in enumerate(cells)]
    there = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields])
    groups = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter(there).groupBy("at", *fields).agg(F.count("*").alias("n"))
    groups = groups.select("*", *[F.lit(None).cast(t).alias(f) for f, t in (("whole", "bigint"), ("real", "double"), ("text", "string")) if f not in fields])
    return groups.select(F.array(*map(F.lit, columns))[F.col("at")].alias("column"), texts.alias("value"), numbers.alias("number"), "n")


def distinct_and_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct, mode, repeated): values, the most frequent (smallest of ties), rows in groups above one."""
    first = F.struct((-F.col("n")).alias("k"), "number", "value")
    return value_counts(df, columns).groupBy("column").agg(F.count("*").alias("distinct"), F.min(first)["value"].alias("mode"), F.min(first)["number"].alias("mode_number"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))
