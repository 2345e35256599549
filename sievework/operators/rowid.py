"""Row identity: what the order of rows means where it matters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kernels import col

ROW_ID = "_row_id"


def order_of(df: DataFrame, order_by: Sequence[str] | None) -> list[Column]:
    """Columns that order rows: those named, else the reading order (partition by partition)."""
    return [col(c) for c in order_by] if order_by else [F.monotonically_increasing_id()]


def with_row_id(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """A sortable _row_id: the struct of the order columns, or the reading order where none is named."""
    if ROW_ID in df.columns:
        return df
    return df.withColumn(ROW_ID, F.struct(*[col(c) for c in order_by]) if order_by and len(order_by) > 1 else order_of(df, order_by)[0])


def need_columns(df: DataFrame, names: Sequence[str], error: type[Exception] = KeyError) -> list[str]:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise error(f"no column {absent[0]!r}" if error is not KeyError else absent[0])
    return list(names)


def need_frame(df: object) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
    return df
