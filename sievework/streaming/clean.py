"""Streams: row-independent operations run unchanged; duplicates and metrics get watermarked forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kernels import col, missing
from ..operators.clean import CleaningOperation


def clean_stream(df: DataFrame, operations: Sequence[CleaningOperation]) -> DataFrame:
    """Apply operations that look at one row at a time; any other is refused rather than run wrongly."""
    for op in operations:
        if not op.is_chunk_safe:
            raise ValueError(f"operation {op.name!r} looks at more than one row and can't run on a stream")
        df = op.apply(df)
    return df


def drop_duplicates_within(df: DataFrame, event_time: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_missing(df: DataFrame, event_time: str, window: str, delay: str) -> DataFrame:
    """Rows and missing cells per column and tumbling window of event time."""
    names = [c for c in df.columns if c != event_time]
    counts: list[Column] = [F.count_if(missing(df, c)).alias(f"missing_{c}") for c in names]
    g = df.withWatermark(event_time, delay).groupBy(F.window(col(event_time), window).alias("w"))
    return g.agg(F.count("*").alias("rows"), *counts).select(F.col("w.start").alias("window_start"), "rows", *[f"missing_{c}" for c in names])


def observe_contract(df: DataFrame, contract, name: str = "contract") -> DataFrame:
    """Counts of a contract's violations as observed metrics of each micro-batch."""
    from ..operators.rules import DataContract, contract_checks

    checks = [(k, c, x) for k, c, x in contract_checks(df, DataContract.of(contract)) if not isinstance(x, bool) and k != "unique"]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(x).alias(f"{k}_{c}") for k, c, x in checks])
