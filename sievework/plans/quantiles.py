"""Exact quantiles without holding a column's values: order statistics by repeated histograms.

percentile() keeps every distinct value of a column in one task. Above EXACT_ROWS rows the quantiles are found instead by
counting values in BINS equal intervals of the range that holds each wanted rank, taking the interval in which the rank falls,
and again inside it, until an interval has few rows (which are then collected) or a single value. Each round is one
aggregate over all columns and ranks; what reaches the driver is a row per column, rank and interval.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

EXACT_ROWS = 5_000_000
BINS, FEW = 512, 2_000


Range = tuple[int, int, int, float | None, float | None]


def ranges_of(df: DataFrame, columns: Sequence[str], of: Callable[[str], Column]) -> tuple[list[Column], Callable[[Any], dict[str, Range]]]:
    """Aggregates (in a fixed order) that exact_quantiles() begins with, and how to read them off a row: to fuse with others."""
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)
    parts = [(F.count, lambda x: x), (F.count_if, lambda x: x == float("-inf")), (F.count_if, lambda x: x == float("inf")), (F.min, finite), (F.max, finite)]
    out = [f(g(of(c))) for c in columns for f, g in parts]
    return out, lambda row: {c: tuple(row[len(parts) * i : len(parts) * (i + 1)]) for i, c in enumerate(columns)}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], of: Callable[[str], Column], known: tuple[int, dict[str, Range]] | None = None) -> dict[str, list[float] | None]:
    """Quantiles with linear interpolation of of(column), a double without NaN; None for a column without values.

    Infinite values count with their sign. known: the number of rows and what ranges_of() found, where that is so.
    """
    if not columns:
        return {}
    if known is None:
        aggregates, read = ranges_of(df, columns, of)
        row = df.agg(F.count("*"), *[x.alias(f"x{i}") for i, x in enumerate(aggregates)]).first()
        known = row[0], read(row[1:])
    if known[0] <= EXACT_ROWS:
        row = df.agg(*[F.percentile(of(c), F.array(*map(F.lit, probs))).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return dict(zip(columns, row))
    # Values made once a row: the conditions below then read plain columns.
    df, of = df.select(*[of(c).alias(f"x{i}") for i, c in enumerate(columns)]), dict(zip(columns, [F.col(f"x{i}") for i in range(len(columns))])).__getitem__
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}  # (column, rank) -> low, high (both inside), rank within
    for i, c in enumerate(columns):
        n, low, high, a, b = known[1][c]
        for p in probs if n else ():
            for r in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                if r < low or r >= n - high:
                    found[i, r] = float("-inf") if r < low else float("inf")
                else:
                    open_[i, r] = (a, b, r - low)
    while open_:
        spans: dict[tuple[int, float, float], list[tuple[int, int]]] = {}
        for (i, r), (a, b, _) in open_.items():
            spans.setdefault((i, a, b), []).append((i, r))
        keys = list(spans)
        entries = []
        for k, (i, a, b) in enumerate(keys):
            x = of(columns[i])
            entries.append(F.when((x >= a) & (x <= b), F.struct(F.lit(k).alias("k"), _bin(x, a, b).cast("int").alias("bin"), x.alias("x"))))
        rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
        table: dict[int, list] = {}
        for r in rows.groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect():
            table.setdefault(r["k"], []).append(r)
        small: dict[tuple[int, float, float], list[tuple[tuple[int, int], int]]] = {}
        for k, key in enumerate(keys):
            for target in spans[key]:
                rank = open_[target][2]
                for r in sorted(table[k], key=lambda r: r["a"]):
                    if rank < r["n"]:
                        break
                    rank -= r["n"]
                if r["a"] == r["b"]:
                    found[target] = r["a"]
                    del open_[target]
                elif r["n"] <= FEW:
                    small.setdefault((key[0], r["a"], r["b"]), []).append((target, rank))
                    del open_[target]
                else:
                    open_[target] = (r["a"], r["b"], rank)
        if small:
            kept = [F.when((of(columns[i]) >= a) & (of(columns[i]) <= b), F.struct(F.lit(k).alias("k"), of(columns[i]).alias("x"))) for k, (i, a, b) in enumerate(small)]
            some: dict[int, list[float]] = {}
            for r in df.select(F.explode(F.array_compact(F.array(*kept))).alias("e")).select("e.*").collect():
                some.setdefault(r["k"], []).append(r["x"])
            for k, targets in enumerate(small.values()):
                values = sorted(some[k])
                for target, rank in targets:
                    found[target] = values[rank]
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(columns):
        n = known[1][c][0]
        out[c] = [_between(found[i, math.floor(t)], found[i, math.ceil(t)], t - math.floor(t)) for t in ((n - 1) * p for p in probs)] if n else None
    return out


def _bin(x: Column, a: float, b: float) -> Column:
    """One of BINS equal intervals of [a, b]; of two, where the doubles between are too few to tell so many apart."""
    width = b / BINS - a / BINS
    if width > 0 and math.isfinite(b / width) and math.isfinite(a / width) and b / width - a / width >= 2:
        return F.least(F.floor(x / width - a / width), F.lit(BINS - 1))
    middle = a + (b - a) / 2
    return F.when(x <= (middle if a <= middle < b else a), 0).otherwise(1)


def _between(low: float, high: float, share: float) -> float:
    """As percentile() has it: equal values and whole ranks need no arithmetic."""
    return low if low == high or not share else (1 - share) * low + share * high
