"""Rank correlations over any number of rows: no task holds a whole column, and no pairs of rows are formed.

Values come as counts of distinct pairs (a, b, n). Ranks are running sums over ranges of values, each range a task and
its offset a broadcast row. Kendall's tau counts pairs of rows by ranges of both columns: pairs in different ranges of both are
settled by the table of counts by range, others share a range of a or of b and are counted inside it by merging. A
frequent value is a range of its own, inside which all pairs are ties: however many rows have it, they aren't gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import ship_package

#: Distinct pairs meant for a range, and ranges at most (their table of counts, of (2 RANGES + 1) ** 2 rows, goes to the driver).
RANGE_ROWS, RANGES = 1_000_000, 512


def pair_counts(df: DataFrame, a, b) -> DataFrame:
    """(a, b, n): the distinct pairs of rows that have both."""
    both = df.select(a.cast("double").alias("a"), b.cast("double").alias("b")).dropna()
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def _bounds(pairs: DataFrame, parts: int) -> dict[str, list[float]]:
    """Values that cut each column into about so many ranges."""
    if parts < 2:
        return {"a": [], "b": []}
    probs = [k / parts for k in range(1, parts)]
    row = pairs.agg(*[F.percentile_approx(c, probs, 10 * parts).alias(c) for c in "ab"]).first()
    return {c: sorted(set(row[c] or ())) for c in "ab"}


def _average_ranks(pairs: DataFrame, c: str, bounds: list[float]) -> DataFrame:
    """(c, rank): the mean rank of each value's rows."""
    v = pairs.groupBy(c).agg(F.sum("n").alias("n"))
    v = v.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(c))) if bounds else F.lit(0))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offset = v.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(before.orderBy("part")), F.lit(0)).alias("offset"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy(c)), F.lit(0))
    return v.withColumn("inner", inner).join(F.broadcast(offset), "part").select(c, (F.col("offset") + F.col("inner") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))


def spearman(df: DataFrame, a, b, rows: int) -> DataFrame:
    """(correlation): one row."""
    pairs = pair_counts(df, a, b)
    bounds = _bounds(pairs, min(RANGES, 1 + rows // RANGE_ROWS))
    ranked = pairs.join(_average_ranks(pairs, "a", bounds["a"]), "a").join(_average_ranks(pairs, "b", bounds["b"]), "b")
    middle = ((pairs.agg(F.sum("n")).first()[0] or 0) + 1) / 2
    x, y = (F.col(f"rank_{c}") - middle for c in "ab")
    n = F.col("n")
    sums = ranked.agg(F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    return sums.select((F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("correlation"))


def concordance(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int | float:
    """Sum of n_i n_j sign(b_j - b_i) over all i, j with a_i < a_j, by merging from below."""
    if len(a) < 2:
        return 0
    n = n.astype(np.int64) if n.sum() < 3e9 else n.astype(np.float64)
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    a, b, n = a[start], b[start], np.add.reduceat(n, start)
    group = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    whole, square = np.add.reduceat(n, group), np.add.reduceat(n * n, group)
    # Sorted so, pairs of equal a count as concordant below: they are taken off again.
    total = -((whole * whole - square).sum() / 2 if n.dtype == np.float64 else int((whole * whole - square).sum()) // 2)
    b = np.unique(b, return_inverse=True)[1].astype(np.int64)
    top = int(b.max()) + 1
    at, width = np.arange(len(b)), 1
    while width < len(b):
        block = at // width
        left = block % 2 == 0
        key = block // 2 * top + b
        by = np.argsort(key, kind="stable")
        at, b, n, left, key, block = at[by], b[by], n[by], left[by], key[by], block[by]
        have = key[left]
        done = np.concatenate([np.zeros(1, n.dtype), n[left].cumsum()])
        right = ~left
        base = block[right] // 2 * top
        less = done[np.searchsorted(have, key[right], "left")] - done[np.searchsorted(have, base, "left")]
        more = done[np.searchsorted(have, base + top, "left")] - done[np.searchsorted(have, key[right], "right")]
        total += (n[right] * (less - more)).sum()
        width *= 2
    return total.item() if hasattr(total, "item") else total


def _cross(cells: list[tuple[int, int, int]]) -> int | float:
    """Pairs of rows in different ranges of both columns: concordant less discordant, from the counts by range."""
    if not cells:
        return 0
    p, r, n = (np.array(c) for c in zip(*cells))
    table = np.zeros((p.max() + 2, r.max() + 2), np.longdouble)
    table[p + 1, r + 1] = n
    below = table.cumsum(0).cumsum(1)  # of all ranges up to here
    rows = table.cumsum(0)
    less = below[p, r]
    more = rows[p].sum(1) - below[p, r + 1]
    return float((n * (less - more)).sum())


def kendall(df: DataFrame, a, b, rows: int) -> float | None:
    """Tau-b."""
    ship_package(df.sparkSession)
    pairs = pair_counts(df, a, b)
    bounds = _bounds(pairs, min(RANGES, 1 + rows // RANGE_ROWS))
    cut = {c: np.array(v) for c, v in bounds.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in "ab":
                x = np.asarray(batch.column(c))
                k = np.searchsorted(cut[c], x, "left")
                on = np.zeros(len(x), np.int64) if not len(cut[c]) else (cut[c][np.minimum(k, len(cut[c]) - 1)] == x).astype(np.int64)
                out.append(pa.array(2 * k + on))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], ["a", "b", "n", "p", "r"])

    def inside(key: str, order: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, held, total = None, [], 0

            def settle() -> int | float:
                return concordance(*(np.concatenate([np.asarray(x.column(c)) for x in held]) for c in (order, "b", "n")) if order != "b" else ())

            for batch in batches:
                spot = np.asarray(batch.column(key))
                edge = [0, *(np.flatnonzero(np.diff(spot)) + 1).tolist(), len(spot)]
                for lo, hi in zip(edge, edge[1:]):
                    if lo == hi:
                        continue
                    if held and spot[lo] != here:
                        total += settle()
                        held.clear()
                    here = spot[lo]
                    held.append(batch.slice(lo, hi - lo))
            if held:
                total += settle()
            yield pa.RecordBatch.from_arrays([pa.array([float(total)])], ["s"])

        return run

    placed = pairs.mapInArrow(place, "a double, b double, n bigint, p bigint, r bigint")
    s = _cross([(x["p"], x["r"], x["n"]) for x in placed.groupBy("p", "r").agg(F.sum("n").alias("n")).collect()])
    # Inside a range of a all pairs count, inside one of b those of different ranges of a; ranges of one value hold ties alone.
    for key, order in (("p", "a"), ("r", "p")):
        some = placed.filter(F.col(key) % 2 == 0).repartition(key).sortWithinPartitions(key)
        s += some.mapInArrow(inside(key, order), "s double").agg(F.sum("s")).first()[0] or 0.0
    big = F.col("n").cast("decimal(38,0)")
    ties = [pairs.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum("n").alias("all"), F.sum(big * big).alias("same")).first() for c in "ab"]
    free = [(int(t["all"] or 0) ** 2 - int(t["same"] or 0)) // 2 for t in ties]
    return s / math.sqrt(free[0] * free[1]) if all(free) else None
