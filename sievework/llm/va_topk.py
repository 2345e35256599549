"""Exact top-k by inner product through vector approximations (a VA-file).

Vectors take part as integers, floor(SCALE * x). Each is stored twice: exactly, and as an approximation of one byte a
component, the cell floor(x / width) of a grid whose width is the vector's largest component over 127. The scan phase
reads approximations alone, candidates and queries in a grid of blocks: a cell's bounds give each candidate a least and
a greatest possible score, and candidates whose greatest is below the k-th best least are passed over. Bounds of all blocks
are brought together, pruned again, and only then are exact vectors read, best bound first, until the k-th exact score
is certain: no bound that is left exceeds it (an equal one may still win by its smaller id, and is read).

Of equal vectors only the k rows of smallest id that aren't the query's own can ever place; k rows of an id and 2 k in
all hold those, so others leave before the scan: a vector that a third of all rows share costs no more than that. Nothing else is dropped.

Vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no part. Lengths that
differ never meet. Rows of the query's id are its own. Rows are told apart by a number: each pair of a query's and a candidate's row is listed once.
Scores outside 64 bits are ranked exactly and
clamped when returned. Empty tables, and tables of one row, give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, materialise
from .vectors import dense

SCALE, K, EVERY = 256, 5, 50
#: Candidates and queries of a block of the grid.
CANDIDATES, QUERIES = 32_768, 2_048


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding) -> (id, class, dim, width, code, exact)."""
    from hashlib import blake2b

    names = ["id", "class", "dim", "width", "code", "exact"]
    for batch in batches:
        ids = batch.column("id")
        for dim, rows, x in dense(batch.column("embedding")):
            x = np.floor(SCALE * x) + 0.0
            good = np.isfinite(x).all(1)
            rows, x = rows[good], x[good]
            width = np.abs(x).max(1) / 127 if len(x) else np.zeros(0)
            code = np.floor(x / np.where(width > 0, width, 1)[:, None]).clip(-128, 127).astype(np.int8)
            exact = [v.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array([blake2b(v, digest_size=16).digest() for v in exact], pa.binary()), pa.array([dim] * len(rows), pa.int32()), pa.array(width), pa.array([v.tobytes() for v in code], pa.binary()), pa.array(exact, pa.binary())], names)


def _bounds(k: int):
    """A cell of the grid, queries (kind 0) before candidates (kind 1): surviving pairs of rows with their bounds."""
    names = ["query_id", "query_row", "vec_id", "vec_row", "least", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        here = None

        def settle() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(pending)
            kind, ids, row, dim = np.asarray(table["kind"]), np.asarray(table["id"]), np.asarray(table["row"]), table["dim"][0].as_py()
            nq = int((kind == 0).sum())
            if not nq or nq == len(kind):
                return
            width = np.asarray(table["width"])[nq:]
            q = np.frombuffer(b"".join(table["data"].slice(0, nq).to_pylist()), np.float64).reshape(nq, dim)
            c = np.frombuffer(b"".join(table["data"].slice(nq).to_pylist()), np.int8).reshape(-1, dim).astype(np.float64)
            vec = ids[nq:]
            for a in range(0, nq, 64):
                part = q[a : a + 64]
                mid = part @ c.T
                slack = 1e-9 * (np.abs(part).sum(1)[:, None] * 128 * width) + 1e-6
                least = (mid + np.minimum(part, 0).sum(1)[:, None]) * width - slack
                most = (mid + np.maximum(part, 0).sum(1)[:, None]) * width + slack
                own = vec[None] == ids[a : min(a + 64, nq)][:, None]
                least[own] = most[own] = -np.inf
                kth = np.partition(least, -k, axis=1)[:, -k] if len(vec) > k else np.full(len(part), -np.inf)
                i, j = np.nonzero((most >= kth[:, None]) & ~own)
                for s in range(0, len(i), 100_000):
                    ii, jj = i[s : s + 100_000], j[s : s + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + ii]), pa.array(row[a + ii]), pa.array(vec[jj]), pa.array(row[nq + jj]), pa.array(least[ii, jj]), pa.array(most[ii, jj])], names)

        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            turn = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(cell)]):
                if a == b:
                    continue
                if here is not None and cell[a] != here:
                    yield from settle()
                    pending = []
                here = cell[a]
                pending.append(batch.slice(a, b - a))
        if pending:
            yield from settle()

    return run


def _exact(k: int):
    """Rows of a query together, best bound first: its k best exact scores."""
    names = ["query_id", "rank", "vec_id", "score"]

    def ranked(query_id: int, best: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        return [(query_id, r + 1, v, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, v) in enumerate(best)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, best, certain = None, [], False
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            data = (batch.column(c).to_pylist() for c in ("query_id", "vec_id", "most", "query", "exact"))
            for qid, vid, most, qv, xv in zip(*data):
                if qid != here:
                    out += ranked(here, best)
                    here, best, certain = qid, [], False
                if certain or len(best) == k and most < -best[-1][0]:
                    certain = True
                    continue
                query, x = np.frombuffer(qv, np.float64), np.frombuffer(xv, np.float64)
                if np.abs(query).sum() * np.abs(x).max() < 2**53:
                    score = int(query @ x)
                else:
                    score = sum(int(a) * int(b) for a, b in zip(query.tolist(), x.tolist()))
                best = sorted([*best, (-score, vid)])[:k]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names)
        cols = list(zip(*ranked(here, best))) if best else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names)

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by every."""
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].alias("embedding")).filter("id is not null")
    loaded = map_arrow(rows, _load, "id bigint, class binary, dim int, width double, code binary, exact binary")
    loaded = materialise(loaded.withColumn("row", F.monotonically_increasing_id()), "va-file")
    queries = loaded.filter(F.col("id") % every == 0)
    nth = F.row_number().over(Window.partitionBy("class").orderBy("id", "row"))
    of_id = F.row_number().over(Window.partitionBy("class", "id").orderBy("row"))
    able = loaded.select("class", "id", "row", "dim", "width", "code").withColumn("nth", of_id).filter(F.col("nth") <= k)
    able = materialise(able.withColumn("nth", nth).filter(F.col("nth") <= 2 * k).drop("nth", "class"), "va-candidates")
    n, m = able.count(), queries.count()
    cb, qb = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    # Each candidate block meets each query block in one cell; a cell holds one length of vectors.
    cell = lambda c, q: (F.col("dim").cast("bigint") * cb + c) * qb + q
    mine = lambda b: F.pmod(F.xxhash64("id"), F.lit(b))
    left = able.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).select(cell(mine(cb), F.col("q")).alias("cell"), F.lit(1).alias("kind"), "id", "row", "dim", "width", F.col("code").alias("data"))
    right = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))).select(cell(F.col("c"), mine(qb)).alias("cell"), F.lit(0).alias("kind"), "id", "row", "dim", F.lit(0.0).alias("width"), F.col("exact").alias("data"))
    cells = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "kind")
    bounds = materialise(map_arrow(cells, _bounds(k), "query_id bigint, query_row bigint, vec_id bigint, vec_row bigint, least double, most double"), "va-bounds")
    # The k-th best least score over all blocks prunes once more, before any exact vector is read.
    best = bounds.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("least")))).filter(F.col("r") <= k)
    floor = best.groupBy("query_id").agg(F.min("least").alias("floor"), F.max("r").alias("n"))
    kept = bounds.join(floor, "query_id").filter((F.col("n") < k) | (F.col("most") >= F.col("floor"))).select("query_id", "query_row", "vec_id", "vec_row", "most")
    kept = kept.join(loaded.select(F.col("row").alias("vec_row"), "exact"), "vec_row")
    kept = kept.join(queries.select(F.col("row").alias("query_row"), F.col("exact").alias("query")), "query_row")
    kept = kept.repartition("query_id").sortWithinPartitions("query_id", F.desc("most"), "vec_id")
    return map_arrow(kept.select("query_id", "vec_id", "most", "query", "exact"), _exact(k), "query_id bigint, rank int, vec_id bigint, score bigint")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
