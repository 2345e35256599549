"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

Vectors link when their labels are equal and not null and their cosine, in double precision, is at least a threshold.
Equal vectors of a label are one class, with a count, from the start. A class's vector is rotated pseudo-randomly (three
rounds of sign flips and a fast Walsh-Hadamard transform) and hashed to the nearest vertex of the cross-polytope, several
rotations together making a bucket, in several tables. Multiprobe: it also goes to the buckets got by taking the
second-nearest vertex in one of the rotations. As many rotations make a bucket as keep it at about LOAD vectors, were
they spread evenly (see SETTINGS), so the pairs compared grow with the number of vectors and not with its square.

Only keys are shuffled to find the buckets that two classes or more share; a class that shares one then goes there with
one byte a component, and with its shared keys. Classes of a bucket are compared in blocks: the bytes bound the cosine from
both sides, which settles most pairs; the few in between are compared again by their whole vectors. A pair is
counted in the least of the buckets that it shares, so no pair leaves a task but those few: only link counts per
class, and a forest of edges for the components.

Buckets of more than BLOCK classes are dealt out in blocks, each pair of blocks to a task of its own: no bucket is capped
and none is gathered whole. How many pairs of a given cosine meet is a matter of chance fixed by SEED; tests measure recall.

Null ids, null labels, and vectors that are null, empty, zero or hold null or non-finite components link with nothing:
their rows come back with no links (a null id: component null, not kept). Vectors of different lengths never link.
Repeated rows are vectors of their own: each counts as a link of the other. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import attach, map_arrow, materialise
from .components import Forest, connected_components
from .vectors import dense

#: Rotations in a bucket's key -> tables, for a recall of 0.99 or more at a cosine of 0.93 (measured in the tests).
SETTINGS, SEED = {2: 5, 3: 8, 4: 14}, 97
#: Vectors of a bucket meant and held in one block; pairs to compare again (some 300 bytes each) whose table is broadcast.
LOAD, BLOCK, FEW_PAIRS = 8, 2048, 50_000


@cache
def _kernel(r: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < r:
        h = np.block([[h, h], [h, -h]])
    return h


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, in radix 16 steps: each turns the last digit of the index and moves it to the front."""
    n, d = x.shape
    left = d
    while left > 1:
        r = min(8 if left == 64 else 16, left)
        x = np.ascontiguousarray((x.reshape(-1, r) @ _kernel(r)).reshape(n, d // r, r).swapaxes(1, 2)).reshape(n, d)
        left //= r
    return x


def rotations(vectors: int, dim: int) -> int:
    """How many rotations make a key, for so many vectors of a label."""
    vertices = 2 << max(1, (dim - 1).bit_length())
    return next((h for h in SETTINGS if (1 + h) * vectors <= LOAD * vertices**h), max(SETTINGS))


def bucket_keys(x: np.ndarray, label: np.ndarray, hashes: int = 2) -> np.ndarray:
    """(n, SETTINGS[hashes] * (1 + hashes)) bucket keys of unit vectors."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    flat = np.zeros((n, d), np.float32)
    flat[:, :dim] = x
    rng = np.random.Generator(np.random.PCG64(SEED + dim))
    tables, all_ = SETTINGS[hashes], np.arange(n)
    out = []
    for table in range(tables):
        near = []  # per rotation: nearest and second-nearest vertex
        for _ in range(hashes):
            y = flat
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], d).astype(np.float32))
            size = np.abs(y)
            one = size.argmax(1)
            size[all_, one] = -1
            two = size.argmax(1)
            near.append((one * 2 + (y[all_, one] < 0), two * 2 + (y[all_, two] < 0)))
        for probe in range(1 + hashes):
            with np.errstate(over="ignore"):
                key = (label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(dim * 1024 + table)
                for k in range(hashes):
                    key = key * np.uint64(0xD6E8FEB86659FD93) + near[k][probe == k + 1].astype(np.uint64)
                    key ^= key >> np.uint64(29)
                key *= np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            out.append(((key & ~np.uint64(15)) | np.uint64(table)).view(np.int64))  # a key tells its table
    return np.stack(out, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _rows(data: list[bytes], packed: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of packed vectors, by length."""
    item = np.dtype(packed).itemsize
    size = np.fromiter(map(len, data), np.int64, len(data))
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        yield rows, _unit(np.frombuffer(b"".join(data[i] for i in rows), packed).astype(np.float64).reshape(-1, width // item))


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, embedding) -> (id, class, label, vector): class and vector null where a row links with nothing.

    A vector's components are packed as they came, in single or double precision.
    """
    from hashlib import blake2b

    for batch in batches:
        single = pa.types.is_float32(batch.schema.field("embedding").type.value_type)
        n = batch.num_rows
        label = batch.column("label").to_pylist()
        ids = batch.column("id").to_pylist()
        kind: list[bytes | None] = [None] * n
        data: list[bytes | None] = [None] * n
        for _, rows, x in dense(batch.column("embedding")):
            top = np.abs(x).max(1) if len(x) else np.zeros(0)
            some = top > 0
            rows, x = rows[some], x[some] + 0.0  # the zeros of either sign are one
            # Scaled by a power of two, so that squares neither overflow nor vanish; cosines stay as they are.
            x = x * np.exp2(-np.floor(np.log2(top[some])))[:, None]
            for i, v in zip(rows.tolist(), x):
                if label[i] is not None and ids[i] is not None:
                    data[i] = (v.astype(np.float32) if single else v).tobytes()
                    kind[i] = blake2b(b"%d:" % label[i] + data[i], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kind, pa.binary()), batch.column("label"), pa.array(data, pa.binary())], ["id", "class", "label", "vector"])


def _entries(packed: str, most: int):
    """Arrow function: (rep, label, vector) -> (key, rep), a row for each bucket. most: vectors of the largest label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column("label")).astype(np.int64)
            for rows, x in _rows(batch.column("vector").to_pylist(), packed):
                keys = bucket_keys(x, label[rows], rotations(most, x.shape[1]))
                keys.sort(axis=1)
                fresh = np.ones(keys.shape, bool)
                fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
                who = np.repeat(rows, keys.shape[1])[fresh.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[fresh.ravel()]), batch.column("rep").take(pa.array(who))], ["key", "rep"])

    return run


_CELL = "key bigint, part bigint, side tinyint, rep bigint, many bigint, label bigint, code binary, scale float, error float, shared binary"


def _cells(packed: str):
    """Arrow function: (rep, many, label, vector, places array<struct<key, blocks>>) -> a row for each cell the class goes to.

    A hot bucket's class is of block m; it goes to the cells of m and x for all x. A cell of one block (side 0) pairs
    all its rows, a cell of two (sides 1 and 2) those of different sides.
    """
    names = [x.split()[0] for x in _CELL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code: list[bytes] = [b""] * n
            scale, error = np.zeros(n, np.float32), np.zeros(n, np.float32)
            for rows, x in _rows(batch.column("vector").to_pylist(), packed):
                width = np.abs(x).max(1) / 127
                q = np.rint(x / width[:, None])
                width = width.astype(np.float32)
                gap = x - q * width.astype(np.float64)[:, None]
                scale[rows], error[rows] = width, np.sqrt((gap * gap).sum(1)) * 1.000001
                for i, v in zip(rows.tolist(), q.astype(np.int8)):
                    code[i] = v.tobytes()
            rep = batch.column("rep").to_pylist()
            out: list[tuple[int, int, int, int]] = []

            def flush() -> pa.RecordBatch:
                who, key, part, side = zip(*out)
                at = pa.array(who)
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part, pa.int64()), pa.array(side, pa.int8()), *[batch.column(c).take(at) for c in ("rep", "many", "label")], pa.array(code, pa.binary()).take(at), pa.array(scale).take(at), pa.array(error).take(at), pa.array(shared, pa.binary()).take(at)], names)

            places = batch.column("places").to_pylist()
            shared = [np.array(sorted((p["key"] for p in some), key=lambda k: k & 15), np.int64).tobytes() for some in places]
            for i, some in enumerate(places):
                for p in some:
                    blocks = p["blocks"]
                    m = (rep[i] * 0x9E3779B97F4A7C15 >> 17) % blocks
                    for x in range(blocks):
                        a, b = min(m, x), max(m, x)
                        out.append((i, p["key"], a << 24 | b, 0 if a == b else 1 if m == a else 2))
                        if len(out) >= 50_000:
                            yield flush()
            if out:
                yield flush()

    return run


def _compare(threshold: float):
    """Arrow function over rows sorted by (key, part): edges (a, b, 0), link counts (a, null, n), pairs to compare again (a, b, -1)."""
    names = ["a", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> pa.RecordBatch:
            """Whole cells: all their pairs, in blocks."""
            key, part = np.asarray(table["key"]), np.asarray(table["part"])
            side = np.asarray(table["side"])
            rep, many, label = np.asarray(table["rep"]), np.asarray(table["many"]), np.asarray(table["label"])
            scale, error = np.asarray(table["scale"]), np.asarray(table["error"])
            code, shared = table["code"].to_pylist(), table["shared"].to_pylist()
            size = np.fromiter(map(len, code), np.int64, len(code))
            # Shared keys by table: (rows, tables, slots), empty ones null. Equal keys are of one table.
            none = np.iinfo(np.int64).max
            count = np.fromiter(map(len, shared), np.int64, len(shared)) // 8
            flat, owner = np.frombuffer(b"".join(shared), np.int64), np.repeat(np.arange(len(shared)), count)
            tab = flat & 15
            start = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (tab[1:] != tab[:-1])]))
            slot = np.arange(len(flat)) - np.repeat(start, np.diff(np.concatenate([start, [len(flat)]])))
            keys = np.full((len(shared), int(tab.max()) + 1, int(slot.max()) + 1), none)
            keys[owner, tab, slot] = flat
            forest, ea, eb = Forest(), [], []
            total: dict[int, int] = {}
            da: list[np.ndarray] = []
            db: list[np.ndarray] = []
            for width in np.unique(size).tolist():  # keys of different lengths differ, so cells stay whole
                rows = np.flatnonzero(size == width)
                x = np.frombuffer(b"".join(code[r] for r in rows), np.int8).reshape(-1, width).astype(np.float32) * scale[rows][:, None]
                k, p, s, lab, err = key[rows], part[rows], side[rows], label[rows], error[rows]
                edge = np.concatenate([[0], np.flatnonzero((np.diff(k) != 0) | (np.diff(p) != 0)) + 1, [len(k)]])
                # Candidates by row: each row meets the rest of its cell after it, some hundred thousand pairs at a time.
                end = np.repeat(edge[1:], np.diff(edge))
                n = end - np.arange(len(k)) - 1
                done = np.concatenate([[0], n.cumsum()])
                at = 0
                while at < len(k):
                    to = max(at + 1, int(np.searchsorted(done, done[at] + 300_000, side="right")) - 1)
                    m = n[at:to]
                    i = np.repeat(np.arange(at, to), m)
                    j = i + 1 + np.arange(len(i)) - np.repeat(m.cumsum() - m, m)
                    at = to
                    ok = ((s[i] == 0) | (s[i] != s[j])) & (lab[i] == lab[j])  # a cell of two blocks pairs across them only
                    i, j = i[ok], j[ok]
                    dot = np.einsum("ij,ij->i", x[i], x[j])
                    slack = err[i] + err[j] + err[i] * err[j] + np.float32(2e-5)
                    near = dot + slack >= threshold
                    i, j, sure = i[near], j[near], (dot - slack)[near] >= threshold
                    if not len(i):
                        continue
                    first = np.zeros(len(i), bool)
                    for a in range(0, len(i), 20_000):
                        ka, kb = keys[rows[i[a : a + 20_000]]], keys[rows[j[a : a + 20_000]]]
                        least = np.where((ka[:, :, :, None] == kb[:, :, None, :]).any(3), ka, none).min((1, 2))
                        first[a : a + 20_000] = least == k[i[a : a + 20_000]]
                    i, j, sure = rows[i[first]], rows[j[first]], sure[first]
                    da.append(rep[i[~sure]])
                    db.append(rep[j[~sure]])
                    i, j = i[sure], j[sure]
                    for a, b, na, nb in zip(rep[i].tolist(), rep[j].tolist(), many[i].tolist(), many[j].tolist()):
                        total[a] = total.get(a, 0) + nb
                        total[b] = total.get(b, 0) + na
                        if forest.union(a, b):
                            ea.append(a)
                            eb.append(b)
            doubt_a, doubt_b = np.concatenate([np.zeros(0, np.int64), *da]), np.concatenate([np.zeros(0, np.int64), *db])
            a = np.concatenate([np.array(ea, np.int64), np.fromiter(total, np.int64, len(total)), doubt_a])
            b = pa.concat_arrays([pa.array(eb, pa.int64()), pa.nulls(len(total), pa.int64()), pa.array(doubt_b, pa.int64())])
            c = np.concatenate([np.zeros(len(ea), np.int64), np.fromiter(total.values(), np.int64, len(total)), np.full(len(doubt_a), -1)])
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(c)], names)

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pending.append(batch)
            held += batch.num_rows
            if held >= 4 * BLOCK:
                table = pa.Table.from_batches(pending)
                spot = np.stack([np.asarray(table["key"]), np.asarray(table["part"])])
                change = np.flatnonzero((spot[:, 1:] != spot[:, :-1]).any(0))
                if len(change):  # the last cell may go on
                    cut = int(change[-1]) + 1
                    yield settle(table.slice(0, cut))
                    pending = table.slice(cut).to_batches()
                    held = sum(b.num_rows for b in pending)
        if held:
            yield settle(pa.Table.from_batches(pending))

    return run


def _again(threshold: float, packed: str):
    """Arrow function: (a, b, x, y, nx, ny) -> (a, b, n) rows as of _compare(), by whole vectors in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            for (rows, u), (_, v) in zip(_rows(x, packed), _rows(y, packed)):
                near = rows[np.einsum("ij,ij->i", u, v) >= threshold]
                a, b, na, nb = (np.asarray(batch.column(c))[near] for c in ("a", "b", "nx", "ny"))
                none = np.zeros(len(near), bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, a, b])), pa.array(np.concatenate([b, b, a]), mask=np.concatenate([none, ~none, ~none])), pa.array(np.concatenate([np.zeros(len(near), np.int64), nb, na]))], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept): one row per vector."""
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[label_col].cast("bigint").alias("label"), vectors[vector_col].alias("embedding"))
    loaded = materialise(map_arrow(rows, _load, "id bigint, class binary, label bigint, vector binary"), "vectors")
    classes = loaded.filter("class is not null").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialise(classes, "vector-classes")
    packed = "float32" if dict(rows.dtypes)["embedding"] == "array<float>" else "float64"
    most = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    entries = materialise(map_arrow(classes.select("rep", "label", "vector"), _entries(packed, most), "key bigint, rep bigint"), "bucket-entries")
    busy = entries.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), F.col("count").alias("_rows"))
    busy = materialise(busy, "shared-buckets")
    placed = attach(entries, busy, "key", entries.count()).filter("blocks is not null")
    places = placed.groupBy("rep").agg(F.collect_list(F.struct("key", "blocks")).alias("places"))  # a row a table and probe at most
    cells = map_arrow(classes.select("rep", "many", "label", "vector").join(places, "rep"), _cells(packed), _CELL)
    cells = cells.repartition("key", "part").sortWithinPartitions("key", "part")
    found = materialise(map_arrow(cells, _compare(threshold), "a bigint, b bigint, n bigint"), "links")
    doubt = found.filter("n = -1").select("a", "b")
    n = doubt.count()
    if n:
        few = F.broadcast if n <= FEW_PAIRS else lambda df: df
        side = lambda rep, x, count: classes.select(F.col("rep").alias(rep), F.col("vector").alias(x), F.col("many").alias(count))
        pairs = side("b", "y", "ny").join(few(side("a", "x", "nx").join(few(doubt), "a")), "b")
        more = map_arrow(pairs.select("a", "b", "x", "y", "nx", "ny"), _again(threshold, packed), "a bigint, b bigint, n bigint")
        found = found.filter("n >= 0").unionByName(materialise(more, "more-links"))
    total = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    joined = connected_components(found.filter("b is not null").select("a", "b"))
    named = classes.select("class", "rep", "many").join(total, F.col("rep") == total["a"], "left").join(joined, F.col("rep") == joined["node"], "left")
    named = named.select("class", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"), F.col("many").alias("_rows"))
    out = attach(loaded.select("id", "class"), materialise(named, "vector-names"), "class", loaded.count())
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS top FROM v UNION SELECT p.b, r.top FROM r JOIN p ON p.a = r.node WHERE r.top < p.b),
c AS (SELECT node, min(top) AS component_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN l ON l.a = v.vec_id
"""
