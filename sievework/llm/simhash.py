"""SimHash near-duplicates through segment popcounts.

A fingerprint is cut into segments and mapped to its bits set per segment. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so a range join of the vectors within the limit finds every
pair. The grid's cells are the vectors over SEGMENTS coarse segments: a distinct fingerprint is at home in its own cell
and visits each cell within the limit (one of the two directions suffices for a pair). Inside a cell, homes are sorted
by the finer vector of eight segments, packed in one integer; the finer vectors that a visitor may meet are looked up by
binary search, and what is found is verified exactly by XOR and popcount.

Equal fingerprints are one point throughout, so groups of copies of any size cost a single row here. Verified pairs
become the edges of a forest within each cell (never all pairs of a group), and components are joined from those.

Null and empty texts have no words: fingerprint zero, linked like any other. Repeated rows share a class. An id that is
null keeps its row, with the smallest id of its class (null where none has one). Other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_CHARS, attach, map_arrow, materialise, pieces, slices
from .components import Forest, connected_components

SEED = 42
WORDS = 3
LIMIT = 3
#: Coarse segments (the grid's dimensions) and fine ones (the order inside a cell).
SEGMENTS, FINE = 4, 8
#: Fingerprints for each part that a cell's homes are dealt out in (a cell has some thousandth of all at most).
HOMES_A_TASK = 200_000_000


def _fingerprint_of_pieces(text: str, chars: int) -> int:
    """The fingerprint of a long text, a piece at a time: bits set are summed, and a piece begins with the words before."""
    from xxhash import xxh64_intdigest

    ones, n, before = np.zeros(64, np.int64), 0, []
    for _, part in pieces(text, chars):
        words = [*before, *part.encode("utf-8", "surrogatepass").lower().split()]
        before = words[1 - WORDS :]
        h = np.fromiter((xxh64_intdigest(b" ".join(words[i : i + WORDS]), SEED) for i in range(len(words) - WORDS + 1)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    if not n and before:  # fewer words than a shingle has
        return xxh64_intdigest(b" ".join(before), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(texts: list[str | None], chars: int = SLICE_CHARS) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text's word shingles, repeats included. Texts beyond so many characters are taken in pieces."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    count = np.zeros(len(texts), np.int64)
    long = {k: _fingerprint_of_pieces(t, chars) for k, t in enumerate(texts) if t and len(t) > chars}
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text and k not in long else []
        n = len(words)
        if not n:
            continue
        data = b" ".join(words)
        if n <= WORDS:
            hashes.append(xxh64_intdigest(data, SEED))
            count[k] = 1
            continue
        size = np.fromiter(map(len, words), np.int64, n)
        end = (size + 1).cumsum() - 1
        first = end - size
        hashes += [xxh64_intdigest(data[a:b], SEED) for a, b in zip(first[: n - WORDS + 1].tolist(), end[WORDS - 1 :].tolist())]
        count[k] = n - WORDS + 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        h = np.array(hashes, np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        start = np.concatenate([[0], count[some].cumsum()[:-1]])
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        major = 2 * ones.astype(np.int64) > count[some][:, None]
        out[some] = np.packbits(major.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    for k, fp in long.items():
        out[k] = fp
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return map_arrow(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")), run, "id bigint, fp bigint")


def _popcounts(fp: np.ndarray, segments: int) -> np.ndarray:
    """(n, segments) bits set per segment of equal width."""
    width = 64 // segments
    shift = np.arange(segments, dtype=np.uint64) * np.uint64(width)
    return np.bitwise_count(fp[:, None] >> shift & np.uint64((1 << width) - 1)).astype(np.int64)


def _ball(dims: int, radius: int) -> np.ndarray:
    """Integer vectors of Manhattan norm at most radius."""
    if radius > 4:
        raise ValueError("limits above 4 differing bits aren't supported")

    def grow(d: int, r: int) -> list[tuple[int, ...]]:
        return [()] if not d else [(x, *rest) for x in range(-r, r + 1) for rest in grow(d - 1, r - abs(x))]

    return np.array(grow(dims, radius), np.int64)


def _pack(vectors: np.ndarray, base: int = 128) -> np.ndarray:
    return vectors @ (base ** np.arange(vectors.shape[1], dtype=np.int64))


def _cells(limit: int, parts: int):
    """Arrow function: (fp, rep) -> (cell, part, visit, fp, rep), homes and visits."""
    ball = _ball(SEGMENTS, limit)
    ahead = ball[_pack(ball) > 0]  # of two cells, the one behind visits the one ahead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = np.asarray(batch.column("fp").slice(at, 20_000)).view(np.uint64)
                rep = np.asarray(batch.column("rep").slice(at, 20_000))
                v = _popcounts(fp, SEGMENTS)
                to = v[:, None, :] + ahead[None]
                ok = ((to >= 0) & (to <= 64 // SEGMENTS)).all(2)
                who, where = np.nonzero(ok)
                who, cell = np.concatenate([np.arange(len(fp)), who]), np.concatenate([_pack(v, 32), _pack(to[who, where], 32)])
                visit = np.repeat([False, True], [len(fp), len(cell) - len(fp)])
                part = (fp % np.uint64(parts)).astype(np.int32)[who]
                if parts > 1:  # homes are dealt out; a visit, and a home as its own cell's visitor, goes to each part
                    again = np.concatenate([np.flatnonzero(visit), np.arange(len(fp))])
                    who, cell = np.concatenate([np.arange(len(fp)), np.repeat(who[again], parts)]), np.concatenate([cell[: len(fp)], np.repeat(cell[again], parts)])
                    part = np.concatenate([part[: len(fp)], np.tile(np.arange(parts, dtype=np.int32), len(again))])
                    visit = np.repeat([False, True], [len(fp), len(cell) - len(fp)])
                for a in range(0, len(who), 200_000):
                    w = who[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 200_000].astype(np.int32)), pa.array(part[a : a + 200_000]), pa.array(visit[a : a + 200_000]), pa.array(fp[w].view(np.int64)), pa.array(rep[w])], ["cell", "part", "visit", "fp", "rep"])

    return run


def _meet(limit: int, parts: int):
    """Arrow function over rows sorted by (cell, part, visit): verified edges (a, b) between representatives."""
    fine = _ball(FINE, limit)
    coarse = _pack(fine.reshape(len(fine), SEGMENTS, FINE // SEGMENTS).sum(2), 32)
    by_shift = {int(s): np.sort(_pack(fine[coarse == s])) for s in np.unique(coarse)}

    def pairs(fa: np.ndarray, fb: np.ndarray, keys_b: np.ndarray, shift: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of visitors a and sorted homes b that are within the limit."""
        keys_a = _pack(_popcounts(fa, FINE))
        for step in by_shift.get(shift, ()):
            want = keys_a + step
            lo, hi = np.searchsorted(keys_b, want), np.searchsorted(keys_b, want, side="right")
            n = hi - lo
            for first in range(0, len(n), 4096):  # so that runs of equal vectors are expanded piece by piece
                m = n[first : first + 4096]
                total = int(m.sum())
                if not total:
                    continue
                for part in np.array_split(np.flatnonzero(m), max(1, total // 2_000_000)):
                    i = np.repeat(part + first, m[part])
                    j = np.arange(len(i)) - np.repeat(m[part].cumsum() - m[part], m[part]) + np.repeat(lo[part + first], m[part])
                    near = (np.bitwise_count(fa[i] ^ fb[j]) <= limit) & ((fa[i] < fb[j]) if own else True)
                    if near.any():
                        yield i[near], j[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: list[tuple[np.ndarray, np.ndarray]] = []
        here, ready, forest = None, None, Forest()
        out_a: list[int] = []
        out_b: list[int] = []

        def match(fa: np.ndarray, ra: np.ndarray, shift: int, own: bool) -> None:
            fb, keys_b, rb = ready
            for i, j in pairs(fa, fb, keys_b, shift, own):
                for x, y in zip(ra[i].tolist(), rb[j].tolist()):
                    if forest.union(x, y):
                        out_a.append(x)
                        out_b.append(y)

        def settle():
            """All homes of the cell are in: sort them, and match them among themselves."""
            nonlocal ready, homes
            fp = np.concatenate([x for x, _ in homes]) if homes else np.zeros(0, np.uint64)
            rep = np.concatenate([x for _, x in homes]) if homes else np.zeros(0, np.int64)
            key = _pack(_popcounts(fp, FINE))
            order = key.argsort(kind="stable")
            ready, homes = (fp[order], key[order], rep[order]), []
            if parts == 1 and len(fp) > 1:
                for a in range(0, len(fp), 1 << 16):
                    match(ready[0][a : a + (1 << 16)], ready[2][a : a + (1 << 16)], 0, True)

        for batch in batches:
            cell = np.asarray(batch.column("cell")).astype(np.int64)
            spot = cell << 32 | np.asarray(batch.column("part"))
            visit = np.asarray(batch.column("visit").to_numpy(zero_copy_only=False))
            fp, rep = np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("rep"))
            turn = np.flatnonzero((np.diff(spot) != 0) | (visit[1:] != visit[:-1])) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(spot)]):
                if a == b:
                    continue
                if spot[a] != here:
                    if here is not None and ready is None:
                        settle()
                    here, ready, homes, forest = spot[a], None, [], Forest()
                if not visit[a]:
                    homes.append((fp[a:b], rep[a:b]))
                    continue
                if ready is None:
                    settle()
                if len(ready[0]):
                    shift = cell[a] - _pack(_popcounts(fp[a:b], SEGMENTS), 32)
                    order = shift.argsort(kind="stable")
                    edge = np.flatnonzero(np.diff(shift[order])) + 1
                    for part in np.split(order, edge):
                        s = int(shift[part[0]])
                        match(fp[a:b][part], rep[a:b][part], s, s == 0)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        if here is not None and ready is None:
            settle()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def near_fingerprints(points: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): edges that connect all points (fp, rep; fingerprints distinct, rep not null) within limit bits."""
    n = points.count()
    parts = 1 + n // HOMES_A_TASK
    spots = map_arrow(points.select("fp", "rep"), _cells(limit, parts), "cell int, part int, visit boolean, fp bigint, rep bigint")
    spots = spots.repartition(F.col("cell"), F.col("part")).sortWithinPartitions("cell", "part", "visit")
    return map_arrow(spots, _meet(limit, parts), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, fingerprint, component_id): one row per document.

    Two documents link when their fingerprints differ in at most limit bits; component_id is the smallest id reachable.
    """
    marked = materialise(fingerprint_documents(docs, id_col, text_col), "fingerprints")
    points = materialise(marked.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("_rows")), "fingerprint-points")
    # A class without any id cannot name a component; it keeps null, and links nothing that has one.
    edges = near_fingerprints(points.filter("rep is not null"), limit)
    joined = connected_components(edges)
    labels = points.join(joined, points["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "_rows")
    # A fingerprint may be that of a third of all documents: such ones are broadcast to their rows.
    out = attach(marked, materialise(labels, "fingerprint-names"), "fp", marked.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
