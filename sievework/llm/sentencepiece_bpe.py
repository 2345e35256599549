"""SentencePiece merge-type (BPE) encoding by a score-ordered agenda, checked against the library.

Every text is cut where no piece of the vocabulary can span: before a run of space marks, around characters that are
in no piece, and between a letter and punctuation that no piece has after a letter. Merges never cross such
a cut, so chunks encode independently of each other, and equal chunks encode equally. A chunk's symbols are merged
through an agenda of adjacent pairs, best score first and leftmost on ties: a heap for long chunks, whose stale
entries are passed over, and rows of priorities taken in lock step for the many short ones. What remains and is no piece falls back to its UTF-8 bytes.

New chunks of an Arrow batch are also given to the sentencepiece library, and the two results compared; should they
differ, the task fails. Vocabularies with normalisation rules, user-defined or unused pieces, or
pieces with an inner space mark are refused when loaded rather than encoded wrongly.

Nulls encode as the empty text: no ids. Empty tables give empty tables; repeated rows give repeated results; columns
besides the id and the text are not read. Very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

MARK = "▁"
#: Chunks that a Python worker remembers before it starts anew; slices of text add to it by their size only.
CACHE = 160_000
#: Code points of chunks merged in lock step; longer ones, and ones with characters outside the vocabulary, use the heap.
SHORT = 24
NEVER = np.iinfo(np.int32).max


class PairTable:
    """(left id, right id) -> merged id, for numpy arrays of pairs: open addressing at low load."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, -1, np.int32)
        for (a, b), i in pairs.items():
            key = a << 32 | b
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.keys[at], self.ids[at] = key, i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, -1 where the two don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ids[at], np.int32(-1))
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at = at[todo] + 1 & (1 << self.bits) - 1 if len(at) == len(key) else at + 1 & (1 << self.bits) - 1
            found, want = self.keys[at], key[todo]
            out[todo[found == want]] = self.ids[at[found == want]]
            more = (found != want) & (found >= 0)
            todo, at = todo[more], at[more]
        return out


class PieceEncoder:
    """Encoder for one .model file of type BPE with byte fallback, space mark in front and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece as spm

        self.library = spm.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.bytes_id: dict[int, int] = {}
        self.rank: dict[str, tuple[float, int]] = {}  # piece -> (-score, id)
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes_id[int(piece[3:-1], 16)] = i
            elif lib.is_control(i) or lib.is_unknown(i):
                continue
            elif lib.is_unused(i):
                raise ValueError("a vocabulary with unused pieces isn't supported")
            else:
                self.rank[piece] = (-lib.get_score(i), i)
        if len(self.bytes_id) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece has an inner space mark: texts can't be cut at spaces")
        if not lib.id_to_piece(lib.encode("a")[0]).startswith(MARK):
            raise ValueError("the model puts no space mark in front")
        for probe in ("  a  \uff21 ", "e\u0301\u00e9\t\n"):
            if lib.decode(lib.encode(probe)) != probe:
                raise ValueError("the model normalises its input")
        # Priorities as dense ranks of the scores: equal scores share one, and the leftmost pair goes first.
        order = {s: k for k, s in enumerate(sorted({s for s, _ in self.rank.values()}))}
        self.priority = np.full(n + 1, NEVER, np.int32)
        for s, i in self.rank.values():
            self.priority[i] = order[s]
        self.pad = n
        self.char_id = np.full(0x110000, -1, np.int32)
        pairs = {}
        for p, (_, i) in self.rank.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
            for k in range(1, len(p)):
                if (a := self.rank.get(p[:k])) and (b := self.rank.get(p[k:])):
                    pairs[a[1], b[1]] = i
        self.pairs = PairTable(pairs)
        # Where no piece can span: on both sides of characters outside the vocabulary (a line feed), and between a
        # letter and such punctuation as follows no letter in any piece.
        after = {p[i + 1] for p in self.rank for i in range(len(p) - 1) if p[i].isalpha()}
        self.kind = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)  # 1: letter
        for c in ".,;:!?|*&%$#":
            self.kind[ord(c)] = 2 * (c not in after)
        for c in "\n\t\r":
            self.kind[ord(c)] = 3 * all(c not in p for p in self.rank)
        self.kind[32] = 4
        self.fence = next(c for c in map(chr, range(1, 32)) if not any(c in p for p in self.rank))
        self.digits = list(map(str, range(n))).__getitem__
        # The cache: by chunk (marks as spaces) its number, by number its ids, those in decimal, and how often it was met.
        self.number: dict[str, int] = {}
        self.text_of: list[bytes] = []
        self.met = np.zeros(0, np.int64)
        self.ids, self.end, self.used = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), 0

    def forget(self) -> None:
        """Keep of the cache what was met repeatedly, and of that the more frequent half of its size at most."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > CACHE // 2:
            keep = np.sort(keep[np.argpartition(-self.met[keep], CACHE // 2)[: CACHE // 2]])
        size = self.end[keep + 1] - self.end[keep]
        end = size.cumsum()
        ids = self.ids[np.repeat(self.end[keep] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        names, some = list(self.number), keep.tolist()
        self.number = {names[k]: i for i, k in enumerate(some)}
        self.text_of = [self.text_of[k] for k in some]
        self.met = self.met[keep] // 2
        self.ids, self.end, self.used = np.concatenate([ids, np.zeros(1 << 16, np.int32)]), np.concatenate([[0], end]), len(ids)

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk with its marks, by a heap of adjacent pairs. For chunks of any length and character."""
        rank, get, n = self.rank, self.rank.get, len(chunk)
        sym: list[str | None] = list(chunk)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, chunk[i : i + 2]) for i in range(n - 1) if (r := get(chunk[i : i + 2]))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            a, j = sym[i], right[i]
            if a is None or j >= n or len(a) + len(sym[j]) != len(pair):
                continue  # a symbol has changed since
            sym[i], sym[j] = pair, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if r := get(pair + sym[k]):
                    heapq.heappush(heap, (r[0], i, pair + sym[k]))
            if (h := left[i]) >= 0 and (r := get(sym[h] + pair)):
                heapq.heappush(heap, (r[0], h, sym[h] + pair))
        ids: list[int] = []
        for s in sym:
            if s is not None:
                ids += [r[1]] if (r := rank.get(s)) else [self.bytes_id[b] for b in s.encode("utf-8", "surrogatepass")]
        return ids

    def lockstep(self, chars: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same agenda for many short chunks at once: rows of symbols, and how many remain of each.

        A row of priorities of adjacent pairs is each chunk's agenda; a step takes the best, leftmost, pair of every row.
        """
        w, width = chars.shape
        sym = np.concatenate([chars, np.full((w, 1), self.pad, np.int32)], axis=1)
        look = lambda a, b: self.priority[self.pairs(a, b)]  # noqa: E731  (-1, no merge, is the last: NEVER)
        prio = look(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(w, width)
        out, left, rows, cols = sym.copy(), lens.copy(), np.arange(w), np.arange(width + 1)
        while True:
            at = prio.argmin(1)
            go = np.flatnonzero(prio[np.arange(len(rows)), at] < NEVER)
            if len(go) < len(rows):
                stop = np.ones(len(rows), bool)
                stop[go] = False
                out[rows[stop], : sym.shape[1]] = sym[stop]
                if not len(go):
                    return out, left
                rows, sym, prio, at = rows[go], sym[go], prio[go], at[go]
            r = np.arange(len(rows))
            sym[r, at] = self.pairs(sym[r, at], sym[r, at + 1])
            left[rows] -= 1
            take = np.minimum(cols + (cols > at[:, None]), width)
            sym = np.take_along_axis(sym, take, 1)
            sym[:, width] = self.pad
            prio = np.take_along_axis(prio, np.minimum(take[:, :width], width - 1), 1)
            prio[:, width - 1] = NEVER
            prio[r, at] = look(sym[r, at], sym[r, at + 1])
            some = np.flatnonzero(at > 0)
            prio[some, at[some] - 1] = look(sym[some, at[some] - 1], sym[some, at[some]])

    def encode_chunks(self, keys: list[str]) -> list[list[int]]:
        """Ids of chunks whose marks are written as spaces."""
        full = [k.replace(" ", MARK) for k in keys]
        out: list[list[int] | None] = [None] * len(full)
        lens = np.fromiter(map(len, full), np.int64, len(full))
        codes = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ids = self.char_id[codes]
        ids = np.where(ids < 0, (codes + self.pad + 1).astype(np.int32), ids)  # outside the vocabulary: merge with nothing
        start = np.concatenate([[0], lens.cumsum()])
        for lo, hi in ((0, 6), (6, 9), (9, 13), (13, SHORT)):
            pick = np.flatnonzero((lens > lo) & (lens <= hi))
            if len(pick):
                n = lens[pick]
                grid = start[pick][:, None] + np.arange(hi)
                chars = np.where(np.arange(hi) < n[:, None], ids[np.minimum(grid, len(ids) - 1)], np.int32(self.pad))
                sym, left = self.lockstep(chars, n)
                odd = (sym > self.pad).any(1).tolist()
                for i, row, k, o in zip(pick.tolist(), sym.tolist(), left.tolist(), odd):
                    out[i] = row[:k] if not o else [b for x in row[:k] for b in ([x] if x < self.pad else [self.bytes_id[v] for v in chr(x - self.pad - 1).encode("utf-8", "surrogatepass")])]
        return [x if x is not None else self.agenda(c) for x, c in zip(out, full)]

    def learn(self, new: list[str]) -> None:
        """Encode chunks not met before, and hold them against the library in one call.

        The library puts a mark in front of each text; a character that merges with nothing fences that off.
        """
        mine = self.encode_chunks(new)
        for i, theirs in enumerate(self.library.encode([self.fence + c for c in new], num_threads=1)):
            if theirs[2:] != mine[i]:
                raise ValueError(f"chunk {new[i]!r} encodes as {mine[i]}, by the library as {theirs[2:]}")
        self.text_of += [(",".join(map(self.digits, ids)) + ",").encode() for ids in mine]
        self.number.update(zip(new, range(len(self.number), len(self.text_of))))
        flat = np.fromiter(chain.from_iterable(mine), np.int32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.end = np.concatenate([self.end, self.used + np.fromiter(map(len, mine), np.int64, len(mine)).cumsum()])
        self.used += len(flat)

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Chunks of all texts in order, and how many each text has. Chunks begin with their run of marks, if any."""
        some = [" " + t.replace(MARK, " ") for t in texts if t]
        if not some:
            return [], np.zeros(len(texts), np.int64)
        big = "".join(some)
        kind = self.kind[np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.concatenate([[0], np.fromiter(map(len, some), np.int64, len(some)).cumsum()])
        prev, here = kind[:-1], kind[1:]
        edge = (here == 4) & (prev != 4) | (here == 3) | (prev == 3) | (here == 2) & (prev == 1)
        edge[begin[1:-1] - 1] = True
        at = np.concatenate([[0], np.flatnonzero(edge) + 1, [len(big)]])
        count = np.zeros(len(texts), np.int64)
        count[[bool(t) for t in texts]] = np.diff(np.searchsorted(at, begin))
        at = at.tolist()
        return [big[a:b] for a, b in zip(at, at[1:])], count

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], bytes]]:
        """Ids of each text, and those in decimal joined by commas."""
        if len(self.number) > CACHE:
            self.forget()
        chunks, count = self.cut(texts)
        which = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(which < 0).tolist()
        if new:
            missing = [chunks[i] for i in new]
            self.learn(list(dict.fromkeys(missing)))
            which[new] = list(map(self.number.__getitem__, missing))
            self.met = np.concatenate([self.met, np.zeros(len(self.number) - len(self.met), np.int64)])
        self.met += np.bincount(which, minlength=len(self.met))
        first, size = self.end[which], self.end[which + 1] - self.end[which]
        total = size.cumsum()
        ids = self.ids[np.repeat(first - total + size, size) + np.arange(total[-1] if len(total) else 0)].tolist()
        numbers, texts_of = which.tolist(), self.text_of.__getitem__
        a = b = 0
        for n in count.tolist():
            m = int(total[a + n - 1]) if n else b
            yield ids[b:m], b"".join(map(texts_of, numbers[a : a + n]))[:-1]
            a, b = a + n, m


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def _texts(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    from .common import slices

    for part in slices(batch, "text", chars):
        yield part, [t or "" for t in part.column("text").to_pylist()]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): the operator's real output."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for part, texts in _texts(batch, 1 << 19):
                ids = [x for x, _ in enc.encode(texts)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(ids, pa.list_(pa.int32())), pa.array(enc.library.decode(ids, num_threads=1) if ids else [], pa.string())], [id_col, "ids", "decoded"])

    return map_arrow(docs.select(docs[id_col], docs[text_col].alias("text")), run, f"{id_col} {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), without the ids leaving the worker."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for part, texts in _texts(batch, 1 << 19):
                ids, a = [], []
                for x, joined in enc.encode(texts):
                    ids.append(x)
                    a.append(hashlib.sha256(joined).hexdigest())
                n = list(map(len, ids))
                b = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in enc.library.decode(ids, num_threads=1)] if ids else []
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(docs[id_col], docs[text_col].alias("text")), run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
