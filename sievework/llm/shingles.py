"""Near copies of texts, exactly: pairs whose sets of WORDS-word shingles have a Jaccard similarity of SIMILAR or more.

First SimHash through segment popcounts, as in simhash.py: fingerprints of equal or near popcount vectors meet in the grid, those
within BITS bits are candidates, and those whose shingle sets are similar link. Texts this similar may have fingerprints further
apart, so a join that misses none finishes what fingerprints leave open.

That is a set similarity join by prefixes. All shingles are put in one order, and of a text with n of them only the first
n - ceil(0.8 n) + 1 are posted: two similar texts share at least one posted shingle, whatever the order. So the order
may be a guess: shingles that are frequent in a sample of the documents come last, and posts of one shingle stay few.
Texts that meet in a shingle become candidates if their sizes, and what can still follow that shingle in both, allow the
similarity (this holds for the first shingle that two similar texts share, so no pair is lost). Most false ones go by the
texts' sketches, some bits a shingle that bound the similarity from above. Others are verified on
their whole shingle sets, in turns, but for pairs that the links found so far (those of fingerprints first) connect anyway: each text
against one of its candidates, to which its set is sent once; then its other pairs; in the last turn all that are left. So near copies of one
text cost a set each, not one for each pair of them.

Words are runs of other than ASCII white space, without regard to ASCII case; a text of fewer words than WORDS is one
shingle. Texts of equal words are one class throughout, so copies cost one row; texts without words are a class of
their own. Rows with a null id take no part. The cost is linear but for groups of different near copies of one text:
their pairs are all candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_CHARS, attach, discard, map_arrow, materialise, slices
from .components import connected_components
from .simhash import LIMIT, fingerprints, near_fingerprints

WORDS = 5
#: The similarity as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
#: Differing bits up to which fingerprints are candidates. It changes costs alone, as the join by prefixes does the rest.
BITS = LIMIT
#: Documents sampled for the order, frequent shingles kept of them, and how often such a one is seen at least. They change costs alone.
SAMPLE, HOT, OFTEN = 10_000, 1 << 17, 3
#: Tests up to which a table of them (some 60 bytes each) is broadcast; hashes of words kept by a worker; candidate pairs expanded at once.
FEW_IDS, CACHE, PAIRS = 300_000, 100_000, 1_000_000
#: Turns of tests, in the last of which all pairs left are tested; leaves of a hub that go to one part of a task.
TURNS, STAR = 4, 4_096

_cache: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def class_of(words: list[bytes]) -> bytes:
    """16 bytes that stand for the words in their order."""
    from hashlib import blake2b

    return blake2b(b" ".join(words), digest_size=16).digest()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def hashes(words: list[bytes]) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    if len(_cache) > CACHE:
        _cache.clear()
    own = []
    for w in words:
        h = _cache.get(w)
        if h is None:
            h = xxh64_intdigest(w, WORDS)
            if len(w) <= 40:
                _cache[w] = h
        own.append(h)
    x = np.array(own, np.uint64)
    n = len(x) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for k in range(WORDS):
        s = (s ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return np.unique(s)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    p, q = SIMILAR
    return q * both >= p * (len(a) + len(b) - both)


def sketch(h: np.ndarray) -> bytes:
    """The set's size, and a bit for each shingle among at least four times as many (a power of two)."""
    bits = max(64, 1 << (4 * len(h) - 1).bit_length()) if len(h) else 64
    on = np.zeros(bits, np.uint8)
    on[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return len(h).to_bytes(4, "little") + np.packbits(on).tobytes()


def may_be_similar(x: bytes, y: bytes) -> bool:
    """Whether two sets' sketches leave it open: each bit that only one has is a shingle that the other lacks."""
    n, m = int.from_bytes(x[:4], "little"), int.from_bytes(y[:4], "little")
    a, b = np.frombuffer(x, np.uint8, offset=4), np.frombuffer(y, np.uint8, offset=4)
    while len(a) > len(b):  # half the bits: those of equal place in both halves together
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    p, q = SIMILAR
    return q * both >= p * (n + m - both)


def _count_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h = [hashes(words_of(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64) if h else np.zeros(0, np.int64))], ["token"])


def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles that a sample of the documents (text) holds often, the most frequent last."""
    few = docs if n <= SAMPLE else docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (SAMPLE << 20) // n)
    counts = map_arrow(few.select("text"), _count_run, "token bigint").groupBy("token").count().filter(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "token").limit(HOT).collect()
    return np.array([r["token"] for r in reversed(rows)], np.int64).view(np.uint64)


def _post(hot: np.ndarray):
    """Arrow function: (text) -> (token, node, at): posted shingles, with the set's size and the place in its order."""
    by = hot.argsort()
    names = ["token", "node", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies within a task post once; those of other tasks are passed over where they meet
        known = hot[by]
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    digest = class_of(words)
                    if not words or digest in seen:
                        continue
                    seen.add(digest)
                    h = hashes(words)
                    n, (p, q) = len(h), SIMILAR
                    rank = np.zeros(n, np.int64)
                    if len(known):
                        at = np.searchsorted(known, h).clip(max=len(known) - 1)
                        rank = np.where(known[at] == h, by[at] + 1, 0)
                    first = np.lexsort((h, rank))[: n - -(-p * n // q) + 1]
                    out.append((h[first].view(np.int64), np.full(len(first), _node(digest)), np.int64(n) << 32 | np.arange(len(first))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, at): candidate pairs (a, b) of nodes, a below b."""
    p, q = SIMILAR
    held: list[tuple[np.ndarray, ...]] = []

    def pairs(token: np.ndarray, node: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]])
        long = np.repeat(np.diff(run) > 1, np.diff(run))
        end = np.repeat(run[1:], np.diff(run))[long]
        rows = np.flatnonzero(long)
        n = end - rows - 1  # each row meets those after it of its shingle
        size, place = at >> 32, at & 0xFFFFFFFF
        cut = np.concatenate([[0], np.flatnonzero(np.diff(n.cumsum() // PAIRS)) + 1, [len(n)]]) if len(n) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            m = n[a:b]
            i = np.repeat(rows[a:b], m)
            j = np.arange(len(i)) - np.repeat(m.cumsum() - m, m) + i + 1
            most = np.minimum(size[i] - place[i], size[j] - place[j])
            near = (q * size[i] >= p * size[j]) & ((p + q) * most >= p * (size[i] + size[j])) & (node[i] != node[j])
            x, y = node[i[near]], node[j[near]]
            if len(x):
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = tuple(np.asarray(batch.column(c)) for c in ("token", "node", "at"))
        if held and held[-1][0][0] == cols[0][0] == cols[0][-1]:
            held.append(cols)  # still one shingle: joined once, when it is over
            continue
        turn = int(np.searchsorted(cols[0], cols[0][-1]))  # where the last shingle, which may go on, begins
        if turn or held:
            yield from pairs(*(np.concatenate([*[h[k] for h in held], cols[k][:turn]]) for k in range(3)))
        held = [tuple(c[turn:] for c in cols)]
    if held:
        yield from pairs(*(np.concatenate([h[k] for h in held]) for k in range(3)))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chars = SLICE_CHARS // 4  # fingerprints take some 100 bytes a word
    for batch in batches:
        for part in slices(batch, "text", chars):
            texts = part.column("text").to_pylist()
            fp = pa.array(fingerprints(texts, chars).view(np.int64))
            words = [words_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(class_of, words), pa.binary()), pa.array([sketch(hashes(w)) for w in words], pa.binary()), fp], ["id", "class", "sketch", "fp"])


def _star_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, class, hub, salt, leaf) -> (hub, salt, leaf, class, shingles), of rows whose text is of the class."""
    seen: set[tuple] = set()  # repeated rows of a task count once; those of other tasks are only tested again
    last: tuple[str | None, bytes, np.ndarray] | None = None
    for batch in batches:
        for part in slices(batch, "text"):
            out: list[tuple] = []
            for text, class_, hub, salt, leaf in zip(*(part.column(c).to_pylist() for c in ("text", "class", "hub", "salt", "leaf"))):
                if (class_, hub, salt, leaf) in seen:
                    continue
                if last is None or last[0] != text:
                    words = words_of(text)
                    last = text, class_of(words), hashes(words)
                if last[1] == class_:
                    seen.add((class_, hub, salt, leaf))
                    out.append((hub, salt, leaf, class_, last[2].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["hub", "salt", "leaf", "class", "shingles"])


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, leaf), the hub's own first: (a, b) of the leaves similar to it."""
    here, own = None, None
    for batch in batches:
        out: list[tuple[bytes, bytes]] = []
        for hub, salt, leaf, class_, shingles in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "leaf", "class", "shingles"))):
            if (hub, salt) != here:
                here, own = (hub, salt), None
            if not leaf:
                own = np.frombuffer(shingles, np.uint64)
            elif similar(own, np.frombuffer(shingles, np.uint64)):
                out.append((hub, class_))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["a", "b"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [may_be_similar(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        some = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(some) for c in ("hub", "leaf")], ["hub", "leaf"])


def _test(rows: DataFrame, points: DataFrame, stars: DataFrame) -> DataFrame:
    """Of (hub, leaf) pairs of classes those that are similar, as (a, b). A leaf's set goes to its hub; a hub's to each part of its leaves."""
    few = F.broadcast if stars.count() <= FEW_IDS else lambda df: df
    of = lambda c, x: points.select(F.col("class").alias(c), F.col("sketch").alias(x))
    one = materialise(few(stars).join(of("hub", "x"), "hub"), "copy-sketches")
    both = one.join(of("leaf", "y"), "leaf")
    stars = materialise(map_arrow(both.select("hub", "leaf", "x", "y"), _open, "hub binary, leaf binary"), "copy-open")
    salts = stars.groupBy("hub").agg((1 + F.floor(F.count("*") / STAR)).alias("salts"))
    leaves = stars.join(salts, "hub").select("hub", F.pmod(F.xxhash64("leaf"), "salts").alias("salt"), F.lit(True).alias("leaf"), F.col("leaf").alias("class"))
    hubs = salts.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("leaf"), F.col("hub").alias("class"))
    due = leaves.unionByName(hubs).join(points.select("class", F.col("rep").alias("id")), "class")
    due = materialise(due.select("id", "class", "hub", "salt", "leaf"), "copy-tests")
    n = due.count()
    texts = rows.join(F.broadcast(due) if n <= FEW_IDS else due, "id").select("text", "class", "hub", "salt", "leaf")
    sets = map_arrow(texts, _star_sets, "hub binary, salt bigint, leaf boolean, class binary, shingles binary")
    sets = sets.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "leaf")
    found = materialise(map_arrow(sets, _star, "a binary, b binary"), "copy-links")
    discard(one, due, stars)
    return found


def _named(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes as pairs of classes, the lesser of which is the hub of the other."""
    side = lambda n, c: points.select(F.col("node").alias(n), F.col("class").alias(c))
    named = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.least("x", "y").alias("hub"), F.greatest("x", "y").alias("leaf"))
    return materialise(named.distinct(), "copy-pairs")


def near_by_fingerprint(points: DataFrame) -> DataFrame:
    """(hub, leaf) classes of points (class, node, fp) to test: those of one fingerprint with the first, and first ones within BITS bits.

    Of the latter those that connect a cell of the grid, as in simhash.py, so that m texts of near fingerprints cost no m² tests.
    """
    prints = materialise(points.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("_rows")), "copy-fingerprints")
    same = attach(points.select("fp", "node"), prints.filter("_rows > 1"), "fp", points.count()).filter("rep <> node")
    pairs = materialise(near_fingerprints(prints, BITS).unionByName(same.select(F.col("rep").alias("a"), F.col("node").alias("b"))), "copy-near")
    named = _named(pairs, points)
    discard(prints, pairs)
    return named


def _unconnected(todo: DataFrame, tested: DataFrame, joined: DataFrame) -> DataFrame:
    """What is left of the pairs todo, which are deleted: those that were not tested and that no links connect."""
    at = lambda n, c: joined.select(F.col("node").alias(n), F.col("component").alias(c))
    rest = todo.join(tested.select("hub", "leaf"), ["hub", "leaf"], "left_anti").join(at("hub", "p"), "hub", "left").join(at("leaf", "q"), "leaf", "left")
    rest = materialise(rest.filter(~F.coalesce(F.col("p") == F.col("q"), F.lit(False))).select("hub", "leaf"), "copy-pairs")
    discard(todo)
    return rest


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class binary, group binary, first): one row per document with an id; first is the smallest id of its group.

    Two documents link when their texts are similar; a group is what links reach.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).filter("id is not null")
    marked = materialise(map_arrow(rows, _classes, "id bigint, class binary, sketch binary, fp bigint"), "text-classes")
    total = marked.count()
    node = F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("bigint")
    points = marked.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("_rows"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    points = materialise(points.withColumn("node", node), "text-points")
    links: DataFrame | None = None
    joined: DataFrame | None = None
    near = near_by_fingerprint(points)
    if not near.isEmpty():
        links = _test(rows, points, near)
        joined = connected_components(links)
    hot = frequent(rows, total)
    posts = map_arrow(rows.select("text"), _post(hot), "token bigint, node bigint, at bigint")
    posts = posts.repartition("token").sortWithinPartitions("token", "at")
    pairs = materialise(map_arrow(posts, _meet, "a bigint, b bigint").distinct(), "copy-candidates")
    todo = _named(pairs, points)
    discard(pairs)
    if joined is not None:
        todo = _unconnected(todo, near, joined)
    discard(near)
    # Each text is held against one hub first: near copies of one text then are linked, and their other pairs need no test.
    for turn in range(TURNS):
        if todo.isEmpty():
            break
        stars = todo if turn == TURNS - 1 else todo.groupBy("leaf").agg(F.min("hub").alias("hub"))
        found = _test(rows, points, stars)
        links = found if links is None else links.unionByName(found)
        joined = connected_components(links)
        if turn < TURNS - 1:
            todo = _unconnected(todo, stars, joined)
    if joined is None:
        groups = points.select("class", "rep", "_rows", F.col("class").alias("group"))
    else:
        groups = points.join(joined, points["class"] == joined["node"], "left").select("class", "rep", "_rows", F.coalesce("component", "class").alias("group"))
    groups = materialise(groups, "copy-groups")
    first = groups.groupBy("group").agg(F.min("rep").alias("first"))
    names = materialise(groups.join(first, "group").select("class", "group", "first", "_rows"), "copy-names")
    return attach(marked.drop("sketch", "fp"), names, "class", total).select(F.col("id").alias(id_col), "class", "group", "first")
