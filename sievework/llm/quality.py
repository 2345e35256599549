"""Quality by naive Bayes support vectors.

A document is the set of its n-grams: words and pairs of words, and single, paired and tripled token shapes (case,
length, what punctuation ends it, whether it repeats the token before), each hashed to one of BUCKETS. An indicator is
scaled by its class log-count ratio, the rows are brought to unit length, and a linear hinge-loss model is fitted to them
by dual coordinate descent. A logistic, fitted on a fifth of the sample that the model then hasn't seen, turns margins
into scores.

The fit runs on the driver over a sample bounded by PER_CLASS documents a class of at most MAX_CHARS code points each
(see common.training_sample); two arrays of BUCKETS numbers go to the tasks in their closure. Scores are of whole texts.

Null and empty texts, and texts of white space only, have no n-gram: they get the score of the bias alone. Repeated rows get
repeated results, an empty table an empty one; without labels of both classes every score is 0.5. Columns besides
the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_CHARS, map_arrow, pieces, slices, training_sample

PER_CLASS, MAX_CHARS, BUCKETS = 800, 20_000, 1 << 18
_CACHE = 300_000
_PARTS = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)


def _crc(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def describe(token: str) -> tuple[int, int]:
    """Hashes of a token's word and of its shape."""
    before, word, after = _PARTS.match(token).groups()
    if not word:
        case = "S"
    elif any(c.isdigit() for c in word):
        case = "N"
    elif len(word) > 1 and word.isupper():
        case = "U"
    elif word[0].isupper():
        case = "T" if word[1:].islower() or len(word) == 1 else "M"
    else:
        case = "l" if word.islower() else "M"
    return _crc(word.lower()), _crc(f"{before[:2]}|{case}{min(len(word) // 4, 5)}|{after[:3]}")


@dataclass
class QualityModel:
    ratio: np.ndarray
    weight: np.ndarray  # of unit rows, the bias last
    logistic: tuple[float, float]
    types: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"types": {}, "_rows": None}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        doc, bucket = self.indicators(texts)
        r = self.ratio[bucket]
        n = len(texts)
        norm = np.sqrt(np.bincount(doc, r * r, n))
        return np.bincount(doc, r * self.weight[bucket], n) / np.where(norm > 0, norm, 1) + self.weight[-1]

    def score(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.logistic
        return 1 / (1 + np.exp(-np.clip(a + b * self.margins(texts), -30, 30)))

    def indicators(self, texts: list[str | None], chars: int = SLICE_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket) of all distinct n-grams, by document. Texts beyond so many characters are taken in pieces."""
        long = {k for k, t in enumerate(texts) if t and len(t) > chars}
        keys = [self._grams(["" if k in long else t for k, t in enumerate(texts)])]
        for k in sorted(long):
            before, more = [], False
            for _, part in pieces(texts[k], chars):
                # The three tokens before come first, of which the first only tells whether the next repeats it.
                tokens = [*before, *part.split()]
                keys.append(k * BUCKETS + self._grams([" ".join(tokens)], int(more)))
                before, more = tokens[-3:], more or len(tokens) > 3
        keys = np.unique(np.concatenate(keys)) if long else keys[0]
        return keys // BUCKETS, keys % BUCKETS

    def _grams(self, texts: list[str | None], skip: int = 0) -> np.ndarray:
        """document * BUCKETS + bucket of the distinct n-grams without the first skip tokens, in order."""
        if len(self.types) > _CACHE:
            self.types = {}
        tokens = [t.split() if t else [] for t in texts]
        count = np.fromiter(map(len, tokens), np.int64, len(tokens))
        new = [t for t in set().union(*tokens) if t not in self.types]
        if not self.types:
            self._rows = np.zeros((1024, 2), np.uint64)
        at = len(self.types)
        while at + len(new) > len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        for t in new:
            self.types[t] = at
            self._rows[at] = describe(t)
            at += 1
        get = self.types.__getitem__
        kind = np.concatenate([np.fromiter(map(get, t), np.int64, len(t)) for t in tokens]) if len(texts) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), count)
        word, shape = self._rows[kind, 0], self._rows[kind, 1].copy()
        same = np.zeros(len(doc), bool)  # whether the token before is of the document
        same[1:] = doc[1:] == doc[:-1]
        again = np.zeros(len(doc), bool)
        again[1:] = same[1:] & (kind[1:] == kind[:-1])
        shape += again.astype(np.uint64) << np.uint64(40)
        with np.errstate(over="ignore"):
            mul = np.uint64(0x9E3779B97F4A7C15)
            mix = lambda salt, h: ((h + np.uint64(salt)) * mul >> np.uint64(20)) * mul
            one, two, three = np.arange(skip, len(doc)), np.flatnonzero(same), np.flatnonzero(same[1:] & same[:-1]) + 1
            two, three = two[two > skip], three[three > skip + 1]
            w1, s1 = mix(1, word), mix(2, shape)
            grams = [(doc[one], w1[one]), (doc[one], s1[one]), (doc[two], mix(3, w1[two - 1]) + w1[two]), (doc[two], mix(4, s1[two - 1]) + s1[two]), (doc[three], mix(5, mix(6, s1[three - 2]) + s1[three - 1]) + s1[three])]
            keys = np.concatenate([d.astype(np.int64) * BUCKETS + (h * mul >> np.uint64(64 - 18)).astype(np.int64) for d, h in grams])
        return np.unique(keys)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Weights (the bias last) of the L1-loss linear support vector machine over sparse rows (indices, values)."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            grad = y[i] * (w[idx] @ val + w[-1]) - 1
            step = min(max(alpha[i] - grad / norm[i], 0.0), c) - alpha[i]
            if step:
                alpha[i] += step
                w[idx] += step * y[i] * val
                w[-1] += step * y[i]
                moved = max(moved, abs(grad))
        if moved < 0.01:
            break
    return w


def fit(sample: list[tuple[str, int]]) -> QualityModel:
    texts, y = [t for t, _ in sample], np.array([2 * v - 1 for _, v in sample])
    model = QualityModel(np.zeros(BUCKETS), np.zeros(BUCKETS + 1), (0.0, 1.0))
    if len(set(y.tolist())) < 2:
        return model
    doc, bucket = model.indicators(texts)
    rest = np.array([_crc(t[:64] + str(len(t))) % 5 for t in texts]) > 0
    if len(set(y[rest].tolist())) < 2 or len(set(y[~rest].tolist())) < 2:
        rest[:] = True
    start = np.searchsorted(doc, np.arange(len(texts) + 1))

    def train(use: np.ndarray) -> None:
        good, bad = (np.bincount(bucket[(use & (y == v))[doc]], minlength=BUCKETS) + 1.0 for v in (1, -1))
        model.ratio = np.where(good + bad > 2, np.log((good / good.sum()) / (bad / bad.sum())), 0)
        rows = []
        for i in range(len(texts)):
            idx = bucket[start[i] : start[i + 1]]
            val = model.ratio[idx]
            rows.append((idx, val / (np.sqrt(val @ val) or 1.0)))
        at = np.flatnonzero(use)
        model.weight = dual_coordinate_descent([rows[i] for i in at], y[at], BUCKETS)

    train(rest)
    seen = ~rest if (~rest).any() else rest
    m = model.margins([t for t, s in zip(texts, seen) if s])
    # Platt's logistic, by Newton steps, with his smoothed targets.
    t, pos = (y[seen] + 1) / 2, max(1, (y[seen] > 0).sum())
    neg = max(1, len(t) - pos)
    t = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.stack([np.ones_like(m), m], axis=1), np.array([0.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * (w - [0, 1]))
    model.logistic = (float(w[0]), float(w[1]))
    train(np.ones(len(texts), bool))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> QualityModel:
    return fit(training_sample(docs, labels, "quality", per_class, max_chars))


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score)."""
    kinds = dict(docs.dtypes)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(model.score(part.column("_text").to_pylist()))], [*names, "score"])

    return map_arrow(docs.select(*names, docs[text_col].alias("_text")), run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double")
