"""Toxicity by a linear-chain conditional random field over tokens.

Labels come by document, so token labels are derived first: words and word beginnings are picked greedily by how many
labelled toxic documents they explain that nothing picked before does, and a token is toxic where it has a picked
feature and stands in a toxic document. The field has two states; a token's emission is the sum of weights of its own
features (the word and its first 3 to 6 letters) and of the words before and after it; transitions are learned. Weights maximise the conditional likelihood of the token labels.
Forward-backward marginals over whole texts give each token's probability; a document's score is a logistic of the
largest marginal, of the expected number of toxic tokens and of its length, and tokens above one half are the offending spans.

The fit runs on the driver over a sample bounded by PER_CLASS documents a class of at most MAX_CHARS code points each
(see common.training_sample); the model, of at most MAX_FEATURES features, goes to the tasks in their closure.

Null and empty texts, and texts of white space only, have no tokens: they get the logistic of nothing (clean), no span.
Repeated rows get repeated results, an empty table an empty one; without labels of both classes everything is clean.
Columns besides the id and the text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_CHARS, map_arrow, pieces, slices, training_sample

#: Bounds of the training sample (documents a class, code points a document) and of the model's features.
PER_CLASS, MAX_CHARS, MAX_FEATURES = 600, 20_000, 4096
#: Steps of a block of the scan over tokens, and tokens of a long text that are held at once.
BLOCK, LONG_STEP = 128, 1 << 17
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CACHE = 120_000


def normal(token: str) -> str:
    """A token as the vocabulary has it: lower case, without punctuation around it."""
    return _EDGE.sub("", token.lower())


def _products(m: np.ndarray) -> np.ndarray:
    """Scaled product of each block's matrices. m: (steps, blocks, 2, 2)."""
    p = m[0].copy()
    for t in range(1, len(m)):
        x, y, q = p[:, :, 0], p[:, :, 1], m[t]
        p = np.stack([x * q[:, 0, 0, None] + y * q[:, 1, 0, None], x * q[:, 0, 1, None] + y * q[:, 1, 1, None]], axis=2)
        if t % 8 == 0:
            p /= p.sum((1, 2))[:, None, None]
    return p / p.sum((1, 2))[:, None, None]


def _steps(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(BLOCK, blocks, 2, 2): each token's matrix, in blocks; steps after the last are the identity."""
    n = len(emission)
    blocks = -(-n // BLOCK)
    m = np.empty((blocks * BLOCK, 2, 2))
    m[n:] = np.eye(2)
    # A chain's start forgets what was before: both rows are the start potentials.
    m[:n] = np.where(first[:, None, None], start[None, None, :], trans[None])
    m[:n, :, 1] *= np.exp(np.clip(emission, -30, 30))[:, None]
    return np.ascontiguousarray(m.reshape(blocks, BLOCK, 2, 2).swapaxes(0, 1))


def chain_product(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The scaled product of all tokens' matrices: what a part of a chain does to what comes into it."""
    out = np.eye(2)
    for p in _products(_steps(emission, first, trans, start)):
        out = out @ p
        out /= out.sum()
    return out


def forward_backward(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, before: tuple[float, float] = (0.5, 0.5), after: tuple[float, float] = (0.5, 0.5)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of many chains laid end to end, as one exact blocked scan of 2 x 2 matrices.

    emission: log potential of state 1 over state 0 of each token; first: whether a chain starts there; trans, start:
    potentials; before, after: the vectors that come in at both ends, for a part of a chain. Returns each token's marginal
    of state 1, and the scaled forward and backward vectors.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2))
    m = _steps(emission, first, trans, start)
    blocks = m.shape[1]
    whole = _products(m)
    into, back = np.empty((blocks, 2)), np.empty((blocks, 2))
    a0, a1 = before
    rows = whole.reshape(blocks, 4).tolist()
    for k, (p00, p01, p10, p11) in enumerate(rows):
        into[k] = a0, a1
        a0, a1 = a0 * p00 + a1 * p10, a0 * p01 + a1 * p11
        s = a0 + a1
        a0, a1 = a0 / s, a1 / s
    b0, b1 = after
    for k in range(blocks - 1, -1, -1):
        back[k] = b0, b1
        p00, p01, p10, p11 = rows[k]
        b0, b1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    alpha, beta = np.empty((BLOCK, blocks, 2)), np.empty((BLOCK, blocks, 2))
    x, y = into[:, 0], into[:, 1]
    for t in range(BLOCK):
        x, y = x * m[t, :, 0, 0] + y * m[t, :, 1, 0], x * m[t, :, 0, 1] + y * m[t, :, 1, 1]
        s = x + y
        x, y = x / s, y / s
        alpha[t, :, 0], alpha[t, :, 1] = x, y
    x, y = back[:, 0], back[:, 1]
    for t in range(BLOCK - 1, -1, -1):
        beta[t, :, 0], beta[t, :, 1] = x, y
        x, y = m[t, :, 0, 0] * x + m[t, :, 0, 1] * y, m[t, :, 1, 0] * x + m[t, :, 1, 1] * y
        s = x + y
        x, y = x / s, y / s
    alpha, beta = (v.swapaxes(0, 1).reshape(-1, 2)[:n] for v in (alpha, beta))
    both = alpha * beta
    return both[:, 1] / both.sum(1), alpha, beta


def features(word: str) -> list[str]:
    """A word's own features: itself, and its beginnings of 3 to 6 letters."""
    return ["=" + word, *["^" + word[:k] for k in range(3, 7) if len(word) >= k]] if word else []


class _Types:
    """Distinct tokens met so far, numbered, with the numbers of their features (0: none)."""

    def __init__(self, known: dict[str, int]):
        self.known, self.number = known, {}
        self.rows = np.zeros((1024, 5), np.int32)

    def add(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.number]
        at = len(self.number)
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        get = self.known.get
        for t in new:
            self.number[t] = at
            for k, f in enumerate(features(normal(t))):
                self.rows[at, k] = get(f, 0)
            at += 1


def summary(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A document's row: 1, largest marginal, log of the expected toxic tokens (of those not unlikely), log of its tokens."""
    at, some = count.cumsum() - count, np.flatnonzero(count)
    x = np.zeros((len(count), 4))
    x[:, 0] = 1
    if len(some):
        x[some, 1] = np.maximum.reduceat(p, at[some])
        x[some, 2] = np.log1p(np.add.reduceat(np.where(p > 0.25, p, 0), at[some]))
        x[:, 3] = np.log1p(count) / 10
    return x


@dataclass
class ToxicModel:
    known: dict[str, int]  # features, numbered from 1
    weights: np.ndarray  # (3, features + 1): of a token's own features, of the word before, of the word after
    bias: float
    trans: np.ndarray
    start: np.ndarray
    logistic: tuple[float, ...]
    #: Kept by a worker between tasks' slices; never sent.
    types: _Types | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"types": None}

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Type numbers of all tokens, and how many each text has."""
        if self.types is None or len(self.types.number) > _CACHE:
            self.types = _Types(self.known)
        tokens = [t.split() for t in texts]
        count = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.types.add(set().union(*tokens))
        get = self.types.number.__getitem__
        return np.concatenate([np.fromiter(map(get, t), np.int32, len(t)) for t in tokens]) if tokens else np.zeros(0, np.int32), count

    def emissions(self, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        rows = self.types.rows[: len(self.types.number)]
        own, before, after = self.weights[0][rows].sum(1), self.weights[1][rows[:, 0]], self.weights[2][rows[:, 0]]
        e = self.bias + own[number]
        e[1:] += before[number[:-1]] * ~first[1:]
        e[:-1] += after[number[1:]] * ~first[1:]
        return e

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number, count = self.tokens(texts)
        first = np.zeros(len(number), bool)
        first[(count.cumsum() - count)[count > 0]] = True
        return forward_backward(self.emissions(number, first), first, self.trans, self.start)[0], count

    def long_emissions(self, text: str, chars: int) -> np.ndarray:
        """Emissions of one text's tokens, a piece at a time."""
        out: list[np.ndarray] = []
        last = None
        for _, part in pieces(text, chars):
            tokens = part.split()
            if not tokens:
                continue
            types = _Types(self.known)
            types.add(set(tokens))
            rows = types.rows[np.fromiter(map(types.number.__getitem__, tokens), np.int64, len(tokens))]
            e = self.bias + self.weights[0][rows].sum(1)
            e[1:] += self.weights[1][rows[:-1, 0]]
            e[:-1] += self.weights[2][rows[1:, 0]]
            if last is not None:
                e[0] += self.weights[1][last]
                out[-1][-1] += self.weights[2][rows[0, 0]]
            last = rows[-1, 0]
            out.append(e)
        return np.concatenate(out) if out else np.zeros(0)

    def long_score(self, text: str, chars: int = SLICE_CHARS, step: int = LONG_STEP) -> tuple[np.ndarray, list[list[int]]]:
        """(summary row, spans) of one long text: exact marginals part by part, from what each part passes on both ways."""
        e = self.long_emissions(text, chars)
        first = np.zeros(len(e), bool)
        first[:1] = True
        cuts = range(0, len(e), step)
        part = [chain_product(e[a : a + step], first[a : a + step], self.trans, self.start) for a in cuts]
        before, after = [np.full(2, 0.5)], [np.full(2, 0.5)]
        for m in part[:-1]:
            v = before[-1] @ m
            before.append(v / v.sum())
        for m in part[:0:-1]:
            v = m @ after[-1]
            after.append(v / v.sum())
        peak, sum_, hot = 0.0, 0.0, []
        for a, u, v in zip(cuts, before, reversed(after)):
            p = forward_backward(e[a : a + step], first[a : a + step], self.trans, self.start, tuple(u), tuple(v))[0]
            peak, sum_ = max(peak, float(p.max())), sum_ + float(p[p > 0.25].sum())
            hot += (a + np.flatnonzero(p > 0.5)).tolist()
        spans: list[list[int]] = []
        want, i = iter(hot), 0
        nxt = next(want, None)
        for at, piece in pieces(text, chars) if hot else ():
            pos = 0
            for token in piece.split():
                pos = piece.index(token, pos)
                if i == nxt:
                    spans.append([at + pos, at + pos + len(token)])
                    nxt = next(want, None)
                pos, i = pos + len(token), i + 1
        return np.array([1, peak, math.log1p(sum_), math.log1p(len(e)) / 10]), spans

    def score(self, texts: list[str | None], chars: int = SLICE_CHARS) -> tuple[np.ndarray, list[list[list[int]]]]:
        """Scores, and offending spans [start, end) in code points. Texts beyond so many characters are taken in parts."""
        long = {k: self.long_score(t, chars) for k, t in enumerate(texts) if t and len(t) > chars}
        texts = ["" if k in long else t or "" for k, t in enumerate(texts)]
        p, count = self.marginals(texts)
        at = count.cumsum() - count
        x = summary(p, count)
        peak = x[:, 1].copy()
        spans: list[list[list[int]]] = [[] for _ in texts]
        for k, (row, found) in long.items():
            x[k], spans[k] = row, found
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(self.logistic), -30, 30)))
        for k in np.flatnonzero(peak > 0.5).tolist():
            hot = np.flatnonzero(p[at[k] : at[k] + count[k]] > 0.5).tolist()
            # Tokens in order, each searched from where the last one ended: offsets without another pattern.
            pos, want = 0, iter(hot)
            nxt = next(want)
            for i, token in enumerate(texts[k].split()):
                pos = texts[k].index(token, pos)
                if i == nxt:
                    spans[k].append([pos, pos + len(token)])
                    nxt = next(want, None)
                    if nxt is None:
                        break
                pos += len(token)
        return score, spans


def offending_features(sample: list[tuple[str, int]], least: int = 3) -> tuple[set[str], list[str]]:
    """Features that explain toxic documents and are rare in clean ones; and the features worth weights."""
    sets, met = [], set()
    for text, y in sample:
        words = {normal(t) for t in text.split()} - {""}
        # Near copies share their least hashes: a family counts once, or its ordinary words would look toxic.
        sketch = (y, *sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words)[:2])
        if words and sketch not in met:
            met.add(sketch)
            sets.append(({f for w in words for f in features(w)}, y))
    toxic = [s for s, y in sets if y]
    clean = Counter(f for s, y in sets if not y for f in s)
    n0, n1 = max(1, len(sets) - len(toxic)), max(1, len(toxic))
    seen = Counter(f for s in toxic for f in s)
    odds = {f: math.log((k + 0.5) / (n1 + 1) * (n0 + 1) / (clean[f] + 0.5)) for f, k in seen.items() if k >= least}
    able = {f for f, o in odds.items() if o > math.log(8)}
    picked: set[str] = set()
    left = list(toxic)
    while left:
        gain = Counter(f for s in left for f in s & able)
        best = max(gain, key=lambda f: (gain[f] * odds[f], len(f), f), default=None)
        if best is None or gain[best] < max(least, 0.01 * n1):
            break
        picked.add(best)
        able.discard(best)
        left = [s for s in left if best not in s]
    # Features as frequent in toxic documents as those that were needed explain the same documents over again.
    if picked:
        bar = 0.6 * min(seen[f] * odds[f] for f in picked)
        picked |= {f for f in able if odds[f] > math.log(30) and seen[f] * odds[f] >= bar}
    # Of a beginning and what continues it in nearly all the same documents, the longer is meant: not "lose" for "loser".
    whole = {f: f[1:] + ("$" if f[0] == "=" else "") for f in picked}
    picked = {f for f in picked if not any(g != f and f[0] == "^" and whole[g].startswith(whole[f]) and seen[g] >= 0.9 * seen[f] for g in picked)}
    shorter = {"^" + f[1:][:k] for f in picked for k in range(3, 7)} - picked
    rest = sorted((f for f in odds if f not in picked and f not in shorter), key=lambda f: (-seen[f] * abs(odds[f]), f))
    return picked, [*sorted(picked), *rest][:MAX_FEATURES]


def gradient(model: ToxicModel, number: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of the negative log likelihood of token labels y: by weights, bias and log transitions. model.types has the tokens."""
    rows, size = model.types.rows[: len(model.types.number)], model.weights.shape[1]
    inner = np.flatnonzero(~first)
    e = model.emissions(number, first)
    p, alpha, beta = forward_backward(e, first, model.trans, model.start)
    gap = p - y
    own = np.bincount(number, gap, len(rows))
    grad = np.stack([np.bincount(rows.ravel(), np.repeat(own, 5), size), np.bincount(rows[number[inner - 1], 0], gap[inner], size), np.bincount(rows[number[inner], 0], gap[inner - 1], size)])
    grad[:, 0] = 0  # no feature, no weight
    m = model.trans[None] * np.stack([np.ones(len(inner)), np.exp(np.clip(e[inner], -30, 30))], axis=1)[:, None, :]
    xi = alpha[inner - 1][:, :, None] * m * beta[inner][:, None, :]
    xi = (xi / xi.sum((1, 2))[:, None, None]).sum(0)
    pair = np.zeros((2, 2))
    np.add.at(pair, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    return grad, float(gap.sum()), xi - pair


def fit(sample: list[tuple[str, int]], steps: int = 30, rate: float = 0.6, decay: float = 1e-4) -> ToxicModel:
    """The field, and the logistic of document scores, from labelled documents."""
    none = ToxicModel({}, np.zeros((3, 1)), -10.0, np.ones((2, 2)), np.ones(2), (-5.0, 4.0, 0.0, 0.0))
    picked, names = offending_features(sample)
    if not picked or all(y for _, y in sample):
        return none
    texts, ys = [t for t, _ in sample], np.array([y for _, y in sample])
    known = {f: k + 1 for k, f in enumerate(names)}
    size = len(known) + 1
    model = ToxicModel(known, np.zeros((3, size)), -3.0, np.ones((2, 2)), np.ones(2), (0.0,) * 4)
    number, count = model.tokens(texts)
    rows = model.types.rows[: len(model.types.number)]
    first = np.zeros(len(number), bool)
    first[(count.cumsum() - count)[count > 0]] = True
    bad = np.zeros(size, bool)
    bad[[known[f] for f in picked if f in known]] = True
    y = bad[rows].any(1)[number] & np.repeat(ys > 0, count)
    theta = [model.weights, np.array([model.bias]), np.zeros((2, 2))]
    mean, var = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    n = len(texts)
    for step in range(1, steps + 1):
        model.bias, model.trans = float(theta[1][0]), np.exp(theta[2])
        g_weights, g_bias, g_trans = gradient(model, number, first, y)
        for x, g, m1, v1 in zip(theta, [g_weights / n + decay * theta[0], np.array([g_bias / n]), g_trans / n], mean, var):
            m1 += 0.1 * (g - m1)
            v1 += 0.02 * (g * g - v1)
            x -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.98**step)) + 1e-8) * (0.3 if x is not theta[0] else 1)
    model.bias, model.trans = float(theta[1][0]), np.exp(theta[2])
    # Logistic over the summaries, by damped Newton steps.
    p, count = model.marginals(texts)
    x = summary(p, count)
    w, ridge = np.zeros(4), np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge + 1e-6 * np.eye(4), x.T @ (ys - q) - ridge @ w)
    model.logistic = tuple(map(float, w))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicModel:
    return fit(training_sample(docs, labels, "toxic", per_class, max_chars))


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score, spans array<array<int>>)."""
    kinds = dict(docs.dtypes)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                score, spans = model.score(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(score), pa.array(spans, pa.list_(pa.list_(pa.int32())))], [*names, "score", "spans"])

    return map_arrow(docs.select(*names, docs[text_col].alias("_text")), run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, spans array<array<int>>")
