"""Scores of both classifiers and of the secret chains from first principles, long texts in parts, and held-out labels."""

import hashlib
import itertools
import math
import random
import string
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import quality, secret_scan, simhash, toxicity
from sievework.llm.common import held_out, pieces

CLEAN = "the morning train leaves from a quiet station near our old town and people talk about weather".split()
RUDE = ["scum", "vermin", "idiots"]


def sample(n=160, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(5, 30))]
        if i % 2:
            words[rng.randrange(len(words))] = rng.choice(RUDE) + rng.choice(["", "!"])
        out.append((" ".join(words), i % 2))
    return out


@pytest.fixture(scope="module")
def toxic():
    return toxicity.fit(sample())


def weights_of(model, tokens):
    """Emission of each token, by its features one at a time."""
    w = lambda kind, f: model.weights[kind][model.known[f]] if f in model.known else 0.0
    word = [toxicity.normal(t) for t in tokens]
    out = []
    for i, x in enumerate(word):
        e = model.bias + sum(w(0, f) for f in toxicity.features(x))
        if i and word[i - 1]:
            e += w(1, "=" + word[i - 1])
        if i + 1 < len(word) and word[i + 1]:
            e += w(2, "=" + word[i + 1])
        out.append(e)
    return out


def sequences(e, trans, start):
    """(labels, potential) of every labelling."""
    for y in itertools.product((0, 1), repeat=len(e)):
        p = start[y[0]] * math.exp(sum(a for a, b in zip(e, y) if b))
        for a, b in zip(y, y[1:]):
            p *= trans[a, b]
        yield y, p


@pytest.mark.parametrize("text", ["you scum vermin leave our town", "a quiet, station.", "idiots!", "... scum , vermin the old"])
def test_toxic_score_against_enumeration(toxic, text):
    tokens = text.split()
    e = weights_of(toxic, tokens)
    total, p = 0.0, np.zeros(len(tokens))
    for y, w in sequences(e, toxic.trans, toxic.start):
        total += w
        p += w * np.array(y)
    p /= total
    x = [1.0, p.max(), math.log1p(p[p > 0.25].sum()), math.log1p(len(p)) / 10]
    want = 1 / (1 + math.exp(-float(np.dot(x, toxic.logistic))))
    score, spans = toxic.score([text])
    assert score[0] == pytest.approx(want, abs=1e-9)
    assert [text[a:b] for a, b in spans[0]] == [t for t, q in zip(tokens, p) if q > 0.5]


def test_gradient_against_enumerated_likelihood(toxic):
    model = toxicity.ToxicModel(toxic.known, toxic.weights.copy(), toxic.bias, toxic.trans.copy(), toxic.start, toxic.logistic)
    texts = ["you scum leave our town", "the old station scum"]
    number, count = model.tokens(texts)
    first = np.zeros(len(number), bool)
    first[[0, count[0]]] = True
    y = np.array([t.startswith("scum") for x in texts for t in x.split()])

    def loss():
        out = 0.0
        for text, part in zip(texts, np.split(y, count.cumsum()[:-1])):
            all_ = list(sequences(weights_of(model, text.split()), model.trans, model.start))
            out += math.log(sum(w for _, w in all_)) - math.log(next(w for s, w in all_ if s == tuple(part.astype(int))))
        return out

    weights, bias, trans = toxicity.gradient(model, number, first, y)
    step = 1e-5
    for kind, f in itertools.product(range(3), ("=scum", "^scu", "=old", "=town")):
        if f in model.known:
            k = model.known[f]
            model.weights[kind][k] += step
            up = loss()
            model.weights[kind][k] -= 2 * step
            assert weights[kind][k] == pytest.approx((up - loss()) / (2 * step), abs=1e-5), (kind, f)
            model.weights[kind][k] += step
    model.bias += step
    up = loss()
    model.bias -= 2 * step
    assert bias == pytest.approx((up - loss()) / (2 * step), abs=1e-5)
    model.bias += step
    for a, b in itertools.product((0, 1), repeat=2):
        old = model.trans[a, b]
        model.trans[a, b] = old * math.exp(step)
        up = loss()
        model.trans[a, b] = old * math.exp(-step)
        assert trans[a, b] == pytest.approx((up - loss()) / (2 * step), abs=1e-5)
        model.trans[a, b] = old


def test_token_labels_name_the_offending_words():
    picked, _ = toxicity.offending_features(sample())
    assert all(picked & set(toxicity.features(w)) for w in RUDE) and not any(picked & set(toxicity.features(w)) for w in CLEAN)


def long_text(n, seed=3):
    rng = random.Random(seed)
    words = [rng.choice(CLEAN + RUDE[:1] * (rng.random() < 0.01)) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", "\n", "  ", " "]) for w in words)


@pytest.mark.parametrize("chars", [1, 37, 500])
def test_long_texts_in_parts_score_as_whole(toxic, chars):
    texts = [long_text(400), "short scum", "", None, "  \n ", "x" * 900, long_text(2, 5)]
    want, spans = toxic.score(texts)
    got, parts = toxic.score(texts, chars)
    assert np.allclose(got, want, atol=1e-9) and parts == spans
    row, found = toxic.long_score(texts[0], chars, 7)
    assert found == spans[0] and 1 / (1 + math.exp(-float(row @ np.array(toxic.logistic)))) == pytest.approx(want[0], abs=1e-9)
    assert (simhash.fingerprints(texts, chars) == simhash.fingerprints(texts)).all()
    model = quality.QualityModel(np.ones(quality.BUCKETS), np.zeros(quality.BUCKETS + 1), (0.0, 1.0))
    for a, b in zip(model.indicators(texts, chars), model.indicators(texts)):
        assert (a == b).all()
    assert all("".join(p for _, p in pieces(t, chars)) == t for t in texts if t)


# Quality

M64 = (1 << 64) - 1


def grams(text):
    """Buckets of a text's n-grams, in whole numbers."""
    mul = 0x9E3779B97F4A7C15
    mix = lambda salt, h: ((((h + salt) * mul & M64) >> 20) * mul) & M64
    tokens = text.split()
    word, shape = zip(*map(quality.describe, tokens)) if tokens else ((), ())
    shape = [s + (1 << 40 if i and tokens[i] == tokens[i - 1] else 0) for i, s in enumerate(shape)]
    w1, s1 = [mix(1, w) for w in word], [mix(2, s) for s in shape]
    out = w1 + s1
    out += [mix(3, a) + b & M64 for a, b in zip(w1, w1[1:])] + [mix(4, a) + b & M64 for a, b in zip(s1, s1[1:])]
    out += [mix(5, mix(6, a) + b & M64) + c & M64 for a, b, c in zip(s1, s1[1:], s1[2:])]
    return {(h * mul & M64) >> 46 for h in out}


def test_quality_score_from_first_principles():
    rng = random.Random(4)
    good = ["The committee met on Tuesday, and agreed the plan.", "Most readers know the town; few have seen its river."]
    bad = ["CLICK HERE!!! win win win $$$", "buy now now now >>> free free"]
    rows = [(" ".join(rng.sample((good if i % 2 else bad)[i // 2 % 2].split(), 5)) + f" {i}", i % 2) for i in range(120)]
    model = quality.fit(rows)
    sets = [grams(t) for t, _ in rows]
    up, down = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for g, (_, y) in zip(sets, rows):
        (up if y else down)[list(g)] += 1
    ratio = np.where(up + down > 2, np.log((up / up.sum()) / (down / down.sum())), 0)
    assert np.allclose(model.ratio, ratio)
    for text in [rows[0][0], rows[1][0], "The river", "win", "unseen words only zzz", ""]:
        g = sorted(grams(text))
        v = ratio[g]
        norm = math.sqrt(float(v @ v)) or 1.0
        margin = float(v @ model.weight[g]) / norm + model.weight[-1]
        a, b = model.logistic
        assert model.score([text])[0] == pytest.approx(1 / (1 + math.exp(-(a + b * margin))), abs=1e-12)
    s = model.score([t for t, _ in rows])
    assert all((x > 0.5) == y for x, (_, y) in zip(s, rows))


# Both on the driver's labels, outside the fold they learn from


@pytest.mark.parametrize("name,label", [("toxicity", "toxic"), ("quality", "quality")])
def test_held_out_labels(spark, name, label):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    module = toxicity if name == "toxicity" else quality
    model = module.train(docs, labels)
    rows = docs.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").filter(held_out(F.col("doc_id")) & F.col("y").isNotNull()).select("text", "y").collect()
    score = model.score([r.text for r in rows])
    score = np.asarray(score[0] if name == "toxicity" else score)
    y = np.array([r.y for r in rows])
    hit, wrong = (score[y == 1] >= (0.5 if name == "toxicity" else 0.3)).mean(), (score[y == 0] >= (0.5 if name == "toxicity" else 0.3)).mean()
    print(name, len(y), y.sum(), hit, wrong)
    assert len(y) > 300 and hit > 0.9 and wrong < 0.02


# Secrets: strings of other makes than the training samples

SECRETS = string.ascii_letters + string.digits


def test_chains_on_strings_of_other_makes():
    rng = random.Random(11)
    model = secret_scan.RandomStrings(secret_scan.builtin_samples())
    found = lambda t: any(k == 3 for _, k, _ in secret_scan.find(f"x {t} y", model))
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    import base64

    secret = [pick(SECRETS + "+/", 40) for _ in range(200)]
    secret += ["ghp_" + pick(SECRETS, 36) for _ in range(200)]
    secret += ["sk-proj-" + pick(SECRETS + "_-", 48) for _ in range(200)]
    secret += [base64.b64encode(rng.randbytes(32)).decode() for _ in range(200)]
    secret += [base64.b32encode(rng.randbytes(20)).decode().rstrip("=") for _ in range(200)]
    words = "river mountain holiday breakfast umbrella painter distance neighbour elephant midnight orchard thunder harvest lantern compass cathedral".split()
    plain = [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(200)]
    plain += [words[rng.randrange(16)] + "".join(rng.choice(words).title() for _ in range(3)) for _ in range(200)]
    plain += ["_".join(rng.choice(words).upper() for _ in range(4)) for _ in range(200)]
    plain += ["/".join(rng.choice(words) for _ in range(4)) + f"/{rng.randrange(2000, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}" for _ in range(200)]
    plain += ["-".join(rng.choice(words) for _ in range(4)) + f"-{rng.randrange(1000)}" for _ in range(200)]
    plain += [hashlib.sha1(str(i).encode()).hexdigest() for i in range(200)]  # fixed pattern hex has them; the chains add nothing
    hits, false = sum(map(found, secret)), sum(map(found, plain))
    assert hits >= 0.97 * len(secret), hits / len(secret)
    assert hits / (hits + false) >= 0.97, false


def test_log_probability_by_hand():
    chain = secret_scan.Markov(["ab", "abc"])
    letters = len(secret_scan._ALPHABET)
    base = lambda ch, k: (k + 1) / (5 + letters)
    one = lambda k, t, p: (k + 8 * p) / (t + 8)
    first = one(2, 2, one(2, 2, base("a", 2)))
    second = one(2, 2, one(2, 2, base("b", 2)))
    third = one(1, 1, one(1, 1, base("c", 1)))
    assert chain.log_probability("abc") == pytest.approx(math.log(first * second * third))


def test_overlapping_spans_by_brute_force():
    rng = random.Random(2)
    model = secret_scan.RandomStrings(secret_scan.builtin_samples())
    for _ in range(60):
        parts = ["token=" + "".join(rng.choice(SECRETS) for _ in range(20)), "AKIA" + "Q7Z" * 6, "0123456789abcdef" * 2, "".join(rng.choice(SECRETS) for _ in range(30)), "plainwords", "/", " "]
        text = "".join(rng.choice(parts) for _ in range(8))
        spans = secret_scan.find(text, model)
        cover = np.zeros(len(text), int)
        for a, k, b in spans:
            if k != 3:
                cover[a:b] = 1
        assert all(not cover[a:b].any() for a, k, b in spans if k == 3)
        assert zlib.crc32(secret_scan.redact(text, spans).encode()) is not None
