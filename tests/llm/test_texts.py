"""Operators on texts, against brute force and libraries."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sievework.llm import quality, secret_scan, sentencepiece_bpe, simhash, toxicity
from sievework.llm.common import annotate
from sievework.llm.queries import piece_model

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in zip(ids, texts)], DOCS)


# SentencePiece


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece_bpe.PieceEncoder(piece_model())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \u2581ab\t\u00e9\u0301\u65e5\U0001f600<s>0x41\n\u00a0the.,;!")), max_size=40), max_size=6))
def test_pieces_match_library(encoder, texts):
    for t, (ids, joined) in zip(texts, encoder.encode(texts)):
        assert ids == encoder.library.encode(t)
        assert joined.decode() == ",".join(map(str, ids))


def test_pieces_long_words_and_heap(encoder):
    rng = random.Random(4)
    texts = ["".join(rng.choice("therinonab") for _ in range(n)) for n in (23, 24, 25, 60, 5000)]
    for t, (ids, _) in zip(texts, encoder.encode(texts)):
        assert ids == encoder.library.encode(t)
    marked = ["\u2581" + t for t in texts[:3]]
    assert [encoder.agenda(m) for m in marked] == encoder.encode_chunks([" " + t for t in texts[:3]])


def test_pieces_digests(spark, encoder):
    texts = ["a b  c\n", None, "", "x" * 3000, "a b  c\n"]
    rows = {r.doc_id: r for r in sentencepiece_bpe.digest_documents(docs(spark, texts), piece_model()).collect()}
    for i, t in enumerate(texts):
        ids = encoder.library.encode(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").replace("\u2581", " ").encode()).hexdigest()
    assert sentencepiece_bpe.digest_documents(docs(spark, []), piece_model()).count() == 0
    whole = {r.doc_id: r for r in sentencepiece_bpe.encode_documents(docs(spark, texts), piece_model()).collect()}
    assert whole[0].ids == encoder.library.encode(texts[0]) and whole[0].decoded == texts[0] and whole[1].ids == []


# SimHash


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_spark_hash(spark):
    texts = ["A b c d", "one", "two Words", "", None, "\x1cX\xa0y z\tq \u00c4\u00e4 b c", "r r r r r r"]
    assert [int(x) for x in simhash.fingerprints(texts)] == [brute_fingerprint(t) for t in texts]
    one = spark.sql("select xxhash64('a b c') as h").first().h & (1 << 64) - 1
    assert one == brute_fingerprint("a b c")


def brute_components(fps, ids, limit=3):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, fa in zip(ids, fps):
        for b, fb in zip(ids, fps):
            if (fa ^ fb).bit_count() <= limit:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("homes", [10**9, 40])
def test_near_fingerprints_against_all_pairs(spark, monkeypatch, homes):
    monkeypatch.setattr(simhash, "HOMES_A_TASK", homes)
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 3, 4, 5)}
    fps |= {0, 1, 7, 15, (1 << 64) - 1, (1 << 64) - 8}
    fps = sorted(fps)
    points = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    edges = [(r.a, r.b) for r in simhash.near_fingerprints(points).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in edges)
    from sievework.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {i: found.get(i, i) for i in range(len(fps))} == brute_components(fps, range(len(fps)))


def test_near_duplicates_edge_cases(spark):
    texts = ["the cat sat on the mat today", "the cat sat on the mat today", None, "", " \n", "other words entirely here now", "w " * 5000]
    d = docs(spark, texts + ["the cat sat on the mat today"], [3, 2, 9, 8, 7, 5, 6, None])
    rows = simhash.near_duplicates(d).collect()
    got = {(r.doc_id, r.component_id) for r in rows}
    assert got == {(3, 2), (2, 2), (9, 7), (8, 7), (7, 7), (5, 5), (6, 6), (None, 2)}
    assert all(r.fingerprint == "0" * 16 for r in rows if r.doc_id in (7, 8, 9))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_long_chain(spark):
    from sievework.llm.components import connected_components

    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Toxicity and quality


def toxic_corpus():
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    out = []
    for i in range(500):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(["grolk", "Vexing!", "zuntheit", "zuntung", "zuntlich"])
        out.append((" ".join(t), y))
    return out


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    e, first = rng.normal(size=300) * 2, rng.random(300) < 0.1
    first[0] = True
    trans, start = rng.random((2, 2)), rng.random(2)
    p, _, _ = toxicity.forward_backward(e, first, trans, start)
    cuts = [*np.flatnonzero(first), len(e)]
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 10:
            continue
        total, ones = 0.0, np.zeros(b - a)
        for path in np.ndindex(*[2] * (b - a)):
            w = start[path[0]] * np.prod([np.exp(e[a + k]) ** s for k, s in enumerate(path)]) * np.prod([trans[x, y] for x, y in zip(path, path[1:])])
            total += w
            ones += w * np.array(path)
        assert np.allclose(p[a:b], ones / total)


def test_toxicity_held_out_and_spans():
    corpus = toxic_corpus()
    model = toxicity.fit(corpus[:400])
    scores, spans = model.score([t for t, _ in corpus[400:]])
    assert [int(s >= 0.5) for s in scores] == [y for _, y in corpus[400:]]
    for (t, y), found in zip(corpus[400:], spans):
        assert {t[a:b] for a, b in found} <= {"grolk", "Vexing!", "zuntheit", "zuntung", "zuntlich"} and bool(found) == bool(y)
    s, f = model.score([None, "", " \n", "grolk"])
    assert (s[:3] < 0.5).all() and s[3] > 0.5 and f[3] == [[0, 5]]


def test_toxicity_without_labels_or_rows(spark):
    d = docs(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity.score_documents(d, toxicity.train(d, labels)).collect()
    assert len(rows) == 2 and all(r.score < 0.5 for r in rows)


def test_quality_held_out(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    corpus = []
    for i in range(300):
        t = [rng.choice(words) for _ in range(50)]
        y = int(i % 3 > 0)
        if not y:
            t = [w + "%%%" for w in t] if i % 2 else [w for w in t[:5] for _ in range(10)]
        corpus.append((" ".join(t), y))
    model = quality.fit(corpus[:220])
    s = model.score([t for t, _ in corpus[220:]])
    assert np.mean([(x >= 0.3) == bool(y) for x, (_, y) in zip(s, corpus[220:])]) > 0.97
    assert np.isfinite(model.score([None, "", "x"])).all()
    one = quality.score_documents(docs(spark, ["a", None]), quality.fit([("a", 1)])).collect()
    assert [r.score for r in one] == [0.5, 0.5]


def test_dual_coordinate_descent_meets_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    y = np.sign(x[:, 0] + 0.3 * rng.normal(size=60))
    w = quality.dual_coordinate_descent([(np.arange(8), r) for r in x], y, 8, rounds=500)
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:8] + w[8])).sum()
    best = loss(w)
    assert all(loss(w + 0.02 * rng.normal(size=9)) >= best - 1e-3 for _ in range(200))


# Secrets


def brute_base(text):
    import regex

    out = []
    for m in regex.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, regex.IGNORECASE | regex.ASCII):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in regex.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in regex.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef01234567", "abc", "-", "/+", "\n", "\u017f", "passwd", "x9"]), max_size=14))
def test_base_secrets(parts):
    text = "".join(parts)
    model = test_base_secrets.model
    spans = secret_scan.find(text, model)
    assert [s for s in spans if s[1] < 3] == brute_base(text)
    if spans:
        assert secret_scan.sieve([text]) == [True]


test_base_secrets.model = secret_scan.RandomStrings(secret_scan.builtin_samples())


def test_random_strings_held_out():
    model = secret_scan.RandomStrings(secret_scan.builtin_samples()[:6000])
    rest = [(s, y) for s, y in secret_scan.builtin_samples()[6000:] if len(s) >= secret_scan.LEAST]
    right = [(model.ratio(s) > secret_scan.RATIO * len(s)) == bool(y) for s, y in rest]
    assert np.mean(right) > 0.95


def test_secret_digests_and_redaction(spark):
    texts = ["\U0001f600 password = 'abcdefabcdefabcdef12' end", None, "", "Qx7ZpL0vR3tYw8KjH2mNbE5s", "plain words here"]
    rows = {r.doc_id: r for r in secret_scan.digest_documents(docs(spark, texts)).collect()}
    assert (rows[0].n_assign, rows[0].n_hex, rows[0].spans) == (1, 1, "assign:2:34,hex:14:34")
    assert rows[0].base_sha256 == hashlib.sha256(b"assign:2:34,hex:14:34").hexdigest()
    assert rows[1].base_sha256 == rows[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[3].spans == f"random:0:{len(texts[3])}" and rows[3].n_hex == 0
    out = {r.doc_id: r.redacted for r in secret_scan.scan_documents(docs(spark, texts)).collect()}
    assert out[0] == "\U0001f600 [SECRET]' end" and out[1] is None and out[3] == "[SECRET]" and out[4] == texts[4]


def test_annotate_keeps_clashing_names(spark):
    d = docs(spark, ["a", None]).withColumn("_0", F.lit(1)).withColumn("text2", F.lit("t"))
    out = annotate(d, "text", lambda texts: [pa.array([len(t or "") for t in texts])], "_new0 bigint", [pa.int64()])
    assert [r[-1] for r in out.collect()] == [1, 0] and len(out.columns) == len(d.columns) + 1
