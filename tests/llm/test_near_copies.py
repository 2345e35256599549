"""The near-duplicate stage of the pipeline: pairs of a similarity of 0.8 or more, all of them and no others."""

import random

import corpus_pipeline
from sievework.llm import shingles, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


def corpus():
    """Documents with near copies on both sides of the limit, and phrases that many share."""
    rng = random.Random(5)
    phrase = [f"license{k}" for k in range(40)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        if i % 3 == 0:
            words = words[:20] + phrase
        rows.append(words)
        for n in (0, 1, 2, 3, 5, 8):
            rows.append(edited(rng, words, n))
    rows += [["one", "two"], ["One", "TWO"], ["one", "three"], [], None]
    rng.shuffle(rows)
    return [(i, None if w is None else " ".join(w)) for i, w in enumerate(rows)]


def test_near_copies_against_brute_force(spark, monkeypatch):
    rows = corpus()
    sets = {i: grams(t) for i, t in rows}
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for a in sets:
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links += sets[a] != sets[b]
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert links > 50
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for pairs, often in ((shingles.PAIRS, 3), (7, 1 << 30)):  # the order by frequency may not matter
        monkeypatch.setattr(shingles, "PAIRS", pairs)
        monkeypatch.setattr(shingles, "OFTEN", often)
        got = {r.doc_id: r["first"] for r in shingles.near_copies(d).collect()}
        assert got == {i: top(i) for i in up}
    assert shingles.near_copies(d.limit(0)).count() == 0


def test_fingerprints_link_what_is_near_and_similar(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(900)]
        rows += [words, [w.upper() for w in words], *(edited(rng, words, n) for n in (1, 2, 6)), words[:20] * 40, words[:20] * 41]
        rows += [words[:20] * 90 + edited(rng, words[20:80], 60) for _ in range(2)]  # near fingerprints of different sets
    texts = [" ".join(w) for w in rows]
    fp, sets = [int(f) for f in simhash.fingerprints(texts)], [grams(t) for t in texts]
    group, seen = list(range(len(rows))), set()
    for a in range(len(rows)):
        for b in range(a):
            alike, bits = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]), (fp[a] ^ fp[b]).bit_count()
            seen.add((alike, min(bits, 4)))
            if alike and bits <= simhash.LIMIT:
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    assert seen >= {(True, 0), (True, 2), (True, 4), (False, 1), (False, 4)}
    monkeypatch.setattr(shingles, "_post", lambda hot: lambda batches: iter(()))  # without the join that finds the others
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r["first"] for r in shingles.near_copies(d).collect()} == dict(enumerate(group))


def test_stage_drops_similar_texts_that_simhash_keeps(spark):
    rng = random.Random(6)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        rows += [(10 * i + 1, " ".join(words)), (10 * i + 2, " ".join(edited(rng, words, 3))), (10 * i + 3, " ".join(edited(rng, words, 20)))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    bits = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(d).collect()}
    assert any((bits[10 * i + 1] ^ bits[10 * i + 2]).bit_count() > 3 for i in range(20))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect()}
    assert kept == {i for i, _ in rows if i % 10 != 2}


def test_stage_keeps_different_texts_of_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    near = a + " more"
    rows = [(7, a, "en"), (7, b, "en"), (7, near, "en"), (7, a, "de"), (3, b, "en"), (9, near, "en"), (8, "x y", "en"), (8, "x y", "en"), (None, a, "en")]
    got = []
    for part in (1, 4):
        d = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows[:: 1 if part == 1 else -1]], DOCS).repartition(part)
        got.append(sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect()), key=repr))
    assert got[0] == got[1]
    assert [r for r in got[0] if r[0] in (3, 8, 9, None)] == [(3, b, "en"), (8, "x y", "en"), (None, a, "en")]
    assert len([r for r in got[0] if r[0] == 7]) == 1 and [r for r in got[0] if r[0] == 7][0][1] in (a, near)
    rows = [(7, a, "en"), (7, b, "en")]
    d = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], DOCS)
    assert corpus_pipeline.drop_near_duplicates(spark, d, "").count() == 2
