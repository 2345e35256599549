"""URL rules, mixing, WARC, embeddings and top-k, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import embedding_dedup, source_mix, url_rules, va_topk, warc


# URL rules


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_url_rules_against_brute_force(spark):
    rng = random.Random(3)
    labels = ["a", "b", "net", "org", "x-y", "c"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join(rng.choice(["/", "/en/", "a", "/de"]) for _ in range(rng.randrange(0, 4)))
    rules = list({(host(), "/" + path().lstrip("/"), rng.choice(["allow", "block"])) for _ in range(60)})
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"http://{host()}{'/' if rng.random() < 0.8 else ''}{path()}{rng.choice(['', '?q=1', '#f'])}" for _ in range(400)] + ["http://hot.net/"] * 300
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_rules.judge_urls(rows, url_rules.rules_table(spark, rules)).collect()}
    for i, u in enumerate(urls):
        r = got[i]
        rest = u.split("://", 1)[1].split("?")[0].split("#")[0]
        h, p = rest.split("/")[0], rest[len(rest.split("/")[0]) :]
        assert (r.host, r.path) == (h.lower(), p)
        assert (r.rule, r.verdict) == brute_rule(h.lower(), p, rules), u


def test_url_edge_cases(spark):
    urls = [None, "", "no scheme", "HTTP://EX\u00c4.Example.NET/EN/?x#y", "http://a?u=http://b.net/c", "x://", "http://example.net", "http://b.example.net/en/1"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(d, url_rules.rules_table(spark, url_rules.RULES)).collect()}
    assert got[0] == got[1] == got[2] == got[5] == ("", "", None, "allow")
    assert got[3] == ("ex\u00c4.example.net", "/EN/", "net/", "block")
    assert got[4] == ("a", "", None, "allow") and got[6] == ("example.net", "", None, "allow")
    assert got[7][2:] == ("example.net/en/", "allow")
    assert url_rules.judge_urls(d.limit(0), url_rules.rules_table(spark, [])).count() == 0


# Mixing


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while True:
        rest = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > 3 * sizes[s] + 1e-9} if w else set()
        if not over:
            return target | {s: rest * weight[s] / w for s in open_}
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("few", [10_000, 0])
def test_mix(spark, monkeypatch, few):
    monkeypatch.setattr(source_mix, "FEW_SOURCES", few)
    rng = random.Random(8)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "a", "a", "a", "b", "B", "\u00e9", None, "tiny"]) if i % 40 else "rare"
        n = rng.randrange(1, 60) if source != "tiny" else 1
        rows.append((i, " ".join(["w"] * n), source))
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, "\t\n", "a"), (7, rows[7][1], rows[7][2])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    got = source_mix.mix(d).collect()
    again = sorted((r.doc_id, r.taken) for r in source_mix.mix(d.repartition(7)).collect())
    assert sorted((r.doc_id, r.taken) for r in got) == again and len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
    want = water_fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]), (s, taken[s], target[s])
        assert all(r.source_size == sizes[s] for r in got if r.source == s)
    mixed = source_mix.copies_of(d)
    assert mixed.columns == d.columns
    count = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in got:
        if r.size and r.doc_id != 7:
            assert count.get(r.doc_id, 0) == r.taken // r.size


def test_mix_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert source_mix.mix(d).count() == 0 and source_mix.copies_of(d).count() == 0


def test_pareto_inclusion_is_near_its_probability(spark):
    """Equal sizes: each source's share of documents taken once more is its fraction."""
    rows = [(i, "w w", "a" if i % 3 else "b") for i in range(900)]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2


# WARC


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1500
    rows = [(1, "http://a/ \u00e9", big), (5, "http://b/", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "\u00e9" * 600), (5, "http://b/", big), (None, "n", big), (9, "v", "y" * 1_500_000)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    import hashlib

    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(d).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 5
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_ranges_own_each_record_once():
    rng = random.Random(1)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 400))) + b"\x1f\x8b\x08" * rng.randrange(3) for _ in range(40)]
    members = [warc.member(warc.record(i, "http://h/", p, "d" * 40, None), rng.choice([0, 6])) for i, p in enumerate(payloads)]
    data = b"".join(members)
    for step in (1, 7, 100, 1000, len(data)):
        found = []
        for start in range(0, len(data), step):
            file = pa.BufferReader(data)
            found += [(warc._page(h["warc-record-id"]), block.split(b"\r\n\r\n", 1)[1]) for h, block in warc.read_range(file, len(data), start, min(start + step, len(data)))]
        assert found == list(enumerate(payloads))


def test_warc_damage_is_seen():
    data = warc.member(warc.record(1, "u", b"abc", "d", None))
    with pytest.raises(ValueError):
        list(warc.read_range(pa.BufferReader(data[:-3]), len(data) - 3, 0, len(data) - 3))


# Embeddings


def embedding_rows(rng, n=400, dim=24):
    x = rng.normal(size=(n, dim))
    for k in range(0, n // 2):
        x[k] = x[k % 25] * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.25])
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3)) for i in range(n)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(60)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 1), (2003, [float("nan")] * dim, 1), (2004, [float("inf")] + [1.0] * (dim - 1), 1), (2005, rows[0][1], None), (2006, rows[0][1][:-1], 0), (2007, [None] + rows[0][1][1:], 0)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_dedup_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = embedding_rows(np.random.default_rng(4))
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("class", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v, y in good:
        for j, w, z in good:
            if i != j and y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i].add(j)
    total, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert found <= total and found >= 0.99 * total and all(got[i].n_links <= len(links[i]) for i in links)
    if found == total:
        for i in links:
            seen, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))
    for i in range(2000, 2008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


@pytest.mark.parametrize("hashes", sorted(embedding_dedup.SETTINGS))
def test_embedding_recall_at_the_threshold(hashes):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    z = np.zeros(len(a), int)
    ka, kb = embedding_dedup.bucket_keys(a, z, hashes), embedding_dedup.bucket_keys(b, z, hashes)
    assert (ka[:, :, None] == kb[:, None, :]).any((1, 2)).mean() > 0.97


def test_embedding_rotations_follow_the_number_of_vectors():
    assert [embedding_dedup.rotations(n, 64) for n in (0, 500, 40_000, 50_000, 4_000_000, 10**9)] == [2, 2, 2, 3, 3, 4]


@pytest.mark.parametrize("d", [2, 16, 32, 64, 128, 512])
def test_hadamard(d):
    x = np.random.default_rng(d).normal(size=(3, d)).astype(np.float32)
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(d)] for i in range(d)])
    assert np.allclose(embedding_dedup._hadamard(x), x @ h, atol=1e-3)


def test_embedding_empty(spark):
    d = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(d).count() == 0 and va_topk.top_k(d).count() == 0


@pytest.mark.parametrize("blocks", [(32_768, 2_048), (50, 3)])
def test_top_k_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(va_topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(va_topk, "QUERIES", blocks[1])
    rows = embedding_rows(np.random.default_rng(9))
    rows.append((50_000, [1e30] * 24, 0))
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("rank", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in va_topk.top_k(d).collect())
    good = [(i, [int(x) for x in np.floor(256 * np.array(v, np.float32).astype(float))]) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in good:
        if i % 50 == 0:
            clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            s = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in good if j != i and len(x) == len(q))[:5]
            want += [(i, k + 1, j, clamp(-score)) for k, (score, j) in enumerate(s)]
    assert got == sorted(want)
