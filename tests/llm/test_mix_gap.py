"""Mixing held against a walk down the Pareto order in plain Python: long documents at the cut, null and repeated ids."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from sievework.llm import source_mix

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def walk(rows):
    """Copies of each row, by position, as a multiset per (doc_id, text, source)."""
    size = [len((r[1] or "").split()) for r in rows]
    total = Counter()
    for r, n in zip(rows, size):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] >= 3 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
            free.discard(s)
    out = Counter()
    for s in names:
        r = target[s] / total[s] if total[s] else 1.0
        whole, f = int(r), r - int(r)
        open_ = max(int(target[s] + 0.5) - whole * total[s], 0)
        ranked = []
        for k, row in enumerate(rows):
            if row[3] == s:
                text = hashlib.md5(row[1].encode()).hexdigest() if row[1] is not None else "null"
                key = f"pareto-2:{'null' if row[0] is None else row[0]}:{text}"
                u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (f / (1 - f)) if f > 0 else 1.0, size[k], k))
        more = set()
        for q, n, k in sorted(ranked):
            if 0 < n <= open_:
                more.add(k)
                open_ -= n
        for q, n, k in ranked:
            out[rows[k][0], rows[k][1], s, whole + (k in more)] += 1
    return out, target


def corpus(seed, kind):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", "c", "d", "e", None):
        sizes = [rng.randrange(0, 60) for _ in range(120)]
        sizes.append(sum(sizes) // 2)  # a third of the source's words
        for k, n in enumerate(sizes):
            i = len(rows)
            doc = {"plain": i, "null": None, "one": 7, "twice": i}[kind]
            rows.append((doc, None if n == 0 and k % 2 else " ".join([f"w{i}"] * n), "en", s, n))
    if kind == "twice":
        rows = rows * 2
        rows += [(5, "same words here", "en", "a", 3)] * 500  # a group of repeated rows at whatever rank
        rows += [(6, "other words here too", "en", "c", 4)] * 700
    return rows


@pytest.mark.parametrize("seed,kind,ahead,few", [(2, "twice", 32, 10_000), (4, "null", 32, 10_000), (5, "one", 1, 10_000), (6, "twice", 1, 0)])
def test_against_a_walk(spark, monkeypatch, seed, kind, ahead, few):
    monkeypatch.setattr(source_mix, "AHEAD", ahead)
    monkeypatch.setattr(source_mix, "FEW_SOURCES", few)
    monkeypatch.setattr(source_mix, "AT_ONCE", 100)
    rows = corpus(seed, kind)
    d = spark.createDataFrame(rows, SCHEMA)
    want, target = walk(rows)
    mixed = source_mix.copies_of(d)
    assert mixed.columns == d.columns
    got = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    due = Counter()
    for (i, t, s, copies), n in want.items():
        due[i, t, s] += copies * n
    assert got == +due
    taken = source_mix.mix(d).groupBy("source", "target").sum("taken").collect()
    for r in taken:
        assert r.target == pytest.approx(target[r.source])
        assert abs(r["sum(taken)"] - r.target) <= 0.02 * r.target + 4
    per_row = Counter((r.doc_id, r.source, r["size"], r.copies) for r in source_mix.mix(d.repartition(7)).collect())
    again = Counter()
    for (i, t, s, copies), n in want.items():
        again[i, s, len((t or "").split()), copies] += n
    assert per_row == again


def test_stage_keeps_columns_of_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 3, "x", 1.5), (1, "a b", "en", "s", 3, "x", 1.5), (None, None, None, None, None, None, None)], SCHEMA + ", q string, `row` double")
    got = corpus_pipeline.mix_sources(spark, d, "")
    assert got.columns == d.columns and got.count() == 3
