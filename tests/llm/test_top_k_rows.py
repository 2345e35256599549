"""Top-k over repeated rows, against brute force."""

import numpy as np
import pytest

from sievework.llm import va_topk


@pytest.mark.parametrize("blocks", [(32_768, 2_048), (40, 3)])
def test_top_k_with_repeated_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(va_topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(va_topk, "QUERIES", blocks[1])
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 151)]
    rows += [r for r in rows if r[0] % 3 == 0] + [r for r in rows if r[0] % 5 == 0] * 2  # some twice, three and four times
    rows += [(50, rows[49][1])] * 12 + [(i, rows[49][1]) for i in range(200, 208)]  # a query's own copies, and others' of its vector
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in va_topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)).collect())
    ints = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    want = []
    for i in {i for i, _ in rows if i % 50 == 0}:
        s = sorted((-int(q @ x), j) for n, q in ints if n == i for j, x in ints if j != i)[:5]
        want += [(i, k + 1, j, -score) for k, (score, j) in enumerate(s)]
    assert got == sorted(want)
