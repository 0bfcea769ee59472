import random

import numpy as np
import pytest
from helpers import same_as_oracle

from costsieve.llm import bitslice as B


def brute(rows, k=20, every=20):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in B.top_k(table, **options).collect())


def test_whole_query_against_sql(spark):
    same_as_oracle(spark, "op3_bit_sliced_top_k")


@pytest.mark.parametrize("spread", [0.05, 1.0, 9.0])
def test_random_vectors_with_ties(spark, spread):
    rng = np.random.default_rng(7)
    rows = [(i, (np.round(rng.normal(0, spread, 5), 1)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one common vector
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, row_block=70, query_block=9) == brute(rows)


def test_defined_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (20, [-1.0, -0.01]),
            (21, [1.0]), (40, [2.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (60, []), (61, []), (80, [1.0, 1.0]), (80, [0.5, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(7, [1.0])]) == []


def test_large_components(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 7, 4)]) for i in range(200)]
    rows += [(300, [300_000.0, -300_000.0, 0.5, 0.0]), (301, [300_000.0, 1.0, -2.0, 0.25]), (320, [0.0, 0.0, 0.0, 2.0**20])]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(B.rows_of_index, "__defaults__", (64,))
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(20, [1e18]), (21, [1.0])])
    with pytest.raises(Exception):
        run(spark, [(20, [2.0**40]), (21, [2.0**40])])


def test_rows_of_index():
    wide, narrow = np.array([[0, 0], [2**40, 2**40]]), np.array([[0, 0], [1, 1]])
    assert B.rows_of_index(wide) < B.rows_of_index(narrow) and B.rows_of_index(wide, 1) == 64
    assert B.rows_of_index(np.zeros((3, 0), np.int64)) > 3


def test_adders():
    rng = random.Random(1)
    for _ in range(50):
        a, b, shift = [rng.randrange(2**12) for _ in range(64)], [rng.randrange(2**9) for _ in range(64)], rng.randrange(6)
        cut = lambda x, n: [np.array([sum((v >> s & 1) << i for i, v in enumerate(x))], np.uint64) for s in range(n)]
        total = B.add(cut(a, 12), cut(b, 9), shift)
        for i in range(64):
            assert sum((int(s[0]) >> i & 1) << j for j, s in enumerate(total)) == a[i] + (b[i] << shift)
