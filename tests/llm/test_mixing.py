import math

import pytest
from helpers import LONG, SF, documents, read

import __spark_entry__ as entry
from costsieve.llm import mixing as M


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= above
    return out


def brute_rates(sizes, target):
    """min(3, exp(t * size / mean)) with the words taken at the target, by bisection."""
    if target >= 3 * sum(sizes):
        return [3.0] * len(sizes)
    mean = sum(sizes) / len([1 for s in sizes if s])
    rate = lambda t: [min(3.0, math.exp(min(50, t * s / mean))) for s in sizes]
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(s * r for s, r in zip(sizes, rate(mid))) > target else (mid, high)
    return rate(low)


def check(rows, docs):
    """rows: the mix; docs: (id, text, source). Everything but which documents are rounded up."""
    sizes = {}
    for _, t, s in docs:
        sizes.setdefault(s, []).append(len((t or "").encode().split()))
    targets = brute_targets({s: sum(z) for s, z in sizes.items()})
    assert len(rows) == len(docs)
    for s, z in sizes.items():
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: r["size"])
        assert [r["size"] for r in own] == sorted(z)
        rates = brute_rates(sorted(z), targets[s])
        for r, w in zip(own, rates):
            assert r["source_size"] == sum(z) and r["target"] == pytest.approx(targets[s])
            assert r["rate"] == pytest.approx(w if r["size"] else 1.0, rel=1e-3, abs=1e-5)
            assert math.floor(r["rate"]) <= r["copies"] <= min(3, math.floor(r["rate"]) + 1)
    return sizes, targets


def test_whole_query(spark):
    docs = read("documents", "doc_id, text, source")
    rows = M.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    sizes, targets = check(rows, docs)
    for s, z in sizes.items():
        taken = sum(r["copies"] * r["size"] for r in rows if r["source"] == s)
        assert abs(taken - targets[s]) <= 0.02 * targets[s]
    got = entry.queries()["op7_entropy_balanced_mix"](spark, SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["id"], r["copies"] * r["size"]) for r in rows)  # reruns agree


def test_caps_nulls_and_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 16)
    docs = [(i, "a b c", "hot") for i in range(300)] + [(1000 + i, "w " * (i + 1), "Z") for i in range(10)]
    docs += [(2000 + i, "x y", None) for i in range(5)] + [(3000, "one", "é"), (3001, "one two", "z"), (3002, "", "empty"), (3003, None, "empty")]
    table = documents(spark, [(i, t, "en", s) for i, t, s in docs], extra=True)
    rows = M.mix(table).collect()
    sizes, targets = check(rows, docs)
    assert targets["é"] == 3 and [r["copies"] for r in rows if r["source"] == "é"] == [3]
    taken = sum(r["copies"] * 3 for r in rows if r["source"] == "hot")
    assert abs(taken - targets["hot"]) <= 1.5
    again = M.mix(table.repartition(7)).collect()
    assert sorted((r["id"], r["copies"]) for r in rows) == sorted((r["id"], r["copies"]) for r in again)


def test_stage_and_defined_cases(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (None, "three", "en", "b"),
            (6, LONG, "en", "b"), (7, "x y z", "en", None)]
    docs = documents(spark, rows, extra=True)
    kept = M.mixture(docs)
    assert kept.columns == [*docs.columns, "copies"]
    plan = M.mix(docs).collect()
    assert sorted((r["doc_id"] or 0, r["copies"]) for r in kept.collect()) == sorted((r["id"] or 0, r["copies"]) for r in plan if r["copies"])
    check(plan, [(r[0], r[1], r[3]) for r in rows])
    assert M.mixture(docs.limit(0)).count() == 0
    nothing = M.mix(documents(spark, [(1, ""), (2, None)])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in nothing] == [(0, 0.0, 1)] * 2


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10}, {"a": 1, "b": 1, "c": 100}, {"a": 5, None: 50, "b": 1, "c": 1, "d": 7}, {"a": 0, "b": 4}])
def test_targets_against_brute_force(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.source_targets(table).collect()}
    assert got == pytest.approx(brute_targets(sizes))
