"""Filter audit: diagrams against plain counting, the copies filter, the defined cases, the SQL."""

import itertools
import random
import re

import pytest
from helpers import LONG, documents, same_as_oracle
from pyspark.sql import functions as F

from costsieve.llm import filter_audit as A


def plain(docs, n):
    """{(order, step): (kept, removed, redundant, unique)} from [(mask, weight)]."""
    out = {}
    for order in itertools.permutations(range(n)):
        left = list(docs)
        for k, v in enumerate(order, 1):
            here = [d for d in left if d[0] >> v & 1]
            left = [d for d in left if not d[0] >> v & 1]
            fails = sum(w for m, w in docs if m >> v & 1)
            removed = sum(w for _, w in here)
            out[order, k] = (sum(w for _, w in left), removed, fails - removed, sum(w for m, w in docs if m == 1 << v))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_adjacent_swaps_reach_every_order(n):
    found = A.order_steps(n, {}, 1)
    assert set(found) == set(itertools.permutations(range(n)))


@pytest.mark.parametrize("seed", range(6))
def test_paths_are_the_counts_of_every_order(seed):
    rnd = random.Random(seed)
    n = 5 if seed else 3
    docs = [(rnd.randrange(1 << n), rnd.randint(0, 3)) for _ in range(rnd.choice([0, 1, 7, 60]))]
    weights = {}
    for mask, w in docs:
        weights[mask] = (weights.get(mask, (0,))[0] + w,)
    expected = plain(docs, n)
    letters = "ABCDEFG"[:n]
    for order, step, *numbers in A._part_rows(letters, weights, 1):
        key = tuple(letters.index(x) for x in order), step
        assert tuple(numbers[:4]) == expected[key]
        v = key[0][step - 1]
        assert numbers[4] == sum(r[1] for (o, s), r in expected.items() if o[s - 1] == v)


def test_equal_nodes_are_shared():
    same = A.Diagram(5, {m: (1,) for m in range(32)}, 1)
    assert [len(x) for x in same.levels] == [1] * 6
    same.swap(2)
    assert [len(x) for x in same.levels] == [1] * 6 and same.path()[0][1] == (16,)


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3)


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_text_failures(monkeypatch, piece):
    monkeypatch.setattr(A, "PIECE", piece)
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "B", " ", "\n", "é", "日", "\xa0", "#", "word "]) for _ in range(rnd.choice([0, 1, 30, 900])))
        assert A.text_failures(text.encode()) == failures(text)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string")


def steps(found, part, order):
    return [tuple(r)[3:] for r in found.where((F.col("part") == part) & (F.col("filter_order") == order)).orderBy("step").collect()]


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = documents(spark, [
        (1, long, "en", "a"), (2, long, "en", "b"), (2, long, "en", "b"), (1, long, "en", None), (None, long, "en", "a"),
        (7, None, "en", None), (8, "", "en", ""), (9, LONG, "en", "a"), (10, "x", "en", "a")], extra=True)
    found = A.text_audit(docs, labels(spark, [(2, 1, None, "p"), (2, None, 1, "p"), (9, 1, 1, None), (None, 1, 1, None)]))
    assert found.count() == 3 * 120 * 5
    # kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
    b = steps(found, "b", "EABCD")
    assert b[0] == (0, 2, 0, 2, 2, 2, 240) and b[1] == (0, 0, 0, 0, 0, 0, 0)  # both rows of id 2 are copies of id 1
    a = steps(found, "a", "EABCD")
    assert a[0][:2] == (4, 0)  # the smallest id, the null id and two texts of their own
    assert a[1][:4] == (3, 1, 0, 1) and a[2][:2] == (2, 1)
    none = steps(found, "", "EABCD")
    assert none[0][:4] == (2, 1, 0, 0) and none[1][:2] == (1, 1)  # a null text and an empty one are copies
    nothing = A.text_audit(documents(spark, []), labels(spark, []))
    assert nothing.count() == 0 and nothing.columns == found.columns


def test_general_filters(spark):
    df = spark.range(100).withColumn("size", F.when(F.col("id") % 10 != 0, F.col("id")))
    found = A.audit(df, F.lit("all"), {"X": F.col("size") < 50, "Y": F.col("id") % 2 == 0}, {"sum": F.col("id")})
    rows = {(r.filter_order, r.step): r for r in found.collect()}
    assert rows["XY", 1].removed == 45 and rows["XY", 1].sum == sum(i for i in range(50) if i % 10)
    assert rows["YX", 2].kept == 25 and rows["XY", 2].kept == 25  # a null comparison passes
    with pytest.raises(ValueError):
        A.audit(df, F.lit("all"), {})


def test_query_is_its_sql(spark):
    same_as_oracle(spark, "op11_filter_decision_diagrams")
