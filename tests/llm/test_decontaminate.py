import random

import numpy as np
from helpers import LONG, documents, same_as_oracle

from costsieve.llm import decontaminate as D


def brute(docs, items, window=13):
    """{doc_id: (n_words, hit word numbers, item ids)}."""
    out = {}
    parsed = [(i, D.alnum_words((t or "").encode())) for i, t in items]
    for doc_id, text in docs:
        words, hit, ids = D.alnum_words((text or "").encode()), set(), set()
        for item, own in parsed:
            n = min(window, len(own))
            wins = {tuple(own[p:p + n]) for p in range(len(own) - n + 1)} if n else set()
            for p in range(len(words) - n + 1 if n else 0):
                if tuple(words[p:p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids.add(item)
        out[doc_id] = (len(words), hit, ids)
    return out


def spans(rows):
    return {r["doc_id"]: (r["n_words"], {w for m in r["matches"] for w in range(m["doc_start"], m["doc_start"] + m["n_words"])},
                          {m["item_id"] for m in r["matches"]}) for r in rows}


def test_whole_query_against_sql(spark):
    same_as_oracle(spark, "op9_suffix_array_decontamination")


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    letters = list("abcd")
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(12)]
    docs = [(i, " ".join(rng.choices(letters + ["zz"], weights=[5] * 4 + [1], k=rng.randrange(0, 90)))) for i in range(60)]
    docs += [(100 + i, "zz " + t + " zz " + t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {k: (n, h, {str(x) for x in ids}) for k, (n, h, ids) in brute(docs, items).items()}
    for window, blocks in ((13, 4_000_000), (13, 10)):
        found = D.benchmark_matches(documents(spark, docs), bench, window=window, block_words=blocks)
        assert spans(found.collect()) == expected


def test_longest_matches_are_maximal(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [(1, "x " + " ".join(f"w{i}" for i in range(5, 30)) + " y")])
    found = D.benchmark_matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in found["matches"]] == [("7", 5, 1, 25)]


def test_suffix_array_sorts():
    seq = np.array(random.Random(1).choices(range(3), k=200))
    order = D.suffix_array(seq, 200)
    ends = [tuple(seq[p:]) for p in order]
    assert ends == sorted(ends)


def test_stage_defined_cases(spark):
    words = " ".join(f"w{i}" for i in range(13))
    docs = documents(spark, [(1, None), (2, ""), (3, "...!"), (4, words.upper()), (4, words.upper()), (None, "fine " + words[:-4]),
                             (6, LONG), (7, LONG + " " + words)], extra=True)
    bench = spark.createDataFrame([(1, words), (1, words), (None, None), (2, "")], "item_id long, text string")
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7]
    assert D.decontaminate(docs, bench.limit(0)).count() == 8
    assert D.decontaminate(docs.limit(0), bench).count() == 0
