import math
from collections import Counter, defaultdict

import pytest
from helpers import LONG, documents

import __spark_entry__ as entry
from costsieve.llm import langid as L
from helpers import SF, read


def bits(train, text, order):
    """PPM-C code length by dictionaries."""
    counts = defaultdict(Counter)
    for t in train:
        t = t.encode().lower()
        for i in range(len(t)):
            for k in range(order + 1):
                if i >= k:
                    counts[t[i - k:i]][t[i]] += 1
    text, total = text.encode().lower(), 0.0
    for i, x in enumerate(text):
        for k in range(min(i, order), -1, -1):
            seen = counts.get(text[i - k:i])
            if seen:
                n, q = sum(seen.values()), len(seen)
                if x in seen:
                    total -= math.log2(seen[x] / (n + q))
                    break
                total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


TRAIN = [("en", "the cat and the hat"), ("en", "then they thought"), ("fr", "le chat et la souris"), ("fr", "les étés")]


@pytest.fixture(scope="module")
def model(spark):
    docs = documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(TRAIN)])
    return L.train(L.training_sample(docs, docs["doc_id"].isNotNull()))


def test_code_lengths_against_brute_force(model):
    texts = ["the mat", "la chatte été", "q", "zz\x01", "", "th", "the cat and the hat" * 9]
    got = model.code_lengths([t.encode() for t in texts])
    for t, row in zip(texts, got):
        for lang, value in zip(model.langs, row):
            assert value == pytest.approx(bits([x for g, x in TRAIN if g == lang], t, L.ORDER), abs=1e-6)


def test_long_text_by_pieces(model, monkeypatch):
    text = ("the chat " * 500).encode()
    whole = model.code_lengths([text])
    monkeypatch.setattr(L, "CHUNK", 97)
    assert model.code_lengths([text])[0] == pytest.approx(whole[0])


def test_held_out_accuracy(spark):
    lang = dict(read("documents", "doc_id, lang"))
    rows = [r for r in entry.queries()["op10_ppm_language_id"](spark, SF).collect()]
    assert len(rows) == len(lang)
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 200
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in unseen) / len(unseen) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_defined_cases(spark, model):
    docs = documents(spark, [(1, None), (2, ""), (3, "12 34 !!"), (4, "the hat"), (4, "the hat"), (None, "la souris"), (6, LONG), (7, "é")], extra=True)
    found = L.identify(docs, model).collect()
    by = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in found)
    assert by == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (6, "en"), (7, "fr")]
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5
    assert {r["lang_pred"] for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0
    assert L.train(L.training_sample(docs.limit(0), docs["doc_id"].isNotNull())) is None


def test_sample_is_bounded(spark):
    docs = documents(spark, [(i, f"text {i}", "en" if i % 3 else None) for i in range(300)])
    got = L.training_sample(docs, docs["doc_id"] > 0, max_docs=20).collect()
    assert len(got) == 20 and {r["lang"] for r in got} == {"en"}
