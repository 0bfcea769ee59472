import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, SF, documents, read

import __spark_entry__ as entry
from costsieve.llm import ctw as C


def words_of(text):
    return (text or "").encode().lower().split()


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


class Brute:
    """CTW by recursion over all contexts, each decision node by itself."""

    def __init__(self, texts):
        self.rows = []
        for t in texts:
            data = C.PAD + t.encode().lower() + C.END
            self.rows += [(data[i - C.DEPTH:i], data[i]) for i in range(C.DEPTH, len(data))]

    def counts(self, context, bits):
        n = [0, 0]
        for c, x in self.rows:
            b = f"{x:08b}"
            if c.endswith(context) and b.startswith(bits):
                n[int(b[len(bits)])] += 1
        return n

    def log_weighted(self, context, bits):
        own = kt(*self.counts(context, bits))
        if len(context) == C.DEPTH:
            return own
        return np.logaddexp(own, self.log_children(context, bits)) - math.log(2)

    def log_children(self, context, bits):
        older = {c[C.DEPTH - len(context) - 1] for c, _ in self.rows if c.endswith(context)}
        return sum(self.log_weighted(bytes([o]) + context, bits) for o in older)

    def chance_of_one(self, context, bits, depth=0):
        own = context[C.DEPTH - depth:]
        a, b = self.counts(own, bits)
        here = (b + 0.5) / (a + b + 1)
        if depth == C.DEPTH:
            return here
        weight = math.exp(kt(a, b) - self.log_children(own, bits))
        return (weight * here + self.chance_of_one(context, bits, depth + 1)) / (weight + 1)

    def score(self, text):
        data, total = C.PAD + text.encode().lower() + C.END, 0.0
        for i in range(C.DEPTH, len(data)):
            b = f"{data[i]:08b}"
            for k in range(8):
                p = self.chance_of_one(data[i - C.DEPTH:i], b[:k])
                total += math.log10(p if b[k] == "1" else 1 - p)
        return total


TEXTS = ["abcab", "abab ab", "É", ""]


def model_of(spark, texts, share):
    docs = documents(spark, list(enumerate(texts)))
    return C.train(C.corpus_counts(docs, "text"), share)


def test_scores_against_brute_force(spark):
    model, brute = model_of(spark, TEXTS, 0.0), Brute(TEXTS)
    for text in ("abca", "ba", "", "zé"):
        assert C.text_scores(model, [text.encode().lower()])[0] == pytest.approx(brute.score(text), rel=1e-5)
    # the whole corpus's block probability, one decision after the other by the chain rule
    assert model.log_block.sum() == pytest.approx(sum(brute.log_weighted(b"", f"{x:08b}"[:k]) for k in range(8) for x in range(0, 256, 1 << (8 - k))), rel=1e-9)


def test_chances_add_up_and_shares_bound_the_tree(spark):
    texts = [f"text {i} of {i % 7}" for i in range(60)]
    for share in (0.0, 0.02, 2.0):
        model = model_of(spark, texts, share)
        assert np.allclose((10.0 ** model.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    small = model_of(spark, texts, 0.02)
    assert all((small.shape.depth == d).sum() <= 50 for d in range(1, C.DEPTH + 1))
    assert len(model.shape.last) == 1


def test_pooled_contexts_against_block_probability(spark):
    """With one retained depth the tree is a root with a leaf for each kept byte and one for the rest."""
    texts = ["aab ab", "ba"]
    model = model_of(spark, texts, 0.2)
    assert sorted(model.shape.last[1:]) and set(model.shape.depth) >= {0, 1}
    assert C.text_scores(model, [b"ab"])[0] > C.text_scores(model, [b"qz"])[0]


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 3.25, 10.0, 1234.5, 1e7])
    assert C.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)


def test_whole_query_base_score_against_brute_force(spark):
    import zlib

    docs = read("documents", "doc_id, text")
    learn = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learn for w in words_of(t))
    counts[None] = len(learn)
    total, bottom = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    got = {r["doc_id"]: r for r in entry.queries()["op5_context_tree_weighting"](spark, SF).collect()}
    assert len(got) == len(docs)
    bits, unseen = 0.0, b""
    for i, t in docs:
        tokens = words_of(t) + [None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / bottom) for w in tokens), rel=1e-9)
        if r["held_out"]:
            bits -= r["score"] / math.log10(2)
            unseen += (t or "").encode().lower() + C.END
    n = Counter(unseen)
    alone = sum(-c * math.log2(c / len(unseen)) for c in n.values())
    assert bits < 0.65 * alone  # far shorter on unseen texts than any code without contexts


def test_rare_words_join(spark, monkeypatch):
    docs = documents(spark, [(i, f"a b c{i} A") for i in range(9)])
    whole = sorted(tuple(r) for r in C.score(docs, docs["doc_id"] > 2).collect())
    monkeypatch.setattr(C, "HOT_WORDS", 1)
    assert [r[:5] for r in sorted(tuple(r) for r in C.score(docs, docs["doc_id"] > 2).collect())] == [r[:5] for r in whole]


def test_defined_cases(spark, monkeypatch):
    docs = documents(spark, [(1, None), (1, ""), (2, "one"), (2, "one"), (None, "two three"), (9, LONG)], extra=True)
    found = {(r["doc_id"], r["n_tokens"]): r for r in C.score(docs, docs["doc_id"] == 2).collect()}
    assert sorted(found, key=repr) == sorted([(1, 1), (2, 2), (None, 3), (9, 60_002)], key=repr)
    whole = found[9, 60_002]["score"]
    monkeypatch.setattr(C, "PIECE", 1000)
    assert {r["score"] for r in C.score(docs.where("doc_id = 9"), docs["doc_id"] == 2).collect()} != {whole}  # it learns nothing there
    nothing = C.score(docs, docs["doc_id"] == 77).collect()
    assert len(nothing) == 6 and {r["train_tokens"] for r in nothing} == {0}
    assert nothing[0]["bits_per_byte"] == pytest.approx(8)
    assert C.score(docs.limit(0), docs["doc_id"] == 2).count() == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    model = model_of(spark, ["word end wording"], 0.0)
    text = ("word wording " * 300).encode()
    whole = C.text_scores(model, [b"end", text, b"x"])
    monkeypatch.setattr(C, "PIECE", 100)
    assert C.text_scores(model, [b"end", text, b"x"]) == pytest.approx(whole, rel=1e-6)


def test_every_context_takes_part(spark, monkeypatch):
    """Rare contexts too, with no string, some strings and all strings broadcast."""
    texts = TEXTS + ["zzé ab", "abcab"]
    docs = documents(spark, list(enumerate(texts))).repartition(3)
    learn = docs["doc_id"] < 4
    brute = Brute(texts[:4])
    for hot, at_once in ((1 << 19, 1 << 17), (5, 1 << 17), (0, 1)):
        monkeypatch.setattr(C, "HOT_CODES", hot)
        monkeypatch.setattr(C, "PAIR_CODES", at_once)
        got = {r["doc_id"]: r["score"] for r in C.score(docs, learn).collect()}
        assert [got[i] for i in range(6)] == pytest.approx([brute.score(t) for t in texts], rel=1e-9)


def test_contexts_below_any_share_of_the_corpus(spark):
    """One text's own contexts are far below 1/16384 of the symbols, and still predict it."""
    rare = "qwxj vkzq jxqk"
    texts = ["plain text of words " * 1000] * 40 + [rare, rare]
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["score"] for r in C.score(docs, docs["doc_id"] <= 40).collect()}
    whole = C.train(C.corpus_counts(docs.where("doc_id <= 40"), "text"), 0.0)
    cut = C.train(C.corpus_counts(docs.where("doc_id <= 40"), "text"), 1 / 16384)
    assert got[41] == pytest.approx(C.text_scores(whole, [rare.encode()])[0], rel=1e-5)
    assert got[41] > C.text_scores(cut, [rare.encode()])[0] + 1


def test_slots_that_collide(monkeypatch):
    monkeypatch.setattr(C, "SLOTS", 8)
    codes, logs = np.arange(40) * 977, -np.arange(40.0)
    hot = C.HotCodes(codes, logs)
    found, left = hot.find(codes)
    assert 0 < len(left) < 40 and 0 not in left
    kept = np.setdiff1d(np.arange(40), left)
    assert found[kept].tolist() == logs[kept].tolist() and not found[left].any()


def test_scores_leave_by_parts_of_a_batch(monkeypatch):
    """What a task holds doesn't follow the rows of a batch; the scores don't depend on the parts."""
    schema = pa.schema([("id", pa.int64()), ("raw", pa.binary()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
                        ("rare_codes", pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())])))])
    texts = [b"", *[b"ab c%d " % k * (k % 7 * 9) for k in range(40)], b"x" * 700, b""]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.binary()), *[pa.array([0] * n, pa.int64())] * 3,
                                        *[pa.array([0.0] * n)] * 2, *[pa.array([[]] * n, schema.field(c).type) for c in ("rare", "rare_codes")]], schema=schema)
    codes = np.unique(C.strings([b"ab c"])[0])
    block = type("B", (), {"value": (codes, np.full(len(codes), -0.5), {b"ab": 0.25}, 1.0)})
    whole = list(C._score(block, "raw")([batch]))
    monkeypatch.setattr(C, "PIECE_TEXT", 200)
    parts = list(C._score(block, "raw")([batch]))
    assert len(whole) == 1 and len(parts) > 8
    assert pa.Table.from_batches(parts).to_pylist() == whole[0].to_pylist()
    counted = list(C._count("raw", "learn")([pa.table({"raw": texts, "learn": [True] * n}).to_batches()[0]]))
    assert sum(r["n"] for b in counted for r in b.to_pylist() if r["word"] is None) == sum(len(t) + 1 for t in texts) + n
