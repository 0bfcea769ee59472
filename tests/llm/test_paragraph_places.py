"""What stays of passages that paragraphs and blocks both see."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents

from costsieve.llm import paragraphs as P


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def cleaned(spark, docs):
    return {r["doc_id"]: r for r in P.remove_repeats(documents(spark, docs), whole=True).collect()}


def test_a_passage_of_a_removed_line_stays_elsewhere(spark):
    """Document 2's line goes as a near copy of document 1's, which lacks the added sentence."""
    rng = random.Random(31)
    base, added = words(rng, 500), words(rng, 60)
    inside = lambda: " ".join(words(rng, 20) + added + words(rng, 20))
    docs = [(1, " ".join(base)), (2, " ".join(base[:250] + added + base[250:])), (3, inside()), (4, inside())]
    got = cleaned(spark, docs)
    assert list(got[2]["removed"]) == [0] and got[2]["text"] == ""
    assert got[3]["text"] == docs[2][1] and got[3]["kept_in"] == []
    assert got[4]["cut"] and got[4]["kept_in"] == [3]


def test_words_gone():
    assert P.gone_words([4, 32], [3]) == 0 and P.gone_words([4, 32], [4]) == P.ALL
    assert P.gone_words([4, 10, 5, 10, 6, 32], [5, 6]) == P.ALL - (2**10 - 1)


def test_passages_go_to_their_ends(spark):
    rng = random.Random(32)
    long, short = words(rng, 51), words(rng, 137)
    docs = [(k, " ".join(words(rng, 13 + 5 * k) + long + words(rng, 21) + short + words(rng, 30))) for k in range(5)]
    docs.append((9, " ".join(words(rng, 20) + long[:20]) + "\n" + " ".join(long[20:] + words(rng, 9)) + "\n" + " ".join(short)))
    got = cleaned(spark, docs)
    assert got[0]["text"] == docs[0][1]
    for i, text in docs[1:]:
        assert got[i]["text"].split() == [w for w in text.split() if w not in {*long, *short}]


def test_words_around_earlier_places():
    """Against a comparison with every earlier place, word by word."""
    rng, n = random.Random(33), P.SIDES
    for _ in range(40):
        earlier, places = P.Earlier(), []
        for _ in range(12):
            text = [rng.choice("ab") if 16 < k < n + P.BLOCK + 2 and rng.random() < 0.2 else "c" for k in range(2 * n + P.BLOCK)]
            cut = rng.choice([0, 0, 5, n])
            word = P.word_hashes([w.encode() for w in text[cut:]])
            sides = [None] * cut + text[cut:n] + text[n + P.BLOCK:]
            lost = rng.choice([0, 1 << rng.randrange(2 * n)])
            expected = 0
            for other, gone in places:
                for step in (range(n - 1, -1, -1), range(n, 2 * n)):
                    for k in step:
                        if sides[k] is None or sides[k] != other[k] or gone >> k & 1:
                            break
                        expected |= 1 << k
            raw = P.side_words(word, np.array([n - cut]))[0]
            assert earlier.add(raw, lost) == expected
            places.append((sides, lost))
    assert P.halves((1 << P.SIDES) - 1 | 1 << P.SIDES + P.BLOCK) == (0, (1 << P.SIDES + 1) - 1)


@pytest.mark.parametrize("hot", [P.HOT, 1])
def test_passages_end_at_any_earlier_place(spark, monkeypatch, hot):
    """Document 1 holds a part of a passage only; document 2 holds all of it."""
    monkeypatch.setattr(P.passage_ends, "__defaults__", (hot,))
    rng = random.Random(34)
    for part in (slice(0, 32), slice(9, 41), slice(18, 50)):
        passage = words(rng, 50)
        docs = [(1, " ".join(words(rng, 22) + passage[part] + words(rng, 27)))]
        docs += [(k, " ".join(words(rng, 20 + k) + passage + words(rng, 30 - k))) for k in (2, 3, 4)]
        docs += docs[-1:]  # a repeated row
        docs.append((None, " ".join(words(rng, 12) + passage + words(rng, 25))))
        got = {}
        for r in P.remove_repeats(documents(spark, docs), whole=True).collect():
            assert got.setdefault(r["doc_id"], r["text"]) is not None
        assert got[1] == docs[0][1]
        for k, text in docs[2:]:
            assert got[k].split() == [w for w in text.split() if w not in passage]


@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_hot_classes_are_cut_into_ranges(spark, monkeypatch, size):
    """Ranges that end anywhere, of few rows each, against a comparison with all earlier places."""
    monkeypatch.setattr(P, "HOT_RANGE", size)
    rng = random.Random(35)
    need, sides, earlier, expected = [], [], {}, {}
    for i in [*range(40), None]:
        own = np.array([rng.choice([3, 5]) if k % P.SIDES < 3 or rng.random() < 0.1 else 9 for k in range(2 * P.SIDES)], np.uint64)
        own = np.zeros((2 * P.SIDES, P.SIDE_BYTES), np.uint8) + own.astype(np.uint8)[:, None]
        left, right = rng.choice([(P.SIDES, P.SIDES), (4, P.SIDES), (P.SIDES, 0)])
        own[left:P.SIDES] = own[P.SIDES + right:] = 0
        gone, key = rng.choice([0, 0, 1 << rng.randrange(2 * P.SIDES)]), rng.choice([1, 2])
        need.append((i, 5, 7, key, 0, gone))
        sides += [(i, 5, 7, key, 0, bytearray(own.tobytes()))] * 2
        if more := earlier.setdefault(key, P.Earlier()).add(own.tobytes(), gone):
            expected[i] = more
    assert len(expected) > 20
    rng.shuffle(need)
    places = "id long, th long, start long, k1 long, k2 long"
    got = P._hot_ends(spark.createDataFrame(sides, f"{places}, sides binary"), spark.createDataFrame(need, f"{places}, sides_gone long"), 2 * len(need))
    assert {r["id"]: r["more"] for r in got.collect()} == expected


def test_texts_without_shared_places_are_not_split_again(monkeypatch):
    """Only marked texts are read for their sets and sides."""
    texts = [b" ".join(b"%d" % (1000 * i + j) for j in range(60)) for i in range(3)]
    bitmap = np.zeros(P.MARKS, bool)
    bitmap[1] = True
    marks, every = np.packbits(bitmap), np.full(P.MARKS // 8, 255, np.uint8)
    one, all_ = (type("B", (), {"value": x}) for x in (marks, every))
    seen = []
    split = P.picked_blocks
    monkeypatch.setattr(P, "picked_blocks", lambda x: seen.append(len(x)) or split(x))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 1, 2]), pa.array(texts)], names=["id", "th", "t"])
    out = pa.Table.from_batches(list(P._marked_sides(all_, one)([batch])))
    assert seen == [1] and set(out["id"].to_pylist()) == {1}
    sets = pa.Table.from_batches(list(P._shingle_sets(all_, one, 25)([batch.select(["th", "t"])])))
    assert sets["class"].to_pylist() == [P.class_id(texts[1].split())]


def test_cut_words_against_bits():
    rng = random.Random(36)
    blocks = [(rng.randrange(P.SIDES, 300), rng.getrandbits(P.BLOCK), rng.getrandbits(2 * P.SIDES)) for _ in range(9)]
    expected = set()
    for start, own, more in blocks:
        bits = more & ((1 << P.SIDES) - 1) | own << P.SIDES | more >> P.SIDES << (P.SIDES + P.BLOCK)
        expected.update(start - P.SIDES + k for k in range(bits.bit_length()) if bits >> k & 1)
    assert set(np.flatnonzero(P.cut_words(*np.array(blocks).T)).tolist()) == expected
    assert P.without("a b  c\x1cd\n e f\tg \n\nh i", set(), P.cut_words(*np.array([[3, 0b1001, 0]]).T)) == "a b  c\x1cd\n f\tg \n\ni"
    assert P.without("a b\nc", {1}, P.cut_words(*np.zeros((3, 0), np.int64))) == "a b"


def test_lines_of_blocks_only_where_some_go():
    """A text's line ends are found only if the text may lose lines."""
    every = type("B", (), {"value": np.full(P.MARKS // 8, 255, np.uint8)})
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([b" ".join(b"%d" % k for k in range(90))])], names=["id", "th", "t"])
    runs = [pa.Table.from_batches(list(P._marked_blocks(every, x)([batch])))["runs"].to_pylist() for x in (None, every)]
    assert len(runs[0]) == len(runs[1]) > 2 and not any(runs[0]) and all(runs[1])
