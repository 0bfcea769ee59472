"""BPE transducer: ids as tiktoken's, exact round trips, restarts, the UTF-8 automaton, defined cases."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from helpers import LONG, documents, read

import __spark_entry__ as entry
from costsieve.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "aaabbcdeé \n\t'sAZ019ß日本 🙂‍́"


@pytest.fixture(scope="module")
def words():
    tokens, lonely = bpe.vocabulary(PATH)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(tokens), special_tokens={})
    return dict(tokens), lonely, theirs


def strings(tokens, n, seed=1):
    rnd = random.Random(seed)
    known = list(tokens)
    for _ in range(n):
        yield "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60)))
        yield b"".join(rnd.choice(known) for _ in range(rnd.randint(1, 12))).decode("utf-8", "replace")


@pytest.mark.parametrize("states,pieces", [(300_000, 100_000), (50, 20)])
def test_ids_are_the_library_ones(words, monkeypatch, states, pieces):
    tokens, lonely, theirs = words
    monkeypatch.setattr(bpe, "PIECES", pieces)
    encoder = bpe.Encoder(tokens, lonely, public_tokenizers.PATTERN)
    encoder.transducer.most = states
    decoder = bpe.Decoder(tokens)
    for text in [*strings(tokens, 1500), "", " ", "ab" * 3000, "é" * 999, "<|endoftext|>"]:
        ids = encoder.encode(text)
        assert list(ids) == theirs.encode_ordinary(text), text
        assert decoder.decode(ids.tobytes()) == text


def test_long_texts_are_read_in_blocks(words, monkeypatch):
    tokens, lonely, theirs = words
    monkeypatch.setattr(bpe, "LONG", 10)
    monkeypatch.setattr(bpe, "BLOCK", 3)
    encoder = bpe.Encoder(tokens, lonely, public_tokenizers.PATTERN)
    for text in strings(tokens, 200, seed=2):
        assert list(encoder.encode(text)) == theirs.encode_ordinary(text)


def test_neighbours_agree_as_merges_say(words):
    tokens, lonely, _ = words
    transducer = bpe.Transducer(tokens, lonely)
    rnd, known = random.Random(5), list(tokens.items())
    short = [x for x in known if len(x[0]) < 4]
    for _ in range(4000):
        (a, i), (b, j) = rnd.choice(short if rnd.random() < 0.7 else known), rnd.choice(short if rnd.random() < 0.7 else known)
        parts = [bytes([x]) for x in a + b]
        for _ in bpe.merge_steps(parts, tokens):
            pass
        assert transducer._agrees(i, j) == (parts == [a, b])


def test_output_lags_by_a_few_tokens(words):
    """A long piece's ids leave while it is read: no state holds back more than a few."""
    tokens, lonely, _ = words
    transducer = bpe.Transducer(tokens, lonely)
    transducer.encode(b"internationalization" * 200)
    assert max(len(held) for s in transducer.states for held, _ in bpe._ways(s)[1]) < 30


def test_vocabularies_that_break_the_description_are_refused():
    with pytest.raises(ValueError):
        bpe.unreachable(frozenset({b"a": 0}.items()))
    base = {bytes([i]): i for i in range(256)}
    # "abc" is made of "bc" (rank 300) after "ab" can't be: it has a lower rank than its part
    with pytest.raises(ValueError):
        bpe.unreachable(frozenset((base | {b"bc": 300, b"abc": 299}).items()))


def test_tokens_that_no_merges_reach_stand_for_whole_pieces_only():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257}
    lonely = bpe.unreachable(frozenset(ranks.items()))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, lonely, public_tokenizers.PATTERN)
    assert lonely == {b"xyz"}
    for text in ("xyz", "xyzab", "abxyz", "ab xyz", "aab"):
        assert list(encoder.encode(text)) == theirs.encode_ordinary(text)


def test_utf8_automaton():
    rnd = random.Random(7)
    pool = [0, 65, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE2, 0xED, 0xEF, 0xF0, 0xF4, 0xF5, 0xFF]
    ranks = {bytes([i]): i for i in range(256)}
    decoder = bpe.Decoder(ranks)
    for _ in range(5000):
        data = bytes(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))
        assert decoder.decode(array("I", list(data)).tobytes()) == data.decode("utf-8", "replace")
    with pytest.raises(KeyError):
        decoder.decode(array("I", [999]).tobytes())


def test_defined_cases(spark, words):
    theirs = words[2]
    docs = documents(spark, [(1, None), (2, ""), (3, LONG), (None, "ab  c\n"), (5, "same é"), (5, "same é")], extra=True)
    found = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert set(docs.columns) < set(found.columns) and found.count() == 6
    rows = bpe.decode(found, PATH).select("text", "ids", "decoded").collect()
    for r in rows:
        assert r.decoded == (r.text or "")
        assert array("I", bytes(r.ids)).tolist() == theirs.encode_ordinary(r.text or "")
    again = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).select("text", "ids", "decoded").collect()
    assert sorted(again, key=repr) == sorted(rows, key=repr)
    assert bpe.encode(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_on_whole_documents(spark, words):
    theirs = words[2]
    found = {r.doc_id: r for r in entry.queries()["op12_byte_bpe_transducer"](spark, "/root/testdata/sf0.01").collect()}
    for doc_id, text in read("documents", "doc_id, text"):
        ids = array("I", theirs.encode_ordinary(text or ""))
        r = found.pop(doc_id)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert not found
