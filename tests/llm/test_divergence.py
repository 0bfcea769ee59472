"""Source divergence: against brute force, whatever the block, chunk and pair limits; the SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import LONG, documents, same_as_oracle

from costsieve.llm import divergence as D


def brute(rows, min_docs, top=10):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))))
            for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in seen.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for _, source, words in mine:
            counts[source].update({t: words[t] for t in kept if t in words})
        v = len(kept)

        def p(table):
            n = sum(table.values())
            return {t: 1 + 10**9 * (table[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(sum(counts.values(), Counter()))
        of = {s: p(c) for s, c in counts.items()}
        for s in of:
            pairs = [(s2, sum(f(of[s][t], of[s2][t]) for t in kept)) for s2 in of if s2 != s]
            terms = [(t, f(of[s][t], q[t])) for t in kept if counts[s][t] > 0 and of[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked if part == "pair" else ranked[:top], 1)]
    return sorted(out)


def rows_of(seed, n=160):
    rnd = random.Random(seed)
    words = ["a", "B", "über", "日本", "x1y", "the", "Zed", "z-z"] + [f"w{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(n):
        weights = [1 / (k + 1 + rnd.random()) for k in range(len(words))]
        text = None if rnd.random() < 0.05 else " ".join(rnd.choices(words, weights, k=rnd.randint(0, 30)))
        rows.append((i, text, rnd.choice(["en", "en", "fr", None, ""]), rnd.choice(["s1", "s1", "s2", "ß", None, "s3"])))
    return rows + [(900, "unseen only here", "xx", "s1"), (901, None, "xx", "s2"), (902, "the", "yy", "s1")]


def found(spark, rows, **options):
    out = D.audit(documents(spark, rows, extra=True).repartition(5), **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block_entries": 9}), (3, {"min_docs": 40}), (4, {"min_docs": 1, "top": 3})])
def test_brute_force(spark, seed, options):
    rows = rows_of(seed)
    assert found(spark, rows, **options) == brute(rows, options.get("min_docs", 10), options.get("top", 10))


def test_small_chunks_and_pair_sums(spark, monkeypatch):
    """Limits so small that runs have many chunks and pair sums are handed on often."""
    batches = list(_postings())
    whole = _sums(D._pair_corrections(batches))
    monkeypatch.setattr(D, "PAIRS", 5)
    assert _sums(D._pair_corrections(batches)) == whole == _sums(D._pair_corrections([b.slice(i, 1) for b in batches for i in range(b.num_rows)]))


def _postings():
    import pyarrow as pa

    rnd = random.Random(9)
    rows = [("en", t, s, rnd.randint(2, 10**9), 2 + len(s)) for t in sorted("abcdef") for s in rnd.sample(["p", "qq", "rrr", "ü"], rnd.randint(1, 4))]
    for k in range(0, len(rows), 3):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k:k + 3])], names=["lang", "term", "source", "p", "low"])


def _sums(batches):
    out = Counter()
    for b in batches:
        for r in b.to_pylist():
            assert r["one"].encode() < r["two"].encode()
            out[r["lang"], r["one"], r["two"]] += r["correction"]
    return out


def test_merge_opens_chunks_in_order(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 2)
    rnd = random.Random(4)
    total, chunks = defaultdict(Counter), []
    for _ in range(7):
        block = D.Block()
        for _ in range(6):
            text = " ".join(rnd.choices("abcdefghij", k=5))
            source = rnd.choice(["s", "t"])
            block.add("en", source, text.encode())
            for w in text.split():
                total[w][source] += 1
        chunks += [r for b in block.run(1) for r in b.to_pylist()]
    assert max(len(c["terms"]) for c in chunks) == 2
    chunks.sort(key=lambda c: c["first"])
    merged = [(t.decode(), D.counts_of(places)) for t, _, places in D.merged(iter(chunks))]
    assert [t for t, _ in merged] == sorted(total) and dict(merged) == {t: dict(c) for t, c in total.items()}


@pytest.mark.parametrize("piece", [1 << 20, 4])
def test_long_and_repeated_texts(spark, monkeypatch, piece):
    block = D.Block()
    monkeypatch.setattr(D, "PIECE", piece)
    block.add("en", "s", "ab cde AB éé1cde".encode())
    assert block.counts["en", "s"] == {b"ab": 2, b"cde": 2, "éé".encode(): 1} and set(block.docs["en", "s"].values()) == {1}
    if piece > 4:
        rows = [(i, LONG, "en", s) for i, s in enumerate("aabbbb" * 3)]
        assert found(spark, rows) == brute(rows, 10)
        assert found(spark, []) == []


def test_query_is_its_sql(spark):
    same_as_oracle(spark, "op13_source_divergence")


def test_merge_by_ranges_leaves_rare_terms_out(monkeypatch):
    """Windows of any size give the same terms, counts and documents."""
    monkeypatch.setattr(D, "CHUNK", 3)
    rnd, total, seen, chunks = random.Random(8), defaultdict(Counter), Counter(), []
    for _ in range(9):
        block = D.Block()
        for _ in range(8):
            words = rnd.choices([f"{a}{b}" for a in "abcdé" for b in "xyz"], k=6)
            source = rnd.choice(["s", "t", "u"])
            block.add("en", source, " ".join(words).encode())
            seen.update(set(words))
            for w in words:
                total[w][source] += 1
        assert all(list(block.counts[k]) == list(block.docs[k]) for k in block.counts)
        chunks += [r for b in block.run(1) for r in b.to_pylist()]
    chunks.sort(key=lambda c: c["first"])
    for window in (1, 5, 1000):
        monkeypatch.setattr(D, "WINDOW", window)
        for least in (1, 30):
            got = [(t.decode(), n, D.counts_of(places)) for t, n, places in D.merged(iter(chunks), least)]
            assert got == [(t, seen[t], dict(total[t])) for t in sorted(total, key=str.encode) if seen[t] >= least]


def test_runs_are_read_and_merged_in_bulk():
    """Rare terms take no steps of their own: far fewer calls than terms."""
    import cProfile
    import pstats

    blocks = []
    for k in range(4):
        blocks.append(D.Block())
        blocks[-1].add("en", "s", " ".join(f"{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(k, 20_000)).encode())
    chunks = sorted((r for b in blocks for x in b.run(1) for r in x.to_pylist()), key=lambda c: c["first"])
    watch = cProfile.Profile()
    assert watch.runcall(lambda: sum(1 for _ in D.merged(iter(chunks), 10))) == 0
    assert pstats.Stats(watch).total_calls < 200_000  # some 80,000 entries; with a heap two calls and more each
