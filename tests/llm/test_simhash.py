import random

import xxhash
from helpers import LONG, SF, components, documents, read

import __spark_entry__ as entry
from costsieve.llm import simhash as S
from costsieve.llm.components import connected_components


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """{print: set of prints in its component}, two bits."""
    ps = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(ps) for b in ps[:i] if (a ^ b).bit_count() <= 2]
    return components(ps, links)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_whole_query_against_brute_force(spark):
    docs = dict(read("documents", "doc_id, text"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entry.queries()["op2_simhash_pigeonring"](spark, SF).collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    roots = brute_components(prints.values())
    least = {}
    for i in sorted(prints):
        least.setdefault(roots[prints[i]], i)
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_links_with_and_without_large_buckets(spark):
    rng = random.Random(5)
    ps = set()
    for _ in range(12):  # families of near fingerprints, with links in chains and across segments
        base = rng.getrandbits(64)
        for _ in range(25):
            p = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                p ^= 1 << b
            ps.add(p)
    expected = {signed(p): signed(r) for p, r in brute_components(ps).items()}
    table = spark.createDataFrame([(signed(p),) for p in ps], "fp long")
    for limit in (1, 4, 128):
        links = [tuple(r) for r in S.near_links(table, bucket_limit=limit).collect()]
        unsigned = [(a % 2**64, b % 2**64) for a, b in links]
        assert all(0 < (a ^ b).bit_count() <= 2 for a, b in unsigned)
        got = components([signed(p) for p in ps], links)
        groups = lambda m: sorted(sorted(v for v in m if m[v] == r) for r in set(m.values()))
        assert groups(got) == groups(expected)


def near_family(rng, base, fixed, n, most):
    """Fingerprints within ``most`` flips of ``base`` and of each other's kin, the ``fixed`` low bits equal."""
    out = set()
    while len(out) < n:
        p = base & ((1 << fixed) - 1) | rng.getrandbits(64 - fixed) << fixed
        out.add(p)
        for b in rng.sample(range(fixed, 64), most):
            p ^= 1 << b
            out.add(p)
    return out


def test_large_buckets_stay_with_the_chains(spark, monkeypatch):
    """All share the first segment: longer keys alone find every link, none is left to the other way."""
    left = []
    monkeypatch.setattr(S, "_links_by_neighbour", lambda prints: left.append(prints.count()) or prints.selectExpr("fp as u", "fp as v").limit(0))
    ps = near_family(random.Random(11), 0x1234567, 21, 700, 3)
    table = spark.createDataFrame([(signed(p),) for p in ps], "fp long")
    links = {tuple(sorted(r)) for r in S.near_links(table, bucket_limit=32).collect()}
    every = sorted(ps)
    assert links == {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(every) for b in every[:i] if (a ^ b).bit_count() <= 2}
    assert sum(left) == 0 and len(links) > 500


def test_other_distances_with_large_buckets(spark):
    rng = random.Random(12)
    ps = sorted(near_family(rng, 0, 40, 150, 4) | near_family(rng, 0xABCDEF, 20, 100, 5))
    table = spark.createDataFrame([(signed(p),) for p in ps], "fp long")
    for bits in (0, 1, 3, 4):
        links = {tuple(sorted(r)) for r in S.near_links(table, bits, bucket_limit=3).collect()}
        assert links == {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(ps) for b in ps[:i] if (a ^ b).bit_count() <= bits}


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    rng.shuffle(edges)
    expected = components({v for e in edges for v in e}, edges)
    got = {r["vertex"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: r for v, r in expected.items() if v in got}
    assert all(v in got for v, r in expected.items() if v != r)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_defined_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (4, "one two"), (2, "ONE two"), (4, "one two"), (None, "lone text here now"), (None, "lone text here now"),
            (8, LONG), (7, LONG), (None, "three")]
    docs = documents(spark, rows, extra=True)
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (4, 2), (2, 2), (4, 2), (None, None), (None, None), (8, 7), (7, 7), (None, None)], key=repr)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept.collect()) == [(0, "lone "), (0, "three"), (2, "ONE t"), (3, ""), (7, "word ")]
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.drop_near_duplicates(docs.limit(0)).count() == 0
