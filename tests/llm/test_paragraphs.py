import random

import pytest
import xxhash
from helpers import LONG, SF, components, documents, read

import __spark_entry__ as entry
from costsieve.llm import paragraphs as P


def text_hash(text):
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(docs, similarity=P.SIMILARITY, min_words=P.MIN_WORDS):
    """{(id, text): removed lines} by comparing all classes that share a shingle."""
    places, sets = {}, {}
    for i, text in docs:
        for line, words in enumerate((text or "").split("\n")):
            words = tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in words).split())
            if len(words) >= min_words:
                places.setdefault(words, []).append((i is None, i or 0, text_hash(text), line, text))
                sets[words] = {words[k:k + 5] for k in range(max(1, len(words) - 4))}
    by_shingle = {}
    for w, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(w)
    links = {(a, b) for group in by_shingle.values() for a in group for b in group
             if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
    root = components(list(sets), links)
    clusters = {}
    for w, r in root.items():
        clusters.setdefault(r, []).extend(places[w])
    gone = {(i, t): [] for i, t in docs}
    for group in clusters.values():
        stays = min(group[:])[:4]
        for null, i, th, line, text in group:
            if (null, i, th, line) != stays:
                gone[None if null else i, text].append(line)
    return {k: sorted(set(v)) for k, v in gone.items()}


def brute_cuts(docs):
    """{(id, text): first words of blocks cut} by all blocks' words and a plain winnowing."""
    places = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        order = P.picked_blocks([words])[1].tolist()
        width = P.PASSAGE - P.BLOCK + 1
        for p in range(len(words) - P.PASSAGE + 1):  # each passage has a picked block
            assert any(p <= q < p + width or tuple(words[q:q + P.BLOCK]) == tuple(words[p:p + P.BLOCK]) for q in order)
        for p in order:
            places.setdefault(tuple(words[p:p + P.BLOCK]), []).append((i is None, i or 0, text_hash(text), p, text))
    gone = {(i, t): [] for i, t in docs}
    for group in places.values():
        for null, i, th, p, text in group:
            if (null, i, th, p) != min(group)[:4]:
                gone[None if null else i, text].append(p)
    return {k: sorted(set(v)) for k, v in gone.items()}


def cleaned(text, lines, cuts):
    """Word by word."""
    if text is None:
        return None
    cut, n, out = {w for c in cuts for w in range(c, c + P.BLOCK)}, 0, []
    for i, line in enumerate(text.split("\n")):
        words = line.encode().split()
        keep = [w for k, w in enumerate(words) if n + k not in cut]
        n += len(words)
        if i not in lines and (keep or not words):
            out.append([w.decode() for w in keep])
    return out or [[]]


def split(text):
    return None if text is None else [[w.decode() for w in line.encode().split()] for line in text.split("\n")]


def passages(docs, n=P.PASSAGE):
    """{words of a passage: ids}, for passages that aren't one word over and over."""
    out = {}
    for i, t in docs:
        words = (t or "").encode().lower().split()
        for p in range(len(words) - n + 1):
            if len(set(words[p:p + n])) > n // 3:
                out.setdefault(tuple(words[p:p + n]), set()).add(i)
    return out


def check(spark, docs, **options):
    expected, cuts = brute(docs, **options), brute_cuts(docs)
    got = P.remove_repeats(documents(spark, docs), **options).collect()
    assert sorted(((r["doc_id"], split(r["text"]), list(r["removed"]), list(r["cut"])) for r in got), key=repr) == sorted(
        [(i, cleaned(t, expected[i, t], cuts[i, t]), expected[i, t], cuts[i, t]) for i, t in docs], key=repr)
    return got


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, base, k):
    out = list(base)
    for p in rng.sample(range(len(out)), k):
        out[p] = f"x{rng.randrange(10**6)}"
    return out


def test_whole_query_against_brute_force(spark):
    docs = read("documents", "doc_id, text")
    expected = brute(docs)
    got = {r["doc_id"]: r for r in entry.queries()["op4_paragraph_minhash"](spark, SF).collect()}
    assert len(got) == len(docs)
    cuts = brute_cuts(docs)
    wrong = [i for i, t in docs if list(got[i]["removed"]) != expected[i, t]]
    assert len(wrong) <= 2  # the recall at the threshold is 0.998
    assert all(list(got[i]["cut"]) == cuts[i, t] for i, t in docs)
    before, after = passages(docs), passages([(i, got[i]["text"]) for i, _ in docs])
    again = {p: ids for p, ids in before.items() if len(ids) > 1}
    assert len(again) > 1000 and not any(len(after.get(p, ())) > 1 for p in again)
    unchanged = [i for i, t in docs if not got[i]["removed"] and not got[i]["cut"]]
    assert len(unchanged) > 700 and all(got[i]["text"] == dict(docs)[i] for i in unchanged)
    assert sum(map(bool, expected.values())) > 50


def test_near_copies_and_clean_texts(spark):
    rng = random.Random(6)
    docs = []
    for g in range(12):
        base = words(rng, 60)
        docs += [(100 * g + k, "\n".join([" ".join(words(rng, 30)), " ".join(changed(rng, base, k % 2)), "short line"])) for k in range(4)]
    docs += [(5000 + k, " ".join(words(rng, 70))) for k in range(20)]
    got = check(spark, docs)
    assert sum(map(len, (r["removed"] for r in got))) >= 36 - 12
    assert all(r["kept_in"] == [] for r in got if r["doc_id"] >= 5000)


@pytest.mark.parametrize("limit,side", [(2, 512), (2, 7), (1024, 512)])
def test_large_buckets(spark, monkeypatch, limit, side):
    """Many near copies of few bases in one bucket, and a chain whose ends aren't similar."""
    monkeypatch.setattr(P, "BUCKET_LIMIT", limit)
    monkeypatch.setattr(P, "SIDE", side)
    rng, docs = random.Random(8), []
    for base in (words(rng, 80), words(rng, 80)):
        docs += [(len(docs) + k, " ".join(changed(rng, base, k % 3))) for k in range(40)]
    link = words(rng, 90)
    for _ in range(8):
        docs.append((len(docs), " ".join(link)))
        link = changed(rng, link, 1)
    check(spark, docs)


def test_passages_inside_lines(spark):
    rng = random.Random(9)
    passage = words(rng, 51)
    docs = [(k, " ".join(words(rng, 10 + 7 * k) + passage + words(rng, 30))) for k in range(6)]
    docs += [(50, " ".join(words(rng, 20) + passage[:20]) + "\n" + " ".join(passage[20:] + words(rng, 9)))]
    docs += [(100 + k, " ".join(words(rng, 80) + passage[:31])) for k in range(3)]  # too short a part
    got = {r["doc_id"]: r for r in check(spark, docs)}
    assert not got[0]["cut"] and all(got[k]["cut"] for k in (1, 2, 3, 4, 5, 50)) and not any(got[k]["cut"] for k in (100, 101, 102))
    assert got[50]["kept_in"] == [0] and " ".join(passage) not in got[3]["text"]


def test_bands_are_tuned():
    bands, rows = P.bands_for()
    assert bands * rows <= P.HASHES and 1 - (1 - P.SIMILARITY**rows) ** bands >= P.RECALL
    assert P.bands_for(0.5, 0.999, 32)[1] < rows + 1 and P.bands_for(0.01, 1.0, 4) == (4, 1)


def test_defined_cases(spark):
    long = LONG + "\n" + LONG
    para = " ".join(f"p{i}" for i in range(50))
    docs = [(1, None), (2, ""), (3, para), (3, para), (4, para.upper() + "\n" + para), (None, "tail\n" + para), (6, long), (7, "few words\nfew words")]
    check(spark, docs)
    table = documents(spark, docs, extra=True)
    out = P.remove_repeats(table)
    assert out.columns == [*table.columns, "removed", "cut", "kept_in"] and out.count() == len(docs)
    assert P.remove_repeats(table.limit(0)).count() == 0
