from helpers import LONG, documents, same_as_oracle

from costsieve.llm import licenses as L


def found(spark, rows, **options):
    docs = documents(spark, rows, extra=True)
    out = L.scan(docs, **options)
    assert set(docs.columns) | {"n_words", "places"} == set(out.columns)
    return [(r["doc_id"], r["n_words"], [(p["label"], p["start"]) for p in r["places"]], [p["share"] for p in r["places"]]) for r in out.collect()]


def test_whole_query_against_sql(spark):
    same_as_oracle(spark, "op8_rare_token_licenses")


def test_every_place_is_found(spark):
    text = "Under the MIT-License! under the mit license, cc BY nc cc by nc; Apache License (Version 2) under the mit"
    rows = found(spark, [(1, text), (2, "cc by"), (3, "nc by cc")])
    assert rows[0][2] == [("mit", 0), ("mit", 4), ("cc-by-nc", 8), ("cc-by-nc", 11), ("apache-2", 14)]
    assert rows[1][2] == rows[2][2] == []


def test_word_breaks(spark):
    rows = found(spark, [(1, "cc\x00by\x1fnc"), (2, "CC_BY`NC\x7f"), (3, "cc\u00a0by nc"), (4, "cc by ñc"), (5, "😀 cc[by{nc}")])
    assert [r[2] for r in rows] == [[("cc-by-nc", 0)], [("cc-by-nc", 0)], [], [], [("cc-by-nc", 1)]]
    assert [r[1] for r in rows] == [3, 3, 2, 3, 4]


def test_index_takes_the_rarest_words():
    df = {"mit": 50, "under": 90, "the": 99, "license": 3}
    assert L.rare_postings(L.TEMPLATES[:1], df) == [[("license", 3), ("mit", 2)]]
    for df in ({}, {"license": 9}, {w: i for i, w in enumerate("under the mit license".split())}):
        assert len(L.rare_postings(L.TEMPLATES, df)) == len(L.TEMPLATES)


def test_share_of_the_sentence(spark):
    rows = found(spark, [(1, "Released under the MIT License."), (2, "under the mit license"),
                         (3, "This work is licensed under the GNU General Public License, version 3.")])
    assert rows[0][3] == [1.0] and rows[1][3] == [0.8] and rows[2][3] == [1.0]
    assert rows[2][2] == [("gpl-3", 6)]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "cc by nc"), (4, "cc by nc"), (None, "É cc by nc"), (6, LONG + " cc by nc")]
    got = sorted(found(spark, rows), key=repr)
    assert [(r[0], r[1], r[2]) for r in got] == sorted([
        (1, 0, []), (2, 0, []), (3, 0, []), (4, 3, [("cc-by-nc", 0)]), (4, 3, [("cc-by-nc", 0)]), (None, 4, [("cc-by-nc", 1)]),
        (6, 60_004, [("cc-by-nc", 60_001)])], key=repr)
    assert L.scan(documents(spark, rows).limit(0)).count() == 0
