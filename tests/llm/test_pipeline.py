"""The pipeline's stages against the brute-force counterparts, each on its own input."""

import corpus_pipeline
import test_decontaminate
import test_mixing
import test_paragraphs  # noqa: F401  (same helpers)
import test_simhash
from helpers import read

import __spark_entry__ as entry
from costsieve.llm import decontaminate, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = read("benchmark", "item_id, text", SF)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns + ["copies"] * (name == "mixing")
        if name == "language_id":
            expected = {i for i, r in before.items() if any(map(str.isalpha, r["text"] or ""))}
        elif name == "simhash_near_dedup":
            prints = {i: test_simhash.brute_print(r["text"]) for i, r in before.items()}
            roots = test_simhash.brute_components(prints.values())
            first = {}
            for i in sorted(prints):
                first.setdefault(roots[prints[i]], i)
            expected = set(first.values())
        elif name == "benchmark_decontamination":
            found = test_decontaminate.brute([(i, r["text"]) for i, r in before.items()], bench)
            expected = {i for i, (n, hit, _) in found.items() if not (hit and 20 * len(hit) >= n)}
            assert expected != set(before)
        elif name == "pii":
            expected = set(before)
            for i, r in before.items():
                same = not pii.detect(r["text"])
                assert (after[i]["text"] == r["text"]) == same
        else:
            rows = [r for r in corpus_pipeline.mixing.mix(spark.createDataFrame(list(before.values()))).collect()]
            test_mixing.check(rows, [(i, r["text"], r["source"]) for i, r in before.items()])
            expected = {r["id"] for r in rows if r["copies"]}
            assert {i: r["copies"] for i, r in after.items()} == {r["id"]: r["copies"] for r in rows if r["copies"]}
        assert set(after) == expected
    assert decontaminate.WINDOW == 13
    whole = entry.queries()["pipeline"](spark, SF)
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(after)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.count() == 0
