"""Languages whose labelled documents are all long."""

from helpers import documents
from pyspark.sql import functions as F

from costsieve.llm import langid as L


def test_language_of_long_documents_is_learned(spark):
    rows = [(k, "the cat sat on the mat " * 3, "en") for k in range(5)] + [(10, "the dog " * 5000, "en")]
    rows += [(20 + k, "zwölf boxkämpfer jagen viktor " * 1000, "de") for k in range(3)]
    sample = L.training_sample(documents(spark, rows), F.lit(True), max_docs=2)
    got = sorted((r["lang"], len(r["t"])) for r in sample.collect())
    assert got == [("de", L.MAX_DOC_BYTES)] * 2 + [("en", 69)] * 2
    assert L.predict(L.train(sample), ["viktor boxkämpfer".encode(), b"the cat"])[0] == ["de", "en"]
