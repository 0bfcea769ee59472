"""Plans without sorts of raw rows or slots, one pass with counts, runs that are repeated or fail."""

import datetime as dt
import re

import pytest
from conftest import SF_SMALL, unified
from pyspark.sql import functions as F

from costsieve.operators import cur as C
from costsieve.operators import detectors as E
from costsieve.operators import features as D
from costsieve.operators import firsts as FI
from costsieve.operators import report as H
from costsieve.plans.pipeline import analyze, build_features
from costsieve.sources import landing as L
from costsieve.sources.tables import billing, cur


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("few", [10_000, 2])
def test_first_values_by_key(spark, monkeypatch, few):
    monkeypatch.setattr(FI, "FEW", few)  # a larger dictionary is written and joined by its size
    rows = [("a", 5, "x"), ("a", 3, "y"), ("a", 3, "b"), ("a", 1, None), ("b", 2**61 - 1, "z"), ("b", 2**61, "a"), ("c", 0, None), ("d", None, "q")]
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    codes = FI.value_codes(df.where("v is not null"), ["v"], "code")
    key = FI.first_key(F.col("seq"), F.col("code"))
    found = df.join(codes, "v", "left").groupBy("k").agg(F.min(key).alias("key")).withColumn("code", FI.code_of(F.col("key")))
    got = {r.k: (r.seq, r.v) for r in found.join(codes, "code", "left").select("k", FI.seq_of(F.col("key")).alias("seq"), "v").collect()}
    assert got == {"a": (3, "b"), "b": (2**61 - 1, "z"), "c": (None, None), "d": (None, None)}


def test_cur_rows_meet_one_hash_aggregate(spark):
    text = plan(C.cur_ingest(cur(spark, SF_SMALL)))
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", text)) == 1
    assert "SortAggregate" not in text and not re.search(r"\bSort \[", text)


def test_storage_detectors_sort_no_slots(spark):
    ft = build_features(billing(spark, SF_SMALL))
    for df in (E.untagged_candidates(ft.slots, ft.services), E.detect_snapshot_sprawl(ft.slots), E.detect_orphaned_storage(ft.slots)):
        assert "SortAggregate" not in plan(df)


def test_first_row_of_a_resource_under_many_services(spark):
    rows = [dict(resource_id="s", provider=p, service=x) for p, x in
            [("GCP", "Snapshot"), ("AWS", "EBS Snapshot"), ("AWS", None), (None, "Backup")]]
    df = unified(spark, rows)
    slots = D.resource_day_slots(df)
    found = E._first_by_resource(slots, E.service_codes(slots), "first_row_owned", F.sum("cost").alias("cost")).collect()
    assert [(r.provider, r.service, r.first_seq, r.cost, r.first_row_owned) for r in found] == [("GCP", "Snapshot", 0, 4.0, False)]
    first_null = unified(spark, [dict(resource_id="s", provider=None, service=None), dict(resource_id="s")])
    slots = D.resource_day_slots(first_null)
    assert [tuple(r)[1:4] for r in E._first_by_resource(slots, E.service_codes(slots)).collect()] == [(0, None, None)]


def test_profile_expands_no_rows(spark):
    rows = [(None, "s1", 1.0, dt.date(2024, 3, 2)), ("r", "s1", 2.0, None), ("r", "s2", None, dt.date(2024, 3, 1)), ("", None, 1.0, None)]
    df = spark.createDataFrame(rows, "resource_id string, service string, cost double, date date")
    stats = C.cur_stats(df)
    r = stats.first()
    assert (r.total_rows, r.total_cost, r.unique_services, r.unique_resources, r.date_start, r.date_end) == (4, 4.0, 2, 2, "2024-03-01", "2024-03-02")
    text = plan(stats)
    assert "Expand" not in text and text.count("Exchange") <= 2
    empty = C.cur_stats(df.limit(0)).first()
    assert (empty.total_rows, empty.total_cost, empty.unique_services, empty.unique_resources) == (0, None, 0, 0)
    few = C.cur_stats(df.select("cost")).first()
    assert (few.total_rows, few.unique_services, few.unique_resources, few.date_start, few.columns_available) == (4, 0, 0, None, "cost")


def test_rejected_rows_are_counted_in_the_pass(spark, tmp_path):
    lines = ["UsageDate,ServiceName,CostInUSD,Quantity,ResourceId,SubscriptionId,MeterName", "2024-03-01,VM,1.5,1,r,s,m",
             "soon,VM,2,1,r,s,m", "2024-03-02,,3,1,r,s,m", "2024-03-02,VM,x,1,r,s,m"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    a = analyze(L.load_export(spark, str(tmp_path / "a.csv")))
    stats = a.stats.first()
    assert (stats.total_records, stats.normalized_records) == (4, 1) and a.features.norm.count() == 1
    assert "csv" not in plan(a.stats).lower()  # the raw file isn't scanned again
    a.close()


def leaks(spark, *names):
    return spark.createDataFrame([(n, "AWS", "s", "r") for n in names], "leak_type string, provider string, service string, resource_id string")


def status(df):
    return {r.leak_type: r.status for r in df.collect()}


def test_a_repeated_run_tags_alike(spark, tmp_path):
    path = str(tmp_path / "ids")
    H.save_current_ids(leaks(spark, "A"), path, "2024-03-01")
    for _ in range(2):  # the second time its own ids are there
        tagged = H.apply_delta(leaks(spark, "A", "B"), H.load_previous_ids(spark, path, "2024-03-02/x"))
        assert status(tagged) == {"A": "EXISTING", "B": "NEW"}
        H.save_current_ids(leaks(spark, "A", "B"), path, "2024-03-02/x")
    assert {r[0] for r in H.load_previous_ids(spark, path).collect()} == {"A::AWS::s::r", "B::AWS::s::r"}
    assert H.load_previous_ids(spark, path, "2024-03-01").count() == 0


def test_a_failed_run_leaves_the_old_ones(spark, tmp_path):
    path, one = str(tmp_path / "x"), spark.createDataFrame([(2,)], "n long")
    H.save_current_ids(leaks(spark, "A"), path, "1")
    bad = leaks(spark, "B").withColumn("resource_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        H.save_current_ids(bad, path, "2")
    assert H.load_previous_ids(spark, path, "3").count() == 1 and H.last_complete_run(spark, path) == "1"
    report, sections = str(tmp_path / "r"), {"summary": one.schema, "leaks": leaks(spark).schema}
    H.write_json_report(report, one, leaks(spark, "A"), None, one, "1")
    with pytest.raises(Exception, match="lost"):
        H.write_json_report(report, one, bad, None, one, "2")
    assert [r.leak_type for r in H.read_json_report(spark, report, sections)["leaks"].collect()] == ["A"]
    H.write_json_report(report, one, leaks(spark, "C"), None, one)  # ids of the time come after "1"
    assert [r.leak_type for r in H.read_json_report(spark, report, sections)["leaks"].collect()] == ["C"]
    with pytest.raises(FileNotFoundError):
        H.read_json_report(spark, str(tmp_path / "none"), sections)
