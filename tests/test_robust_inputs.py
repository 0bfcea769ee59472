"""Inputs as careless exports have them, plan shapes, loader errors and report sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, days, unified
from costsieve.operators import detect as B
from costsieve.operators import detectors as E
from costsieve.operators import enrich as G
from costsieve.operators import normalize as N
from costsieve.operators import report as H
from costsieve.plans.pipeline import analyze, build_features
from costsieve.sources import landing as L
from costsieve.sources.tables import billing, cur


# ------------------------------------------------------------------ dates
@pytest.mark.parametrize("text,day", [
    ("2024-03-01", "2024-03-01"), ("2024-3-1", "2024-03-01"), ("3/1/2024", "2024-03-01"), ("03/01/2024", "2024-03-01"),
    ("1-Mar-2024", "2024-03-01"), ("01-MAR-2024", "2024-03-01"), ("1 Mar 2024", "2024-03-01"), ("Mar 1, 2024", "2024-03-01"),
    ("March 1, 2024", "2024-03-01"), ("20240301", "2024-03-01"), ("2024/3/1", "2024-03-01"), (" 2024-03-01 ", "2024-03-01"),
    ("2024-03-01T23:30:00-05:00", "2024-03-01"), ("2024-03-01 00:10:00+09:00", "2024-03-01"), ("2024-03-01T05:00:00Z", "2024-03-01"),
    ("2024-03-01T05:00:00.123456 UTC", "2024-03-01"), ("202403", None), ("2024-02-30", None), ("13/45/2024", None), ("soon", None),
    ("2024-03-01Tmorning", None), ("", None), (None, None)])
def test_date_layouts(spark, text, day):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(N.parse_date(df, "d").cast("string")).first()[0] == day


def test_null_tokens_of_csv_files(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\nNA,1\n"n/a",2\nnull,3\nNone,4\n,5\nNAN,6\nnan,7\n')
    assert [(r.a, r.b) for r in L.read_csv_export(spark, str(path)).orderBy("b").collect()] == [
        (None, "1"), (None, "2"), (None, "3"), (None, "4"), (None, "5"), ("NAN", "6"), (None, "7")]


def test_names_that_differ_by_case(spark):
    raw = spark.createDataFrame([("2024-03-01", "x", "vm", "4.5", "sub")], "Date string, date string, ServiceName string, Cost string, SubscriptionId string")
    assert [(str(r.date), r.cost) for r in N.normalize(raw, "AZURE").collect()] == [("2024-03-01", 4.5)]
    both = spark.createDataFrame([("2024-03-02", "AmazonEC2", "1.5", "old", "older")],
                                 "line_item_usage_start_date string, product_servicecode string, line_item_unblended_cost string, Date string, date string")
    assert [(str(r.date), r.cost) for r in N.normalize(both, "AWS").collect()] == [("2024-03-02", 1.5)]


def test_dotted_owner_columns(spark):
    rows = unified(spark, [dict(date=d, resource_id="a", cost=5.0) for d in days(3)] + [dict(resource_id="b", cost=5.0)])
    rows = rows.withColumn("labels.owner", F.when(F.col("resource_id") == "a", F.lit("team"))).withColumn("labels.project", F.lit(None).cast("string"))
    a = analyze(rows, already_normalized=True)
    assert {r.resource_id for r in a.leaks.where("leak_type = 'UNTAGGED_RESOURCE'").collect()} == {"b"}
    a.close()


def test_missing_optional_columns(spark):
    rows = unified(spark, [dict(date=d, cost=100.0) for d in days(3)]).drop("region", "resource_id", "usage")
    a = analyze(rows, already_normalized=True)
    assert a.features.resources.count() == 0 and a.summary.first().total_leaks >= 0
    assert a.stats.first().total_records == 3


# ------------------------------------------------------------------ landing zone
def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_every_file_is_classified(spark, tmp_path):
    write(tmp_path / "mixed/a.csv", "foo,bar", "1,2")
    write(tmp_path / "mixed/b.csv", "SubscriptionId,UsageDate,MeterName,ResourceId", "s,2024-03-01,m,r")
    write(tmp_path / "two/a.csv", "SubscriptionId,UsageDate", "s,2024-03-01")
    write(tmp_path / "two/b.csv", "line_item_line_item_type,line_item_unblended_cost", "Usage,1")
    write(tmp_path / "one/a.csv", '"billing_account_id","cost, net","usage_start_time"', '1,"a', 'b",3', "", "2,c,4")
    files = L.file_headers(spark, f"{tmp_path}/*/*.csv").withColumnRenamed("file", "source")
    name = L.export_name(F.col("source"))
    short = F.regexp_extract("source", r"([^/]+/[^/]+)$", 1)
    per_file = B.detect_provider_files(files)
    assert {r[0]: r[1] for r in per_file.select(short, "provider").collect()} == {
        "mixed/a.csv": None, "mixed/b.csv": "AZURE", "two/a.csv": "AZURE", "two/b.csv": "AWS", "one/a.csv": "GCP"}
    rolled = {r.source: (r.provider, r.mixed) for r in B.provider_by_export(per_file, name).collect()}
    assert rolled == {"mixed": (None, False), "two": (None, True), "one": ("GCP", False)}
    assert {r["column"] for r in files.where(short == "one/a.csv").collect()} == {"billing_account_id", "cost, net", "usage_start_time"}
    rows = {r[0]: r[1] for r in L.file_row_counts(spark, f"{tmp_path}/*/*.csv").select(F.regexp_extract("file", r"([^/]+/[^/]+)$", 1), "rows").collect()}
    assert rows["one/a.csv"] == 2 and rows["mixed/a.csv"] == 1  # quoted line break and blank line
    valid = B.validity_by_export(B.validate_billing_files(files, L.file_row_counts(spark, f"{tmp_path}/*/*.csv").withColumnRenamed("file", "source")), name)
    assert {r.source: r.is_valid for r in valid.collect()} == {"mixed": False, "two": True, "one": True}
    kinds = {r.source: r.file_kind for r in B.kind_by_export(B.detect_file_kind(files), name).collect()}
    assert kinds["mixed"] == "COST_USAGE+UNKNOWN"


def test_loader_suffixes_and_errors(spark, tmp_path):
    write(tmp_path / "x.csv", "a,b", "NA,2")
    write(tmp_path / "empty.csv", "a,b")
    write(tmp_path / "x.txt", "a")
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "x.parquet"))
    spark.createDataFrame([(2,)], "a int").write.parquet(str(tmp_path / "x.pqt"))
    assert [tuple(r) for r in L.load_export(spark, str(tmp_path / "x.csv")).collect()] == [(None, "2")]
    assert L.load_export(spark, str(tmp_path / "x.parquet")).first().a == 1 and L.load_export(spark, str(tmp_path / "x.pqt")).first().a == 2
    with pytest.raises(FileNotFoundError):
        L.load_export(spark, str(tmp_path / "none.csv"))
    for bad in ("x.txt", "empty.csv"):
        with pytest.raises(ValueError):
            L.load_export(spark, str(tmp_path / bad))


# ------------------------------------------------------------------ commitments, plans
def test_slash_layout_finds_both_commitment_leaks(spark):
    a = analyze(L.cur_slash_export(cur(spark, SF_SMALL)))
    assert a.skipped == [] and {r.leak_type for r in a.leaks.collect()} >= {"RI_SAVINGS_PLAN_WASTE", "RI_UNUSED_RESERVATION"}
    a.close()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_and_aggregates(spark, tmp_path):
    path = str(tmp_path / "cur")
    cur(spark, SF_SMALL).write.parquet(path)
    raw = spark.read.parquet(path)
    assert plan(E.commitment_totals(raw)).count("FileScan") == 1
    a = analyze(raw)
    for df in (a.leaks, a.scored, a.stats, a.summary, a.forecasts):
        assert path not in plan(df)  # all from the written aggregates
    from costsieve.operators.cur import cur_aggregate, cur_extract

    text = plan(cur_aggregate(cur_extract(raw)))
    below = text[text.rindex("Exchange hashpartitioning"):]  # what the raw rows meet before their shuffle
    assert "HashAggregate" in below and "Sort" not in below
    assert "FileScan parquet" in plan(a.features.slots)
    orphaned = plan(E.detect_orphaned_storage(a.features.slots))
    assert "usage_sum" not in orphaned and "owned" not in orphaned and "cost#" not in orphaned  # only the columns it needs
    untagged = plan(E.untagged_candidates(a.features.slots, a.features.services))
    assert untagged.count("FileScan") == 2 and untagged.count("Exchange hashpartitioning(resource_id") == 1
    a.close()
    with pytest.raises(Exception):
        a.features.slots.count()


# ------------------------------------------------------------------ E5, E8 around their thresholds
def slots_of(spark, rows):
    return build_features(unified(spark, rows), materialize=False)


def test_orphaned_storage_by_slot(spark):
    d1, d2 = days(2)
    rows = [dict(service="AmazonEBS", resource_id="v1", date=d1, region="a"), dict(service="AmazonEC2", resource_id="m1", date=d1, region="a"),
            dict(service="AmazonEBS", resource_id="v2", date=d1, region="b"), dict(service="AmazonEBS", resource_id="v2", date=d2, region="b"),
            dict(service="AmazonEBS", resource_id="v3", date=d2, region="a"), dict(service="AmazonEBS", resource_id="v3", date=d1, region="a"),
            dict(service="AmazonEBS", resource_id="v4", date=d1, region="a", provider="GCP"),
            dict(service="Persistent Disk", resource_id="v5", date=d1, region=None, provider="GCP"),
            dict(service="Compute Engine", resource_id="m2", date=d1, region="", provider="GCP")]
    found = E.detect_orphaned_storage(slots_of(spark, rows).slots).collect()
    assert {r.resource_id for r in found} == {"v2"}


@pytest.mark.parametrize("cost,n", [(0.0049, 0), (0.005, 1), (0.006, 1)])
def test_untagged_cost_threshold(spark, cost, n):
    ft = slots_of(spark, [dict(resource_id="r", cost=cost), dict(resource_id="r", cost=cost)])
    assert E.untagged_candidates(ft.slots, ft.services).count() == n


# ------------------------------------------------------------------ reports
def test_json_report_round_trip(spark, tmp_path):
    leaks = spark.createDataFrame([("A", 1.5, dt.date(2024, 3, 1)), ("B", float("nan"), None)], "leak_type string, waste double, day date")
    one = spark.createDataFrame([(2,)], "n long")
    H.write_json_report(str(tmp_path / "r"), one, leaks, leaks.limit(0), one)
    back = H.read_json_report(spark, str(tmp_path / "r"), {"leaks": H.sanitize_frame(leaks).schema, "summary": one.schema, "forecasts": H.sanitize_frame(leaks).schema})
    assert sorted(map(tuple, back["leaks"].collect())) == [("A", 1.5, "2024-03-01"), ("B", None, None)]
    assert back["summary"].first().n == 2 and back["forecasts"].count() == 0


def test_previous_ids(spark, tmp_path):
    assert H.load_previous_ids(spark, None).count() == 0 and H.load_previous_ids(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([("a",)], "other string").write.parquet(str(tmp_path / "bad"))
    assert H.load_previous_ids(spark, str(tmp_path / "bad")).count() == 0


@pytest.mark.parametrize("value", [12345678.9, 0.0, 1.5, 100.0, 0.25, 1e15, 1234567.0, None])
def test_prompt_numbers_as_json(spark, value):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(G.json_value(F.col("x"), True)).first()[0] == json.dumps(value)


@pytest.mark.parametrize("value", ["plain", "a — b", 'quote " back \\ tab \t', "é 😀", None])
def test_prompt_texts_as_json(spark, value):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(G.json_value(F.col("x"))).first()[0] == json.dumps(value)


def test_pivot_shows_every_service(spark):
    from costsieve.operators.explore import daily_service_pivot

    rows = spark.createDataFrame([(dt.date(2024, 3, 1), f"s{i}", 1.0) for i in range(6)], "date date, service string, cost double")
    assert len(daily_service_pivot(rows).columns) == 7


def test_billing_view_has_all_accounts(spark):
    assert L.with_account(billing(spark, SF_SMALL)).where("account is null").count() == 0
    rows = spark.createDataFrame([("click-3",), ("purchase-29",)], "resource_id string")
    assert [r.account for r in L.with_account(rows).orderBy("account").collect()] == [3, 24]
