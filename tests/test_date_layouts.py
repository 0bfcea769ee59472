"""Date layouts that a closed list of shapes would drop with their rows."""

import datetime as dt

import pytest

from costsieve.operators import normalize as N

MARCH = dt.date(2024, 3, 1)


@pytest.mark.parametrize("text,day", [
    ("3/1/2024 12:00:00 AM", MARCH), ("3/1/2024 11:59 pm", MARCH), ("3/1/2024 11:59:00PM", MARCH),
    ("2024-03-01 00:00:00+00", MARCH), ("2024-03-01T23:30:00-08", MARCH), ("2024-03", MARCH), ("2024-3", MARCH),
    ("2024", dt.date(2024, 1, 1)), ("2024-03-01 23:30:00 America/New_York", MARCH), ("2024-03-01T00:30:00+05:30:15", MARCH),
    ("2024-13", None), ("2024-02-30 x", None), ("12:30:00", None), ("2024/03", None), ("not-a-date", None)])
def test_layout(spark, text, day):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(N.parse_date(df, "d")).first()[0] == day


def test_export_with_am_pm_keeps_its_rows(spark):
    rows = [("3/1/2024 12:00:00 AM", "VM", "1.5"), ("3/2/2024 1:00:00 PM", "VM", "2.5")]
    out = N.normalize(spark.createDataFrame(rows, "UsageDate string, ServiceName string, CostInUSD string"), "azure").orderBy("date").collect()
    assert [(r["date"], r["cost"]) for r in out] == [(MARCH, 1.5), (dt.date(2024, 3, 2), 2.5)]


@pytest.mark.parametrize("text", [
    "1 March 2024", "Mar 1 2024", "01-Mar-24", "3/1/24", "3-1-2024", "3.1.2024", "2024.03.01", "20240301T000000Z", "20240301T0000",
    "March 2024", "Mar-2024", "Sept 1, 2024", "1 sep. 2024", "September 1 2024", "03/01/2024 10:15", "1-MAR-2024", "Mar. 1, 2024 11:00 PM"])
def test_more_layouts(spark, text):
    day = dt.date(2024, 9, 1) if "sep" in text.lower() else MARCH
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(N.parse_date(df, "d")).first()[0] == day


@pytest.mark.parametrize("texts,days", [
    (["13/03/2024", "01/03/2024"], [(2024, 3, 13), (2024, 3, 1)]),       # a number above 12 in front: days first
    (["03/13/2024", "03/01/2024"], [(2024, 3, 13), (2024, 3, 1)]),       # above 12 behind: months first
    (["03/01/2024", None, ""], [(2024, 3, 1), None, None]),              # nothing decides: months first
    (["13/03/2024", "03/14/2024", "02/03/2024"], [(2024, 3, 13), (2024, 3, 14), (2024, 2, 3)]),  # both: each as it can, else months first
    (["31.12.69", "01.02.68"], [(1969, 12, 31), (2068, 2, 1)]),
    (["2024-03-01", "25-12-2023", "05-12-2023"], [(2024, 3, 1), (2023, 12, 25), (2023, 12, 5)]),
    (["32/13/2024", "0/1/2024", "1/2-2024", "12/2024", "Smarch 1, 2024", "31 Feb 2024"], [None] * 6)])
def test_the_column_decides_the_order(spark, texts, days):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string").repartition(3)
    found = df.select("i", N.parse_date(df, "d").alias("d")).orderBy("i").collect()
    assert [r.d and (r.d.year, r.d.month, r.d.day) for r in found] == days


def test_kept_and_rejected_are_all_rows(spark):
    rows = [("2024-03-01", "VM", "1", "Usage"), ("soon", "VM", "1", "Usage"), (None, None, "x", "Usage"), ("2024-03-01", "VM", "1", "Tax"),
            ("soon", "VM", None, "Tax"), ("March 2024", "VM", "NaN", None), ("2024-03-01", "VM", "1", None)]
    raw = spark.createDataFrame(rows, "line_item_usage_start_date string, product_servicecode string, line_item_unblended_cost string, line_item_line_item_type string")
    kept, rejected = N.normalize(raw, "AWS"), N.rejected_rows(raw, "aws")
    assert kept.count() == 2 and kept.count() + rejected.count() == len(rows)
    assert sorted(r.reject_reason for r in rejected.collect()) == [
        "cost unreadable: NaN", "date missing; service missing; cost unreadable: x", "date unreadable: soon", "tax line", "tax line"]
    gcp = spark.createDataFrame([("x", "s", "1", "1", None)], "usage_start_time string, service_description string, cost string, usage_amount string, resource_name string")
    assert N.rejected_rows(gcp, "GCP").first().reject_reason == "date unreadable: x" and N.normalize(gcp, "GCP").count() == 0


def test_one_aggregate_decides(spark):
    """A typed column isn't looked at; a text column's vote reads that column alone."""
    typed = spark.range(1).select(N.F.current_date().alias("d"))
    assert N.day_first(typed, "d") is False
