"""Normalizers, schema enforcement and CUR ingest."""

import pytest

from costsieve.operators import cur as C
from costsieve.operators import normalize as N
from costsieve.operators.detect import cur_column_mapping, detect_provider, validate_cur_columns

UNDERSCORE = ["line_item_usage_start_date", "product_servicecode", "line_item_resource_id",
              "line_item_usage_amount", "line_item_unblended_cost", "product_region", "line_item_line_item_type"]
SLASH = ["lineItem/UsageStartDate", "product/servicecode", "lineItem/ResourceId", "lineItem/UsageAmount",
         "lineItem/UnblendedCost", "product/region", "lineItem/LineItemType"]
ROWS = [
    ("2024-03-01", "AmazonEC2", "i-1", "2.0", "10.5", "us-east-1", "Usage"),
    ("2024-03-02", "AmazonEC2", "i-1", "2.0", "1.5", "us-east-1", "Tax"),
    ("2024-03-03", "AmazonS3", "b-1", "5.0", "3.0", "us-east-1", None),
    ("not-a-date", "AmazonS3", "b-1", "5.0", "3.0", "us-east-1", "Usage"),
    ("2024-03-04", "AmazonRDS", "db-1", "x", "bad", "us-east-1", "Usage"),
]


def frame(spark, cols, rows=ROWS):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_aws_underscore_drops_tax_keeps_null_type_and_bad_rows(spark):
    out = N.normalize(frame(spark, UNDERSCORE), "aws").orderBy("date").collect()
    assert [(r["service"], r["cost"]) for r in out] == [("AmazonEC2", 10.5), ("AmazonS3", 3.0)]
    assert {r["provider"] for r in out} == {"AWS"}


def test_slash_layout_equals_underscore(spark):
    a = N.normalize(frame(spark, UNDERSCORE), "AWS").drop("line_item_line_item_type")
    b = N.normalize(frame(spark, SLASH), "AWS").drop("line_item_line_item_type")
    assert sorted(map(tuple, a.select("date", "service", "cost").collect())) == \
        sorted(map(tuple, b.select("date", "service", "cost").collect()))


def test_ebs_relabel(spark):
    df = spark.createDataFrame([
        ("2024-03-01", "AmazonEC2", "1.0", "Amazon Elastic Block Store Volume"),
        ("2024-03-01", "Amazon Elastic Block Store", "1.0", None),
        ("2024-03-01", "AmazonEC2", "1.0", None),
    ], "line_item_usage_start_date string, product_servicecode string, line_item_unblended_cost string, "
       "product_product_name string")
    assert sorted(r[0] for r in N.normalize_aws(df).select("service").collect()) == \
        ["AmazonEBS", "AmazonEBS", "AmazonEC2"]


def test_azure_tags_and_candidates(spark):
    df = spark.createDataFrame([
        ("2024-03-01", "Virtual Machines", "12.5", "3", "vm-1", "eastus", "Owner=team-a;Environment=prod"),
        ("2024-03-02", "Storage", "1.0", "1", "st-1", "eastus", ""),
        ("2024-03-03", "Storage", "1.0", "1", "st-2", "eastus", "project=apollo,owner=ops"),
    ], "UsageDate string, ServiceName string, CostInUSD string, Quantity string, ResourceId string, "
       "Region string, Tags string")
    out = {r["resource_id"]: r for r in N.normalize(df, "azure").collect()}
    assert out["vm-1"]["labels_owner"] == "team-a" and out["vm-1"]["labels_environment"] == "prod"
    assert out["st-1"]["labels_owner"] is None
    assert out["st-2"]["labels_project"] == "apollo" and out["st-2"]["labels_owner"] == "ops"
    assert out["vm-1"]["cost"] == 12.5 and out["vm-1"]["provider"] == "AZURE"


def test_gcp_missing_resource_is_unknown(spark):
    df = spark.createDataFrame([
        ("2024-03-01T05:00:00Z", "Compute Engine", 4.0, 1.0, None, "us-central1", "prod"),
    ], "usage_start_time string, service_description string, cost double, usage_amount double, "
       "resource_name string, region string, label_environment string")
    r = N.normalize(df, "GCP").first()
    assert r["resource_id"] == "unknown" and str(r["date"]) == "2024-03-01" and r["provider"] == "GCP"


def test_enforce_schema_adds_optional_columns(spark):
    df = spark.createDataFrame([("2024-03-01", "ec2", "2.5"), ("2024-03-01", None, "1"), ("bad", "ec2", "1")],
                               "date string, service string, cost string")
    out = N.enforce_schema(df)
    assert {"usage", "resource_id", "region"} <= set(out.columns)
    assert [(r["service"], r["cost"]) for r in out.collect()] == [("ec2", 2.5)]


def test_detect_provider_signals(spark):
    mk = lambda cols: spark.createDataFrame([], ", ".join(f"`{c}` string" for c in cols))
    assert detect_provider(mk(["line_item_line_item_type"])) == "AWS"
    assert detect_provider(mk(["lineItem/UsageAccountId"])) == "AWS"
    assert detect_provider(mk(["SubscriptionId", "UsageDate"])) == "AZURE"
    assert detect_provider(mk(["billing_account_id"])) == "GCP"
    assert detect_provider(mk(["x"]), override="gcp") == "GCP"
    for cols in (["line_item_line_item_type", "SubscriptionId"], ["nothing"]):
        with pytest.raises(ValueError):
            detect_provider(mk(cols))


def test_cur_column_mapping_aliases():
    cols = ["product_servicecode", "product_product_name", "pricing_currency", "line_item_unblended_cost"]
    m = cur_column_mapping(cols)
    assert m == {"product_servicecode": "service", "line_item_unblended_cost": "cost", "pricing_currency": "currency"}
    assert validate_cur_columns(cols)[0] and not validate_cur_columns(cols, required=True)[0]
    assert not validate_cur_columns(["foo"])[0]


def test_cur_extract_and_aggregate(spark):
    cols = ["line_item_usage_start_date", "product_servicecode", "line_item_resource_id", "line_item_usage_type",
            "line_item_usage_amount", "line_item_unblended_cost", "product_region", "line_item_line_item_type"]
    rows = [
        ("2024-01-01", "AmazonEC2", " i-1 ", "BoxUsage-m5", "1", "2.5", None, "Usage"),
        ("2024-01-01", "AmazonEC2", "i-1", "BoxUsage-c5", "2", "bad", "us-east-1", "Usage"),
        ("2024-01-01", "AmazonNew", None, None, "x", "1e12", "eu-west-1", "Fee"),
        ("oops", "AmazonS3", "b-1", "Req", "1", "1", "us-east-1", "Usage"),
        ("2024-01-02", "AmazonS3", "b-1", "Req", "1", "1", "us-east-1", "Tax"),
    ]
    raw = spark.createDataFrame([(i,) + r for i, r in enumerate(rows)],
                                "seq long, " + ", ".join(f"{c} string" for c in cols))
    x = {(r["resource_id"], r["usage_type"]): r for r in C.cur_extract(raw).collect()}
    assert set(x) == {("i-1", "BoxUsage"), ("", "Unknown")}
    assert x[("", "Unknown")]["service"] == "AmazonNew" and x[("", "Unknown")]["cost"] == 1e12
    agg = C.cur_ingest(raw).collect()
    ec2 = [r for r in agg if r["service"] == "EC2"][0]
    # null region became "Unknown" during extraction, and seq 0 is the first row
    assert ec2["cost"] == 2.5 and ec2["usage"] == 3.0 and ec2["region"] == "Unknown"
    assert agg[0].__fields__ == ["date", "service", "cost", "usage_type", "resource_id", "usage", "region"]


def test_commitment_detector_prunes_and_pushes_down(spark, tmp_path):
    """On a raw CUR Parquet table the savings-plan detector reads two columns and pushes
    its item-type filter into the scan."""
    from conftest import SF_SMALL

    from costsieve.operators import detectors as E
    from costsieve.sources.tables import cur

    path = str(tmp_path / "cur")
    cur(spark, SF_SMALL).write.parquet(path)
    plan = E.detect_savings_plan(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(line_item_line_item_type" in plan
    assert "ReadSchema: struct<line_item_unblended_cost:double,line_item_line_item_type:string>" in plan
