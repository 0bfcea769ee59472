"""Billing views over the driver's test tables (see FIXTURES.md §2).

``billing`` shapes ``events`` into unified cost-usage rows (three providers, five
service families); ``cur`` shapes ``lineitem`` into raw AWS CUR rows. Both are pure
projections, so Catalyst prunes the Parquet scan to the columns used and pushes any
later filter (e.g. on ``date``) into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _by_provider(provider: Column, aws: str, azure: str, gcp: str) -> Column:
    return F.when(provider == "AWS", aws).when(provider == "AZURE", azure).otherwise(gcp)


def billing_from_events(events: DataFrame) -> DataFrame:
    """Unified cost-usage rows: seq, date, provider, service, cost, usage, resource_id,
    region, labels_owner."""
    e = events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("date").alias("date"),
        "user_id", "value", "event_type",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )
    uid = F.col("user_id")
    e = e.select(
        "*",
        F.when(uid % 3 == 0, "AWS").when(uid % 3 == 1, "AZURE").otherwise("GCP").alias("provider"),
        (uid % 30).alias("rid"),
        F.datediff(F.col("date"), F.lit("2024-01-01").cast("date")).alias("dn"),
    )
    p, et = F.col("provider"), F.col("event_type")
    service = (
        F.when(et == "purchase", _by_provider(p, "AmazonEC2", "Virtual Machines", "Compute Engine"))
        .when(et == "view", _by_provider(p, "AmazonRDS", "SQL Database", "Cloud SQL"))
        .when(et == "click", _by_provider(p, "AmazonEBS", "Managed Disk", "Persistent Disk"))
        .when(et == "signup", _by_provider(p, "AmazonS3", "Storage", "Cloud Storage"))
        .otherwise(_by_provider(p, "EBS Snapshot", "Backup", "Snapshot"))
    )
    rid, dn, k = F.col("rid"), F.col("dn"), F.col("k")
    signup = et == "signup"
    cost = F.when(signup, F.col("value") * (F.lit(1.0) + dn * dn / F.lit(50.0))).otherwise(F.col("value"))
    usage = F.when(signup, k * F.lit(0.05)).otherwise(k * F.lit(0.2))
    res_kind = F.when((et == "error") & (rid % 2 == 0), F.lit("purchase")).otherwise(et)
    resource_id = F.concat(res_kind, F.lit("-"), rid.cast("string"))
    region = F.when(et == "purchase", F.concat(F.lit("r"), (rid % 4).cast("string"))).otherwise(
        F.concat(F.lit("r"), (rid % 5).cast("string")))
    owned = (p == "AZURE") | ((rid % 5 == 0) & ~((p == "GCP") & (et == "view")))
    owner = F.when(owned, F.concat(F.lit("team-"), (rid % 3).cast("string")))
    return e.select(
        "seq", "date", "provider", service.alias("service"), cost.alias("cost"),
        usage.alias("usage"), resource_id.alias("resource_id"), region.alias("region"),
        owner.alias("labels_owner"),
    )


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_from_events(read_table(spark, sf_dir, "events"))


def cur_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Raw AWS CUR rows (underscore layout). ``seq`` = (orderkey, linenumber) order."""
    supp, line, flag = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_returnflag")
    service = (
        F.when(supp % 4 == 0, "AmazonEC2").when(supp % 4 == 1, "AmazonRDS")
        .when(supp % 4 == 2, "AmazonS3").otherwise("AWSLambda")
    )
    item_type = (
        F.when((line == 1) & (flag == "A"), "SavingsPlanRecurringFee")
        .when((line == 2) & (flag == "R"), "SavingsPlanNegation")
        .when((line == 3) & (flag == "N"), "Tax")
        .otherwise("Usage")
    )
    return lineitem.select(
        (F.col("l_orderkey") * 100 + line).alias("seq"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("line_item_usage_start_date"),
        service.alias("product_servicecode"),
        F.concat(F.lit("i-"), F.col("l_partkey").cast("string")).alias("line_item_resource_id"),
        F.concat(F.lit("BoxUsage-"), line.cast("string")).alias("line_item_usage_type"),
        F.col("l_quantity").alias("line_item_usage_amount"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("line_item_unblended_cost"),
        F.concat(F.lit("r"), (supp % 5).cast("string")).alias("product_region"),
        item_type.alias("line_item_line_item_type"),
        F.when(line == 4, F.col("l_quantity")).otherwise(F.lit(0.0)).alias("reservation_unused_quantity"),
        (F.col("l_tax") * F.lit(100.0)).alias("reservation_unused_recurring_fee"),
    )


def cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cur_from_lineitem(read_table(spark, sf_dir, "lineitem"))
