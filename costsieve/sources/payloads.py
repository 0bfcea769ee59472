"""Saved cost-API payloads -> unified rows.

The live network clients are not rebuilt; their pages, saved as JSON files, are read by
``spark.read.json`` and flattened with ``explode`` — every page and every group is a row
in Spark, so any number of saved pages is flattened in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# AWS Cost Explorer ``get_cost_and_usage`` page (the parts that are read).
_AMOUNT = T.StructType([T.StructField("Amount", T.StringType()), T.StructField("Unit", T.StringType())])
AWS_PAGE = T.StructType([
    T.StructField("ResultsByTime", T.ArrayType(T.StructType([
        T.StructField("TimePeriod", T.StructType([
            T.StructField("Start", T.StringType()), T.StructField("End", T.StringType())])),
        T.StructField("Groups", T.ArrayType(T.StructType([
            T.StructField("Keys", T.ArrayType(T.StringType())),
            T.StructField("Metrics", T.StructType([
                T.StructField("BlendedCost", _AMOUNT), T.StructField("UsageQuantity", _AMOUNT)])),
        ]))),
    ]))),
    T.StructField("NextPageToken", T.StringType()),
])
# Azure Cost Management ``query.usage`` result: column names + rows of mixed scalars.
AZURE_PAGE = T.StructType([
    T.StructField("columns", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
])


def read_aws_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AWS_PAGE).json(path)


def read_azure_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AZURE_PAGE).json(path)


def flatten_aws_cost_explorer(pages: DataFrame, region: str) -> DataFrame:
    """ResultsByTime[] x Groups[] -> (date, service, cost, usage, provider, resource_id, region).

    Missing usage -> 0; only cost > 0 is kept; resource_id is "" (service-level data).
    """
    periods = pages.select(F.explode("ResultsByTime").alias("r"))
    groups = periods.select(
        F.to_date(F.col("r.TimePeriod.Start")).alias("date"), F.explode("r.Groups").alias("g"))
    cost = F.col("g.Metrics.BlendedCost.Amount").try_cast("double")
    usage = F.coalesce(F.col("g.Metrics.UsageQuantity.Amount").try_cast("double"), F.lit(0.0))
    out = groups.select(
        "date", F.col("g.Keys").getItem(0).alias("service"), cost.alias("cost"), usage.alias("usage"),
        F.lit("AWS").alias("provider"), F.lit("").alias("resource_id"), F.lit(region).alias("region"),
    )
    return out.where(F.col("cost") > 0)


def flatten_azure_query(pages: DataFrame) -> DataFrame:
    """Zip ``columns[].name`` with each row; null cost -> 0; keep cost > 0; only
    8-character yyyyMMdd dates; usage 0.0, region "", resource_id ""."""
    rows = pages.select(F.col("columns.name").alias("names"), F.explode("rows").alias("row"))
    m = F.map_from_arrays(F.col("names"), F.col("row"))
    rows = rows.select(m.alias("m"))
    cost = F.coalesce(F.col("m")["Cost"].try_cast("double"), F.lit(0.0))
    raw_date = F.coalesce(F.col("m")["UsageDate"], F.lit(""))
    # str(row.get("ServiceName", "Unknown")): a present-but-null value prints as "None"
    service = F.when(F.map_contains_key(F.col("m"), F.lit("ServiceName")),
                     F.coalesce(F.col("m")["ServiceName"], F.lit("None"))).otherwise(F.lit("Unknown"))
    out = rows.select(
        F.when(F.length(raw_date) == 8, F.try_to_timestamp(raw_date, F.lit("yyyyMMdd"))).cast("date").alias("date"),
        service.alias("service"), cost.alias("cost"), F.lit(0.0).alias("usage"),
        F.lit("AZURE").alias("provider"), F.lit("").alias("resource_id"), F.lit("").alias("region"),
        F.length(raw_date).alias("_len"),
    )
    return out.where((F.col("cost") > 0) & (F.col("_len") == 8) & F.col("date").isNotNull()).drop("_len")


# ---------------------------------------------------------------- payload pages derived from billing rows
def aws_pages_from_billing(billing: DataFrame) -> DataFrame:
    """Cost Explorer-shaped pages (one per month) of the AWS billing rows, daily by service.

    Every page holds one month of days x services (bounded by the service catalogue).
    S3 groups omit UsageQuantity, exercising the "missing usage -> 0" path.
    """
    aws = billing.where(F.col("provider") == "AWS")
    daily = aws.groupBy("date", "service").agg(F.sum("cost").alias("cost"), F.sum("usage").alias("usage"))
    group = F.struct(
        F.array(F.col("service")).alias("Keys"),
        F.struct(
            F.struct(F.col("cost").cast("string").alias("Amount"), F.lit("USD").alias("Unit")).alias("BlendedCost"),
            F.when(F.col("service") != "AmazonS3",
                   F.struct(F.col("usage").cast("string").alias("Amount"), F.lit("N/A").alias("Unit")))
            .alias("UsageQuantity"),
        ).alias("Metrics"),
    )
    per_day = daily.groupBy("date").agg(F.collect_list(group).alias("Groups")).select(
        F.struct(
            F.struct(F.col("date").cast("string").alias("Start"),
                     F.date_add("date", 1).cast("string").alias("End")).alias("TimePeriod"),
            "Groups",
        ).alias("r"), F.date_trunc("month", "date").alias("month"))
    return per_day.groupBy("month").agg(F.collect_list("r").alias("ResultsByTime")).select(
        "ResultsByTime", F.lit(None).cast("string").alias("NextPageToken"))


def azure_pages_from_billing(billing: DataFrame) -> DataFrame:
    """Azure query-result pages (one per month) of the AZURE billing rows, daily by service.
    "Storage" rows carry an ISO date instead of yyyyMMdd, exercising the date guard."""
    az = billing.where(F.col("provider") == "AZURE")
    daily = az.groupBy("date", "service").agg(F.sum("cost").alias("cost"))
    usage_date = F.when(F.col("service") == "Storage", F.date_format("date", "yyyy-MM-dd")).otherwise(
        F.date_format("date", "yyyyMMdd"))
    row = F.array(F.col("cost").cast("string"), usage_date, F.col("service"), F.lit("USD"))
    cols = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"))
                     for n, t in [("Cost", "Number"), ("UsageDate", "Number"), ("ServiceName", "String"),
                                  ("Currency", "String")]])
    return daily.groupBy(F.date_trunc("month", "date").alias("month")).agg(F.collect_list(row).alias("rows")).select(
        cols.alias("columns"), "rows")
