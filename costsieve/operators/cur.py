"""AWS Cost & Usage Report ingest (C13–C16): extract, clean, aggregate, profile.

The raw -> standard column map is applied raw name -> standard name (the reference
inverts it by mistake, which would leave the frame unrenamed).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costsieve.functions import np_round
from costsieve.operators.detect import cur_column_mapping, validate_cur_columns
from costsieve.operators.firsts import code_of, first_key, value_codes
from costsieve.operators.normalize import parse_date

# ---- fixed values: CUR service codes -> display names ----
SERVICE_CODE_MAPPING = {
    "AmazonEC2": "EC2",
    "AmazonRDS": "RDS",
    "AmazonS3": "S3",
    "AWSLambda": "Lambda",
    "AmazonDynamoDB": "DynamoDB",
    "AmazonElastiCache": "ElastiCache",
    "AmazonESG": "Elasticsearch",
    "AmazonCloudFront": "CloudFront",
    "AmazonSNS": "SNS",
    "AmazonSQS": "SQS",
    "AWSKms": "KMS",
    "AmazonVPC": "VPC",
    "AWSCloudTrail": "CloudTrail",
}
KEPT_ITEM_TYPES = ["Usage", "DiscountedUsage", "Fee"]
DEFAULT_GROUP_BY = ["date", "service", "resource_id", "usage_type"]
INGEST_COLUMNS = ["date", "service", "cost", "usage_type", "resource_id", "usage", "region",
                  "owner_tag", "environment_tag"]
# ---- end of fixed values ----


def _code_map():
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(SERVICE_CODE_MAPPING.items())])


def _strip(c):
    """Python ``str.strip()`` for ASCII whitespace (space, tab, newlines, VT, FF)."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def cur_extract(df: DataFrame, column_mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename detected CUR columns, parse/clean, keep Usage / DiscountedUsage / Fee rows."""
    mapping = column_mapping if column_mapping is not None else cur_column_mapping(df.columns)
    if not mapping:
        raise ValueError("No AWS CUR columns detected in DataFrame")
    out = df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
    cols = out.columns
    if "date" in cols:
        out = out.withColumn("date", parse_date(out, "date")).where(F.col("date").isNotNull())
    if "service" in cols:
        s = F.coalesce(F.col("service").cast("string"), F.lit("Unknown"))
        out = out.withColumn("service", F.coalesce(_code_map()[_strip(s)], s))
    for c in ("cost", "usage"):
        if c in cols:
            out = out.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
            out = out.withColumn(c, F.when(F.isnan(c), F.lit(0.0)).otherwise(F.col(c)))
    if "usage_type" in cols:
        ut = F.coalesce(F.col("usage_type").cast("string"), F.lit("Unknown"))
        out = out.withColumn("usage_type", F.split(ut, "-").getItem(0))
    if "resource_id" in cols:
        out = out.withColumn("resource_id", _strip(F.coalesce(F.col("resource_id").cast("string"), F.lit(""))))
    if "region" in cols:
        out = out.withColumn("region", F.coalesce(F.col("region").cast("string"), F.lit("Unknown")))
    if "item_type" in cols:
        out = out.where(F.col("item_type").isin(*KEPT_ITEM_TYPES))
    return out


def cur_aggregate(df: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """C14: sum cost/usage, first non-null region/tags per (date, service, resource_id,
    usage_type) — the ones present, nulls kept as their own group; rounded to 6 places.

    The region and tags are looked up in dictionaries of their distinct values, and the first one of
    a key is the least (``seq``, code) in one decimal (``operators.firsts``): all buffers are
    fixed-width, so the rows meet one hash aggregate and are shuffled once, combined. Without ``seq``
    the smallest value is taken, the same every run.
    """
    keys = [c for c in (group_by or DEFAULT_GROUP_BY) if c in df.columns]
    sums = [c for c in ("cost", "usage") if c in df.columns]
    firsts = [c for c in ("region", "owner_tag", "environment_tag") if c in df.columns]
    if not keys or not (sums or firsts):
        return df
    seq = F.col("seq") if "seq" in df.columns else F.lit(0)
    coded, codes = df, {}
    for c in firsts:
        codes[c] = value_codes(df.where(F.col(c).isNotNull()), [c], f"__{c}")
        coded = coded.join(codes[c], c, "left")
    out = coded.groupBy(*keys).agg(*[np_round(F.sum(c), 6).alias(c) for c in sums],
                                   *[F.min(first_key(seq, F.col(f"__{c}"))).alias(f"__first_{c}") for c in firsts])
    for c in firsts:
        out = out.withColumn(f"__{c}", code_of(F.col(f"__first_{c}"))).join(codes[c], f"__{c}", "left")
    return out.select(*keys, *sums, *firsts)


def cur_ingest(raw: DataFrame, aggregate: bool = True, sample_rows: int | None = None) -> DataFrame:
    """A3 sample -> B5 validation -> C13 -> C14 -> fixed projection."""
    if sample_rows:
        raw = first_rows(raw, int(sample_rows))
    ok, message = validate_cur_columns(raw.columns)
    if not ok:
        raise ValueError(f"Validation failed: {message}")
    out = cur_extract(raw)
    if aggregate:
        out = cur_aggregate(out)
    return out.select(*[c for c in INGEST_COLUMNS if c in out.columns])


def first_rows(raw: DataFrame, n: int) -> DataFrame:
    """A3: the first n rows in ``seq`` order, ties broken by the row values (a total order,
    so the sample is the same on every run); a top-n, not a full sort."""
    order = (["seq"] if "seq" in raw.columns else []) + [c for c in raw.columns if c != "seq"]
    return raw.orderBy(*[F.col(f"`{c}`") for c in order]).limit(n)


def cur_stats(df: DataFrame) -> DataFrame:
    """Rows, total cost, distinct services / resources, date range, column list (one row).

    By resource first: a hash aggregate that also notes each resource's services, then one row of
    all. So no row is copied for a distinct count; the services that meet in the end are few.
    """
    cols = df.columns
    null = F.lit(None).cast("string")
    given = df.select(
        *[(F.col(c) if c in cols else null).alias(c) for c in ("resource_id", "service", "date")],
        (F.col("cost") if "cost" in cols else F.lit(0.0)).alias("cost"))
    by_resource = given.groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("cost").alias("cost"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.collect_set("service").alias("services"))
    services = F.size(F.array_distinct(F.flatten(F.collect_set("services"))))
    return by_resource.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        (F.sum("cost") if "cost" in cols else F.lit(0)).alias("total_cost"),
        services.cast("long" if "service" in cols else "int").alias("unique_services"),
        F.count("resource_id").cast("long" if "resource_id" in cols else "int").alias("unique_resources"),
        F.min("first").cast("string").alias("date_start"), F.max("last").cast("string").alias("date_end"),
    ).withColumn("columns_available", F.lit(",".join(cols)))
