"""Schema detection and validation.

Two forms:
* one-table helpers that look at ``df.columns`` (schema metadata on the driver, never
  rows) — used by the pipeline;
* landing-zone operators over a *header table* (one row per (source, position, column); a
  source is a file), which join a broadcast signal table and aggregate per file, and
  roll-ups of the files to exports. Files of one export that don't agree make it ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: column-name signals ----
PROVIDER_SIGNALS = {
    "AWS": [
        "line_item_usage_account_id", "line_item_line_item_type", "bill_payer_account_id",
        "lineItem/UsageAccountId", "lineItem/LineItemType", "bill/PayerAccountId",
    ],
    "AZURE": ["SubscriptionId", "UsageDate", "MeterName"],
    "GCP": ["billing_account_id", "project_id", "service_description"],
}
# File-kind signals, matched on lower-cased names; >= 2 hits of one provider -> COST_USAGE.
KIND_SIGNALS = {
    "AWS": ["line_item_usage_start_date", "line_item_usage_amount", "line_item_unblended_cost",
            "product_servicecode", "line_item_resource_id"],
    "AZURE": ["usagedate", "consumedquantity", "costinbillingcurrency", "metercategory",
              "resourceid", "subscriptionid"],
    "GCP": ["usage_start_time", "usage.amount", "cost", "service.description", "billing_account_id",
            "project.id"],
}
INVOICE_SIGNALS = ["invoice id", "billing period", "balance due", "invoice amount"]
COST_WORDS = ["cost", "amount", "usage", "quantity"]
CUR_COLUMNS = {
    "line_item_usage_start_date": "date",
    "line_item_product_code": "service_code",
    "product_servicecode": "service",
    "line_item_resource_id": "resource_id",
    "line_item_usage_type": "usage_type",
    "line_item_usage_amount": "usage",
    "line_item_unblended_cost": "cost",
    "product_region": "region",
    "resource_tags_user_owner": "owner_tag",
    "resource_tags_user_environment": "environment_tag",
    "line_item_line_item_type": "item_type",
}
CUR_COLUMN_ALIASES = {
    "bill_billing_period_start_date": "date",
    "product_product_name": "service",
    "line_item_unblended_rate": "unit_cost",
    "pricing_currency": "currency",
}
# ---- end of fixed values ----

PROVIDER_ORDER = ["AWS", "AZURE", "GCP"]


# ================================================================ one-table helpers
def detect_provider(df: DataFrame, override: str | None = None) -> str:
    """B1: override -> first value of a ``provider`` column -> exactly one signal match."""
    if override:
        return override.upper()
    if "provider" in df.columns:
        order = [F.col("seq")] if "seq" in df.columns else []
        first = (df.orderBy(*order) if order else df).select("provider").limit(1).collect()
        if not first or first[0][0] is None:
            raise ValueError("provider column is empty")
        return str(first[0][0]).upper()
    cols = set(df.columns)
    matches = {p: bool(cols & set(sig)) for p, sig in PROVIDER_SIGNALS.items()}
    hit = [p for p in PROVIDER_ORDER if matches[p]]
    if len(hit) != 1:
        raise ValueError(f"Ambiguous or unknown billing format. Signals found: {matches}. "
                         "Specify provider explicitly.")
    return hit[0]


def cur_column_mapping(columns: list[str]) -> dict[str, str]:
    """Raw CUR column -> standard name; an alias only when its target is still free."""
    detected = {c: std for c, std in CUR_COLUMNS.items() if c in columns}
    for alias, std in CUR_COLUMN_ALIASES.items():
        if alias in columns and std not in detected.values():
            detected[alias] = std
    return detected


def validate_cur_columns(columns: list[str], required: bool = False) -> tuple[bool, str]:
    """Strict needs date, service and cost; loose needs cost or usage."""
    found = set(cur_column_mapping(columns).values())
    if required:
        missing = {"date", "service", "cost"} - found
        if missing:
            return False, f"Missing required AWS CUR columns: {sorted(missing)}"
    elif "cost" not in found and "usage" not in found:
        return False, "No cost or usage data found in file"
    return True, f"Valid AWS CUR file with columns: {sorted(found)}"


# ================================================================ landing-zone operators
def _signal_table(spark: SparkSession, table: dict[str, list[str]], kind: str) -> DataFrame:
    rows = [(kind, p, s) for p, sig in table.items() for s in sig]
    return spark.createDataFrame(rows, "kind string, provider string, signal string")


def detect_provider_files(headers: DataFrame) -> DataFrame:
    """B1 per file: flags per provider and the single match (NULL when 0 or >1 match)."""
    spark = headers.sparkSession
    sig = _signal_table(spark, PROVIDER_SIGNALS, "provider")  # constant size
    hits = headers.join(F.broadcast(sig), headers["column"] == sig["signal"], "left")
    flags = hits.groupBy("source").agg(
        *[F.bool_or(F.coalesce(F.col("provider") == p, F.lit(False))).alias(f"is_{p.lower()}")
          for p in PROVIDER_ORDER]
    )
    n = sum(F.col(f"is_{p.lower()}").cast("int") for p in PROVIDER_ORDER)
    which = F.lit(None).cast("string")
    for p in reversed(PROVIDER_ORDER):
        which = F.when(F.col(f"is_{p.lower()}"), F.lit(p)).otherwise(which)
    return flags.select("source", *[f"is_{p.lower()}" for p in PROVIDER_ORDER],
                        F.when(n == 1, which).alias("provider"))


def detect_file_kind(headers: DataFrame) -> DataFrame:
    """B2 per file: COST_USAGE (>= 2 distinct signals of one provider, AWS then Azure then
    GCP), INVOICE (any invoice signal), else UNKNOWN. Names compared lower-cased."""
    spark = headers.sparkSession
    sig = _signal_table(spark, KIND_SIGNALS, "cost").unionByName(
        _signal_table(spark, {"INVOICE": INVOICE_SIGNALS}, "invoice"))
    low = headers.select("source", F.lower("column").alias("lc"))
    hits = low.join(F.broadcast(sig), low["lc"] == sig["signal"], "inner")
    per = hits.groupBy("source", "kind", "provider").agg(F.countDistinct("signal").alias("hits"))
    files = headers.select("source").distinct()
    wide = per.groupBy("source").agg(
        *[F.max(F.when((F.col("kind") == "cost") & (F.col("provider") == p), F.col("hits"))).alias(p)
          for p in PROVIDER_ORDER],
        F.max(F.when(F.col("kind") == "invoice", F.col("hits"))).alias("invoice_hits"),
    )
    j = files.join(wide, "source", "left")
    cost_hit = None
    for p in PROVIDER_ORDER:
        cond = F.coalesce(F.col(p), F.lit(0)) >= 2
        cost_hit = cond if cost_hit is None else (cost_hit | cond)
    kind = F.when(cost_hit, "COST_USAGE").when(F.coalesce(F.col("invoice_hits"), F.lit(0)) > 0, "INVOICE") \
        .otherwise("UNKNOWN")
    return j.select("source", kind.alias("file_kind"))


def validate_billing_files(headers: DataFrame, row_counts: DataFrame) -> DataFrame:
    """B3 per file: has rows and some column name contains cost/amount/usage/quantity."""
    pattern = "|".join(COST_WORDS)
    sig = headers.groupBy("source").agg(
        F.coalesce(F.bool_or(F.lower("column").rlike(pattern)), F.lit(False)).alias("has_cost_signal"))
    if "format" not in row_counts.columns:
        row_counts = row_counts.withColumn("format", F.lit("CSV"))
    kind = F.coalesce(F.col("format"), F.lit("CSV"))
    j = sig.join(row_counts, "source", "left").withColumn("rows", F.coalesce(F.col("rows"), F.lit(0)))
    valid = (F.col("rows") > 0) & F.col("has_cost_signal")
    message = (
        F.when(F.col("rows") <= 0, F.concat(kind, F.lit(" file is empty")))
        .when(~F.col("has_cost_signal"), F.concat(kind, F.lit(" does not contain cost or usage data")))
        .otherwise(F.concat(kind, F.lit(" is valid for analysis")))
    )
    return j.select("source", "rows", "has_cost_signal", valid.alias("is_valid"), message.alias("message"))


def cur_column_map_files(headers: DataFrame) -> DataFrame:
    """B4 per file: (source, raw_column, standard_name); an alias only where no direct
    column of the same file already maps to its target (``left_anti``)."""
    spark = headers.sparkSession
    direct = spark.createDataFrame(list(CUR_COLUMNS.items()), "raw_column string, standard_name string")
    alias = spark.createDataFrame(list(CUR_COLUMN_ALIASES.items()), "raw_column string, standard_name string")
    h = headers.select("source", F.col("column").alias("raw_column"))
    d = h.join(F.broadcast(direct), "raw_column", "inner")
    a = h.join(F.broadcast(alias), "raw_column", "inner")
    a = a.join(d.select("source", "standard_name"), ["source", "standard_name"], "left_anti")
    return d.unionByName(a).select("source", "raw_column", "standard_name")


# ================================================================ files -> exports
def provider_by_export(files: DataFrame, export) -> DataFrame:
    """Providers found in an export's files; the one provider if all files agree."""
    found = F.array_sort(F.collect_set("provider"))  # three values at most
    g = files.groupBy(export.alias("source")).agg(
        *[F.bool_or(f"is_{p.lower()}").alias(f"is_{p.lower()}") for p in PROVIDER_ORDER],
        found.alias("_found"), F.bool_and(F.col("provider").isNotNull()).alias("_all"))
    return g.select("source", *[f"is_{p.lower()}" for p in PROVIDER_ORDER],
                    F.when(F.col("_all") & (F.size("_found") == 1), F.col("_found")[0]).alias("provider"),
                    (F.size("_found") > 1).alias("mixed"))


def kind_by_export(files: DataFrame, export) -> DataFrame:
    """The kinds of an export's files, joined by ``+``."""
    return files.groupBy(export.alias("source")).agg(F.array_join(F.array_sort(F.collect_set("file_kind")), "+").alias("file_kind"))


def validity_by_export(files: DataFrame, export) -> DataFrame:
    """Rows of all files; an export is valid if each of its files is."""
    return files.groupBy(export.alias("source")).agg(
        F.sum("rows").alias("rows"), F.bool_and("has_cost_signal").alias("has_cost_signal"), F.bool_and("is_valid").alias("is_valid"),
        F.min(F.struct("is_valid", "message"))["message"].alias("message"))


def cur_map_by_export(files: DataFrame, export) -> DataFrame:
    return files.select(export.alias("source"), "raw_column", "standard_name").distinct()
