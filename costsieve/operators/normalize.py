"""Normalization of provider exports into the unified cost-usage table.

Every step is a projection or a filter: renames, ``try_cast`` coercions, regex tag
extraction, ``when`` relabels. Bad numbers and dates become NULL (ANSI mode would
raise on a plain cast) and rows missing date, service or cost are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costsieve import schema as S
from costsieve.functions import nan_to_null

# ---- fixed values: column names of the provider export layouts ----
SLASH_TO_UNDERSCORE = {
    "lineItem/UnblendedCost": "line_item_unblended_cost",
    "lineItem/UsageStartDate": "line_item_usage_start_date",
    "lineItem/ResourceId": "line_item_resource_id",
    "lineItem/UsageAmount": "line_item_usage_amount",
    "lineItem/LineItemType": "line_item_line_item_type",
    "lineItem/UsageAccountId": "line_item_usage_account_id",
    "product/servicecode": "product_servicecode",
    "product/region": "product_region",
    "product/ProductName": "product_product_name",
    "reservation/UnusedQuantity": "reservation_unused_quantity",
    "reservation/UnusedRecurringFee": "reservation_unused_recurring_fee",
}
CUR_TO_UNIFIED = {
    "line_item_usage_start_date": "date",
    "product_servicecode": "service",
    "line_item_resource_id": "resource_id",
    "line_item_usage_amount": "usage",
    "line_item_unblended_cost": "cost",
    "product_region": "region",
}
EBS_SERVICE_NAME = "Amazon Elastic Block Store"
EBS_PRODUCT_MARK = "Elastic Block Store"
EBS_LABEL = "AmazonEBS"
AZURE_CANDIDATES = {
    "date": ["UsageDate", "Date", "BillingPeriodStartDate", "date", "billingPeriodStartDate"],
    "service": ["ServiceName", "MeterCategory", "ConsumedService", "serviceFamily", "serviceName"],
    "cost": ["CostInUSD", "Cost", "PreTaxCost", "CostInBillingCurrency", "costInUSD", "cost"],
    "usage": ["Usage", "Quantity", "UsageQuantity", "quantity", "usageQuantity"],
    "resource_id": ["ResourceId", "InstanceId", "ResourceName", "resourceId", "instanceId", "resourceName"],
    "region": ["Region", "ResourceLocation", "resourceLocation", "region", "ResourceRegion"],
    "tags": ["Tags", "tags", "TagsDictionary"],
}
AZURE_TAG_PATTERNS = {
    "labels_project": r"[Pp]roject=([^;,]+)",
    "labels_owner": r"[Oo]wner=([^;,]+)",
    "labels_environment": r"[Ee]nvironment=([^;,]+)",
}
# Texts of dates: a time of day and an offset may follow; months by name; two-digit years from 69 on are 19xx.
_TIME = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?[AaPp][Mm])?(?: ?(?:Z|UTC|[+-]\d{2}(?::?\d{2})?))?)?$"
_MONTH = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
          r"oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?")
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ISO_SHAPE = r"^(\d{4}-\d{1,2}-\d{1,2})" + _TIME
NUMBERS_SHAPE = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _TIME  # month and day in either order
# shape, and the numbers of its groups that hold year, month and day (0: the first day)
DATE_SHAPES = [
    (r"^(\d{4})([/.])(\d{1,2})\2(\d{1,2})" + _TIME, (1, 3, 4)),
    (r"^(\d{4})(\d{2})(\d{2})(?:T\d{4}(?:\d{2})?Z?)?$", (1, 2, 3)),
    (r"^(\d{4})-(\d{1,2})$", (1, 2, 0)),
    (r"(?i)^(\d{1,2})[- ]" + _MONTH + r"(?:[- ]|, ?)(\d{4}|\d{2})" + _TIME, (3, 2, 1)),
    (r"(?i)^" + _MONTH + r"[- ](\d{1,2})(?:, ?| )(\d{4})" + _TIME, (3, 1, 2)),
    (r"(?i)^" + _MONTH + r"(?:[- ]|, ?)(\d{4})$", (2, 1, 0)),
]
# ---- end of fixed values ----


def _q(name: str) -> Column:
    """Column by exact name, safe for dots and slashes."""
    return F.col(f"`{name}`")


def _is_text(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _is_plain(s: Column) -> Column:
    """yyyy-MM-dd: read by one cast, and kept out of the dearer shapes."""
    return (F.length(s) == 10) & (F.substring(s, 5, 1) == "-") & (F.substring(s, 8, 1) == "-") & F.substring(s, 10, 1).between("0", "9")


def day_first(df: DataFrame, name: str) -> bool:
    """Whether the column writes days before months, by a vote of all its texts like 13/03/2024.

    One aggregate over the column: the layout that fits all such texts is taken. Where both do (no
    number above 12) or neither does, months come first, and only texts that fit the other order alone
    are read by that.
    """
    if not _is_text(df, name):
        return False
    s = F.trim(_q(name).cast("string"))
    s = F.when(~_is_plain(s), s)
    first, second = (F.regexp_extract(s, NUMBERS_SHAPE, k).try_cast("int") for k in (1, 3))
    most = df.agg(F.max(first).alias("a"), F.max(second).alias("b")).first()
    return (most.a or 0) > 12 >= (most.b or 0)


def _year_month_day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none such."""
    named = F.when(
        month.rlike("^[A-Za-z]"), (F.instr(F.lit(MONTHS), F.lower(F.substring(month, 1, 3))) + 2) / 3).otherwise(month.try_cast("int"))
    y = F.when(F.length(year) == 2, year.try_cast("int") + F.when(year >= "69", 1900).otherwise(2000)).otherwise(year.try_cast("int"))
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(named.cast("int").cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def parse_date(df: DataFrame, name: str, days_first: bool | None = None) -> Column:
    """Any date-like column -> DATE; unparseable text -> NULL (per row).

    A text's shape chooses its one layout, and the column's vote (``day_first``, run here unless
    ``days_first`` is given) the order of days and months. The date is taken from the text itself,
    so a stamp with an offset keeps its own calendar day whatever the session's time zone.
    """
    c = _q(name)
    if not _is_text(df, name):
        return c.cast("date")
    days_first = day_first(df, name) if days_first is None else days_first
    s = F.trim(c.cast("string"))

    # the rare layouts stay out of the generated code of the row loop, which would grow too long to compile
    def other(x: Column) -> Column:
        a, b, year = (F.regexp_extract(x, NUMBERS_SHAPE, k) for k in (1, 3, 4))
        orders = [_year_month_day(year, a, b), _year_month_day(year, b, a)]
        parsed = F.when(x.rlike(NUMBERS_SHAPE), F.coalesce(*(reversed(orders) if days_first else orders)))
        for shape, places in DATE_SHAPES:
            y, m, d = (F.regexp_extract(x, shape, k) if k else F.lit("1") for k in places)
            parsed = parsed.when(x.rlike(shape), _year_month_day(y, m, d))
        stamp = F.try_to_timestamp(x)
        day = F.coalesce(F.regexp_extract(x, r"^\d{4}-\d{1,2}-\d{1,2}", 0).try_cast("date"), stamp.cast("date"))
        return parsed.when(x.rlike(r"^\d{4}(?:-|$)") & stamp.isNotNull(), day)

    return F.when(_is_plain(s), s.try_cast("date")).when(
        s.rlike(ISO_SHAPE), F.regexp_extract(s, ISO_SHAPE, 1).try_cast("date")).otherwise(F.get(F.transform(F.array(s), other), F.lit(0)))


def exact_names(df: DataFrame, prefer: list[str] | None = None) -> DataFrame:
    """Names that differ only by case made distinct, so that each can be selected: the one that
    comes first in ``prefer`` (else in the table) keeps its name, the others get a suffix."""
    order = {c: i for i, c in enumerate(prefer or [])}
    by_lower: dict[str, list[int]] = {}
    for i, c in enumerate(df.columns):
        by_lower.setdefault(c.lower(), []).append(i)
    if len(by_lower) == len(df.columns):
        return df
    names = list(df.columns)
    for places in by_lower.values():
        ranked = sorted(places, key=lambda i: (order.get(df.columns[i], len(order)), i))
        for k, i in enumerate(ranked[1:], 1):
            names[i] = f"{names[i]}__{k}"
    return df.toDF(*names)


def to_double(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    c = _q(name)
    if isinstance(dtype, T.NumericType):
        return nan_to_null(c.cast("double")) if not isinstance(dtype, (T.DoubleType, T.FloatType)) else \
            F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


# ---------------------------------------------------------------- C6
REJECTED = "_rejected"


def coerce_schema(df: DataFrame) -> DataFrame:
    """Cost/usage as double and date as DATE (bad -> NULL), missing optional columns as NULL, and in
    ``_rejected`` why C6 drops a row (null: it is kept): the required fields that are missing or
    unreadable, with their texts. Other columns ride along."""
    cols, why = [], []
    for name in df.columns:
        if name in ("cost", "usage", "date"):
            value = parse_date(df, name) if name == "date" else to_double(df, name)
            cols.append(value.alias(name))
        else:
            cols.append(_q(name))
        if name in S.REQUIRED_COLUMNS:
            value = cols[-1] if name in ("cost", "date") else _q(name)
            text = _q(name).cast("string")
            why.append(F.when(value.isNull(), F.when(text.isNull(), F.lit(f"{name} missing")).otherwise(F.concat(F.lit(f"{name} unreadable: "), text))))
    out = df.select(*cols, F.nullif(F.concat_ws("; ", *why), F.lit("")).alias(REJECTED))
    for opt, typ in (("usage", "double"), ("resource_id", "string"), ("region", "string")):
        if opt not in out.columns:
            out = out.withColumn(opt, F.lit(None).cast(typ))
    return out


def enforce_schema(df: DataFrame) -> DataFrame:
    """The rows of ``coerce_schema`` that have a date, a service and a cost."""
    return coerce_schema(df).drop(REJECTED).na.drop(subset=S.REQUIRED_COLUMNS)


def rejected_rows(raw: DataFrame, provider: str) -> DataFrame:
    """What ``normalize`` drops of a raw export: its rows with the column ``reject_reason``.

    A row is either here or in the normalized table, so both together are as many as the raw rows.
    """
    p = provider.upper()
    prepared = _PREPARE[p](raw)
    unread = coerce_schema(prepared).where(F.col(REJECTED).isNotNull()).withColumnRenamed(REJECTED, "reject_reason")
    if p != "AWS" or TAX_COLUMN not in rename_slash_columns(exact_names(raw, [*SLASH_TO_UNDERSCORE, *CUR_TO_UNIFIED])).columns:
        return unread
    tax = coerce_schema(_prepare_aws(raw, tax=True)).drop(REJECTED).withColumn("reject_reason", F.lit("tax line"))
    return unread.unionByName(tax)


# ---------------------------------------------------------------- C1..C5
def rename_slash_columns(df: DataFrame) -> DataFrame:
    """Slash-format CUR names -> underscore names, only when lineItem/UnblendedCost is there."""
    if "lineItem/UnblendedCost" not in df.columns:
        return df
    present = {k: v for k, v in SLASH_TO_UNDERSCORE.items() if k in df.columns}
    return df.withColumnsRenamed(present)


TAX_COLUMN = "line_item_line_item_type"


def drop_tax_rows(df: DataFrame) -> DataFrame:
    """Drop item type "Tax"; NULL item types are kept (a plain != would drop them)."""
    if TAX_COLUMN not in df.columns:
        return df
    return df.where(~F.col(TAX_COLUMN).eqNullSafe("Tax"))


def relabel_ebs(df: DataFrame) -> DataFrame:
    """C4: EBS service label: exact service name, or product name containing the EBS mark."""
    if "service" not in df.columns:
        return df
    svc = F.when(F.col("service") == EBS_SERVICE_NAME, F.lit(EBS_LABEL)).otherwise(F.col("service"))
    if "product_product_name" in df.columns:
        svc = F.when(F.coalesce(F.col("product_product_name").contains(EBS_PRODUCT_MARK), F.lit(False)),
                     F.lit(EBS_LABEL)).otherwise(svc)
    return df.withColumn("service", svc)


def _prepare_aws(df: DataFrame, tax: bool = False) -> DataFrame:
    """Everything of ``normalize_aws`` before C6; ``tax``: of the rows that C2 drops instead."""
    df = rename_slash_columns(exact_names(df, [*SLASH_TO_UNDERSCORE, *CUR_TO_UNIFIED]))
    df = df.where(F.col(TAX_COLUMN) == "Tax") if tax else drop_tax_rows(df)
    present = {k: v for k, v in CUR_TO_UNIFIED.items() if k in df.columns}
    taken = {v.lower() for v in present.values()} | {"provider"}
    df = df.select(*[_q(c) for c in df.columns if c in present or c.lower() not in taken]).withColumnsRenamed(present)
    return relabel_ebs(df).withColumn("provider", F.lit("AWS"))


def normalize_aws(df: DataFrame) -> DataFrame:
    """AWS CUR (underscore or slash layout) -> unified rows, provider AWS. A column that
    already has a unified name gives way to the CUR column mapped to it."""
    return enforce_schema(_prepare_aws(df))


# ---------------------------------------------------------------- C7..C9
def pick(df: DataFrame, candidates: list[str]) -> Column:
    """The first candidate that exists as a column (exact case), else NULL."""
    for c in candidates:
        if c in df.columns:
            return _q(c)
    return F.lit(None)


def azure_tags(tags: Column) -> list[Column]:
    """Project / owner / environment from a Tags text; no match -> NULL."""
    t = F.coalesce(tags.cast("string"), F.lit(""))
    return [F.nullif(F.regexp_extract(t, pat, 1), F.lit("")).alias(name) for name, pat in AZURE_TAG_PATTERNS.items()]


def _row_order(df: DataFrame) -> list[Column]:
    """The rows' order key, if they have one."""
    return [_q("seq")] if "seq" in df.columns else []


def _prepare_azure(df: DataFrame) -> DataFrame:
    df = exact_names(df, [c for names in AZURE_CANDIDATES.values() for c in names])
    tmp = df.select(
        pick(df, AZURE_CANDIDATES["date"]).alias("date"),
        pick(df, AZURE_CANDIDATES["service"]).cast("string").alias("service"),
        pick(df, AZURE_CANDIDATES["cost"]).alias("cost"),
        pick(df, AZURE_CANDIDATES["usage"]).alias("usage"),
        F.lit("Azure").alias("provider"),
        pick(df, AZURE_CANDIDATES["resource_id"]).cast("string").alias("resource_id"),
        pick(df, AZURE_CANDIDATES["region"]).cast("string").alias("region"),
        *azure_tags(pick(df, AZURE_CANDIDATES["tags"])),
        *_row_order(df),
    )
    return tmp


def normalize_azure(df: DataFrame) -> DataFrame:
    """Azure Cost Management / EA / MCA exports -> unified rows (provider "Azure",
    stamped upper-case by the pipeline)."""
    return enforce_schema(_prepare_azure(df))


# ---------------------------------------------------------------- C10
def _prepare_gcp(df: DataFrame) -> DataFrame:
    df = exact_names(df, ["usage_start_time", "service_description", "cost", "usage_amount", "resource_name", "region"])
    for need in ("usage_start_time", "service_description", "cost", "usage_amount", "resource_name"):
        if need not in df.columns:
            raise ValueError(f"GCP export lacks column {need!r}")
    tmp = df.select(
        F.col("usage_start_time").alias("date"),
        F.col("service_description").cast("string").alias("service"),
        F.col("cost").alias("cost"),
        F.col("usage_amount").alias("usage"),
        F.coalesce(F.col("resource_name").cast("string"), F.lit("unknown")).alias("resource_id"),
        (F.col("region").cast("string") if "region" in df.columns else F.lit(None).cast("string")).alias("region"),
        (F.col("label_environment").cast("string") if "label_environment" in df.columns
         else F.lit(None).cast("string")).alias("labels_environment"),
        F.lit("GCP").alias("provider"),
        *_row_order(df),
    )
    return tmp


def normalize_gcp(df: DataFrame) -> DataFrame:
    """GCP billing export (flattened) -> unified rows; missing resource_name -> "unknown"."""
    return enforce_schema(_prepare_gcp(df))


_PREPARE = {"AWS": _prepare_aws, "AZURE": _prepare_azure, "GCP": _prepare_gcp}


# ---------------------------------------------------------------- C11, C12
def stamp_provider(df: DataFrame, provider: str) -> DataFrame:
    return df.withColumn("provider", F.lit(provider.upper()))


def normalize(df: DataFrame, provider: str, keep_rejected: bool = False) -> DataFrame:
    """Dispatch on the detected provider, then stamp it upper-case on every row.

    ``keep_rejected``: rows that C6 drops stay, with nothing but nulls and the provider, for the one
    pass that also counts what it reads.
    """
    p = provider.upper()
    if p not in _PREPARE:
        raise ValueError(f"Unsupported provider: {p}")
    if not keep_rejected:
        return stamp_provider(enforce_schema(_PREPARE[p](df)), p)
    full = coerce_schema(_PREPARE[p](df))
    kept = F.col(REJECTED).isNull()
    return stamp_provider(full.select(*[F.when(kept, _q(c)).alias(c) for c in full.columns if c != REJECTED]), p)
