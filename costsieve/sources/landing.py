"""Provider exports as files, and the landing-zone scans that classify them.

``write_export`` writes one provider-shaped CSV export, ``write_accounts`` a landing zone with a
folder for each billing account; which layouts an account's files have follows from its rows.
``file_heads`` gives the column names of every file, CSV or Parquet: Spark lists the files, and
each task opens a group of them and reads a CSV file's first line or a Parquet file's footer.
``file_row_counts`` gives the rows that a reader finds in every file.

CSV fields may hold line breaks in quotes. Such files can't be split, so the reader (and the row
counter alike) looks first: files that fit one split are read whole anyway; where larger ones are
among them, a split scan says whether any line leaves a quote open.
"""

from __future__ import annotations

import csv
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costsieve.operators.normalize import SLASH_TO_UNDERSCORE
from costsieve.session import materialise, scratch_path
from costsieve.sources.tables import billing, cur, read_table

# ---- fixed values: texts that a CSV reader takes for a missing value ----
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# ---- end of fixed values ----

CSV_SUFFIXES, PARQUET_SUFFIXES = (".csv",), (".parquet", ".pqt")
HEAD_BYTES = 1 << 16
FILES_A_TASK = 64


def holds_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether the CSV files at ``path`` have to be read as whole files.

    Without a file larger than a split nothing is lost by that, and no line is looked at. Else a
    line with an odd number of quotes says so; that scan reads in splits.
    """
    n, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    size = int(n) << 10 * " kmgtp".index(unit or " ")
    files = spark.read.format("binaryFile").load(path).select("length")
    if files.where(F.col("length") > size).isEmpty():
        return True
    line = F.col("value")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(path).where(odd).isEmpty()


def _csv_reader(spark: SparkSession, path: str):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", holds_line_breaks(spark, path))


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    """A1: CSV with header, every column read as text (types are applied by ``try_cast``
    in the normalizers), quotes escaped by doubling, line breaks within quotes, null tokens as nulls."""
    raw = _csv_reader(spark, path).option("inferSchema", False).csv(path)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def load_export(spark: SparkSession, path: str) -> DataFrame:
    """A2/A4: a CSV or Parquet export, chosen by suffix; a missing file, another suffix and an
    export without rows are errors."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in CSV_SUFFIXES + PARQUET_SUFFIXES:
        raise ValueError(f"unsupported file type {suffix or path!r}: use .csv, .parquet or .pqt")
    try:
        df = read_csv_export(spark, path) if suffix in CSV_SUFFIXES else spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def azure_export(b: DataFrame) -> DataFrame:
    """Azure Cost Management export layout of the AZURE billing rows."""
    az = b.where(F.col("provider") == "AZURE")
    env = F.when(F.col("cost") > 20, F.lit("prod")).otherwise(F.lit("dev"))
    project = F.when(F.col("region") == "r0", F.lit(",Project=apollo")).otherwise(F.lit(""))
    tags = F.when(F.col("labels_owner").isNotNull(),
                  F.concat(F.lit("Owner="), F.col("labels_owner"), F.lit(";Environment="), env, project))
    return az.select(
        F.col("seq").alias("RecordId"),
        F.date_format("date", "yyyy-MM-dd").alias("UsageDate"),
        F.col("service").alias("ServiceName"), F.col("cost").alias("CostInUSD"), F.col("usage").alias("Quantity"),
        F.col("resource_id").alias("ResourceId"), F.col("region").alias("ResourceLocation"), tags.alias("Tags"),
        F.concat(F.lit("sub-"), (F.col("seq") % 3).cast("string")).alias("SubscriptionId"),
        F.lit("standard").alias("MeterName"),
    )


def azure_ea_export(b: DataFrame) -> DataFrame:
    """Enterprise Agreement layout: other names, dates as month/day/year."""
    az = azure_export(b)
    return az.select(
        "RecordId", F.date_format(F.to_date("UsageDate"), "MM/dd/yyyy").alias("Date"), F.col("ServiceName").alias("MeterCategory"),
        F.col("CostInUSD").alias("CostInBillingCurrency"), "Quantity", F.col("ResourceId").alias("InstanceId"),
        "ResourceLocation", "Tags", "SubscriptionId")


def azure_day_first_export(b: DataFrame) -> DataFrame:
    """The Enterprise Agreement layout of a locale that writes day/month/year."""
    return azure_ea_export(b).withColumn("Date", F.date_format(F.to_date("Date", "MM/dd/yyyy"), "dd/MM/yyyy"))


def azure_mca_export(b: DataFrame) -> DataFrame:
    """Microsoft Customer Agreement layout: names in lower camel case."""
    az = azure_export(b)
    return az.select(
        "RecordId", F.col("UsageDate").alias("date"), F.col("ServiceName").alias("serviceFamily"), F.col("CostInUSD").alias("costInUSD"),
        F.col("Quantity").alias("quantity"), F.col("ResourceId").alias("resourceId"), F.col("ResourceLocation").alias("resourceLocation"),
        F.col("Tags").alias("tags"), F.col("SubscriptionId").alias("SubscriptionId"))


def gcp_export(b: DataFrame) -> DataFrame:
    """GCP billing export (flattened) layout of the GCP billing rows; every tenth row has
    no resource name."""
    g = b.where(F.col("provider") == "GCP")
    return g.select(
        F.col("seq").alias("record_id"),
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("usage_start_time"),
        F.col("service").alias("service_description"), F.col("cost"), F.col("usage").alias("usage_amount"),
        F.when(F.col("seq") % 10 != 0, F.col("resource_id")).alias("resource_name"),
        F.col("region"),
        F.when(F.col("labels_owner").isNotNull(), F.lit("prod")).alias("label_environment"),
        F.lit("ba-0001").alias("billing_account_id"),
        F.concat(F.lit("proj-"), (F.col("seq") % 4).cast("string")).alias("project_id"),
    )


def cur_export(c: DataFrame) -> DataFrame:
    """AWS CUR (underscore layout) with two alias columns: one free target, one taken."""
    return c.drop("seq").withColumn("pricing_currency", F.lit("USD")).withColumn(
        "product_product_name", F.concat(F.lit("Amazon "), F.col("product_servicecode")))


def cur_slash_export(c: DataFrame) -> DataFrame:
    """The same CUR rows in the newer slash layout."""
    back = {v: k for k, v in SLASH_TO_UNDERSCORE.items()}
    return c.drop("seq").withColumnsRenamed({k: v for k, v in back.items() if k in c.columns})


def invoice_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("Invoice ID"),
        F.date_format("o_orderdate", "yyyy-MM").alias("Billing Period"),
        F.col("o_totalprice").alias("Invoice Amount"),
        F.col("o_totalprice").alias("Balance Due"),
    )


def write_export(df: DataFrame, name: str) -> str:
    """Write one export as CSV (with header) into a folder of its own."""
    path = f"{scratch_path(df.sparkSession, 'landing')}/{name}"
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def with_account(b: DataFrame) -> DataFrame:
    """Billing rows by account: the number at the end of the resource id, 24 and above together
    (so that account has rows of all providers)."""
    return b.withColumn("account", F.least(F.regexp_extract("resource_id", r"(\d+)$", 1).cast("int"), F.lit(24)))


def cur_from_billing(b: DataFrame) -> DataFrame:
    aws = b.where(F.col("provider") == "AWS")
    return aws.select(
        "account", F.date_format("date", "yyyy-MM-dd").alias("line_item_usage_start_date"), F.col("service").alias("product_servicecode"),
        F.col("resource_id").alias("line_item_resource_id"), F.lit("BoxUsage").alias("line_item_usage_type"),
        F.col("usage").alias("line_item_usage_amount"), F.col("cost").alias("line_item_unblended_cost"),
        F.col("region").alias("product_region"), F.lit("Usage").alias("line_item_line_item_type"), F.lit("USD").alias("pricing_currency"),
        F.concat(F.lit("Amazon "), F.col("service")).alias("product_product_name"))


def write_accounts(spark: SparkSession, sf_dir: str) -> str:
    """A landing zone ``account=K/part-*``. AWS rows of odd accounts come with slash names, those of
    every fourth account as Parquet; accounts from 100 on hold invoices, from 200 on tables without
    costs."""
    b = with_account(billing(spark, sf_dir))
    aws = cur_from_billing(b)
    by_provider = {"azure": azure_export, "gcp": gcp_export}
    odd = F.col("account") % 2 == 1
    slash = aws.where(odd).withColumnsRenamed({v: k for k, v in SLASH_TO_UNDERSCORE.items() if v in aws.columns})
    keyed = {name: _keep_account(b, f) for name, f in by_provider.items()}
    invoices = invoice_export(spark, sf_dir).withColumn("account", (F.col("`Invoice ID`") % 5 + 100).cast("int"))
    nations = read_table(spark, sf_dir, "nation").withColumn("account", (F.col("n_regionkey") + 200).cast("int"))
    root = scratch_path(spark, "landing")
    fourth = F.col("account") % 4 == 0
    for df in (aws.where(~odd & ~fourth), slash, *keyed.values(), invoices, nations):
        df.write.option("header", True).option("escape", '"').partitionBy("account").mode("append").csv(root)
    aws.where(fourth).write.partitionBy("account").mode("append").parquet(root)
    return root


def _keep_account(b: DataFrame, export) -> DataFrame:
    """An export layout of the rows with their account beside it (by the layout's record id)."""
    out = export(b)
    record = next(c for c in out.columns if c.lower() in ("recordid", "record_id"))
    return out.join(b.select(F.col("seq").alias("_seq"), "account"), F.col(record) == F.col("_seq")).drop("_seq")


def export_name(file: Column) -> Column:
    """Export folder of a landing file; of ``key=value`` folders the value."""
    return F.regexp_extract(file, r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)


# ------------------------------------------------------------------ heads of files
def _csv_head(opened) -> tuple[list[str], int | None]:
    """The names of the first line that isn't blank; a line ends where its quotes are closed."""
    text = b""
    while block := opened.read(HEAD_BYTES):
        text += block
        lines = text.decode("utf-8-sig", "replace").lstrip("\r\n").splitlines(keepends=True)
        for i in range(1, len(lines) + 1):
            head = "".join(lines[:i])
            if head.count('"') % 2 == 0 and head.endswith(("\n", "\r")):
                return next(csv.reader([head]), []), None
    return next(csv.reader([text.decode("utf-8-sig", "replace").lstrip("\r\n")]), []), None


def _parquet_head(opened) -> tuple[list[str], int | None]:
    footer = pq.ParquetFile(opened)
    return footer.schema_arrow.names, footer.metadata.num_rows


def _opened(path: str, content: bytes | None):
    if content is not None:
        return pa.BufferReader(content)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _heads(batches):
    schema = pa.schema([("file", pa.string()), ("format", pa.string()), ("rows", pa.int64()),
                        ("columns", pa.list_(pa.string())), ("error", pa.string())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            names, rows, error = [], None, None
            try:
                with _opened(r["path"], r.get("content")) as opened:
                    names, rows = (_csv_head if r["format"] == "CSV" else _parquet_head)(opened)
            except (pa.ArrowInvalid, csv.Error) as e:  # a file that isn't what its name says; other errors fail the task
                error = str(e).splitlines()[0][:200]
            out.append({"file": r["file"], "format": r["format"], "rows": rows, "columns": names, "error": error})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _tasks_can_open(path: str) -> bool:
    """Whether Python tasks know the path's scheme themselves."""
    try:
        fs.FileSystem.from_uri(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, NotImplementedError):
        return False


def landing_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, format, length) of the CSV and Parquet files under ``path`` (a folder or a pattern);
    Spark lists them, on executors where there are many. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(suffix.isin(*CSV_SUFFIXES), "CSV").when(suffix.isin(*PARQUET_SUFFIXES), "Parquet")
    return found.select(F.col("_metadata.file_path").alias("file"), "path", kind.alias("format"), "length").where("format is not null")


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, rows, columns, error) for every CSV and Parquet file under ``path``.

    Tasks take FILES_A_TASK files each and read only a file's head or footer; rows come from the
    footer (null for CSV). A Parquet file that can't be read has no columns and an ``error``. Stores
    that only Spark can open are read through it, whole files then.
    """
    listed = materialise(landing_files(spark, path), "files")
    n, one = listed.agg(F.count(F.lit(1)), F.min("path")).first()
    given = listed.select("file", "path", "format").repartition(max(1, -(-n // FILES_A_TASK)))
    if one is not None and not _tasks_can_open(one):
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
        given = given.join(whole, "path")
    return materialise(given.mapInArrow(_heads, "file string, format string, rows long, columns array<string>, error string"), "heads")


def headers_of(heads: DataFrame) -> DataFrame:
    """(file, position, column); a file without columns has one row with nulls."""
    return heads.select("file", F.posexplode_outer("columns").alias("position", "column"))


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, column) for every CSV and Parquet file under ``path``."""
    return headers_of(file_heads(spark, path))


def file_row_counts(spark: SparkSession, path: str, heads: DataFrame | None = None) -> DataFrame:
    """(file, rows, format): of Parquet files by their footers, of CSV files the rows that ``read_csv_export``
    finds in each, quoted line breaks and blank lines included in its rules."""
    heads = file_heads(spark, path) if heads is None else heads
    found = heads.where("format = 'Parquet'").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), "format")
    if heads.where("format = 'CSV'").isEmpty():
        return found
    pattern = path if path.lower().endswith(CSV_SUFFIXES) else path.rstrip("/")
    csv_files = _csv_reader(spark, pattern).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]")
    counted = csv_files.schema("first string").csv(pattern).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    return found.unionByName(counted.withColumn("format", F.lit("CSV")))
