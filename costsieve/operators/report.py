"""Report tables and sinks.

Reports are DataFrames written by Spark writers; the Markdown rendering of the
reference is not rebuilt (its tables are ``report_table`` / ``high_findings`` /
``forecast_top``). Reports and the leak ids for run-to-run delta tagging lie in folders of
their run under a path the caller names; a marker that is written last says that a run is whole.
"""

from __future__ import annotations

from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from costsieve import schema as S
from costsieve.functions import money, nan_to_null
from costsieve.operators.ranking import global_positions
from costsieve.operators.scoring import _map_expr

# ---- fixed values: report texts ----
HEALTHY_INSIGHT = "✅ No cost leaks detected. Your cloud usage looks healthy."
RESOURCE_CUT = 30
HIGH_FINDINGS = 15
FORECAST_ROWS_REPORT = 10
FORECAST_ALERT_PCT = 15
# ---- end of fixed values ----


def _none_text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


# ---------------------------------------------------------------- H1 / A7
def leak_id() -> "F.Column":
    """``type::provider::service::resource`` with Python's "None" for missing parts."""
    return F.concat_ws("::", *[_none_text(c) for c in ("leak_type", "provider", "service", "resource_id")])


def new_run_id() -> str:
    """A run id of the present time; ids are compared as texts."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")


def _run_folder(path: str, kind: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/{kind}/{quote(run_id, safe='')}"


def _mark_run(spark: SparkSession, path: str, run_id: str, complete: bool) -> None:
    """Say whether a run's tables under ``path`` are whole. It is the last thing that a run writes."""
    spark.createDataFrame([(run_id, complete)], "run string, complete boolean").coalesce(1).write.mode("overwrite").parquet(
        _run_folder(path, "complete", run_id))


def last_complete_run(spark: SparkSession, path: str, before: str | None = None) -> str | None:
    """The last run whose tables are whole, of those before ``before`` if that is given."""
    try:
        runs = spark.read.schema("run string, complete boolean").option("recursiveFileLookup", True).parquet(f"{path.rstrip('/')}/complete")
    except AnalysisException:  # no folder: no run yet
        return None
    runs = runs.where("complete")
    return (runs if before is None else runs.where(F.col("run") < before)).agg(F.max("run")).first()[0]


def load_previous_ids(spark: SparkSession, path: str | None, run_id: str | None = None) -> DataFrame:
    """The leak ids of the last complete run before ``run_id`` (else of the last one at all); an
    empty set where there is none. A run that is repeated under its id sees what it saw at first."""
    run = last_complete_run(spark, path, run_id) if path else None
    if run is None:
        return spark.createDataFrame([], "leak_id string")
    return spark.read.schema("leak_id string").parquet(_run_folder(path, "ids", run))


def save_current_ids(leaks: DataFrame, path: str, run_id: str | None = None) -> str:
    """Write this run's ids as its snapshot in a folder of the run; the run's id is returned.

    A repeated run replaces its own snapshot only, which counts for nobody until it is whole again.
    """
    spark, run_id = leaks.sparkSession, run_id or new_run_id()
    _mark_run(spark, path, run_id, False)
    leaks.select(leak_id().alias("leak_id")).distinct().write.mode("overwrite").parquet(_run_folder(path, "ids", run_id))
    _mark_run(spark, path, run_id, True)
    return run_id


def apply_delta(leaks: DataFrame, previous_ids: DataFrame) -> DataFrame:
    """H1: status EXISTING when the leak id was in the previous run, else NEW."""
    prev = previous_ids.select(F.col("leak_id").alias("_prev_id")).distinct()
    tagged = leaks.withColumn("leak_id", leak_id())
    tagged = tagged.join(prev, tagged["leak_id"] == prev["_prev_id"], "left")
    return tagged.withColumn("status", F.when(F.col("_prev_id").isNotNull(), "EXISTING").otherwise("NEW")).drop(
        "_prev_id")


# ---------------------------------------------------------------- A5
def report_summary(tagged: DataFrame) -> DataFrame:
    """A5 summary block: totals, new count, counts per severity, monthly / annual waste."""
    sev = F.col("severity")
    total = F.coalesce(F.sum("estimated_monthly_waste"), F.lit(0.0))
    return tagged.agg(
        F.count(F.lit(1)).alias("total_leaks"),
        F.count_if(F.col("status") == "NEW").alias("new_leaks"),
        F.count_if(sev == "HIGH").alias("high"),
        F.count_if(sev == "MEDIUM").alias("medium"),
        F.count_if(sev == "LOW").alias("low"),
        money(total).alias("estimated_total_monthly_waste_usd"),
        money(total * 12).alias("estimated_total_annual_waste_usd"),
    )


def read_json_report(spark: SparkSession, path: str, sections: dict[str, T.StructType], run_id: str | None = None) -> dict[str, DataFrame]:
    """The sections of the last whole JSON report (or of the run's), read back with their schemas."""
    run = run_id or last_complete_run(spark, path)
    if run is None:
        raise FileNotFoundError(f"no report in {path}")
    return {name: spark.read.schema(schema).json(f"{_run_folder(path, 'runs', run)}/{name}") for name, schema in sections.items()}


def write_json_report(path: str, summary: DataFrame, leaks: DataFrame, forecasts: DataFrame | None,
                      stats: DataFrame, run_id: str | None = None) -> str:
    """A5 sink: one JSON folder per section (NaN/Inf -> null, dates ISO), under a folder of the run.

    The report is published by a last small marker, so readers see all sections of one run, and a
    run that fails leaves the report before it whole. The run's id is returned.
    """
    sections = {"summary": summary, "leaks": leaks, "pipeline_stats": stats}
    if forecasts is not None:
        sections["forecasts"] = forecasts
    spark, run_id = summary.sparkSession, run_id or new_run_id()
    _mark_run(spark, path, run_id, False)
    for name, df in sections.items():
        sanitize_frame(df).write.mode("overwrite").json(f"{_run_folder(path, 'runs', run_id)}/{name}")
    _mark_run(spark, path, run_id, True)
    return run_id


# ---------------------------------------------------------------- A10
def sanitize_frame(df: DataFrame) -> DataFrame:
    """A10: NaN / +-Inf doubles -> null, dates and timestamps -> ISO strings."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(c).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


# ---------------------------------------------------------------- A6
def report_table(primary: DataFrame) -> DataFrame:
    """Numbered list of all findings in report order, resource id cut to 30 chars."""
    numbered = global_positions(primary, [F.col("first_key")], "row_no")
    status = F.col("status") if "status" in primary.columns else F.lit("N/A")
    rid = F.col("resource_id")
    return numbered.select(
        F.col("row_no").cast("long").alias("row_no"), "severity", "leak_type", "service",
        F.substring(F.when(rid.isNotNull() & (rid != ""), rid).otherwise(F.lit("N/A")), 1, RESOURCE_CUT).alias("resource"),
        "estimated_monthly_waste", "confidence", status.alias("status"),
    )


def high_findings(primary: DataFrame, n: int = HIGH_FINDINGS) -> DataFrame:
    """The first n HIGH findings in report order (top-k report)."""
    return primary.where(F.col("severity") == "HIGH").orderBy("first_key").limit(n)


# ---------------------------------------------------------------- H2
def leak_type_rollup(leaks: DataFrame) -> DataFrame:
    """H2: findings per leak type with severity counts, new count and waste; priority order."""
    status = F.col("status") if "status" in leaks.columns else F.lit(None).cast("string")
    sev = F.col("severity")
    g = leaks.withColumn("_status", status).groupBy("leak_type").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(sev == "HIGH").alias("high"),
        F.count_if(sev == "MEDIUM").alias("medium"),
        F.count_if(sev == "LOW").alias("low"),
        F.count_if(F.col("_status") == "NEW").alias("new"),
        money(F.sum("estimated_monthly_waste")).alias("monthly_waste"),
    )
    g = g.withColumn("priority", _map_expr(F.col("leak_type"), S.LEAK_PRIORITY, 0))
    return g.orderBy(F.col("priority").desc(), "leak_type")


# ---------------------------------------------------------------- H3
def insights(leaks: DataFrame) -> DataFrame:
    """H3: one insight text per leak; a single "healthy" line when there is none."""
    text = F.concat(
        F.lit("["), _none_text("severity"), F.lit("] "), _none_text("leak_type"), F.lit(" detected in "),
        _none_text("provider"), F.lit(" "), _none_text("service"),
        F.lit("\n→ Resource: "), _none_text("resource_id"),
        F.lit("\n→ Reason: "), _none_text("reason"),
        F.lit("\n→ Recommended action: "), _none_text("recommended_action"),
    )
    per_leak = leaks.select(text.alias("insight"))
    spark = leaks.sparkSession
    healthy = spark.range(1).crossJoin(leaks.agg(F.count(F.lit(1)).alias("_n"))).where(F.col("_n") == 0).select(
        F.lit(HEALTHY_INSIGHT).alias("insight"))
    return per_leak.unionByName(healthy)


# ---------------------------------------------------------------- H4, H5, H6
def filter_severity(leaks: DataFrame, severity: str = "ALL") -> DataFrame:
    """H4: ALL, HIGH, MEDIUM or LOW."""
    s = severity.upper()
    return leaks if s == "ALL" else leaks.where(F.col("severity") == s)


def convert_currency(leaks: DataFrame, currency: str, columns: list[str], rates: dict[str, float] | None = None) -> DataFrame:
    """H5: money columns in the chosen currency."""
    rate = (rates or S.CURRENCY_RATES)[currency]
    return leaks.select(*[c for c in leaks.columns if c not in columns], F.lit(currency).alias("currency"),
                        F.lit(float(rate)).alias("rate"), *[(F.col(c) * F.lit(float(rate))).alias(c) for c in columns])


def forecast_top(forecasts: DataFrame, n: int = FORECAST_ROWS_REPORT) -> DataFrame:
    """H6: the n largest projections with an alert flag when the trend exceeds 15 %."""
    return (forecasts.withColumn("trend_alert", F.col("trend_pct") > FORECAST_ALERT_PCT)
            .orderBy(F.col("projected_monthly_cost").desc(), "provider", "service").limit(n))
