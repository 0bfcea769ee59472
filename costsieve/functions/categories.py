"""Service classification as Column expressions.

Everything here is a plain Catalyst expression (``lower`` + ``contains`` chains), so
it stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: keyword lists that decide categories (must match the reference) ----
# Category keywords, tested in this order: compute, storage, serverless, database.
COMPUTE_SERVICES = ["ec2", "virtual machines", "compute engine"]
STORAGE_SERVICES = ["s3", "storage", "cloud storage"]
SERVERLESS_SERVICES = ["lambda", "functions", "cloud functions"]
DATABASE_SERVICES = ["rds", "sql", "cosmos", "cloud sql"]

# Provider-aware keyword lists (provider compared lower-cased).
COMPUTE_KEYWORDS = {"aws": ["ec2"], "azure": ["virtual machines"], "gcp": ["compute engine"]}
STORAGE_KEYWORDS = {
    "aws": ["ebs", "s3"],
    "azure": ["disk", "storage"],
    "gcp": ["persistent disk", "cloud storage"],
}
SNAPSHOT_KEYWORDS = {"aws": ["snapshot"], "azure": ["snapshot", "backup"], "gcp": ["snapshot"]}
BLOCK_STORAGE_KEYWORDS = {"aws": ["ebs", "volume"], "azure": ["disk"], "gcp": ["persistent disk"]}
# ---- end of fixed values ----


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(text: Column, keywords: list[str]) -> Column:
    """True when ``text`` contains one of ``keywords`` (substring test, null -> null)."""
    return reduce(lambda a, b: a | b, [text.contains(k) for k in keywords])


def service_category(service: str | Column = "service") -> Column:
    """compute / storage / serverless / database / other, first keyword hit wins.

    Null or empty service names are ``other``. Matching is by substring, so e.g.
    "rds" also hits "dashboards" – that is the intended (reference) behaviour.
    """
    s = F.lower(_col(service))
    return (
        F.when(s.isNull() | (s == ""), F.lit("other"))
        .when(contains_any(s, COMPUTE_SERVICES), F.lit("compute"))
        .when(contains_any(s, STORAGE_SERVICES), F.lit("storage"))
        .when(contains_any(s, SERVERLESS_SERVICES), F.lit("serverless"))
        .when(contains_any(s, DATABASE_SERVICES), F.lit("database"))
        .otherwise(F.lit("other"))
    )


def _provider_flag(service, provider, table: dict[str, list[str]]) -> Column:
    s = F.lower(_col(service))
    p = F.lower(_col(provider))
    expr = F.lit(False)
    for prov, words in table.items():
        expr = F.when(p == prov, contains_any(s, words)).otherwise(expr)
    # empty / null service or provider -> False (never null)
    ok = s.isNotNull() & (s != "") & p.isNotNull() & (p != "")
    return F.when(ok, F.coalesce(expr, F.lit(False))).otherwise(F.lit(False))


def is_compute(service="service", provider="provider") -> Column:
    return _provider_flag(service, provider, COMPUTE_KEYWORDS)


def is_storage(service="service", provider="provider") -> Column:
    return _provider_flag(service, provider, STORAGE_KEYWORDS)


def is_snapshot(service="service", provider="provider") -> Column:
    return _provider_flag(service, provider, SNAPSHOT_KEYWORDS)


def is_block_storage(service="service", provider="provider") -> Column:
    return _provider_flag(service, provider, BLOCK_STORAGE_KEYWORDS)


def has_text(c: str | Column) -> Column:
    """Python truthiness of a string id: not null and not empty."""
    c = _col(c)
    return c.isNotNull() & (c != "")
