"""The end-to-end waste analysis.

``analyze`` wires: detect provider -> normalize -> shared features (daily series with
z-scores, per-service stats, per-resource features) -> ten detectors -> union ->
dedupe -> score -> primary -> summary / stats / forecast. It runs the jobs that write the
shared aggregates and returns DataFrames over them; rows never come to the driver, which
only sees column names, parameters and single totals.

Aggregates that several plans read (one row per service-day, per service, per resource, per
resource-day-region, per finding) are written as Parquet under the shared checkpoint
folder: lineage is cut and each reader takes the columns it needs. ``Analysis.close()``
deletes them.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costsieve import schema as S
from costsieve.operators import detectors as E
from costsieve.operators import features as D
from costsieve.operators import scoring as Fs
from costsieve.operators.detect import detect_provider
from costsieve.operators.normalize import SLASH_TO_UNDERSCORE, normalize
from costsieve.session import materialise, remove_paths

log = logging.getLogger(__name__)


@dataclass
class Features:
    norm: DataFrame
    daily: DataFrame          # D1 + D5 columns (+ owned flag)
    services: DataFrame       # per (provider, service)
    resources: DataFrame      # per (provider, service, resource_id)
    slots: DataFrame          # per (resource_id, provider, service, date, region)
    materialized: bool = False
    rows_read: DataFrame | None = None  # total_records, where rejected rows are counted in the pass over the rows
    paths: list[str] = field(default_factory=list)


@dataclass
class Analysis:
    provider: str
    features: Features
    leaks: DataFrame          # deduped LEAK rows
    scored: DataFrame
    primary: DataFrame
    summary: DataFrame
    forecasts: DataFrame | None
    stats: DataFrame
    skipped: list[str] = field(default_factory=list)

    def close(self) -> None:
        """Delete the tables that the analysis wrote; its DataFrames can't be read after that."""
        remove_paths(self.features.norm.sparkSession, self.features.paths)

    def ordered_primary(self) -> DataFrame:
        return self.primary.orderBy("first_key")

    def ordered_scored(self) -> DataFrame:
        return self.scored.orderBy("rank_key")


FILES_TO_BROADCAST = 100_000
KEY_BITS = 61  # the slots pack a flag beside the key into one long


def with_seq(df: DataFrame) -> DataFrame:
    """Give rows a first-seen order when the input has none: by file name, then position in the file.

    The order is that of the files' names and rows however Spark packs them into tasks. A Parquet
    row's position is its row index. A CSV row's is the first byte of its block plus its number in the
    task: a block that isn't its file's last fills a task alone, and holds fewer rows than bytes.
    Rows that aren't read from files are numbered by partition.
    """
    if "seq" in df.columns:
        whole = isinstance(df.schema["seq"].dataType, T.IntegralType)
        return df if whole else df.withColumn("seq", F.col("seq").try_cast("long"))
    names = sorted(re.sub(r"^(\w+):///", r"\1:/", n) for n in df.inputFiles())  # as _metadata has them
    fields = _metadata_fields(df) if names else []
    if "file_block_start" not in fields:
        return df.withColumn("seq", F.monotonically_increasing_id())
    ranks = df.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "__path string, __rank long")
    if len(names) <= FILES_TO_BROADCAST:
        ranks = F.broadcast(ranks)
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = F.col("_metadata.row_index") if "row_index" in fields else F.col("_metadata.file_block_start") + in_task
    placed = df.withColumns({"__path": F.col("_metadata.file_path"), "__place": place}).join(ranks, "__path", "left")
    seq = F.shiftleft(F.coalesce("__rank", F.lit(len(names))), KEY_BITS - len(names).bit_length()) + F.col("__place")
    return placed.withColumn("seq", seq).drop("__path", "__rank", "__place")


def _metadata_fields(df: DataFrame) -> list[str]:
    """What Spark can tell of a row's file; nothing where the rows come from further operators."""
    try:
        return df.select("_metadata").schema["_metadata"].dataType.names
    except AnalysisException:
        return []


def with_optional(df: DataFrame) -> DataFrame:
    """Optional columns that the input lacks, as typed nulls."""
    kinds = {"usage": "double", "resource_id": "string", "region": "string"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def build_features(norm: DataFrame, materialize: bool = True, with_rejected: bool = False) -> Features:
    """The four shared aggregates every detector reads, built from ONE pass over the rows.

    With ``materialize`` (default) they are written to the shared checkpoint folder: up to ten
    plans read them, a lost executor re-reads them instead of the input, and every detector sees
    bit-identical float sums (a re-evaluated sum may differ in the last bit). ``with_rejected``: rows
    without a date are rejected ones (``normalize(keep_rejected=True)``); they are only counted.
    """
    norm, paths = with_optional(norm), []
    keep = (lambda df, name: materialise(df, name, paths)) if materialize else (lambda df, name: df)
    slots = keep(D.resource_day_slots(norm), "slots")  # the only pass over the rows
    rows_read = None
    if with_rejected:
        rows_read = slots.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"))
        slots, norm = slots.where("date is not null"), norm.where("date is not null")
    daily = keep(D.cost_zscore(D.daily_from_slots(slots)), "daily")
    resources = keep(D.resource_features_from_slots(slots), "resources")
    services = keep(D.service_stats(daily), "services")
    return Features(norm=norm, daily=daily, services=services, resources=resources, slots=slots,
                    materialized=materialize, rows_read=rows_read, paths=paths)


def underscore_names(raw: DataFrame) -> DataFrame:
    """A raw CUR with slash names under its underscore names."""
    if "lineItem/UnblendedCost" not in raw.columns:
        return raw
    return raw.withColumnsRenamed({k: v for k, v in SLASH_TO_UNDERSCORE.items() if k in raw.columns})


def run_detectors(ft: Features, commitments: DataFrame | None = None, raw_columns: set[str] = frozenset(),
                  top_untagged: int | None = S.UNTAGGED_TOP_N) -> tuple[list[DataFrame], list[str]]:
    """All detectors in reference order (the order dedupe keeps). Missing inputs never
    fail a run: absent usage makes ratios NULL (zombie / idle / idle-DB find nothing),
    absent reservation or item-type columns make the commitment detectors empty (their
    names are returned in ``skipped``). Plans are not wrapped in
    try/except at action time. ``commitments``: ``detectors.commitment_totals`` of the raw CUR."""
    out, skipped = [], []
    codes = E.service_codes(ft.services, ft.paths)
    zombie = E.detect_zombie(ft.resources, materialized=ft.materialized)
    if ft.materialized:  # read by the idle detector too
        zombie = materialise(zombie, "zombies", ft.paths)
    out.append(zombie)
    out.append(E.detect_idle(ft.resources, ft.services, zombie.select("resource_id")))
    out.append(E.detect_runaway(ft.services, ft.resources))
    out.append(E.detect_always_on(ft.daily, ft.services))
    out.append(E.detect_orphaned_storage(ft.slots, codes))
    out.append(E.detect_idle_database(ft.resources))
    out.append(E.detect_snapshot_sprawl(ft.slots, codes))
    out.append(E.detect_untagged(ft.slots, ft.services, top_untagged, codes))
    if commitments is not None:
        if E.SAVINGS_COLUMNS <= raw_columns:
            out.append(E.savings_plan_leak(commitments))
        else:
            skipped.append("detect_savings_plan")
        if E.UNUSED_COLUMNS <= raw_columns:
            out.append(E.unused_reservation_leak(commitments, "product_servicecode" in raw_columns))
        else:
            skipped.append("detect_unused_reservation")
    return out, skipped


def analyze(raw: DataFrame, provider: str | None = None, already_normalized: bool = False,
            top_untagged: int | None = S.UNTAGGED_TOP_N, forecast: bool = True,
            materialize: bool = True) -> Analysis:
    """Run the whole analysis. ``already_normalized`` input keeps its own ``provider`` column
    when it has one (multi-provider tables), else is stamped. The rows are read once for the
    features (which also counts the rejected ones) and, for a raw AWS export, once more for the
    commitment totals; a text column of dates is voted on before (``normalize.day_first``)."""
    # before rows get a made-up order: an input without one isn't scanned for its first row
    label = None if already_normalized else detect_provider(raw, provider)
    raw = with_seq(raw)
    commitments, raw_columns = None, set()
    if already_normalized:
        if "provider" in raw.columns and provider is None:
            norm = raw
            label = "MULTI"
        else:
            label = (provider or "AWS").upper()
            norm = raw.withColumn("provider", F.lit(label))
    else:
        try:
            norm = normalize(raw, label, keep_rejected=label != "AWS")  # AWS rows are counted with the commitments
        except Exception as exc:  # noqa: BLE001 - plan-time error in the mapping
            raise ValueError(f"Normalization failed: {exc}") from exc
        if label == "AWS":
            plain = underscore_names(raw)
            raw_columns, commitments = set(plain.columns), E.commitment_totals(plain)
    ft = build_features(norm, materialize=materialize, with_rejected=not already_normalized and label != "AWS")
    if materialize and commitments is not None:
        commitments = materialise(commitments, "commitments", ft.paths)
    frames, skipped = run_detectors(ft, commitments, raw_columns, top_untagged)
    for name in skipped:
        log.warning("detector %s has no input columns; it finds nothing", name)
    leaks = Fs.dedupe_leaks(Fs.union_leaks(frames))
    scored = Fs.score_leaks(leaks, ft.services, ft.resources)
    primary = Fs.select_primary(scored)
    if materialize:  # one row per resource with a finding, read by every report
        primary = materialise(primary, "primary", ft.paths)
    forecasts = D.forecast_30d(ft.daily) if forecast else None
    normalized = ft.slots.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("normalized_records"))
    if commitments is not None:
        total = commitments.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"))
    elif already_normalized:  # every row is one of the slots
        total = normalized.withColumnRenamed("normalized_records", "total_records")
    else:
        total = ft.rows_read
    return Analysis(
        provider=label, features=ft, leaks=leaks, scored=scored, primary=primary,
        summary=Fs.summary(primary), forecasts=forecasts,
        stats=Fs.pipeline_stats(total, normalized, forecasts, label), skipped=skipped,
    )
