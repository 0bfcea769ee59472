"""SparkSession construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "costsieve") -> SparkSession:
    """A session tuned for the billing workloads.

    * AQE on: runtime broadcast of small aggregate sides (measured, not guessed),
      partition coalescing and skew-join splitting.
    * Session time zone UTC: billing dates are calendar days, never shifted.
    * The UI stays off.
    On a cluster, pass ``master=None`` and size ``spark.sql.shuffle.partitions`` to
    roughly input_bytes / 200 MB; AQE coalesces it down for the small stages.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    parts = shuffle_partitions or os.environ.get("COSTSIEVE_SHUFFLE_PARTITIONS")
    if not parts and (master or "").startswith("local"):
        parts = 8  # a cluster keeps its own setting
    if parts:
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    b = (
        b.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is configured.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is always used.
    The one branch by master is for tests: a local-mode session without the setting gets a fresh temporary folder;
    a cluster session without it is an error, because a machine-local folder would not
    survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="costsieve-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for checkpoints")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (``spark.checkpoint.dir``) and
    cut its lineage.

    An eager ``Dataset.checkpoint`` evaluates the plan once and writes the partitions in
    that job (measured: about the cost of one ``count``), cheaper than a Parquet write plus
    read-back for the small aggregates it is used on. Used for aggregates read by many
    plans and right after non-deterministic steps (range bounds + partition ids), so a
    lost executor never recomputes them differently. Never ``localCheckpoint``: those
    blocks die with their executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and read it back.

    For aggregates that many plans read: lineage is cut as with a checkpoint, and each
    reader prunes columns, pushes filters down and sees the table's size. ``made`` collects
    the folder for ``remove_paths``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders that ``materialise`` made, wherever the shared folder lies."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/costsieve-{name}-{uuid.uuid4().hex[:12]}"
