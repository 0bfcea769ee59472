"""Exact ranks inside groups without sending a whole group to one task.

A plain ``Window.partitionBy(group).orderBy(value)`` puts every row of a group in a
single task; with one service holding a third of all resources that task holds a
third of the table. ``value_ranks`` instead:

1. collapses ties: ``groupBy(group, value).count()`` (partial aggregation, so a hot
   value never ships more than one row per map task);
2. range-partitions the distinct values on ``(group, value)``, so a large group is cut
   into contiguous *slices* spread over many tasks, and pins the slice id in a reliable
   checkpoint (range bounds come from sampling and must not change on recomputation);
3. per slice, a running sum gives the rank inside the slice; a tiny per-(slice, group)
   table (at most slices + groups rows) gives each slice's offset in its group.

Result: for each distinct (group, value) the exact number of rows with a smaller value
(``lt``), with the same value (``eq``) and in the group (``n``).

``average_rank_pct`` slices the rows themselves, ties included, so each row gets its rank where it
lies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costsieve.session import reliable_checkpoint


def null_safe_join_cond(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column | None:
    """AND of ``left[a] <=> right[b]`` over ``pairs``; ``None`` when empty."""
    if not pairs:
        return None
    return reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def join_back(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join ``lookup`` to ``df`` on ``on`` (null-safe), keeping ``df``'s key columns.

    The lookup's keys are renamed first, so a lookup derived from ``df`` itself never
    makes an ambiguous self-join.
    """
    renamed = lookup.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)],
        *[c for c in lookup.columns if c not in on],
    )
    cond = null_safe_join_cond(df, renamed, [(c, f"__k{i}") for i, c in enumerate(on)])
    if cond is None:
        raise ValueError("join_back needs a key")
    joined = df.join(renamed, cond, how)
    return joined.drop(*[f"__k{i}" for i in range(len(on))])


def value_ranks(df: DataFrame, keys: list[str], value: str, slices: int | None = None) -> DataFrame:
    """Distinct (keys, value) with exact ``lt``, ``eq`` and ``n`` (nulls in ``value`` skipped)."""
    spark = df.sparkSession
    n_slices = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    distinct = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_eq"))
    )
    sliced = reliable_checkpoint(
        distinct.repartitionByRange(n_slices, *keys, value).withColumn("_slice", F.spark_partition_id())
    )
    per_slice = sliced.groupBy("_slice", *keys).agg(F.sum("_eq").alias("_slice_rows"))
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = per_slice.select(
        "_slice", *keys,
        F.coalesce(
            F.sum("_slice_rows").over(by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
        F.sum("_slice_rows").over(by_group).alias("_n"),
    )
    in_slice = Window.partitionBy("_slice", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("_lt_in_slice", F.coalesce(F.sum("_eq").over(in_slice), F.lit(0)))
    joined = join_back(ranked, offsets, ["_slice", *keys], "inner")
    return joined.select(
        *keys,
        value,
        (F.col("_before") + F.col("_lt_in_slice")).cast("long").alias("lt"),
        F.col("_eq").cast("long").alias("eq"),
        F.col("_n").cast("long").alias("n"),
    )


def row_slices(df: DataFrame, keys: list[str], value: str, slices: int | None = None) -> DataFrame:
    """The rows of ``df`` in contiguous slices (``_slice``) of the order (keys, value), pinned as a table.

    Rows of one value are parted by a hash of the whole row, so a value that half of all rows share
    is spread over as many slices as its rows fill.
    """
    n_slices = slices or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = df.repartitionByRange(n_slices, *keys, value, F.xxhash64(*df.columns))
    return reliable_checkpoint(ordered.withColumn("_slice", F.spark_partition_id()))


def _slice_facts(sliced: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per (slice, keys): rows of the group before it (``_before``) and in all (``_n``), and for its first
    and last value how often other slices hold them (``_edges``). At most slices + groups rows."""
    per_value = sliced.where(F.col(value).isNotNull()).groupBy("_slice", *keys, value).agg(F.count(F.lit(1)).alias("_eq"))
    per_slice = per_value.groupBy("_slice", *keys).agg(
        F.sum("_eq").alias("_rows"),
        F.struct(F.min(value).alias("v"), F.min_by("_eq", value).alias("eq")).alias("_first"),
        F.struct(F.max(value).alias("v"), F.max_by("_eq", value).alias("eq")).alias("_last"),
    )
    in_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = Window.unboundedPreceding, -1
    facts = per_slice.select(
        "_slice", *keys, "_first", "_last",
        F.coalesce(F.sum("_rows").over(in_group.orderBy("_slice").rowsBetween(*before)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(in_group).alias("_n"),
    )
    # a value in several slices is the first or the last one of each of them
    edges = facts.select("_slice", *keys, "_before", "_n", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("e"))
    of_value = Window.partitionBy(*keys, "e.v")
    edges = edges.select(
        "_slice", *keys, "_before", "_n", F.struct(
            F.col("e.v").alias("v"),
            F.coalesce(F.sum("e.eq").over(of_value.orderBy("_slice").rowsBetween(*before)), F.lit(0)).alias("eq_before"),
            F.sum("e.eq").over(of_value).alias("eq"),
        ).alias("e"))
    return edges.groupBy("_slice", *keys).agg(
        F.max("_before").alias("_before"), F.max("_n").alias("_n"), F.collect_list("e").alias("_edges"))


def average_rank_pct(df: DataFrame, keys: list[str], value: str, out: str = "pct",
                     materialized: bool = False, slices: int | None = None) -> DataFrame:
    """pandas ``rank(pct=True)`` (method='average') of ``value`` inside ``keys``, 0..1; null for nulls.

    Every row stays in its range slice: ranks inside the slice come from a window, and what other
    slices add from one row per (slice, group). Nothing is joined on the value itself, so equal
    values make no hot key. ``df`` is materialised first, as float sums may differ if evaluated twice.
    """
    if not materialized:
        df = reliable_checkpoint(df)
    sliced = row_slices(df, keys, value, slices)
    own = Window.partitionBy("_slice", *keys).orderBy(value)
    ranked = sliced.select(
        "*",
        F.count(value).over(own).alias("_le"),
        F.count(value).over(own.rangeBetween(Window.currentRow, Window.currentRow)).alias("_eq"),
    )
    joined = join_back(ranked, _slice_facts(sliced, keys, value), ["_slice", *keys], "left")
    edge = F.get(F.filter("_edges", lambda e: e["v"].eqNullSafe(F.col(value))), F.lit(0))
    lt = F.col("_before") + F.col("_le") - F.col("_eq") - F.coalesce(edge["eq_before"], F.lit(0))
    eq = F.coalesce(edge["eq"], F.col("_eq"))
    pct = F.when(F.col(value).isNotNull(), (lt + (eq + F.lit(1)) / F.lit(2.0)) / F.col("_n"))
    return joined.select(*df.columns, pct.alias(out))


def kth_smallest(df: DataFrame, keys: list[str], value: str, k_of_n) -> DataFrame:
    """Per group, the value at 0-based sorted position ``k_of_n(n)`` (a Column fn of n).

    Returns keys, ``n`` and the picked value (column named ``value``).
    """
    ranks = value_ranks(df, keys, value)
    k = k_of_n(F.col("n"))
    return ranks.where((F.col("lt") <= k) & (k < F.col("lt") + F.col("eq"))).select(*keys, "n", value)


def global_positions(df: DataFrame, order_cols: list[Column], out: str = "position") -> DataFrame:
    """1-based position of every row in the total order ``order_cols`` (must be unique).

    Distributed replacement of a global ``row_number()`` (which would gather all rows in
    one task): the order key is packed in one struct and ranked with ``value_ranks``.
    """
    keyed = reliable_checkpoint(df.withColumn("_order_key", F.struct(*order_cols)))
    ranks = value_ranks(keyed, [], "_order_key").select("_order_key", (F.col("lt") + 1).alias(out))
    return join_back(keyed, ranks, ["_order_key"], "left").drop("_order_key")
