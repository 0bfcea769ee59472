"""First values by group inside a hash aggregate.

``min(struct(seq, text))`` holds a text in its buffer, which Spark can only aggregate by sorting all
rows. Here the texts become codes of a small dictionary, and (seq, code) is one wide decimal: a
fixed-width buffer, so the rows meet a hash aggregate, are combined in each task and shuffled once.
The dictionary holds the distinct values; it is broadcast only where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costsieve.session import materialise

FEW = 10_000
_WIDE = "decimal(38,0)"
_CODES = 1 << 62  # codes are below, sequence numbers too: their product has 37 digits


def value_codes(df: DataFrame, columns: list[str], code: str, made: list[str] | None = None) -> DataFrame:
    """The distinct values of ``columns`` with a number that rises in their order.

    At most FEW values are numbered on the driver and broadcast; more are numbered and written by
    Spark, which joins that table by its size.
    """
    values = df.select(*columns).distinct()
    first = values.orderBy(*columns).limit(FEW + 1).collect()
    if len(first) <= FEW:
        schema = T.StructType([*values.schema.fields, T.StructField(code, T.LongType())])
        return F.broadcast(df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(first)], schema))
    return materialise(values.orderBy(*columns).withColumn(code, F.monotonically_increasing_id()), "codes", made)


def first_key(seq: Column, code: Column) -> Column:
    """(seq, code) as one number in their order; null where the code is."""
    return seq.cast("decimal(19,0)").cast(_WIDE) * F.lit(_CODES).cast("decimal(19,0)") + code.cast("decimal(19,0)")


def seq_of(key: Column) -> Column:
    return F.call_function("div", key - (key % F.lit(_CODES).cast("decimal(19,0)")), F.lit(_CODES).cast("decimal(19,0)"))


def code_of(key: Column) -> Column:
    return (key % F.lit(_CODES).cast("decimal(19,0)")).cast("long")
