"""Helpers shared by the training-data operators.

Conventions of every operator here:

* The text and id columns are parameters; operators read only those and private columns whose
  names are made fresh, so extra input columns of any name are carried along untouched. Where an
  operator adds a column, an input column of that name is replaced.
* A null text counts as an empty one unless the operator says otherwise.
* Tables read by several plans are written as Parquet under ``spark.checkpoint.dir``, so a lost
  executor never makes a row id or a range bound change. They stay as long as an operator's
  result may be read; ``temporary_tables`` deletes them once that is done.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costsieve import session

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# bytes.split() parts words at exactly \x20 and \x09-\x0D, the white space of the contracts.
# The second kind of words is ASCII digits and letters and all bytes from \x80 on.
LOWER_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_MADE: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back."""
    return session.materialise(df, name, _MADE[-1] if _MADE else None)


@contextlib.contextmanager
def temporary_tables(spark: SparkSession):
    """Delete, at its end, what operators have written inside. Write their results before."""
    _MADE.append([])
    try:
        yield
    finally:
        session.remove_paths(spark, _MADE.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, dots and back-ticks included."""
    return F.col(q(name))


def id_text(id_col: str) -> Column:
    """The id as text; a null id as the empty text."""
    return F.coalesce(col(id_col).cast("string"), F.lit(""))


def crc_mod(id_col: str, n: int) -> Column:
    return F.crc32(id_text(id_col).cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, A_Z, A_Z.lower())


def text_bytes(text_col: str) -> Column:
    """UTF-8 bytes of the text, null as empty: what Python tasks read."""
    return F.coalesce(col(text_col).cast("binary"), F.lit(b""))


def groups_of(values: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """(start, end) ranges of ``values`` of about ``most`` bytes; one value is never split."""
    start = size = 0
    for i, v in enumerate(values):
        if i > start and size + len(v) > most:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)


def map_arrow(df: DataFrame, run) -> DataFrame:
    """``df.mapInArrow`` with the same columns in and out, also where names hold dots or ticks."""
    odd = {c: f"__odd{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
    plain = df.select(*[col(c).alias(odd.get(c, c)) for c in df.columns]) if odd else df
    out = plain.mapInArrow(run, plain.schema)
    return out.select(*[col(odd.get(c, c)).alias(c) for c in df.columns]) if odd else out
