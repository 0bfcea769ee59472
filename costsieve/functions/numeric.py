"""Numeric and text helpers that reproduce Python's number semantics with built-ins.

Python's ``round(x, d)`` and ``f"{x:.{d}f}"`` round the *exact binary* value of a
double, half-to-even on true ties. Spark's ``round`` rounds the shortest decimal
string half-up, so ``round(2.675, 2)`` is 2.68 in Spark but 2.67 in Python.
``format_number`` uses ``java.text.DecimalFormat`` (HALF_EVEN on the exact binary
value), which is exactly Python's rule, so the helpers below build on it.
All of them are JVM expressions: no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt_fixed(c, digits: int) -> Column:
    """``f"{x:.{digits}f}"`` (no thousands separator)."""
    return F.regexp_replace(F.format_number(_col(c), digits), ",", "")


def fmt_grouped(c, digits: int) -> Column:
    """``f"{x:,.{digits}f}"`` (comma thousands separator)."""
    return F.format_number(_col(c), digits)


def py_round(c, digits: int) -> Column:
    """Python ``round(x, digits)`` for doubles; null stays null; -0.0 is folded to 0.0."""
    return fmt_fixed(c, digits).try_cast("double") + F.lit(0.0)


def money(c, digits: int = 2) -> Column:
    """Python ``round(x, 2)`` of a value computed from float sums, made order-independent.

    Float sums differ in the last bits with summation order (Spark's partial aggregation
    order is not fixed), and money products such as ``avg * 30 * 0.3`` often land on an
    exact ``.xx5``; the last bits would then decide the cent. Rounding to 9 decimals
    first removes the summation noise, so the cent is the same on every run.
    """
    return py_round(py_round(c, 9), digits)


def np_round(c, digits: int) -> Column:
    """numpy / pandas ``.round(digits)``: ``rint(x * 10**d) / 10**d`` (half-even on the product)."""
    scale = float(10**digits)
    return F.bround(_col(c) * F.lit(scale), 0) / F.lit(scale)


def nan_to_null(c) -> Column:
    """NaN and +/-Infinity become null (A10 ``sanitize_floats``)."""
    c = _col(c)
    bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(c)


def clamp(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _col(c)))
