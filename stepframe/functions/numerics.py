"""Functions for process bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def where(condition: Column, yes, no) -> Column:
    return F.when(condition, _col(yes)).otherwise(_col(no))


def maximum(a, b) -> Column:
    """The larger; NaN if either is (NaN is Spark's largest double)."""
    return F.greatest(_col(a), _col(b))


def minimum(a, b) -> Column:
    """The smaller; NaN if either is."""
    a, b = _col(a), _col(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


def truncated(x) -> Column:
    return _col(x).cast("int")


def temperature_modification(soil_temperature=15.0, process_at_T_ref=1.0, T_ref=0.0, A=-0.05, B=3.0, C=1.0) -> Column:
    """Response of a process to temperature: p * b^(1-C) * b^(C * dT / 10) with b = A * dT + B, dT = T - T_ref.

    0 where C is neither 0 nor 1, or C is 1 and b negative; else at least 0.
    """
    dt = _col(soil_temperature) - _col(T_ref)
    b, c = _col(A) * dt + _col(B), _col(C)
    value = F.greatest(_col(process_at_T_ref) * F.pow(b, 1 - c) * F.pow(b, c * dt / 10.0), F.lit(0.0))
    return F.when(~c.isin(0.0, 1.0) | ((c == 1.0) & (b < 0.0)), F.lit(0.0)).otherwise(value)


temperature_modification_old = temperature_modification
