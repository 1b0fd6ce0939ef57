"""Time-indexed forcing tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owners(components: Mapping, columns: Iterable[str]) -> dict[str, list[str]]:
    """By compartment, the forcing variables it takes: those that a component holds as state, or takes as input while none does."""
    states = {n for c in components.values() for n in c.state_variables}
    out: dict[str, list[str]] = {}
    for name in columns:
        for c in components.values():
            if name in c.state_variables or (name in c.inputs and name not in states):
                held = out.setdefault(c.compartment, [])
                if name not in held:
                    held.append(name)
    return out


def forcing_row(table: DataFrame, when: int, names: Iterable[str], index: str = "t") -> DataFrame:
    """The one row of step ``when``. An absent step is an error, not a gap to fill."""
    row = table.where(F.col(index) == when).select(*[F.col(n).alias(f"__forcing_{n}") for n in names])
    if not row.take(1):
        raise KeyError(when)
    return row


def apply_tables(df: DataFrame, table: DataFrame, when: int, names: Iterable[str], fill: bool = False, key: str = "vid", index: str = "t") -> DataFrame:
    """Set the variables of step ``when``: at vertex 1 only, or with ``fill`` in every row (voxels)."""
    names = list(names)
    row = forcing_row(table, when, names, index)
    joined = df.crossJoin(F.broadcast(row))  # one row
    made = {n: F.col(f"__forcing_{n}") for n in names}
    if not fill:
        made = {n: F.when(F.col(key) == 1, c).otherwise(F.col(n) if n in df.columns else F.lit(None)) for n, c in made.items()}
    return joined.withColumns(made).drop(*[f"__forcing_{n}" for n in names])
