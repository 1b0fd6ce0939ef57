"""Processes as column expressions.

A process body is called once, with columns for its arguments and the instance's attributes as literals. Between
processes effects are sequential, inside one simultaneous: one ``withColumns`` each, whose expressions read the row as it was.
"""

from __future__ import annotations

import functools
import operator
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.plans.schedule import Process
from stepframe.plans.translate import Untranslatable, output_names, translated


def outputs(process: Process, value) -> dict[str, Column]:
    """Names and expressions of what a body returned: one value, or (value, name, value, name, value ...)."""
    if isinstance(value, tuple):
        names = [process.name, *value[1::2]]
        return {n: as_column(v) for n, v in zip(names, [value[0], *value[2::2]], strict=True)}
    return {process.name: as_column(value)}


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value) if isinstance(value, (int, float)) else value)


def _by_value(instance) -> None:
    """Models are sent whole: executors needn't have their module."""
    for owner in type(instance).__mro__:
        if owner is not object and owner.__module__.split(".")[0] != "stepframe":
            register_pickle_by_value(sys.modules[owner.__module__])


def by_row(process: Process, instance, columns: list[Column], focus: Column) -> dict[str, Column]:
    """For bodies that need Python values: an Arrow-batched function, applied to the rows in focus that have all arguments; null elsewhere."""
    _by_value(instance)
    call: Callable = lambda *a: process.function(instance, *a)

    def rows(inside: pd.Series, series: tuple[pd.Series, ...]) -> list:
        return [call(*a) if f and not any(pd.isna(x) for x in a) else None for f, *a in zip(inside, *series, strict=True)]

    if not process.many:
        def one(inside: pd.Series, *series: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else float(v) for v in rows(inside, series)], dtype="float64")

        return {process.name: F.pandas_udf(one, T.DoubleType())(focus, *columns)}
    names = [process.name, *output_names(process.function)]

    def many(inside: pd.Series, *series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[None] * len(names) if v is None else [float(v[0]), *map(float, v[2::2])] for v in rows(inside, series)], columns=names, dtype="float64")

    packed = F.pandas_udf(many, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))(focus, *columns)
    return {n: packed[n] for n in names}


def expressions(process: Process, instance, resolve: Callable[[str], Column], focus: Column) -> dict[str, Column]:
    """A body's outputs: what it makes of columns; else its translation; else Python, row by row."""
    columns = [resolve(n) for n in process.inputs]
    try:
        return outputs(process, process.function(instance, *columns))
    except (PySparkException, TypeError) as e:
        if isinstance(e, TypeError) and "Column" not in str(e):
            raise
    try:  # Python's if, max or min on a column
        found = translated(process.function, instance, dict(zip(process.inputs, columns, strict=True)))
    except Untranslatable:
        return by_row(process, instance, columns, focus)
    whole = functools.reduce(operator.and_, [c.isNotNull() for c in columns])
    return {n: F.when(whole, c) for n, c in outputs(process, tuple(found) if len(found) > 1 else found[0]).items()}


def project(df: DataFrame, process: Process, instance, resolve: Callable[[str], str], focus: str | None) -> DataFrame:
    """Apply a projection; with ``focus`` only its rows change, and only they reach a body in Python."""
    inside = F.col(focus) if focus else F.lit(True)
    made = {resolve(n): c for n, c in expressions(process, instance, lambda n: F.col(resolve(n)), inside).items()}
    if focus:
        made = {n: F.when(F.col(focus), c).otherwise(F.col(n) if n in df.columns else F.lit(None)) for n, c in made.items()}
    return df.withColumns(made)


def python_total(df: DataFrame, process: Process, instance, resolve: Callable[[str], str], key: str, plant: str | None) -> DataFrame:
    """For bodies that need whole mappings of vertex to value: one task holds a plant's inputs (16 bytes a vertex and input, and
    Python's mappings of them), or the whole table's where there is one plant. Aggregates, or what ``translate`` makes of a body, have no such bound."""
    _by_value(instance)
    names = [process.name, *(output_names(process.function) if process.many else ())]
    by = F.col(plant) if plant else F.lit(0)
    rows = df.select(by.alias("__plant"), F.col(key).alias("__key"), *[F.col(resolve(n)).cast("double").alias(f"__{i}") for i, n in enumerate(process.inputs)])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__key")
        got = process.function(instance, *[dict(zip(pdf["__key"], pdf[f"__{i}"], strict=True)) for i in range(len(process.inputs))])
        values = [got[0], *got[2::2]] if isinstance(got, tuple) else [got]
        return pd.DataFrame([[pdf["__plant"].iloc[0], *map(float, values)]], columns=["__plant", *names])

    kind = rows.schema["__plant"].dataType.simpleString()
    return rows.groupBy("__plant").applyInPandas(whole, f"__plant {kind}, " + ", ".join(f"`{n}` double" for n in names))


def total(df: DataFrame, process: Process, instance, resolve: Callable[[str], str], key: str, plant: str | None) -> DataFrame:
    """Whole-column aggregates, focus or not, stored at vertex 1 (of each plant)."""
    columns = {n: F.col(resolve(n)) for n in process.inputs}
    made = None
    try:
        made = outputs(process, process.function(instance, *columns.values()))
    except (PySparkException, TypeError, AttributeError):  # a body for mappings, such as sum(x.values())
        try:
            found = translated(process.function, instance, columns)
            made = outputs(process, tuple(found) if len(found) > 1 else found[0])
        except Untranslatable:
            pass
    if made is not None:
        sums = df.groupBy(F.col(plant).alias("__plant") if plant else F.lit(0).alias("__plant")).agg(*[c.alias(f"__total_{resolve(n)}") for n, c in made.items()])
    else:
        table = python_total(df, process, instance, resolve, key, plant)
        made = dict.fromkeys(table.columns[1:])
        sums = table.select("__plant", *[F.col(n).alias(f"__total_{resolve(n)}") for n in made])
    names = [resolve(n) for n in made]
    joined = df.join(sums, df[plant].eqNullSafe(sums["__plant"]), "left") if plant else df.crossJoin(F.broadcast(sums))  # one row
    kept = {n: F.when(F.col(key) == 1, F.col(f"__total_{n}")).otherwise(F.col(n) if n in df.columns else F.lit(None)) for n in names}
    return joined.withColumns(kept).drop("__plant", *[f"__total_{n}" for n in names])


def references(process: Process) -> int:
    """How many column references a body makes at most: what one step multiplies the plan by."""
    return max(1, len(process.inputs) * 2)
