"""Variable declarations and the catalog that can be queried about them."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = (
    "unit", "unit_comment", "description", "min_value", "max_value", "value_comment", "references", "DOI", "variable_type", "by", "state_variable_type", "edit_by",
)
VARIABLE_TYPES = ("state_variable", "plant_scale_state", "input", "parameter")
STATE_TYPES = ("massic_concentration", "intensive", "extensive", "NonInertialExtensive", "NonInertialIntensive", "descriptor")
EDITORS = ("user", "dev", "developer")


def declare(
    unit, unit_comment, description, min_value, max_value, value_comment, references, DOI, variable_type, by, state_variable_type, edit_by, default=None, default_factory=None, validate=False
):
    """A dataclass field that carries the twelve metadata. A given ``default_factory`` wins over ``default``."""
    meta = dict(zip(METADATA, (unit, unit_comment, description, min_value, max_value, value_comment, references, DOI, variable_type, by, state_variable_type, edit_by), strict=True))
    if validate:
        if variable_type not in VARIABLE_TYPES:
            raise ValueError(f"unknown variable_type {variable_type!r}")
        if state_variable_type not in (*STATE_TYPES, "", None):
            raise ValueError(f"unknown state_variable_type {state_variable_type!r}")
        if edit_by not in (*EDITORS, "", None):
            raise ValueError(f"unknown edit_by {edit_by!r}")
        if not isinstance(unit, str):
            raise ValueError("unit must be a string")
        if default_factory is None and not isinstance(default, (int, float)):
            raise ValueError("default must be a number")
    if default_factory:
        return dataclasses.field(default_factory=default_factory, metadata=meta)
    return dataclasses.field(default=default, metadata=meta)


def fields_of(component) -> dict[str, dataclasses.Field]:
    return {f.name: f for f in dataclasses.fields(component)}


def select(component, **wanted) -> list[str]:
    """Names of the declared variables whose metadata have these values (or one of them), in declaration order."""
    keep = {k: v if isinstance(v, (list, tuple, set)) else [v] for k, v in wanted.items()}
    return [n for n, f in fields_of(component).items() if all(f.metadata[k] in v for k, v in keep.items())]


def default_of(component, name: str):
    if name in vars(component):
        return vars(component)[name]
    f = fields_of(component)[name]
    return f.default_factory() if f.default is dataclasses.MISSING and f.default_factory is not dataclasses.MISSING else f.default


def struct_type(component) -> T.StructType:
    """vid and all variables as doubles, with their metadata."""
    kept = [T.StructField(n, T.DoubleType(), True, {k: v for k, v in f.metadata.items() if v is not None}) for n, f in fields_of(component).items()]
    return T.StructType([T.StructField("vid", T.LongType(), False), *kept])


def catalog(spark: SparkSession, components: Iterable) -> DataFrame:
    """One row for each declared variable: component, position, name, default and the metadata, all as text."""
    rows = [
        (type(c).__name__ if not isinstance(c, type) else c.__name__, i, n, *["" if f.metadata[k] is None else str(f.metadata[k]) for k in METADATA])
        for c in components for i, (n, f) in enumerate(fields_of(c).items())
    ]
    return spark.createDataFrame(rows, "component string, position int, name string, " + ", ".join(f"`{k}` string" for k in METADATA))


def documented(variables: DataFrame, filters: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """component, position, line: the catalog rows that satisfy every filter, as fixed-width text."""
    for k, v in (filters or {}).items():
        variables = variables.where(F.col(k).isin(list(v)))

    def cell(name: str, width: int):
        return F.rpad(F.substring(F.col(name), 1, width), width + 1, " ")

    about = F.rpad(F.when(F.length("description") > 90, F.concat(F.substring("description", 1, 87), F.lit("..."))).otherwise(F.col("description")), 91, " ")
    line = F.concat_ws(" | ", cell("name", 30), *[about if k == "description" else cell(k, 30) for k in METADATA])
    return variables.select("component", "position", line.alias("line"))


def report(spark: SparkSession, components: Iterable, filters: Mapping[str, Iterable[str]] | None = None) -> str:
    """The whole report: for each component its name, a header and one line a variable."""
    rows = documented(catalog(spark, components), filters).orderBy("component", "position").collect()  # one row for each declared variable
    head = " | ".join(f"{k[:30]:<{91 if k == 'description' else 31}}" for k in ("name", *METADATA))
    out: list[str] = []
    for r in rows:
        if r.component not in out:
            out += [r.component, head]
        out.append(r.line)
    return "\n".join(out)
