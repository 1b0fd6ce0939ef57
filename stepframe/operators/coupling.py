"""Coupling of components: edges of (receiver, applier, input variable, source variable, conversion)."""

from __future__ import annotations

import ast
import operator
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.operators.component import Component
from stepframe.operators.forcing import apply_tables, owners
from stepframe.plans import catalog

Translator = Mapping[str, Mapping[str, Mapping[str, Mapping[str, float | str]]]]
GEOMETRY = ("vertex_index", "x1", "x2", "y1", "y2", "z1", "z2")
SOIL = "SoilModel"
_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def conversion(value: float | str) -> float:
    """A number, or arithmetic on numbers as text (``"1/12"``); nothing else is evaluated."""

    def walk(node) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.operand))
        raise ValueError(f"not an arithmetic expression: {value!r}")

    return float(value) if isinstance(value, (int, float)) else float(walk(ast.parse(value, mode="eval").body))


def parse_sources(text: str) -> dict[str, float]:
    """``"name * factor ; name2"`` as {name: factor}."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, _, factor = part.partition("*")
        out[name.strip()] = conversion(factor.strip() or 1.0)
    return out


def edges(translator: Translator) -> list[tuple[str, str, str, str, float]]:
    return [(r, a, i, s, conversion(k)) for r, by in translator.items() for a, ins in by.items() for i, sources in (ins or {}).items() for s, k in sources.items()]


def edge_table(spark: SparkSession, translator: Translator) -> DataFrame:
    return spark.createDataFrame(edges(translator), "receiver string, applier string, input_var string, source_var string, conversion double")


def inputs_outputs(table: DataFrame, target: str, names_for_others: bool = True) -> tuple[DataFrame, DataFrame]:
    """(name) of what ``target`` takes and of what others take from it, each once; by the others' names or its own."""
    takes, gives = ("source_var", "input_var") if names_for_others else ("input_var", "source_var")
    ins = table.where(F.col("receiver") == target).select(F.col(takes).alias("name")).distinct()
    outs = table.where((F.col("applier") == target) & (F.col("receiver") != target)).select(F.col(gives).alias("name")).distinct()
    return ins, outs


def couple(receiver: Component, name: str, appliers: Iterable[str], translator: Translator, shared: bool = True, subcategory: str | None = None) -> None:
    """Set a receiver's aliases and pullable inputs. One source of the same name and factor 1 needs nothing; one of another
    name and factor 1 in a shared table is an alias; all else is pulled as a weighted sum."""
    for applier in appliers:
        if applier == name:
            continue
        for target, found in ((translator.get(name) or {}).get(applier) or {}).items():
            sources = {s: conversion(k) for s, k in found.items()}
            if len(sources) == 1 and shared:
                (source, k), = sources.items()
                if k == 1.0:
                    if source != target:
                        receiver.aliases[target] = source
                    continue
            if subcategory:
                receiver.pullable_inputs.setdefault(subcategory, {}).setdefault(target, sources)
            else:
                receiver.pullable_inputs[target] = sources


def suggest(components: Mapping[str, Component]) -> dict:
    """A translator by name: each input from the component that declares a state variable of that name."""
    out: dict = {r: {a: {} for a in components if a != r} for r in components}
    for r, c in components.items():
        for n in c.inputs:
            for a, other in components.items():
                if a != r and n in other.state_variables:
                    out[r][a][n] = {n: 1.0}
    return out


class Composite:
    """Coupled components over named compartments (tables)."""

    def __init__(self, time_step: int = 3600):
        self.time_step, self.time = time_step, 0
        self.components: dict[str, Component] = {}
        self.data: dict[str, DataFrame] = {}

    def declare_data(self, shoot=None, root=None, atmosphere=None, soil=None) -> None:
        self.data |= {k: v for k, v in (("shoot", shoot), ("root", root), ("atmosphere", atmosphere), ("soil", soil)) if v is not None}

    def couple_components(self, components: Mapping[str, Component], translator: Translator) -> None:
        self.components = dict(components)
        root = self.data["root"]
        soil_inputs: list[str] = []
        if SOIL in components:
            given = [s for _, ins in (translator.get(SOIL) or {}).items() for sources in (ins or {}).values() for s in sources]
            soil_inputs = [*GEOMETRY, *dict.fromkeys(given)]
            outs = dict.fromkeys(s for r, a, _, s, _ in edges(translator) if a == SOIL and r != SOIL)
            root = root.withColumns({n: F.lit(0.0) for n in outs if n not in root.columns})
        self.plant_side_soil_inputs = soil_inputs
        for name, c in self.components.items():
            shared = all(c.compartment == o.compartment for o in self.components.values()) or c.compartment == "root"
            couple(c, name, [*self.components, SOIL], translator, shared)
        missing = {s for c in self.components.values() for s in c.aliases.values() if s not in root.columns}
        self.data["root"] = root.withColumns({s: F.lit(None).cast("double") for s in missing}) if missing else root

    def declare_data_and_couple_components(self, components: Mapping[str, Component], translator: Translator, **data) -> None:
        self.declare_data(**data)
        self.couple_components(components, translator)

    def get_documentation(self, spark: SparkSession, filters=None, models=None) -> str:
        return catalog.report(spark, models or self.components.values(), filters)

    def documentation(self, spark: SparkSession) -> str:
        return self.get_documentation(spark)

    def inputs(self, spark: SparkSession) -> str:
        return self.get_documentation(spark, {"variable_type": ["input"]})

    def apply_input_tables(self, table: DataFrame, when: int, everywhere: bool = False) -> None:
        for compartment, names in owners(self.components, table.columns).items():
            if compartment in self.data:
                self.data[compartment] = apply_tables(self.data[compartment], table, when, names, fill=compartment == "soil" or everywhere)

    def run(self, table: DataFrame | None = None) -> None:
        """Apply the forcing of the current step, step all components in order, move on."""
        if table is not None:
            self.apply_input_tables(table, self.time)
        for c in self.components.values():
            where = c.compartment if c.compartment in self.data else "root"
            self.data[where] = c.step(self.data[where])
        self.time += 1
