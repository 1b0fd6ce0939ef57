"""Components: declared variables, processes, and one table of vertices that they step."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.plans import catalog, compiler, schedule

KEY, FOCUS = "vid", "focus"
#: Vertices that take part (fixed values): labels Segment and Apex; types from the base of the root system on.
FOCUS_LABELS = (1, 2)
FOCUS_TYPES = (1, 7, 8, 9, 10, 11, 12)


def focus_filter(mass="struct_mass", label="label", kind="type", labels: Iterable = FOCUS_LABELS, kinds: Iterable = FOCUS_TYPES):
    """Whether a vertex takes part. NaN is greater than 0 to Spark, but not here."""
    m = F.col(mass)
    return F.coalesce((m > 0) & ~F.isnan(m) & F.col(label).isin(*labels) & F.col(kind).isin(*kinds), F.lit(False))


class Component:
    """Base of components. Subclasses are dataclasses of ``declare``d variables with decorated methods."""

    compartment = "root"
    #: Column of the plant that a vertex belongs to, if there are several.
    plant: str | None = None
    schedule = schedule.DEFAULT_SCHEDULE
    time_step = sub_time_step = 3600

    def __init__(self, time_step: int = 3600, sub_time_step: int | None = None, **scenario):
        self.time_step, self.sub_time_step = time_step, sub_time_step or time_step
        self.pullable_inputs: dict[str, dict[str, float]] = {}
        self.aliases: dict[str, str] = {}
        self.apply_scenario(**scenario)

    inputs = property(lambda self: catalog.select(self, variable_type="input"))
    state_variables = property(lambda self: catalog.select(self, variable_type="state_variable"))
    plant_scale_state = property(lambda self: catalog.select(self, variable_type="plant_scale_state"))
    parameter = property(lambda self: catalog.select(self, variable_type="parameter"))

    def _states(self, *kinds: str) -> list[str]:
        return catalog.select(self, variable_type="state_variable", state_variable_type=kinds)

    extensive_variables = property(lambda self: self._states("extensive"))
    massic_concentration = property(lambda self: self._states("massic_concentration"))
    intensive_variables = property(lambda self: self._states("intensive"))
    non_inertial_extensive = property(lambda self: self._states("NonInertialExtensive"))
    non_inertial_intensive = property(lambda self: self._states("NonInertialIntensive"))
    non_inertial_variables = property(lambda self: self._states("NonInertialIntensive", "NonInertialExtensive"))
    descriptor = property(lambda self: self._states("descriptor"))

    def apply_scenario(self, **values) -> None:
        """Override attributes; names that there aren't are warned about."""
        for name, value in values.items():
            if hasattr(type(self), name) or name in catalog.fields_of(self):
                setattr(self, name, value)
            else:
                warnings.warn(f"{type(self).__name__} has no {name}", stacklevel=2)

    @functools.cached_property
    def groups(self):
        return schedule.ordered(schedule.processes(type(self)), self.schedule)

    def resolve(self, name: str) -> str:
        """The column that holds a variable: another's, where coupling made it an alias."""
        return self.aliases.get(name, name)

    def link(self, df: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
        """Add the declared variables: inputs where they aren't complete, states always, plant-scale states at vertex 1."""
        ignore = set(ignore)
        present = [n for n in self.inputs if n in df.columns and n not in ignore]
        counts = df.agg(F.count(F.lit(1)).alias("__all"), *[F.count(n).alias(n) for n in present]).first() if present else None
        fill = {n: F.lit(catalog.default_of(self, n)).cast("double") for n in self.inputs if n not in ignore and (n not in present or counts[n] != counts["__all"])}
        fill |= {n: F.lit(catalog.default_of(self, n)).cast("double") for n in self.state_variables if n not in ignore}
        fill |= {n: F.when(F.col(KEY) == 1, F.lit(catalog.default_of(self, n)).cast("double")) for n in self.plant_scale_state if n not in ignore}
        meta = {n: {k: v for k, v in f.metadata.items() if v is not None} for n, f in catalog.fields_of(self).items()}
        return df.withColumns({n: c.alias(n, metadata=meta[n]) for n, c in fill.items()}) if fill else df

    def focused(self, df: DataFrame) -> DataFrame:
        """Mark the vertices that take part, once: a mark that is there is kept."""
        return df if FOCUS in df.columns or self.compartment != "root" else df.withColumn(FOCUS, focus_filter())

    def refresh_focus(self, df: DataFrame) -> DataFrame:
        return df.withColumn(FOCUS, focus_filter())

    def pull(self, df: DataFrame) -> DataFrame:
        """Inputs from other columns: weighted sums, where the first source has a value."""
        made, entries = {}, {}
        for name, sources in self.pullable_inputs.items():  # a subcategory holds inputs of its own
            entries |= sources if any(isinstance(k, Mapping) for k in sources.values()) else {name: sources}
        for name, sources in entries.items():
            terms = [F.col(s) * F.lit(float(k)) for s, k in sources.items()]
            made[name] = F.when(F.col(next(iter(sources))).isNotNull(), functools.reduce(lambda a, b: a + b, terms, F.lit(0.0)))
        return df.withColumns(made) if made else df

    def run_process(self, df: DataFrame, p: schedule.Process) -> DataFrame:
        if p.side_effect:
            found = p.function(self, *([df] if p.inputs else []))
            return found if isinstance(found, DataFrame) else df.transform(found) if callable(found) else df
        if p.total:
            return compiler.total(df, p, self, self.resolve, KEY, self.plant)
        return compiler.project(df, p, self, self.resolve, FOCUS if self.compartment == "root" else None)

    def step(self, df: DataFrame) -> DataFrame:
        """Pull inputs, then run all groups as often as sub-steps fit into the time step."""
        if self.compartment not in ("root", "soil"):
            raise KeyError(self.compartment)
        df = self.pull(self.focused(df))
        for _ in range(int(self.time_step / self.sub_time_step)):
            for _, group in self.groups:
                for p in group:
                    df = self.run_process(df, p)
        return df

    __call__ = step

    @property
    def growth(self) -> int:
        """By how much one step can multiply the references in a plan."""
        return 1 + sum(compiler.references(p) for _, group in self.groups for p in group)


Model = Component
