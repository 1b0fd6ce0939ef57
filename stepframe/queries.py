"""The engine's operators on the benchmark tables, each with SQL that says the same."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepframe.functions.numerics import minimum, temperature_modification, where
from stepframe.models import COMPONENTS, TRANSLATOR, Starch
from stepframe.operators import keyed, scene
from stepframe.operators.component import Component, focus_filter
from stepframe.operators.coupling import Composite, couple, edge_table, inputs_outputs, suggest
from stepframe.operators.forcing import apply_tables
from stepframe.plans import schedule
from stepframe.plans.catalog import catalog, declare, documented
from stepframe.plans.runtime import checkpoint_folder, loop
from stepframe.plans.schedule import actual, allocation, axial, deficit, postsegmentation, potential, priorbalance, rate, segmentation, selfbalance, state, stepinit, totalrate, totalstate
from stepframe.sources import tables
from stepframe.streaming.steps import StreamedRun, windowed

LABELS, KINDS = (1, 2, 5, 7, 9, 12), ("BUILDING", "MACHINERY", "HOUSEHOLD")
_FOCUS = "c_acctbal > 0 AND c_nationkey IN (1,2,5,7,9,12) AND c_mktsegment IN ('BUILDING','MACHINERY','HOUSEHOLD')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as vertices: balance as mass, nation as label, segment as type."""
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"), F.col("c_acctbal").alias("struct_mass"), F.col("c_nationkey").alias("label"), F.col("c_mktsegment").alias("type"))
    return df.withColumn("focus", focus_filter(labels=LABELS, kinds=KINDS))


def _var(kind="state_variable", state_kind="extensive", default=0.0):
    return declare("", "", "", "", "", "", "", "", kind, "", state_kind, "user", default=default)


@dataclass(init=False)
class Exuder(Component):
    exudation: float = _var()

    @rate
    def _exudation(self, struct_mass):
        return 0.1 * struct_mass + 1


@dataclass(init=False)
class Growth(Component):
    actual: float = _var()
    deficit: float = _var()

    @potential
    def _actual(self, struct_mass) -> tuple[float, str, float]:
        kept = minimum(struct_mass, 1000.0)
        return kept, "deficit", struct_mass - kept


@dataclass(init=False)
class Rates(Component):
    flow: float = _var()
    hexose: float = _var(default=1.0)

    @rate
    def _flow(self, hexose):
        return 1.0 + hexose

    @state
    def _hexose(self, hexose, struct_mass, flow):
        return hexose + (self.time_step / struct_mass) * flow


@dataclass(init=False)
class Sums(Component):
    total_mass: float = _var("plant_scale_state")

    @totalstate
    def _total_mass(self, struct_mass):
        return F.sum(struct_mass)


@dataclass(init=False)
class Halves(Component):
    h: float = _var()

    @state
    def _h(self, h):
        return h + 0.5 * h


@dataclass(init=False)
class Starved(Component):
    shortage: float = _var()

    @deficit
    def _shortage(self, struct_mass):
        return where(struct_mass < 5000.0, 5000.0 - struct_mass, 0.0)


def focus_query(spark, sf_dir):
    return vertices(spark, sf_dir).where("focus").select("vid")


def rate_masked(spark, sf_dir):
    c = Exuder()
    return c.step(c.link(vertices(spark, sf_dir))).select("vid", "exudation")


def deficit_where(spark, sf_dir):
    c = Starved()
    return c.step(c.link(vertices(spark, sf_dir))).select("vid", "shortage")


def euler_state(spark, sf_dir):
    c = Rates()
    return c.step(c.link(vertices(spark, sf_dir))).where("focus").select("vid", "hexose")


def multi_output(spark, sf_dir):
    c = Growth()
    return c.step(c.link(vertices(spark, sf_dir))).select("vid", "actual", "deficit")


def total_state(spark, sf_dir):
    c = Sums()
    return c.step(c.link(vertices(spark, sf_dir))).where("vid = 1").select("vid", F.round("total_mass", 4).alias("total_mass"))


def _suppliers(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"), F.lit(True).alias("focus"))


def pull_weighted(spark, sf_dir):
    c = Component()
    c.pullable_inputs["pulled"] = {"balance": 0.5, "nation": 1.0 / 12.0}
    return c.pull(_suppliers(spark, sf_dir)).select("vid", "pulled")


@dataclass(init=False)
class Linked(Component):
    v: float = _var("input", "", 7.0)
    w: float = _var("input", "", 9.0)
    size: float = _var(default=3.0)
    whole: float = _var("plant_scale_state", "", 5.0)


def link_default_fill(spark, sf_dir):
    """Inputs that lack a vertex get their default everywhere, complete ones stay; states and totals are set."""
    found = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("vid")).agg(F.max("o_totalprice").alias("v"))
    base = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"), F.col("c_acctbal").alias("w"))
    return Linked().link(base.join(found, "vid", "left")).select("vid", "v", "w", "size", "whole")


def _series(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("t"), F.col("value").alias("temperature"))


def forcing_vertex1(spark, sf_dir):
    df = vertices(spark, sf_dir).withColumn("temperature", F.lit(0.0))
    return apply_tables(df, _series(spark, sf_dir), 3, ["temperature"]).select("vid", "temperature")


def forcing_fill(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"))
    return apply_tables(df, _series(spark, sf_dir), 3, ["temperature"], fill=True).select("voxel", "temperature")


def temperature_response(spark, sf_dir):
    t = F.col("p_size").cast("double") * 2
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.round(temperature_modification(t), 8).alias("m"))


def substep2(spark, sf_dir):
    c = Halves(time_step=2, sub_time_step=1)
    return c.step(_suppliers(spark, sf_dir).withColumn("h", F.col("balance"))).select("vid", F.col("h").alias("h2"))


def _column(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"), F.col("c_acctbal").alias("v"))


def index_of(spark, sf_dir):
    df = _column(spark, sf_dir)
    return keyed.indices_of(df, df.select("vid")).select("vid", "idx")


def upsert(spark, sf_dir):
    df = _column(spark, sf_dir)
    return keyed.upsert(df.where("vid < 1000"), df.where("vid >= 900").select("vid", F.lit(0.0).alias("v")))


def scatter(spark, sf_dir):
    df = _column(spark, sf_dir)
    return keyed.scatter(df, df.where("vid % 7 = 3").select("vid", F.lit(-1.0).alias("v")))


def delete_keys(spark, sf_dir):
    return keyed.delete(_column(spark, sf_dir), _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vid")))


def assign_at(spark, sf_dir):
    return keyed.assign_at(_column(spark, sf_dir), spark.createDataFrame([(0, 7.0), (2, 9.0)], "idx long, v double"))


def aligned_columns(spark, sf_dir):
    a, b = _column(spark, sf_dir), _suppliers(spark, sf_dir).select("vid", F.col("balance").alias("v"))
    return keyed.aligned({"customer": a, "supplier": b}, strict=False)


def check_invariant(spark, sf_dir):
    return keyed.check_invariant(_column(spark, sf_dir))


def stand_layout(spark, sf_dir):
    x = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("row"))
    grid = x.crossJoin(F.broadcast(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number"))))  # 5 x 25 places, the grid itself
    placed = scene.place_plants(grid, F.col("row"), F.col("number"), 41, 1.0, 0.15, 0.025, None)
    return placed.select((F.col("row") * 41 + F.col("number")).alias("plant_no"), F.round("x", 9).alias("px"), F.round("y", 9).alias("py"), F.col("z").alias("pz"))


def model_pick(spark, sf_dir):
    u = (F.col("vid") % 1000) / F.lit(1000.0)
    return _column(spark, sf_dir).select("vid", scene.pick(u, (0.3, 0.7)).alias("model"))


def exchange(spark, sf_dir):
    plants = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"), F.col("c_nationkey").alias("voxel"), F.col("c_acctbal").alias("uptake"))
    soil = scene.demand(plants, "voxel", {"soil_signal": "uptake"}).withColumn("soil_signal", F.round("soil_signal", 4))
    return scene.exchange(plants, soil, "voxel", ["soil_signal"]).select("vid", "soil_signal")


def component_io(spark, sf_dir):
    ins, _ = inputs_outputs(edge_table(spark, TRANSLATOR), "Mineral")
    return ins.select(F.lit("Mineral").alias("receiver"), F.col("name").alias("source_var"))


def schedule_order(spark, sf_dir):
    found = [schedule.Process(n, len, (n,), "", i) for i, n in enumerate(("rate", "state", "potential", "axial", "priorbalance"))]
    rows = [(p.name, k + 1) for k, (_, group) in enumerate(schedule.ordered(found)) for p in group]
    return spark.createDataFrame(rows, "name string, pos long")


def time_loop(spark, sf_dir):
    """The three example components, coupled over all customers, for three steps."""
    df = vertices(spark, sf_dir)
    parts = {name: kind() for name, kind in COMPONENTS.items()}
    for c in parts.values():
        df = c.link(df, ignore=[n for n in c.inputs if n in df.columns])
    model = Composite()
    model.declare_data_and_couple_components(parts, TRANSLATOR, root=df)

    def step(df: DataFrame, t: int) -> DataFrame:
        model.data["root"] = df
        model.run()
        return model.data["root"]

    return loop(model.data["root"], step, 3, every=2).where("focus").select("vid", "starch", "nitrate", "water")


def affinity(spark, sf_dir):
    free = _table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("cpu"))
    return scene.affinity(free, 4, 2).select("worker", "cpu")


SELECTORS = (
    "inputs", "state_variables", "extensive_variables", "massic_concentration", "intensive_variables", "non_inertial_extensive", "non_inertial_intensive", "non_inertial_variables",
    "descriptor", "plant_scale_state", "parameter",
)


def catalog_selectors(spark, sf_dir):
    rows = [(name, kind, n) for name, c in COMPONENTS.items() for kind in SELECTORS for n in getattr(c(), kind)]
    return spark.createDataFrame(rows, "component string, selector string, name string")


def documentation_lines(spark, sf_dir):
    return documented(catalog(spark, [Starch]), {"variable_type": ["input"]}).select("component", "position", "line")


def columnised(spark, sf_dir):
    df = _table(spark, sf_dir, "nation")
    return keyed.columnised(df, "n_nationkey", ignore=[])


def windowed_forcing(spark, sf_dir):
    out = windowed(_table(spark, sf_dir, "events"), "ts", "1 day", "1 hour", {"v": "value"}, "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", F.round("v", 4).alias("v"))


def total_by_plant(spark, sf_dir):
    df = vertices(spark, sf_dir).withColumns({"plant": F.col("label"), "vid": F.row_number().over(W.partitionBy("label").orderBy("vid")).cast("long")})
    c = Sums()
    c.plant = "plant"
    return c.step(c.link(df)).where("vid = 1").select("plant", F.round("total_mass", 4).alias("total_mass"))


def scene_loop(spark, sf_dir):
    """Two steps of a scene: plants change what they take up, voxels lose what is asked, plants get the answer."""
    plants = vertices(spark, sf_dir).select("vid", F.col("label").alias("voxel"), F.greatest("struct_mass", F.lit(0.0)).alias("uptake")).withColumn("water", F.lit(0.0))
    soil = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("voxel"), F.lit(1e6).alias("water"), F.lit(0.0).alias("asked"))
    dry = lambda s, t: s.withColumn("water", F.col("water") - F.col("asked"))
    grow = lambda df, t: df.withColumn("uptake", F.col("uptake") * 0.5 + 1.0)
    end, _ = scene.play(plants, soil, grow, dry, "voxel", {"asked": "uptake"}, ["water"], steps=2)
    return end.select("vid", "uptake", F.round("water", 4).alias("water"))


@dataclass(init=False)
class Mirror(Component):
    copied: float = _var("input")
    doubled: float = _var()

    @state
    def _copied(self, copied):
        return copied + 1

    @state
    def _doubled(self, copied):
        return copied * 2


def alias_coupling(spark, sf_dir):
    """A write through an alias is a write to the column it stands for, and later processes see it."""
    c = Mirror()
    couple(c, "Mirror", ["Bank"], {"Mirror": {"Bank": {"copied": {"balance": 1.0}}}})
    df = _suppliers(spark, sf_dir).withColumn("doubled", F.lit(0.0))
    return c.step(df).select("vid", "balance", "doubled")


def coupled_conversion(spark, sf_dir):
    c = Mirror()
    couple(c, "Mirror", ["Bank"], {"Mirror": {"Bank": {"copied": {"balance": "1/12", "nation": "2*3"}}}})
    return c.pull(_suppliers(spark, sf_dir)).select("vid", F.round("copied", 8).alias("copied"))


def component_outputs(spark, sf_dir):
    _, outs = inputs_outputs(edge_table(spark, TRANSLATOR), "Starch")
    return outs.select(F.col("name").alias("source_var"))


def keyed_items(spark, sf_dir):
    """Set default (of a key that is there, and of the first that is not), pop and overwrite on one keyed column."""
    df = _column(spark, sf_dir)
    after = df.agg(F.max("vid")).first()[0] + 1
    df = keyed.set_default(keyed.set_default(df, 7, -5.0), after, -5.0)
    return keyed.set_item(keyed.pop(df, 3)[1], 5, 55.0)


@dataclass(init=False)
class EveryStep(Component):
    """One process for each step; what is left in x tells their order."""

    x: float = _var()
    rates: float = _var("plant_scale_state")
    states: float = _var("plant_scale_state")

    @state
    def _x(self, x):
        return x * 2 + 9

    @rate
    def _rated(self, x):
        return x * 2 + 8

    @stepinit
    def _begin(self, df):
        return df.withColumn("x", F.when(F.col("focus"), F.col("rated")).otherwise(F.col("x")) * 2 + 7)

    @totalrate
    def _rates(self, x):
        return F.sum(x)

    @totalstate
    def _states(self, x):
        return F.max(x)

    @axial
    def _ax(self, x):
        return x * 2 + 6

    @potential
    def _p(self, x):
        return x * 2 + 1

    @deficit
    def _d(self, p):
        return p * 2 + 2

    @allocation
    def _al(self, d):
        return d * 2 + 3

    @actual
    def _ac(self, al):
        return al * 2 + 4

    @segmentation
    def _s(self, ac):
        return ac * 2 + 5

    @postsegmentation
    def _rated_first(self, s):
        return s * 2 + 5.5

    @priorbalance
    def _prior(self, df):
        return df.withColumn("x", F.col("x") * 3)

    @selfbalance
    def _self(self, df):
        return df.withColumn("x", F.col("x") + 1)


def all_steps(spark, sf_dir):
    c = EveryStep()
    df = c.link(vertices(spark, sf_dir)).withColumns({"x": F.col("vid").cast("double"), "rated": F.lit(1.0)})
    return c.step(df).select("vid", "x", "rates", "states", "ax", "p", "d", "al", "ac", "s", "rated_first", "rated")


@dataclass(init=False)
class Scaled(Exuder):
    factor: float = _var("parameter", "", 1.0)

    @rate
    def _exudation(self, struct_mass):
        return self.factor * struct_mass

    @rate
    def _second(self, exudation):
        return exudation + 1


def override_and_scenario(spark, sf_dir):
    """An inherited process is replaced, another is added after it, and a scenario sets the parameter."""
    c = Scaled(factor=0.25)
    return c.step(c.link(vertices(spark, sf_dir))).select("vid", "exudation", "second")


class Reordered(Scaled):
    schedule = (("state",), ("rate",))

    @state
    def _late(self, exudation):
        return exudation * 2


def custom_schedule(spark, sf_dir):
    """A schedule of its own that runs states after rates, by rows."""
    c = Reordered()
    return c.step(c.link(vertices(spark, sf_dir))).select("vid", "late")


@dataclass(init=False)
class Grid(Component):
    compartment = "soil"
    moisture: float = _var(default=2.0)

    @rate
    def _moisture(self, moisture, size):
        return moisture * size


def whole_array(spark, sf_dir):
    """A soil component replaces whole columns: no focus."""
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("size"))
    c = Grid()
    return c.step(c.link(df)).select("vid", "moisture")


@dataclass(init=False)
class Branches(Component):
    """Bodies in plain Python. Out of focus are vertices of mass 0 and less, which would divide by 0."""

    tax = 0.125

    @rate
    def _share(self, struct_mass, size):
        rest = max(size, 2.0) - min(abs(struct_mass), 5.0)
        if struct_mass > 5000.0 and not size == 3.0:
            return rest / struct_mass
        elif 100.0 < struct_mass <= 2000.0:
            rest = rest * self.tax
        return rest if rest > 0.0 else -1.0


def _sized(spark, sf_dir):
    return vertices(spark, sf_dir).withColumn("size", F.col("label").cast("double"))


def python_branches(spark, sf_dir):
    c = Branches()
    return c.step(_sized(spark, sf_dir)).select("vid", "share")


@dataclass(init=False)
class Digits(Component):
    @rate
    def _odd(self, struct_mass, size):
        return float(math.floor(size / struct_mass * 1000.0) % 7)

    @rate
    def _low(self, size) -> tuple[float, str, float]:
        parts = divmod(int(size), 4)
        return float(parts[0]), "high", float(parts[1])


def python_rows(spark, sf_dir):
    """Bodies that need Python's values, one with two outputs."""
    c = Digits()
    return c.step(_sized(spark, sf_dir)).select("vid", "odd", "low", "high")


@dataclass(init=False)
class Weighed(Component):
    plant = "plant"

    @totalstate
    def _mass(self, struct_mass):
        return sum(struct_mass.values()) / len(struct_mass.values())

    @totalstate
    def _heaviest(self, struct_mass) -> tuple[float, str, float]:
        top = sorted(struct_mass, key=lambda v: (-struct_mass[v], v))[0]
        return struct_mass[top], "where", float(top)


def python_total(spark, sf_dir):
    """Totals of whole mappings by plant: one becomes an aggregate, one needs Python."""
    df = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("plant")).agg(F.min("o_orderkey").alias("least"))
    df = _table(spark, sf_dir, "orders").join(df, F.col("o_custkey") == F.col("plant")).select("plant", (F.col("o_orderkey") - F.col("least") + 1).alias("vid"), F.col("o_totalprice").alias("struct_mass"))
    return Weighed().step(df.withColumn("focus", F.lit(True))).where("vid = 1").select("plant", F.round("mass", 4).alias("mass"), "heaviest", "where")


def null_updates(spark, sf_dir):
    """Changes to null are changes: by upsert, scatter and position."""
    df = _column(spark, sf_dir)
    none = F.lit(None).cast("double").alias("v")
    df = keyed.upsert(df, df.where("vid % 5 = 1").select("vid", none))
    df = keyed.scatter(df, df.where("vid % 5 = 2").select("vid", none))
    return keyed.assign_at(df, keyed.positions(df).where("idx % 5 = 2").select("idx", none))


def assign_all(spark, sf_dir):
    df = _column(spark, sf_dir)
    return keyed.assign_all(df, keyed.positions(df).select("idx", (F.col("idx") * 0.5).alias("v")))


def keys_and_values(spark, sf_dir):
    """Keys and values in key order, put side by side by position."""
    df = _column(spark, sf_dir)
    at = keyed.positions(keyed.keys(df))
    return at.join(keyed.positions(df).select("idx", "v"), "idx").select("idx", "vid", "v")


def column_length(spark, sf_dir):
    return keyed.length(_column(spark, sf_dir))


def key_difference(spark, sf_dir):
    return keyed.difference(_column(spark, sf_dir), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid")))


def short_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", keyed.short_hash(F.col("n_name")).alias("h"))


def any_busy(spark, sf_dir):
    return scene.any_busy(_table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 9990).alias("busy")))


def stand_plants(spark, sf_dir):
    """The default scene of one model, exactly placed."""
    return scene.stand(spark, "field", ["bean"], exact=True).select("plant_id", F.round("x", 9).alias("px"), F.round("y", 9).alias("py"), F.col("z").alias("pz"))


def stop_signal(spark, sf_dir):
    return loop(_column(spark, sf_dir), lambda df, t: df.withColumn("v", F.col("v") + (t + 1)), 10, stop=lambda t: t == 3)


def _folder(spark, name: str) -> str:
    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def logged_snapshots(spark, sf_dir):
    """Every second state of a loop, as the sink wrote it."""
    path = _folder(spark, "log")
    loop(_column(spark, sf_dir), lambda df, t: df.withColumn("v", F.col("v") * 0.5), 4, on_step=tables.snapshots(path, every=2))
    return spark.read.schema("vid long, v double, scene string, t int").parquet(path).select("t", "vid", "v")


def replaced_outputs(spark, sf_dir):
    """A scene's outputs are written anew, by plant."""
    path, df = _folder(spark, "outputs"), _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").cast("int").alias("plant"))
    tables.fresh(df, path, ("plant",))
    tables.fresh(df.withColumn("v", F.col("v") + 1.0), path, ("plant",))
    return spark.read.schema("vid long, v double, plant int").parquet(path)


def stored_table(spark, sf_dir):
    return tables.table(spark, f"{sf_dir}/supplier.parquet", "s_suppkey").select("vid", "s_name", "s_acctbal")


def in_memory_properties(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").collect()  # 25 rows
    return tables.properties(spark, {"region": {r.n_nationkey: r.n_regionkey for r in rows if r.n_regionkey}, "name": {r.n_nationkey: r.n_name for r in rows}})


def forcing_file(spark, sf_dir):
    """A forcing series written and read as CSV."""
    path = _folder(spark, "forcing")
    _series(spark, sf_dir).write.csv(path, header=True)
    return tables.forcing_csv(spark, path, ["temperature"])


def suggested_edges(spark, sf_dir):
    found = suggest({name: kind() for name, kind in COMPONENTS.items()})
    return edge_table(spark, found).select("receiver", "applier", "input_var")


def subcategory_pull(spark, sf_dir):
    """Sources of several receivers' inputs kept under a subcategory are pulled like others."""
    c = Component()
    couple(c, "Mirror", ["Bank"], {"Mirror": {"Bank": {"half": {"balance": 0.5}, "both": {"balance": 1.0, "nation": 2.0}}}}, shared=False, subcategory="soil")
    return c.pull(_suppliers(spark, sf_dir)).select("vid", "half", "both")


def scalar_temperature(spark, sf_dir):
    """Other parameters of the temperature response: C = 0 is linear."""
    t = F.col("p_size").cast("double")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.round(temperature_modification(t, C=0.0, A=0.5, B=2.0), 8).alias("m"))


def streamed_windows(spark, sf_dir):
    """``windowed_forcing`` over a stream of the events file, with its watermark."""
    schema, name = _table(spark, sf_dir, "events").schema, f"windows_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    out = windowed(stream, "ts", "1 day", "1 hour", {"v": "value"}, "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", F.round("v", 4).alias("v"))
    out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark, "windows")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def streamed_steps(spark, sf_dir):
    """A stream of five forcing rows steps the state of all customers; the state of each batch is kept."""
    stream = spark.readStream.schema(_table(spark, sf_dir, "region").schema).parquet(f"{sf_dir}/region.parque[t]").select(F.col("r_regionkey").cast("int").alias("t"), (F.col("r_regionkey") * 2.0).alias("temperature"))

    def step(state: DataFrame, forcing: DataFrame, t: int) -> DataFrame:
        return apply_tables(state, forcing, t, ["temperature"], fill=True).withColumn("v", F.col("v") * 0.5 + F.col("temperature"))

    run = StreamedRun(_column(spark, sf_dir).withColumn("temperature", F.lit(0.0)), step, _folder(spark, "states"))
    run.start(stream, _folder(spark, "steps")).awaitTermination()
    return run.state.select("vid", "v")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "focus_filter": focus_query, "rate_masked": rate_masked, "deficit_where": deficit_where, "euler_state": euler_state, "multi_output": multi_output, "total_state": total_state,
    "pull_weighted": pull_weighted, "link_default_fill": link_default_fill, "forcing_vertex1": forcing_vertex1, "forcing_fill": forcing_fill,
    "temperature_response": temperature_response, "substep2": substep2, "index_of": index_of, "upsert": upsert, "scatter": scatter, "delete_keys": delete_keys,
    "assign_at": assign_at, "aligned_columns": aligned_columns, "check_invariant": check_invariant, "stand_layout": stand_layout, "model_pick": model_pick,
    "exchange": exchange, "component_io": component_io, "schedule": schedule_order, "time_loop": time_loop, "affinity": affinity,
    "total_by_plant": total_by_plant, "scene_loop": scene_loop, "alias_coupling": alias_coupling, "coupled_conversion": coupled_conversion,
    "component_outputs": component_outputs, "keyed_items": keyed_items,
    "all_steps": all_steps, "override_and_scenario": override_and_scenario, "custom_schedule": custom_schedule, "whole_array": whole_array,
    "python_branches": python_branches, "python_rows": python_rows, "python_total": python_total, "null_updates": null_updates, "assign_all": assign_all,
    "keys_and_values": keys_and_values, "column_length": column_length, "key_difference": key_difference, "short_hashes": short_hashes, "any_busy": any_busy,
    "stand_plants": stand_plants, "stop_signal": stop_signal, "logged_snapshots": logged_snapshots, "replaced_outputs": replaced_outputs, "stored_table": stored_table,
    "in_memory_properties": in_memory_properties, "forcing_file": forcing_file, "suggested_edges": suggested_edges, "subcategory_pull": subcategory_pull,
    "scalar_temperature": scalar_temperature, "streamed_windows": streamed_windows, "streamed_steps": streamed_steps,
    "catalog_selectors": catalog_selectors, "documentation_lines": documentation_lines, "columnised": columnised, "windowed_forcing": windowed_forcing,
}

ORACLE_SQL: dict[str, str] = {
    "total_by_plant": "SELECT c_nationkey AS plant, round(sum(c_acctbal), 4) AS total_mass FROM customer GROUP BY c_nationkey",
    "scene_loop": "WITH p AS (SELECT c_custkey AS vid, c_nationkey AS voxel, greatest(c_acctbal, 0E0)*0.5E0+1E0 AS u FROM customer), a AS (SELECT voxel, sum(u) AS s1, sum(u*0.5E0+1E0) AS s2 FROM p GROUP BY voxel) SELECT vid, u*0.5E0+1E0 AS uptake, round(1E6 - s1 - s2, 4) AS water FROM p JOIN a USING (voxel)",
    "alias_coupling": "SELECT s_suppkey AS vid, s_acctbal + 1 AS balance, (s_acctbal + 1) * 2 AS doubled FROM supplier",
    "coupled_conversion": "SELECT s_suppkey AS vid, round(s_acctbal * (1E0/12E0) + s_nationkey * 6E0, 8) AS copied FROM supplier",
    "component_outputs": "SELECT * FROM (VALUES ('starch')) AS t(source_var)",
    "keyed_items": "SELECT c_custkey AS vid, CASE WHEN c_custkey = 5 THEN 55E0 ELSE c_acctbal END AS v FROM customer WHERE c_custkey <> 3 UNION ALL SELECT max(c_custkey) + 1, -5E0 FROM customer",
    "focus_filter": f"SELECT c_custkey AS vid FROM customer WHERE {_FOCUS}",
    "rate_masked": f"SELECT c_custkey AS vid, CASE WHEN {_FOCUS} THEN 0.1E0*c_acctbal+1E0 ELSE 0E0 END AS exudation FROM customer",
    "deficit_where": f"SELECT c_custkey AS vid, CASE WHEN {_FOCUS} AND c_acctbal < 5E3 THEN 5E3 - c_acctbal ELSE 0E0 END AS shortage FROM customer",
    "euler_state": f"SELECT vid, hexose+(3600E0/mass)*rate AS hexose FROM (SELECT c_custkey vid, c_acctbal mass, 1E0 hexose, 1E0+1E0 rate FROM customer WHERE {_FOCUS}) t",
    "multi_output": f"SELECT c_custkey AS vid, CASE WHEN {_FOCUS} THEN least(c_acctbal,1000E0) ELSE 0E0 END AS actual, CASE WHEN {_FOCUS} THEN c_acctbal-least(c_acctbal,1000E0) ELSE 0E0 END AS deficit FROM customer",
    "total_state": "SELECT CAST(1 AS BIGINT) AS vid, round(sum(c_acctbal),4) AS total_mass FROM customer",
    "pull_weighted": "SELECT s_suppkey AS vid, s_acctbal*0.5E0+CAST(s_nationkey AS DOUBLE)*(1E0/12E0) AS pulled FROM supplier",
    "link_default_fill": "WITH o AS (SELECT o_custkey k, max(o_totalprice) v FROM orders GROUP BY o_custkey), j AS (SELECT c_custkey AS vid, o.v, c_acctbal AS w FROM customer LEFT JOIN o ON c_custkey = o.k) SELECT vid, CASE WHEN (SELECT count(*) = count(v) FROM j) THEN v ELSE 7E0 END AS v, w, 3E0 AS size, CASE WHEN vid = 1 THEN 5E0 END AS whole FROM j",
    "forcing_vertex1": "SELECT c.c_custkey AS vid, CASE WHEN c.c_custkey=1 THEN f.value ELSE 0E0 END AS temperature FROM customer c CROSS JOIN (SELECT value FROM events WHERE event_id=3) f",
    "forcing_fill": "SELECT p.p_partkey AS voxel, f.value AS temperature FROM part p CROSS JOIN (SELECT value FROM events WHERE event_id=3) f",
    "temperature_response": "SELECT p_partkey AS vid, CASE WHEN -0.05E0*(2E0*p_size)+3E0 < 0E0 THEN 0E0 ELSE round(greatest(power(-0.05E0*(2E0*p_size)+3E0,(2E0*p_size)/10E0),0E0),8) END AS m FROM part",
    "substep2": "SELECT s_suppkey AS vid, ((s_acctbal+0.5E0*s_acctbal)+0.5E0*(s_acctbal+0.5E0*s_acctbal)) AS h2 FROM supplier",
    "index_of": "SELECT c_custkey AS vid, row_number() OVER (ORDER BY c_custkey)-1 AS idx FROM customer",
    "upsert": "SELECT coalesce(u.k,b.k) AS vid, coalesce(u.v,b.v) AS v FROM (SELECT c_custkey k,c_acctbal v FROM customer WHERE c_custkey<1000) b FULL OUTER JOIN (SELECT c_custkey k,0E0 v FROM customer WHERE c_custkey>=900) u ON b.k=u.k",
    "scatter": "SELECT c_custkey AS vid, CASE WHEN c_custkey % 7 = 3 THEN -1E0 ELSE c_acctbal END AS v FROM customer",
    "delete_keys": "SELECT c_custkey AS vid, c_acctbal AS v FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey=c.c_custkey)",
    "assign_at": "SELECT vid, CASE WHEN idx IN (0,2) THEN CAST(idx+7 AS DOUBLE) ELSE v END AS v FROM (SELECT c_custkey vid,c_acctbal v,row_number() OVER (ORDER BY c_custkey)-1 idx FROM customer) t",
    "aligned_columns": "SELECT c_custkey AS vid, c_acctbal AS customer, s_acctbal AS supplier FROM customer JOIN supplier ON c_custkey = s_suppkey",
    "check_invariant": "SELECT count(*)=count(DISTINCT c_custkey) AS ok FROM customer",
    "stand_layout": "SELECT x.r*41+y.r AS plant_no, round(0.15E0/2+x.r*0.15E0,9) AS px, round((1E0/41)/2+y.r*(1E0/41),9) AS py, -0.025E0 AS pz FROM (SELECT r_regionkey AS r FROM region) x CROSS JOIN (SELECT n_nationkey AS r FROM nation) y",
    "model_pick": "SELECT c_custkey AS vid, CASE WHEN d>0E0 AND d<=0.3E0 THEN 0 WHEN d>0.3E0 AND d<=1E0 THEN 1 ELSE -1 END AS model FROM (SELECT c_custkey,(c_custkey%1000)/1000E0 AS d FROM customer) t",
    "exchange": "WITH demand AS (SELECT c_nationkey voxel, round(sum(c_acctbal),4) tot FROM customer GROUP BY c_nationkey) SELECT c.c_custkey AS vid, d.tot AS soil_signal FROM customer c JOIN demand d ON c.c_nationkey=d.voxel",
    "component_io": "SELECT DISTINCT receiver, source_var FROM (VALUES ('Starch','Mineral','nitrate'),('Mineral','Starch','starch'),('Mineral','SoilModel','water'),('SoilModel','Mineral','uptake')) AS t(receiver,applier,source_var) WHERE receiver='Mineral'",
    "schedule": "SELECT name, CAST(row_number() OVER (ORDER BY a,b,c,d) AS BIGINT) AS pos FROM (VALUES ('rate',0,2,0,0),('state',0,4,0,0),('potential',0,0,0,1),('axial',0,0,1,0),('priorbalance',1,0,0,0)) AS t(name,a,b,c,d)",
    "time_loop": f"WITH RECURSIVE r(vid,mass,t,starch,nitrate,water) AS (SELECT c_custkey, c_acctbal, 0, 2E0, 1E0, 64E0 FROM customer WHERE {_FOCUS} UNION ALL SELECT vid, mass, t+1, starch + 3600E0*(0.25E0*4E0*(1E0-0E0)+0.5E0*nitrate)/(mass+1000E0), nitrate+0.25E0*greatest(3E0-nitrate,0E0), water-0.5E0*greatest(3E0-nitrate,0E0) FROM r WHERE t<3) SELECT vid, starch, nitrate, water FROM r WHERE t=3",
    "affinity": "SELECT worker, cpu FROM (SELECT n_nationkey AS cpu, CAST(floor((row_number() OVER (ORDER BY n_nationkey)-1)/2) AS BIGINT) AS worker FROM nation WHERE n_nationkey%2=0) t WHERE worker<4",
    "catalog_selectors": "SELECT * FROM (VALUES ('Starch','inputs','nitrate'),('Starch','inputs','light'),('Starch','state_variables','starch'),('Starch','state_variables','gain'),('Starch','state_variables','vigour'),('Starch','state_variables','shade'),('Starch','state_variables','surface'),('Starch','state_variables','rank'),('Starch','extensive_variables','surface'),('Starch','massic_concentration','starch'),('Starch','intensive_variables','vigour'),('Starch','non_inertial_extensive','gain'),('Starch','non_inertial_intensive','shade'),('Starch','non_inertial_variables','gain'),('Starch','non_inertial_variables','shade'),('Starch','descriptor','rank'),('Starch','plant_scale_state','reserve'),('Starch','parameter','efficiency'),('Mineral','inputs','starch'),('Mineral','inputs','water'),('Mineral','state_variables','nitrate'),('Mineral','state_variables','uptake'),('Mineral','massic_concentration','nitrate'),('Mineral','non_inertial_extensive','uptake'),('Mineral','non_inertial_variables','uptake'),('SoilModel','inputs','uptake'),('SoilModel','state_variables','water'),('SoilModel','extensive_variables','water')) AS t(component,selector,name)",
    "documentation_lines": "SELECT 'Starch' AS component, CAST(p AS INTEGER) AS position, rpad(n,31,' ') || ' | ' || rpad(u,31,' ') || ' | ' || rpad('',31,' ') || ' | ' || rpad('',91,' ') || repeat(' | ' || rpad('',31,' '), 5) || ' | ' || rpad('input',31,' ') || ' | ' || rpad(b,31,' ') || ' | ' || rpad('',31,' ') || ' | ' || rpad('user',31,' ') AS line FROM (VALUES (0,'nitrate','mol/g','mineral'),(1,'light','W/m2','weather')) AS t(p,n,u,b)",
    "columnised": "SELECT n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation",
    "windowed_forcing": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    "all_steps": f"WITH v AS (SELECT c_custkey AS vid, c_acctbal AS mass, CAST(c_nationkey AS DOUBLE) AS size, ({_FOCUS}) AS f FROM customer), g AS (SELECT vid, f, CAST(vid AS DOUBLE) AS x0, CASE WHEN f THEN (vid*2E0+1E0) END AS p FROM v), h AS (SELECT *, p*2+2 AS d FROM g), i AS (SELECT *, d*2+3 AS al FROM h), j AS (SELECT *, al*2+4 AS ac FROM i), k AS (SELECT *, ac*2+5 AS s, CASE WHEN f THEN x0*2+6 END AS ax, (CASE WHEN f THEN 1E0 ELSE x0 END)*2+7 AS x1 FROM j), l AS (SELECT *, CASE WHEN f THEN x1*2+8 ELSE 1E0 END AS rated FROM k), m AS (SELECT *, CASE WHEN f THEN x1*2+9 ELSE x1 END AS x2, (SELECT sum(x1) FROM l) AS rates FROM l) SELECT vid, x2*3+1 AS x, CASE WHEN vid=1 THEN rates END AS rates, CASE WHEN vid=1 THEN (SELECT max(x2) FROM m) END AS states, ax, p, d, al, ac, s, s*2+5.5E0 AS rated_first, rated FROM m",
    "override_and_scenario": f"SELECT vid, CASE WHEN f THEN 0.25E0*mass ELSE 0E0 END AS exudation, CASE WHEN f THEN 0.25E0*mass+1E0 END AS second FROM (SELECT c_custkey AS vid, c_acctbal AS mass, CAST(c_nationkey AS DOUBLE) AS size, ({_FOCUS}) AS f FROM customer) t",
    "custom_schedule": f"SELECT vid, CASE WHEN f THEN mass*2E0 END AS late FROM (SELECT c_custkey AS vid, c_acctbal AS mass, CAST(c_nationkey AS DOUBLE) AS size, ({_FOCUS}) AS f FROM customer) t",
    "whole_array": "SELECT p_partkey AS vid, 2E0*p_size AS moisture FROM part",
    "python_branches": f"WITH v AS (SELECT c_custkey AS vid, c_acctbal AS mass, CAST(c_nationkey AS DOUBLE) AS size, ({_FOCUS}) AS f FROM customer), r AS (SELECT *, greatest(size,2E0)-least(abs(mass),5E0) AS rest FROM v), q AS (SELECT *, CASE WHEN mass>100E0 AND mass<=2000E0 THEN rest*0.125E0 ELSE rest END AS rest2 FROM r) SELECT vid, CASE WHEN NOT f THEN NULL WHEN mass>5000E0 AND size<>3E0 THEN rest/mass WHEN rest2>0E0 THEN rest2 ELSE -1E0 END AS share FROM q",
    "python_rows": f"WITH v AS (SELECT c_custkey AS vid, c_acctbal AS mass, CAST(c_nationkey AS DOUBLE) AS size, ({_FOCUS}) AS f FROM customer), r AS (SELECT vid, f, CASE WHEN f THEN floor(size/mass*1000E0) END AS k, CASE WHEN f THEN size END AS size FROM v) SELECT vid, k-7E0*floor(k/7E0) AS odd, floor(size/4E0) AS low, size-4E0*floor(size/4E0) AS high FROM r",
    "python_total": "WITH o AS (SELECT o_custkey AS plant, o_orderkey-min(o_orderkey) OVER (PARTITION BY o_custkey)+1 AS vid, o_totalprice AS p FROM orders) SELECT plant, round(avg(p),4) AS mass, max(p) AS heaviest, CAST(first(vid ORDER BY p DESC, vid) AS DOUBLE) AS \"where\" FROM o GROUP BY plant",
    "null_updates": "SELECT c_custkey AS vid, CASE WHEN c_custkey % 5 IN (1,2) OR (row_number() OVER (ORDER BY c_custkey)-1) % 5 = 2 THEN NULL ELSE c_acctbal END AS v FROM customer",
    "assign_all": "SELECT c_custkey AS vid, (row_number() OVER (ORDER BY c_custkey)-1)*0.5E0 AS v FROM customer",
    "keys_and_values": "SELECT row_number() OVER (ORDER BY c_custkey)-1 AS idx, c_custkey AS vid, c_acctbal AS v FROM customer",
    "column_length": "SELECT count(*) AS n FROM customer",
    "key_difference": "SELECT c_custkey AS vid FROM customer EXCEPT SELECT o_custkey FROM orders",
    "short_hashes": "SELECT n_nationkey, substr(sha1(n_name),1,16) AS h FROM nation",
    "any_busy": "SELECT coalesce(bool_or(c_acctbal > 9990), false) AS busy FROM customer",
    "stand_plants": "SELECT 'bean_' || i || '_field' AS plant_id, round(0.15E0/2+(i//41)*0.15E0,9) AS px, round((1E0/41)/2+(i%41)*(1E0/41),9) AS py, -0.025E0 AS pz FROM range(246) AS t(i)",
    "stop_signal": "SELECT c_custkey AS vid, c_acctbal+1E0+2E0+3E0 AS v FROM customer",
    "logged_snapshots": "SELECT 0 AS t, c_custkey AS vid, c_acctbal AS v FROM customer UNION ALL SELECT 2, c_custkey, c_acctbal*0.5E0*0.5E0 FROM customer",
    "replaced_outputs": "SELECT s_suppkey AS vid, s_acctbal+1E0 AS v, CAST(s_nationkey AS INTEGER) AS plant FROM supplier",
    "stored_table": "SELECT s_suppkey AS vid, s_name, s_acctbal FROM supplier",
    "in_memory_properties": "SELECT CAST(n_nationkey AS BIGINT) AS vid, CASE WHEN n_regionkey<>0 THEN CAST(n_regionkey AS DOUBLE) END AS region, n_name AS name FROM nation",
    "forcing_file": "SELECT CAST(event_id AS INTEGER) AS t, value AS temperature FROM events",
    "suggested_edges": "SELECT * FROM (VALUES ('Starch','Mineral','nitrate'),('Mineral','Starch','starch'),('Mineral','SoilModel','water'),('SoilModel','Mineral','uptake')) AS t(receiver,applier,input_var)",
    "subcategory_pull": "SELECT s_suppkey AS vid, s_acctbal*0.5E0 AS half, s_acctbal+2E0*s_nationkey AS \"both\" FROM supplier",
    "scalar_temperature": "SELECT p_partkey AS vid, round(greatest(0.5E0*p_size+2E0,0E0),8) AS m FROM part",
    "streamed_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    "streamed_steps": "SELECT c_custkey AS vid, ((((c_acctbal*0.5E0+0E0)*0.5E0+2E0)*0.5E0+4E0)*0.5E0+6E0)*0.5E0+8E0 AS v FROM customer",
}
