import math
import random
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from stepframe.functions.numerics import maximum, minimum, temperature_modification
from stepframe.models import TRANSLATOR, Mineral, Pool, Starch
from stepframe.operators import coupling, keyed, scene
from stepframe.operators.component import Component
from stepframe.operators.forcing import apply_tables, owners
from stepframe.plans import catalog, schedule
from stepframe.plans.runtime import loop
from stepframe.plans.schedule import actual, axial, potential, priorbalance, rate, state, stepinit, totalstate
from stepframe.queries import _var
from stepframe.sources import tables

#: Golden trace of a level that grows by itself and what it gives off (one vertex, 3600 s, mass 0.001): both after each step (fixed values).
TRACE = [
    (3600000.0, 3600.0),
    (12960007200000.0, 12960007200.0),
    (4.66560388800108e19, 4.66560388800108e16),
    (1.6796178662407773e26, 1.6796178662407774e23),
    (6.046625998084665e32, 6.046625998084664e29),
    (2.1767859639730792e39, 2.1767859639730792e36),
]


@dataclass(init=False)
class Level(Component):
    level: float = _var("state_variable", "massic_concentration")
    out: float = _var("state_variable", "NonInertialExtensive")

    @rate
    def _out(self, level):
        return 1 + level

    @actual
    @state
    def _level(self, out, level, struct_mass):
        return level + self.time_step / struct_mass * out


@dataclass(init=False)
class Sink(Component):
    out: float = _var("input", "")
    caught: float = _var()

    @state
    def _caught(self, out, caught):
        return caught + self.time_step * out


def vertex_table(spark, rows):
    return spark.createDataFrame(rows, "vid long, struct_mass double, label int, type int")


def test_single_component(spark):
    c = Level()
    df = c.step(c.link(vertex_table(spark, [(1, 0.001, 2, 7), (2, 0.001, 2, 5), (3, float("nan"), 1, 1), (4, 0.0, 1, 1), (5, None, 1, 1)])))
    got = {r.vid: (r.level, r.out) for r in df.collect()}
    assert got[1] == (3.6e6, 1.0) and all(got[k] == (0.0, 0.0) for k in (2, 3, 4, 5))


def test_assembly_follows_the_golden_trace(spark):
    level, sink, model = Level(), Sink(), coupling.Composite()
    df = level.link(vertex_table(spark, [(1, 0.001, 2, 7)]))
    model.declare_data_and_couple_components({"Level": level, "SoilModel": sink}, {"SoilModel": {"Level": {"out": {"out": 1.0}}}}, root=sink.link(df, ignore=["out"]))
    got = []
    for _ in TRACE:
        model.run()
        got.append(tuple(model.data["root"].select("level", "caught").first()))
    assert got == TRACE


def test_selectors_and_report(spark):
    c = Starch()
    assert c.massic_concentration == ["starch"] and c.inputs == ["nitrate", "light"]
    assert c.non_inertial_variables == ["gain", "shade"] and c.non_inertial_extensive == ["gain"]
    assert Mineral().extensive_variables == Mineral().intensive_variables == Mineral().descriptor == Mineral().parameter == Mineral().plant_scale_state == Mineral().non_inertial_intensive == []
    assert len(c.state_variables) == 6 and catalog.struct_type(c)["starch"].metadata["variable_type"] == "state_variable"
    text = catalog.report(spark, [Starch, Mineral], {"variable_type": ["input"]})
    assert text.count("\n") == 7 and text.startswith("Mineral")
    long = catalog.declare("u", "", "d" * 95, "", "", "", "", "", "parameter", "", "", "user", default=1.0)
    made = dataclass(init=False)(type("Long", (Component,), {"__annotations__": {"p": float}, "p": long}))
    assert "d" * 87 + "..." in catalog.report(spark, [made])


def test_declaration():
    assert catalog.declare(*[""] * 8, "input", "", "", "user", default=0.0).default == 0.0
    for wrong in ({"variable_type": "x"}, {"state_variable_type": "x"}, {"edit_by": "x"}, {"unit": 1}, {"default": "x"}):
        given = dict.fromkeys(catalog.METADATA, "") | {"variable_type": "input", "default": 0.0} | wrong
        with pytest.raises(ValueError):
            catalog.declare(**given, validate=True)


def test_default_order():
    steps = [n for row in schedule.DEFAULT_SCHEDULE for n in row]
    found = [schedule.Process(n, len, (n,), "", i) for i, n in enumerate(steps)]
    assert [p.name for _, g in schedule.ordered(found) for p in g] == [
        "potential", "deficit", "allocation", "actual", "segmentation", "postsegmentation", "axial", "stepinit", "rate", "totalrate", "state", "totalstate", "priorbalance", "selfbalance",
    ]
    assert schedule.ordered(found) == schedule.ordered(found, as_text=True)
    assert [v for v, _ in Level().groups] == [(0, 2, 0, 0), (0, 4, 0, 4)]
    other = schedule.ordered(found, (("rate",), ("state",)))
    assert other[0][0] == (0, 0) and [p.name for p in other[1][1]] == ["state"]


@dataclass(init=False)
class Base(Component):
    a: float = _var(default=2.0)
    b: float = _var()
    total: float = _var("plant_scale_state")
    seen = 0

    @stepinit
    def _init(self):
        Base.seen += 1

    @rate
    def _a(self, a):
        return a + 1

    @rate
    def _b(self, a):
        return a * 10

    @totalstate
    def _total(self, a):
        return F.sum(a)

    @priorbalance
    def _double(self, df):
        return df.withColumn("b", F.col("b") * 2)


@dataclass(init=False)
class Child(Base):
    @rate
    def _a(self, a):
        return a + 100

    @axial
    def _c(self, struct_mass):
        return 1.0 if struct_mass > 2 else 0.0  # plain Python: row by row

    @potential
    def _d(self, struct_mass) -> tuple[float, str, float]:
        return struct_mass, "e", -struct_mass


def test_processes_totals_hooks_and_inheritance(spark):
    df = vertex_table(spark, [(1, 1.0, 1, 1), (2, 3.0, 1, 1), (3, 5.0, 9, 1)])
    c = Base(time_step=10, sub_time_step=4)  # two sub-steps, the remainder is dropped
    got = {r.vid: r for r in c.step(c.link(df)).collect()}
    assert got[1].a == 4.0 and got[3].a == 2.0 and got[1].total == 10.0 and got[2].total is None
    assert got[2].b == 80.0 and Base.seen == 2
    c = Child()
    got = {r.vid: r for r in c.step(c.link(df)).collect()}
    assert got[1].a == 102.0 and (got[1].c, got[2].c, got[3].c) == (0.0, 1.0, None) and (got[2].d, got[2].e) == (3.0, -3.0)
    none = Base(time_step=1, sub_time_step=2)
    assert {r.a for r in none.step(none.link(df)).collect()} == {2.0}


@dataclass(init=False)
class Bodies(Component):
    k = 2.0

    @rate
    def _branch(self, struct_mass):
        x = self.k * struct_mass
        if x > 10:
            return x
        return -x if x > 4 else max(x, 0.0) / struct_mass

    @rate
    def _pair(self, struct_mass) -> tuple[float, str, float]:
        if int(struct_mass) % 2:
            return 1.0, "left", struct_mass
        return 0.0, "left", -struct_mass

    @totalstate
    def _spread(self, struct_mass):
        return max(struct_mass.values()) - min(struct_mass.values())

    @totalstate
    def _middle(self, struct_mass):
        return sorted(struct_mass.values())[len(struct_mass) // 2]


def test_python_bodies(spark):
    df = vertex_table(spark, [(1, 1.0, 1, 1), (2, 3.0, 1, 1), (3, 6.0, 1, 1), (4, 0.0, 1, 1)])
    got = {r.vid: r for r in Bodies().step(df).collect()}
    assert [got[k].branch for k in (1, 2, 3, 4)] == [2.0, -6.0, 12.0, None]
    assert [(got[k].pair, got[k].left) for k in (1, 2, 3, 4)] == [(1.0, 1.0), (1.0, 3.0), (0.0, -6.0), (None, None)]
    assert got[1].spread == 6.0 and got[1].middle == 3.0 and got[2].middle is None

    @rate
    def _disagree(self, struct_mass) -> tuple[float, str, float]:
        return (1.0, "a", 1.0) if int(struct_mass) else (1.0, "b", 1.0)

    with pytest.raises(TypeError):
        type("Disagree", (Component,), {"_disagree": _disagree})().step(df)


def test_updates_to_null(spark):
    d, none = keyed.column(spark, {1: 1.0, 2: 2.0}), keyed.column(spark, {1: None})
    assert keyed.to_dict(keyed.upsert(d, none)) == keyed.to_dict(keyed.scatter(d, none)) == {1: None, 2: 2.0}
    assert keyed.to_dict(keyed.assign_at(d, spark.createDataFrame([(1, None)], "idx long, v double"))) == {1: 1.0, 2: None}


def test_totals_by_plant(spark):
    df = spark.createDataFrame([("p", 1, 1.0, 1, 1), ("p", 2, 2.0, 1, 1), ("q", 1, 5.0, 1, 1)], "plant string, vid long, struct_mass double, label int, type int")
    c = Base()
    c.plant = "plant"
    got = {(r.plant, r.vid): r.total for r in c.step(c.link(df)).collect()}
    assert got == {("p", 1): 6.0, ("p", 2): None, ("q", 1): 3.0}


def test_scenario_and_linking(spark):
    with pytest.warns(UserWarning):
        c = Base(unknown=1, a=7.0)
    df = c.link(vertex_table(spark, [(1, 1.0, 1, 1), (2, 1.0, 1, 1)]).withColumn("b", F.lit(5.0)), ignore=["b"])
    assert {(r.a, r.b) for r in df.collect()} == {(7.0, 5.0)}
    part = vertex_table(spark, [(1, 1.0, 1, 1), (2, 1.0, 1, 1)]).withColumns({"water": F.when(F.col("vid") == 1, 3.0), "starch": F.lit(4.0)})
    assert sorted((r.water, r.starch) for r in Mineral().link(part).collect()) == [(0.0, 4.0)] * 2


def test_coupling(spark):
    assert coupling.conversion("1/12") == 1 / 12 and coupling.conversion("-(2+1)**2") == -9.0
    for bad in ("__import__('os')", "a*2", "1 if 2 else 3"):
        with pytest.raises(ValueError):
            coupling.conversion(bad)
    assert coupling.parse_sources("a * 2 ; b") == {"a": 2.0, "b": 1.0}
    t = {"R": {"A": {"x": {"x": 1.0}, "y": {"z": 1.0}, "u": {"v": "1/2"}, "w": {"p": 1.0, "q": 3}}}}
    c = Component()
    coupling.couple(c, "R", ["A", "R"], t)
    assert c.aliases == {"y": "z"} and c.pullable_inputs == {"u": {"v": 0.5}, "w": {"p": 1.0, "q": 3.0}}
    df = spark.createDataFrame([(1, 4.0, 1.0, 2.0), (2, None, None, 2.0)], "vid long, v double, p double, q double")
    assert sorted(((r.vid, r.u, r.w) for r in c.pull(df).collect())) == [(1, 2.0, 7.0), (2, None, None)]
    ins, outs = coupling.inputs_outputs(coupling.edge_table(spark, TRANSLATOR), "Mineral")
    assert {r.name for r in ins.collect()} == {"starch", "water"} and {r.name for r in outs.collect()} == {"nitrate", "uptake"}
    assert coupling.suggest({"S": Starch(), "P": Pool(), "M": Mineral()})["M"] == {"S": {"starch": {"starch": 1.0}}, "P": {"water": {"water": 1.0}}}


def test_forcing(spark, tmp_path):
    (tmp_path / "f.csv").write_text("t,temperature\n0,20\n1,18\n")
    table = tables.forcing_csv(spark, str(tmp_path / "f.csv"), ["temperature"])
    df = vertex_table(spark, [(1, 1.0, 1, 1), (2, 1.0, 1, 1)]).withColumn("temperature", F.lit(0.0))
    assert {r.vid: r.temperature for r in apply_tables(df, table, 1, ["temperature"]).collect()} == {1: 18.0, 2: 0.0}
    assert {r.temperature for r in apply_tables(df, table, 0, ["temperature"], fill=True).collect()} == {20.0}
    with pytest.raises(KeyError):
        apply_tables(df, table, 9, ["temperature"])
    assert owners({"S": Starch(), "M": Mineral()}, ["t", "light", "starch"]) == {"root": ["light", "starch"]}


def test_numerics(spark):
    rows = [(float(t),) for t in (-5, 0, 10, 15, 20, 30, 60, 70)]
    df = spark.createDataFrame(rows, "t double").select("t", temperature_modification(F.col("t")).alias("m"), temperature_modification(F.col("t"), C=0.5).alias("z"), temperature_modification(F.col("t"), C=0.0, A=0.1, B=1.0).alias("q"))
    for r in df.collect():
        b = -0.05 * r.t + 3.0
        assert r.m == pytest.approx(0.0 if b < 0 else max(b ** (r.t / 10), 0.0)) and r.z == 0.0 and r.q == pytest.approx(max(0.1 * r.t + 1, 0))
    nan = spark.range(1).select(maximum(float("nan"), 1.0).alias("a"), minimum(float("nan"), 1.0).alias("b"), minimum(2.0, 1.0).alias("c")).first()
    assert math.isnan(nan.a) and math.isnan(nan.b) and nan.c == 1.0


def test_keyed_column_sequence(spark):
    d = keyed.column(spark, {3: 0.3, 1: 0.1, 2: 0.2})
    d = keyed.set_item(keyed.set_item(d, 5, 0.5), 4, 0.4)
    d = keyed.upsert(d, keyed.column(spark, {2: 9.0, 10: 1.0, 0: 0.0}))
    d = keyed.assign_at(d, spark.createDataFrame([(0, 7.0), (2, 8.0)], "idx long, v double"))
    d = keyed.delete(d, 3, strict=True)
    assert keyed.to_dict(d) == {0: 7.0, 1: 0.1, 2: 8.0, 4: 0.4, 5: 0.5, 10: 1.0} and keyed.check_invariant(d).first().ok
    assert keyed.get(d, 4) == 0.4 and keyed.contains(d, 5) and not keyed.contains(d, 3)
    wanted = spark.createDataFrame([(10,), (0,), (10,)], "vid long")
    assert sorted((r.vid, r.idx) for r in keyed.indices_of(d, wanted).collect()) == [(0, 0), (10, 5), (10, 5)]
    for call in (lambda: keyed.get(d, 3), lambda: keyed.delete(d, 3, strict=True), lambda: keyed.scatter(d, keyed.column(spark, {77: 1.0})), lambda: keyed.indices_of(d, spark.createDataFrame([(77,)], "vid long"))):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError):
        keyed.assign_all(d, keyed.column(spark, {0: 1.0}))
    assert keyed.pop(d, 4)[0] == 0.4 and keyed.pop_first(d)[0] == (0, 7.0) and keyed.clear(d).count() == 0
    assert keyed.equal(d, d) and not keyed.equal(d, keyed.assign_scalar(d, 0.0)) and keyed.to_dict(keyed.set_default(d, 4, 1.0))[4] == 0.4
    assert not keyed.check_invariant(d.unionByName(d)).first().ok


def test_random_upserts_and_deletes(spark):
    rng, want, d = random.Random(3), {}, keyed.column(spark, {})
    for _ in range(6):
        new = {rng.randrange(60): float(rng.randrange(9)) for _ in range(15)}
        want |= new
        gone = rng.sample(sorted(want), 4)
        d = keyed.delete(keyed.upsert(d, keyed.column(spark, new)), spark.createDataFrame([(g,) for g in gone], "vid long"))
        for g in gone:
            del want[g]
    assert keyed.to_dict(d) == want


def test_scene(spark, tmp_path):
    plants = scene.stand(spark, "s", ["A"], exact=True)
    assert plants.count() == 246 and plants.select("plant_id").distinct().count() == 246
    jittered = scene.stand(spark, "s", ["A", "B"], (0.3, 0.7), seed=4)
    shares = {r.model: r["count"] for r in jittered.groupBy("model").count().collect()}
    assert shares["B"] > shares["A"] and [r.y for r in jittered.collect()] == [r.y for r in scene.stand(spark, "s", ["A", "B"], (0.3, 0.7), seed=4).collect()]
    with pytest.raises(ZeroDivisionError):
        scene.layout_numbers(0.1, 1.0, 250, 0.15)
    with pytest.raises(OverflowError):
        scene.affinity(spark.createDataFrame([(0,), (1,)], "cpu int"), 1, 2)
    assert scene.any_busy(spark.createDataFrame([(True,), (False,)], "busy boolean")).first().busy
    vertices = spark.createDataFrame([("p", 1, 0, 2.0), ("p", 2, 1, 3.0), ("q", 1, 1, 4.0)], "plant string, vid long, voxel long, uptake double").withColumn("water", F.lit(0.0))
    soil = spark.createDataFrame([(0, 100.0), (1, 100.0), (2, 100.0)], "voxel long, water double").withColumn("asked", F.lit(0.0))
    log = tables.snapshots(str(tmp_path / "log"), every=2)
    end, ground = scene.play(vertices, soil, lambda df, t: df, lambda s, t: s.withColumn("water", F.col("water") - F.col("asked")), "voxel", {"asked": "uptake"}, ["water"], steps=3, log=log)
    assert sorted((r.plant, r.vid, r.water) for r in end.collect()) == [("p", 1, 94.0), ("p", 2, 79.0), ("q", 1, 79.0)]
    assert sorted(r.water for r in ground.collect()) == [79.0, 94.0, 100.0]
    assert sorted(r.t for r in spark.read.parquet(str(tmp_path / "log")).select("t").distinct().collect()) == [0, 2]


def test_sources(spark, tmp_path):
    df = tables.properties(spark, {"a": {1: 1, 2: None}, "n": {2: "x", 3: "y"}, "b": {3: True}})
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1.0, None, None), (2, None, "x", None), (3, None, "y", 1.0)]
    assert keyed.columnised(spark.createDataFrame([(1, 2, True, "s")], "vid long, i int, f boolean, s string")).dtypes == [("vid", "bigint"), ("i", "double"), ("f", "double"), ("s", "string")]
    import numpy as np

    grid = tables.voxels(spark, {"w": np.arange(6).reshape(2, 3), "d": np.ones((2, 3))})
    assert [r.w for r in grid.orderBy("voxel_id").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    with pytest.raises(FileNotFoundError):
        tables.translator(str(tmp_path))
    assert tables.translator(str(tmp_path), lambda: TRANSLATOR) == TRANSLATOR == tables.translator(str(tmp_path))


def test_long_nonlinear_chain_does_not_explode(spark):
    def step(df, t):
        df = df.withColumn("r", F.col("h") * 0.01 + F.sqrt("h"))
        return df.withColumn("h", F.col("h") + F.col("r") * F.col("r") * 1e-3)

    h = 1.0
    for _ in range(24):
        r = h * 0.01 + math.sqrt(h)
        h = h + r * r * 1e-3
    got = loop(spark.createDataFrame([(1.0,)], "h double"), step, 24, every=5, growth=5).first()
    assert got.h == pytest.approx(h, rel=1e-12)
    assert loop(spark.createDataFrame([(1.0,)], "h double"), step, 24, stop=lambda t: t == 0).first().h == 1.0


def test_streamed_steps(spark, tmp_path):
    from stepframe.streaming.steps import StreamedRun

    for t in range(3):
        spark.createDataFrame([(t, 10.0 * t)], "t int, temperature double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = StreamedRun(spark.createDataFrame([(1, 0.0), (2, 0.0)], "vid long, temperature double"), lambda s, f, t: apply_tables(s, f, t, ["temperature"]).withColumn("sum", F.coalesce(F.col("sum"), F.lit(0.0)) + F.col("temperature") if "sum" in s.columns else F.col("temperature")))
    stream = spark.readStream.schema("t int, temperature double").parquet(str(tmp_path / "in"))
    run.start(stream, str(tmp_path / "check")).awaitTermination(120)
    assert {r.vid: r["sum"] for r in run.state.collect()} == {1: 30.0, 2: 0.0} and run.done == 2
    kept = StreamedRun(run.state, run.step, str(tmp_path / "kept"))
    forcing = spark.createDataFrame([(3, 5.0)], "t int, temperature double")
    kept.batch(forcing, 0)
    again = StreamedRun(spark.createDataFrame([(9, 0.0)], "vid long, temperature double"), run.step, str(tmp_path / "kept"))
    again.batch(forcing, 0)  # replayed after a restart
    again.batch(spark.createDataFrame([(4, 1.0)], "t int, temperature double"), 1)
    assert {r.vid: r["sum"] for r in again.state.collect()} == {1: 36.0, 2: 0.0} and again.done == 4
