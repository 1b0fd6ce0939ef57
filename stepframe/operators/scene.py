"""Scenes: planting layouts, shares of models, CPU groups, and the exchange between plants and voxels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.operators.keyed import positions
from stepframe.plans.runtime import loop


def layout_numbers(xrange: float, yrange: float, density: float, row_spacing: float) -> tuple[int, int]:
    """Rows, and plants in each: the density counts on the width that was asked for."""
    rows = int(xrange / row_spacing)
    if not rows:
        raise ZeroDivisionError("the scene is narrower than a row")
    return rows, max(int(yrange * xrange * density / rows), 1)


def place_plants(grid: DataFrame, row: Column, number: Column, per_row: int, yrange: float, row_spacing: float, depth: float, seed: int | None) -> DataFrame:
    """Coordinates of the plants of a grid; without a seed exact, with one the places along a row are jittered by up to a quarter."""
    d = yrange / per_row
    jitter = (F.rand(seed) - 0.5) * (d / 2) if seed is not None else F.lit(0.0)
    turn = F.rand(seed + 1) * 360.0 if seed is not None else F.lit(0.0)
    x, y = row_spacing / 2 + row.cast("double") * row_spacing, d / 2 + number.cast("double") * d + jitter
    return grid.withColumns({"x": x, "y": y, "z": F.lit(-depth), "rotation": turn})


def pick(u: Column, frequencies: Sequence[float]) -> Column:
    """The number of the model whose stretch of cumulated frequencies (low, high] holds u; -1 if none."""
    out, low = F.lit(-1), 0.0
    for i, f in reversed(list(enumerate(frequencies))):
        low = sum(frequencies[:i])
        out = F.when((u > low) & (u <= low + f), F.lit(i)).otherwise(out)
    return out


def stand(spark: SparkSession, scene: str, models: Sequence[str], frequencies: Sequence[float] = (1.0,), xrange=1.0, yrange=1.0, density=250.0, depth=0.025, row_spacing=0.15, seed: int = 0, exact: bool = False) -> DataFrame:
    """plant_id, model, x, y, z, rotation of every plant of a scene."""
    rows, per_row = layout_numbers(xrange, yrange, density, row_spacing)
    grid = spark.range(rows * per_row).select("id", F.floor(F.col("id") / per_row).alias("row"), (F.col("id") % per_row).alias("number"))
    placed = place_plants(grid, F.col("row"), F.col("number"), per_row, yrange, row_spacing, depth, None if exact else seed)
    drawn = placed.withColumn("u", 1.0 - F.rand(seed + 2) if len(models) > 1 else F.lit(1.0))  # drawn once for each plant, from (0, 1]
    chosen = drawn.withColumn("m", pick(F.col("u"), frequencies))
    name = F.element_at(F.array(*map(F.lit, models)), F.col("m") + 1)
    return chosen.select(F.concat_ws("_", name, F.col("id").cast("string"), F.lit(scene)).alias("plant_id"), name.alias("model"), "x", "y", "z", "rotation")


def affinity(free: DataFrame, workers: int, threads: int, cpu: str = "cpu") -> DataFrame:
    """worker, cpu: groups of ``threads`` free CPUs, lowest first. More must be free than are asked for."""
    if free.count() <= workers * threads:
        raise OverflowError("not enough free CPUs")
    ranked = positions(free, cpu, "__rank").withColumn("worker", F.floor(F.col("__rank") / threads))
    return ranked.where(F.col("worker") < workers).select("worker", cpu)


def any_busy(cpus: DataFrame) -> DataFrame:
    return cpus.agg(F.coalesce(F.bool_or("busy"), F.lit(False)).alias("busy"))


def demand(plants: DataFrame, voxel: str, amounts: Mapping[str, str]) -> DataFrame:
    """What all vertices ask of each voxel: sums that are combined before they are shuffled."""
    return plants.groupBy(voxel).agg(*[F.sum(source).alias(name) for name, source in amounts.items()])


def exchange(plants: DataFrame, voxels: DataFrame, voxel: str, answers: Sequence[str]) -> DataFrame:
    """Give every vertex its voxel's answers. Spark broadcasts small grids and shuffles, splitting hot voxels, otherwise."""
    return plants.join(voxels.select(voxel, *answers), voxel)


def play(plants: DataFrame, soil: DataFrame, plant_step: Callable, soil_step: Callable, voxel: str, amounts: Mapping[str, str], answers: Sequence[str], steps: int = 2500, log: Callable[[DataFrame, int], None] | None = None, stop: Callable[[int], bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """The scene's loop: plants step, voxels get what they ask for and step, plants get the answers."""
    held = {"soil": soil}

    def one(df: DataFrame, t: int) -> DataFrame:
        df = plant_step(df, t)
        asked = held["soil"].drop(*amounts).join(demand(df, voxel, amounts), voxel, "left").fillna(0.0, list(amounts))
        held["soil"] = soil_step(asked, t)
        return exchange(df.drop(*answers), held["soil"], voxel, answers)

    # the soil follows from the plants' plan, so both are cut at every step
    from stepframe.plans.runtime import cut

    def cut_both(df: DataFrame, t: int) -> DataFrame:
        out = cut(one(df, t))
        held["soil"] = cut(held["soil"])
        return out

    return loop(plants, cut_both, steps, every=steps + 1, stop=stop, on_step=log), held["soil"]
