"""Sources and sinks: property tables, voxel grids, coupling files, forcing series, snapshots of steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSLATOR = "coupling_translator.yaml"


def properties(spark: SparkSession, columns: Mapping[str, Mapping[int, object]], key: str = "vid") -> DataFrame:
    """A wide table from one mapping of vertex to value for each variable; vertices a variable lacks are null."""
    vids = sorted({v for c in columns.values() for v in c})
    kinds = {n: _kind(c.values()) for n, c in columns.items()}
    cast = {"double": float, "string": str}
    rows = [(v, *[None if c.get(v) is None else cast[kinds[n]](c[v]) for n, c in columns.items()]) for v in vids]
    return spark.createDataFrame(rows, f"{key} long, " + ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def _kind(values) -> str:
    first = next((v for v in values if v is not None), 0.0)
    return "string" if isinstance(first, str) else "double"


def table(spark: SparkSession, path: str, key: str, name: str = "vid") -> DataFrame:
    """A stored table of vertices with its key as ``vid``."""
    return spark.read.parquet(path).withColumn(name, F.col(key).cast("long"))


def voxels(spark: SparkSession, arrays: Mapping[str, object]) -> DataFrame:
    """A grid of cells from arrays of one shape: voxel_id is the place in row-major order."""
    import numpy as np

    flat = {n: np.asarray(a, float).ravel() for n, a in arrays.items()}
    if len({len(a) for a in flat.values()}) > 1:
        raise ValueError("the arrays differ in size")
    rows = list(zip(range(len(next(iter(flat.values())))), *[a.tolist() for a in flat.values()], strict=True))
    return spark.createDataFrame(rows, "voxel_id long, " + ", ".join(f"`{n}` double" for n in flat))


def forcing_csv(spark: SparkSession, path: str, variables: list[str], index: str = "t") -> DataFrame:
    return spark.read.csv(path, header=True, schema=f"`{index}` int, " + ", ".join(f"`{v}` double" for v in variables))


def translator(folder: str, otherwise: Callable[[], dict] | None = None) -> dict:
    """The coupling file of a folder; where there is none, what ``otherwise`` makes is written and returned."""
    path = Path(folder) / TRANSLATOR
    if path.exists():
        return yaml.safe_load(path.read_text())
    if otherwise is None:
        raise FileNotFoundError(path)
    made = otherwise()
    path.write_text(yaml.safe_dump(made))
    return made


def snapshots(path: str, every: int = 1, scene: str = "scene") -> Callable[[DataFrame, int], None]:
    """A sink for the step loop: the state before every ``every``-th step, as a partition of a Parquet table."""

    def write(df: DataFrame, t: int) -> None:
        if t % every == 0:
            df.withColumns({"scene": F.lit(scene), "t": F.lit(t)}).write.mode("append").partitionBy("scene", "t").parquet(path)

    return write


def fresh(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Replace a scene's outputs."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
