"""Helpers that the training-data operators share: shared storage, shipping code, byte-balanced batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: With this setting shuffle files go when the execution that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each application."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="stepframe-code-")) / "stepframe_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "stepframe").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share; removed when the JVM ends.

    Only where that setting is absent and Spark runs in this one process (as in tests) a folder is made and set as checkpoint
    folder; on a cluster its absence raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="stepframe-checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath, _ = _filesystem(spark, path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    jpath, fs = _filesystem(spark, path)
    fs.delete(jpath, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that lost executors cost no recomputation. The shuffle files
    of the write are of no more use then and go at once, so local disks hold those of one write and not of the whole job."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, when nothing reads it any more."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their tasks, and what their allocators keep adds to the executor's
    memory in all later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function for ``mapInArrow`` or ``mapInPandas`` that gives freed memory back when it is through."""

    def through(batches):
        yield from run(batches)
        give_back()

    return through


def lean_group(run: Callable) -> Callable:
    """The same for ``applyInPandas`` on groups."""

    def through(pdf):
        out = run(pdf)
        give_back()
        return out

    return through


def lean_cogroup(run: Callable) -> Callable:
    """The same for ``applyInPandas`` on groups of two tables."""

    def through(left, right):
        out = run(left, right)
        give_back()
        return out

    return through


def byte_slices(batches, column: int, limit: int = 4_000_000, rows: int = 2000) -> Iterator:
    """Record batches in slices of about ``limit`` bytes of a text column and at most ``rows`` rows; a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(max(int(np.searchsorted(ends, before + limit, "right")), at + 1), at + rows, b.num_rows)
            yield b.slice(at, end - at)
            at = end


def byte_chunks(texts, limit: int) -> Iterator[list[str | None]]:
    """An Arrow string array in lists of about ``limit`` bytes each; a longer text is a list of its own."""
    import pyarrow.compute as pc

    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + size > limit:
            yield texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    if start < len(texts):
        yield texts.slice(start).to_pylist()
