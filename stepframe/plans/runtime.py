"""The step loop: plans are cut by checkpoints before they grow beyond use."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_EVERY = 5
#: Estimated column references in a plan beyond which it is cut early: nested rates multiply step by step.
MOST_REFERENCES = 10_000


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; set one of our own only where there is none and Spark runs in this one process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stepframe-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there; it survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def loop(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], steps: int, every: int = CHECKPOINT_EVERY, growth: int = 1, stop: Callable[[int], bool] | None = None, on_step: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Apply ``step(df, t)`` for t from 0; ``on_step`` sees each state before its step, ``stop`` can end the loop."""
    size = 1
    for t in range(steps):
        if stop and stop(t):
            break
        if on_step:
            on_step(df, t)
        df = step(df, t)
        size *= max(1, growth)
        if (t + 1) % every == 0 or size > MOST_REFERENCES:
            df, size = cut(df), 1
    return df
