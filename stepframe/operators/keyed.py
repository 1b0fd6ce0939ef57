"""Keyed columns: tables (vid, v) with the operations of a sorted key-value column.

Order isn't a property of a table; positions are ranks in ascending key order. Missing keys and wrong lengths raise, after a
job that looks for them, unless ``strict`` is off.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.plans.runtime import cut

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def column(spark: SparkSession, items: Mapping[int, float] | Iterable[tuple[int, float]]) -> DataFrame:
    """A keyed column from pairs; the last of equal keys wins."""
    rows = [(int(k), None if v is None else float(v)) for k, v in dict(items).items()]
    return spark.createDataFrame(rows, "vid long, v double")


def columnised(df: DataFrame, key: str = "vid", ignore: Iterable[str] = ()) -> DataFrame:
    """All numeric (and true/false) columns as doubles; text and nested ones, the key and ``ignore`` stay."""
    skip = {key, *ignore}
    made = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in skip}
    return df.withColumns(made) if made else df


def get(df: DataFrame, key: int) -> float:
    row = df.where(F.col("vid") == key).select("v").first()
    if row is None:
        raise KeyError(key)
    return row.v


def contains(df: DataFrame, key: int) -> bool:
    return bool(df.where(F.col("vid") == key).take(1))


def keys(df: DataFrame) -> DataFrame:
    return df.select("vid").orderBy("vid")


def values(df: DataFrame) -> DataFrame:
    return df.orderBy("vid").select("v")


def items(df: DataFrame) -> DataFrame:
    return df.select("vid", "v").orderBy("vid")


def to_dict(df: DataFrame) -> dict[int, float]:
    """All rows on the driver, by ascending key: for small columns."""
    return {r.vid: r.v for r in items(df).toLocalIterator()}


def positions(df: DataFrame, key: str = "vid", name: str = "idx") -> DataFrame:
    """Adds each row's rank in key order, from 0. Ranges of keys are sorted side by side; only a count for each range meets on the driver."""
    dealt = cut(df.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")))
    held = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first")).orderBy("__part").collect()
    rows, before = [], 0
    for r in held:
        rows.append((r["__part"], before - r["first"]))
        before += r.n
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __shift long")
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def indices_of(df: DataFrame, wanted: DataFrame, key: str = "vid", strict: bool = True) -> DataFrame:
    """``wanted`` with the position of each of its keys; repeated keys are kept."""
    found = wanted.join(positions(df.select(key), key), key, "left")
    if strict and found.where(F.col("idx").isNull()).take(1):
        raise KeyError("a key isn't there")
    return found


def upsert(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of ``changes`` replace or join those of ``df``; a change to null is a change."""
    new = changes.select("vid", F.col("v").alias("__new"), F.lit(True).alias("__given"))
    return df.join(new, "vid", "full_outer").select("vid", F.when(F.col("__given"), F.col("__new")).otherwise(F.col("v")).alias("v"))


def set_item(df: DataFrame, key: int, value: float) -> DataFrame:
    return upsert(df, column(df.sparkSession, {key: value}))


def set_default(df: DataFrame, key: int, value: float) -> DataFrame:
    return df if contains(df, key) else set_item(df, key, value)


def delete(df: DataFrame, gone: DataFrame | int, strict: bool = False) -> DataFrame:
    """Without one key, or the keys of a table."""
    if isinstance(gone, int):
        if strict and not contains(df, gone):
            raise KeyError(gone)
        return df.where(F.col("vid") != gone)
    if strict and gone.join(df, "vid", "left_anti").take(1):
        raise KeyError("a key isn't there")
    return df.join(gone.select("vid"), "vid", "left_anti")


def pop(df: DataFrame, key: int) -> tuple[float, DataFrame]:
    return get(df, key), delete(df, key)


def pop_first(df: DataFrame) -> tuple[tuple[int, float], DataFrame]:
    row = df.orderBy("vid").first()
    if row is None:
        raise KeyError("the column is empty")
    return (row.vid, row.v), delete(df, row.vid)


def clear(df: DataFrame) -> DataFrame:
    return df.limit(0)


def equal(a: DataFrame, b: DataFrame) -> bool:
    both = a.alias("a").join(b.alias("b"), "vid", "full_outer")
    return not both.where(~F.col("a.v").eqNullSafe(F.col("b.v")) | F.col("vid").isNull()).take(1) and a.count() == b.count()


def scatter(df: DataFrame, changes: DataFrame, strict: bool = True) -> DataFrame:
    """New values, null among them, for keys that are there."""
    if strict and changes.join(df, "vid", "left_anti").take(1):
        raise KeyError("a key isn't there")
    new = changes.select("vid", F.col("v").alias("__new"), F.lit(True).alias("__given"))
    return df.join(new, "vid", "left").select("vid", F.when(F.col("__given"), F.col("__new")).otherwise(F.col("v")).alias("v"))


def assign_at(df: DataFrame, changes: DataFrame) -> DataFrame:
    """New values by position: ``changes`` (idx, v)."""
    new = changes.select(F.col("idx").cast("long").alias("idx"), F.col("v").alias("__new"), F.lit(True).alias("__given"))
    return positions(df).join(new, "idx", "left").select("vid", F.when(F.col("__given"), F.col("__new")).otherwise(F.col("v")).alias("v"))


def assign_all(df: DataFrame, new: DataFrame) -> DataFrame:
    """All values anew, by position: ``new`` (idx, v) with as many rows."""
    if df.count() != new.count():
        raise ValueError("the lengths differ")
    return assign_at(df, new)


def assign_scalar(df: DataFrame, value: float | Column) -> DataFrame:
    return df.withColumn("v", value if isinstance(value, Column) else F.lit(float(value)))


def length(df: DataFrame) -> DataFrame:
    """One row (n): how many keys there are."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The keys of ``a`` that ``b`` lacks."""
    return a.select("vid").distinct().join(b.select("vid"), "vid", "left_anti")


def short_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of a text's SHA-1."""
    return F.substring(F.sha1(text), 1, 16)


def check_invariant(df: DataFrame) -> DataFrame:
    """One row (ok): whether every key occurs once."""
    per_key = df.groupBy("vid").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg((F.coalesce(F.max("n"), F.lit(1)) == 1).alias("ok"))


def aligned(columns: Mapping[str, DataFrame], strict: bool = True) -> DataFrame:
    """Separate keyed columns side by side, on the keys that all of them have."""
    names = list(columns)
    out = columns[names[0]].select("vid", F.col("v").alias(names[0]))
    for n in names[1:]:
        right = columns[n].select("vid", F.col("v").alias(n))
        if strict and out.join(right, "vid", "left_anti").take(1):
            raise KeyError(f"{n} lacks a key")
        out = out.join(right, "vid")
    return out
