"""Joins and carries that documents need: by priority, by first defined value, and along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """rows with value and level (from 1) of the first of `keys` that lookup(key, value) has; null if none.

    One equi-join over all keys of a row, not one for each: every key that occurs is looked up once, whatever rows
    hold it, and rows of equal keys get their value together. No row is numbered, so nothing hangs on the order of evaluation.
    """
    asked = rows.select(F.array(*[F.col(k) for k in keys]).alias("_keys")).distinct()
    tried = asked.select("_keys", F.posexplode("_keys").alias("_level", "key")).where("key is not null")
    best = tried.join(lookup.groupBy("key").agg(F.min("value").alias("value")), "key").groupBy("_keys").agg(F.min_by("value", "_level").alias("value"), (F.min("_level") + 1).alias("level"))
    return rows.withColumn("_keys", F.array(*[F.col(k) for k in keys])).join(best.withColumnRenamed("_keys", "_asked"), F.col("_keys").eqNullSafe(F.col("_asked")), "left").drop("_keys", "_asked")


def first_defined(rows: DataFrame, keys: list[str], level: str, properties: list[str]) -> DataFrame:
    """For each of keys and each property on its own, the value of the least level where it is not null."""
    return rows.groupBy(*keys).agg(*[F.min_by(p, F.when(F.col(p).isNotNull(), F.col(level))).alias(p) for p in properties])


def carried(rows: DataFrame, keys: list[str], order: str, states: dict[str, Column]) -> DataFrame:
    """rows with each state's last value that is not null, up to the row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.last(value, ignorenulls=True).over(w) for name, value in states.items()})
