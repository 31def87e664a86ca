"""Lookups that fail where something is missing, instead of giving nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(found: Column, value: Column, what: str, name: Column) -> Column:
    """``value`` where ``found``; otherwise the job fails, naming what is missing."""
    return F.when(found, value).otherwise(F.raise_error(F.concat(F.lit(f"{what} not found: "), F.coalesce(name.cast("string"), F.lit("null")))))


def looked_up(asked: DataFrame, rows: DataFrame, key: str, place: str, what: str) -> DataFrame:
    """The rows that ``asked`` (``key`` and ``place``) names, one per request with its place; the job
    fails where a key is missing, when that row is read. Rows without the key take no part."""
    there = rows.where(F.col(key).isNotNull()).withColumn("_there", F.lit(True))
    found = asked.select(place, key).join(there, key, "left")
    return found.withColumn(key, required(F.col("_there").isNotNull(), F.col(key), what, F.col(key))).drop("_there")


def history(rows: DataFrame, asked: DataFrame, key: str, order: str, what: str) -> DataFrame:
    """All rows of the asked keys with their number in order, from 1; the job fails where a key has
    none."""
    from pyspark.sql import Window

    numbered = rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    found = asked.select(key).distinct().join(numbered, key, "left")
    return found.withColumn(key, required(F.col("seq").isNotNull(), F.col(key), what, F.col(key)))
