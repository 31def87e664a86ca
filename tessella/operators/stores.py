"""Stores that are written: content by hash, rows that are added once, and groups whose members a save
replaces. Each is a Parquet folder; a put reads what is there and writes only what is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import materialise

#: Parts that a store of groups is dealt into, so that a save rewrites the parts that it touches.
PARTS = 16


def _there(spark: SparkSession, path: str, schema: str, partition: str) -> DataFrame:
    """The rows of a store, none where nothing was put yet. The partition column comes last."""
    spark.createDataFrame([], schema).write.partitionBy(partition).mode("append").parquet(path)
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}=*"))
    return spark.read.schema(schema).parquet(path) if held is not None and len(held) else spark.createDataFrame([], schema)


def add_new(rows: DataFrame, path: str, keys: list[str], partition: Column | None = None) -> None:
    """Append the rows whose key the store has not got, one row of each key; those that it has stay as
    they are. The store is partitioned by ``_part``, a hash of the key where none is given, and only keys
    and parts are read. A run that ends before its commit adds nothing."""
    spark = rows.sparkSession
    own = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("string") if partition is None else partition)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    there = _there(spark, path, schema, "_part").select("_part", *keys)
    new = own.dropDuplicates(keys).join(there, ["_part", *keys], "left_anti")
    # what is new is written once, and a part by one task, or by several where it is large
    new.select(*own.columns).hint("rebalance", F.col("_part")).write.partitionBy("_part").mode("append").parquet(path)


def put_blobs(blobs: DataFrame, path: str) -> None:
    """Store ``content`` under its SHA-256, in a part by the first two digits; content that is there is
    not written again."""
    rows = blobs.select(F.sha2("content", 256).alias("sha256"), F.col("content").cast("binary").alias("content"), *[c for c in blobs.columns if c != "content"])
    add_new(rows, path, ["sha256"], F.substring("sha256", 1, 2))


def replace_groups(members: DataFrame, path: str, group: str) -> None:
    """Put the members of each group in place of those that the store has of it. Groups that are not named
    stay: the parts that a save touches are read, and only they are overwritten."""
    spark = members.sparkSession
    own = members.withColumn("_part", F.pmod(F.xxhash64(group), F.lit(PARTS)).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    named = materialise(own.select("_part", group).distinct(), "saved-groups")
    there = _there(spark, path, schema, "_part")
    rest = there.join(named.select("_part").distinct(), "_part", "left_semi").join(named, ["_part", group], "left_anti")
    # written apart first, as what is read cannot be overwritten
    after = materialise(rest.select(*own.columns).unionByName(own), "saved-parts")
    after.write.partitionBy("_part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def known(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The keys of a store; none where nothing was put yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return stored(spark, path).select(*keys) if there else None


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store."""
    return spark.read.parquet(path).drop("_part")
