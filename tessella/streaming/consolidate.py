"""Consolidating files into a library by content: staged, verified, promoted, and resumed at any step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import stores
from tessella.plans import materialise

#: The steps in order; a file in error or never seen begins anew.
STEPS = ("staged", "verified", "promoted")
JOURNAL = "asset_id string, sha256 string, status string, run int, step int"


def journal(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the journal."""
    spark.createDataFrame([], JOURNAL).write.mode("append").parquet(f"{root}/journal/none")
    return spark.read.schema(JOURNAL).option("recursiveFileLookup", "true").parquet(f"{root}/journal")


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """asset_id, sha256 and status of each file's newest row."""
    newest = F.max_by(F.struct("sha256", "status"), F.struct("run", "step")).alias("row")
    return journal(spark, root).groupBy("asset_id").agg(newest).select("asset_id", "row.*")


def consolidate(files: DataFrame, root: str, run: int, until: str = "promoted") -> None:
    """Bring files (asset_id, content) into ``root``/library. Promoted files are skipped; staged and verified
    ones go on from their staged bytes; all others are staged first. Content is stored once, by hash, in
    staging and in the library. The sources are only read. ``until`` ends the run after a step."""
    spark = files.sparkSession

    def log(rows: DataFrame, step: int) -> None:
        rows.select("asset_id", "sha256", "status", F.lit(run).alias("run"), F.lit(step).alias("step")).write.mode("overwrite").parquet(f"{root}/journal/run={run}/step={step}")

    named = files.withColumn("sha256", F.sha2("content", 256))
    had = materialise(checkpoints(spark, root), "checkpoints")
    going = had.where(F.col("status").isin("staged", "verified")).join(files.select("asset_id"), "asset_id", "left_semi")
    fresh = named.join(had.where(F.col("status").isin(*STEPS)), "asset_id", "left_anti")
    stores.put_blobs(fresh.select("content"), f"{root}/staging")
    log(fresh.withColumn("status", F.lit("staged")), 1)
    if until == "staged":
        return
    mine = spark.read.schema(JOURNAL).parquet(f"{root}/journal/run={run}/step=1").select("asset_id", "sha256").unionByName(going.select("asset_id", "sha256"))
    # read back: the bytes that were staged are what counts
    there = stores.stored(spark, f"{root}/staging").select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("same"))
    status = F.when(F.coalesce("same", F.lit(False)), "verified").otherwise("error")
    log(mine.join(there, "sha256", "left").withColumn("status", status), 2)
    if until == "verified":
        return
    verified = spark.read.schema(JOURNAL).parquet(f"{root}/journal/run={run}/step=2").where("status = 'verified'")
    content = stores.stored(spark, f"{root}/staging").join(verified.select("sha256").distinct(), "sha256", "left_semi")
    stores.put_blobs(content.select("content"), f"{root}/library")
    log(verified.withColumn("status", F.lit("promoted")), 3)
