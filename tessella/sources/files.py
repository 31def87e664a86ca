"""Files as tables: scans, originals, health and reports, through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalar import MEDIA, RAW, SIDECARS, basename, suffix

def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = MEDIA + RAW, after: str = "") -> DataFrame:
    """SC1, SC4, SC22, SC23: files below ``path`` whose suffix is one of ``suffixes``, in the order of
    their paths and beyond ``after``: path, name, length, revision token (nanoseconds of the change,
    size) and whether they are listed only. Content is not read. Hidden files are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    kind = suffix(F.col("path"))
    token = F.concat_ws(":", (F.unix_micros("modificationTime") * 1000).cast("string"), F.col("length").cast("string"))
    listed = files.where(kind.isin(*suffixes) & (F.col("path") > after)).where(~basename(F.col("path")).startswith("."))
    return listed.select("path", basename(F.col("path")).alias("name"), "length", token.alias("revision"), kind.isin(*RAW).alias("unsupported")).orderBy("path")


def originals(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SC5: path, content and its SHA-256 of the named files, each read once by one task."""
    read = spark.read.format("binaryFile").load(paths).select("path", "content")
    return read.withColumn("sha256", F.sha2("content", 256))


def health(spark: SparkSession, path: str) -> DataFrame:
    """SC7: one row: how many files a source lists, how many can be decoded, and their bytes."""
    found = scan(spark, path)
    return found.agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("unsupported")).alias("media"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_report(report: DataFrame, path: str) -> None:
    """SK31: rows as JSON lines with nulls kept, in place of an earlier report."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
