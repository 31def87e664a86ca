"""A training-corpus pipeline: five operators one after the other over ``documents``.

Each stage reads what the stage before it kept, written as Parquet in between, and returns the
columns of ``documents``; the last returns the pieces of the packed sequences. A null doc_id counts
as -1 throughout, and of rows that share a doc_id and a text one stays after the exact stage; rows
are told apart by doc_id and text hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.exact_dedup import exact_dedup, lower_sql
from tessella.llm.mixing import mix
from tessella.llm.near_dedup import components
from tessella.llm.packing import pack
from tessella.llm.quality import fit, verdicts
from tessella.llm.text import BATCH_BYTES, doc_id, text_or_empty
from tessella.plans import materialise

#: A document is rejected where its calibrated probability of label 1 is below this.
REJECT_BELOW = 0.5


def _keyed(docs: DataFrame, text: Column) -> DataFrame:
    """The rows of ``docs``, whole, with the document's id and the hash of ``text``: rows that share
    an id differ in it. A row is one column, so that its own columns may have any names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, doc_id().alias("id"), F.sha2(text.cast("binary"), 256).alias("sha"))


def _id() -> list[Column]:
    return [F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")]


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``place``, from 0, of the rows of a table, in the order in which they were
    written: by file, and by row in the file. Other frames are written first."""
    try:
        at = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not read from files
        return in_order(materialise(docs.select("doc_id", "text"), "unordered"))
    # as many rows as the table has files
    sizes = at.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()
    first, before = [], 0
    for r in sorted(sizes, key=lambda r: (int((re.search(r"part-(\d+)", r["file"]) or [0, 0])[1]), r["file"])):
        first.append((r["file"], before))
        before += r["n"]
    offsets = docs.sparkSession.createDataFrame(first, "file string, first long")
    return at.join(F.broadcast(offsets), "file").select("doc_id", "text", (F.col("first") + F.col("row")).alias("place"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # texts are handed to Python in small batches also when the result is written, after this returns
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return verdicts(docs, model, REJECT_BELOW)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    kept = exact_dedup(docs.select("doc_id", "text")).where("kept").select(*_id())
    return _keyed(docs, lower_sql()).join(kept, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one with the least doc_id, and of
    several texts with that id the one with the least hash."""
    group = F.coalesce(F.col("component").cast("string"), F.concat_ws(":", "doc_id", "text_sha256"))
    least = F.min(F.struct(*_id())).alias("least")
    kept = components(docs.select("doc_id", "text")).where("kept").groupBy(group.alias("group")).agg(least).select("least.*")
    return _keyed(docs, text_or_empty()).join(kept, ["id", "sha"], "left_semi").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of a mix by their sources' shares; none is left out, as no weights
    are stated. The order is that of the rows as they are written."""
    placed = mix(docs.select("doc_id", "text", "source")).where("in_mix").select(*_id(), "position")
    ordered = _keyed(docs, text_or_empty()).join(placed, ["id", "sha"])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartitionByRange(partitions, "position").sortWithinPartitions("position").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, which follow the order in
    which the mix has the documents."""
    return pack(in_order(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: SQL cannot state the trained, sampled and tokenised stages; they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
