"""Exact deduplication by block naming.

A normalised text is cut into blocks of fixed size. The distinct blocks are sorted and named by
integers; then adjacent names are paired, the distinct pairs named in turn, and so on, halving the
sequence each time, until each document has a single name. Two documents of the same number of
rounds share a name exactly when their texts are equal: names are given to values, never to hashes.

A 64-bit hash of a block only routes it: where one hash stands for one block, which is then known
to be so by comparing the blocks themselves, documents look the name up by the hash and their text
is not shuffled a second time; where a hash stands for several blocks, they look it up by hash and
block. A name is a sorted partition's number and the place in it, so no task sees all names, and
copies are combined before each shuffle. Joins on names may be skewed by large groups of copies;
they are plain equi-joins that adaptive execution splits, and their rows are a few bytes.

Defined cases: a null text counts as empty; of equal texts the row with the largest doc_id stays;
a long text has as many blocks as it needs and one more round per doubling; rows equal in doc_id and text are one row each of the same group, of which one row is kept;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.text import arrow_bytes, chunks, doc_id, lower_ascii, text_or_empty
from tessella.plans import broadcast_if_small, materialise, scratch

BLOCK_BYTES = 4096
#: Bits of the routing hash; tests lower it so that hashes collide.
HASH_BITS = 63
#: Blocks under shared hashes up to which they are broadcast; beyond it the join shuffles.
SMALL = 10_000


def _normalised(docs: DataFrame) -> DataFrame:
    return docs.select(doc_id(), text_or_empty().alias("text"))


def _cut(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)] or [b""]


def _hashes(blocks: list[bytes], bits: int) -> list[int]:
    import numpy as np

    both = np.empty(len(blocks), object)
    both[:] = blocks
    return (pd.util.hash_array(both, categorize=False).view("uint64") >> np.uint64(64 - bits)).astype("int64").tolist()


def block_table(docs: DataFrame, size: int = BLOCK_BYTES, bits: int = HASH_BITS) -> DataFrame:
    """The distinct blocks of all documents: hash and block, each once per task at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            own = list(dict.fromkeys(b for t in lower_ascii(part.column("text")).to_pylist() for b in _cut(t.encode(), size)))
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(own, bits), pa.int64()), pa.array(own, pa.binary())], names=["hash", "block"])

    return _normalised(docs).mapInArrow(cut, "hash long, block binary")


def sequences(docs: DataFrame, size: int = BLOCK_BYTES, bits: int = HASH_BITS) -> DataFrame:
    """doc_id, text_sha256 and the hashes of the document's blocks in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            raws = [t.encode() for t in lower_ascii(part.column("text")).to_pylist()]
            blocks = [_cut(r, size) for r in raws]
            flat = _hashes([b for own in blocks for b in own], bits)
            at, lists = 0, []
            for own in blocks:
                lists.append(flat[at : at + len(own)])
                at += len(own)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "text_sha256", "hashes"],
            )

    return _normalised(docs).mapInArrow(cut, "doc_id long, text_sha256 string, hashes array<long>")


def _shared_blocks(docs: DataFrame, shared: DataFrame, size: int, bits: int) -> DataFrame:
    """(row, idx, hash, block) of the documents' blocks under shared hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            out: list[tuple] = []
            for row, text in zip(part.column("row").to_pylist(), lower_ascii(part.column("text")).to_pylist(), strict=True):
                own = _cut(text.encode(), size)
                out += [(row, i, h, b) for i, (h, b) in enumerate(zip(_hashes(own, bits), own, strict=True))]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row", "idx", "hash", "block"])

    rows = docs.select(F.concat_ws(":", doc_id(), F.sha2(lower_sql().cast("binary"), 256)).alias("row"), text_or_empty().alias("text")).dropDuplicates(["row"])
    return rows.mapInArrow(cut, "row string, idx long, hash long, block binary").join(shared, "hash", "left_semi")


def lower_sql():
    return F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows with a name each: sorted within the partitions that the keys are hashed to,
    numbered by partition and place."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, size: int = BLOCK_BYTES, bits: int = HASH_BITS) -> DataFrame:
    """doc_id, text_sha256 and ``identity``, which rows share exactly when their texts are equal."""
    names = materialise(named(block_table(docs, size, bits).distinct(), "hash", "block"), "block-names")
    shared = materialise(names.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "shared-hashes")
    table = materialise(sequences(docs, size, bits), "sequences")

    at = table.select("doc_id", "text_sha256", F.posexplode("hashes").alias("idx", "hash")).withColumn("idx", F.col("idx").cast("long"))
    by_hash = names.select("hash", "name")
    if shared.isEmpty():
        level = at.join(by_hash, "hash")
    else:
        alone = by_hash.join(broadcast_if_small(shared, SMALL), "hash", "left_anti")
        several = names.join(broadcast_if_small(shared, SMALL), "hash", "left_semi")
        own = _shared_blocks(docs, broadcast_if_small(shared, SMALL), size, bits).join(several, ["hash", "block"]).select("row", "idx", "name")
        rest = at.join(broadcast_if_small(shared, SMALL), "hash", "left_semi").withColumn("row", F.concat_ws(":", "doc_id", "text_sha256"))
        level = at.join(alone, "hash").select("doc_id", "text_sha256", "idx", "name").unionByName(
            rest.join(own, ["row", "idx"]).select("doc_id", "text_sha256", "idx", "name")
        )
    # rows alike in doc_id and text have equal sequences; one row stands for them until the end
    level = level.select("doc_id", "text_sha256", "idx", "name").distinct()
    longest = table.agg(F.max(F.size("hashes"))).first()[0] or 1
    finished = None
    rounds = 0
    while True:
        level = materialise(level, f"names-{rounds}")
        lone = level.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.first("name").alias("name")).where("n = 1")
        done = lone.select("doc_id", "text_sha256", F.struct(F.lit(rounds).alias("rounds"), "name").alias("identity"))
        if longest <= 1:
            finished = done if finished is None else finished.unionByName(done)
            break
        # a document with one name left drops out; the others pair their names
        finished = done if finished is None else finished.unionByName(done)
        pair = F.when(F.col("idx") % 2 == 0, F.col("name"))
        follow = F.when(F.col("idx") % 2 == 1, F.col("name"))
        pairs = (
            level.groupBy("doc_id", "text_sha256", F.floor(F.col("idx") / 2).cast("long").alias("half"))
            .agg(F.max(pair).alias("left"), F.coalesce(F.max(follow), F.lit(-1)).alias("right"))
        )
        rest = materialise(pairs.join(lone.select("doc_id", "text_sha256"), ["doc_id", "text_sha256"], "left_anti"), f"pairs-{rounds}")
        given = materialise(named(rest.select("left", "right").distinct(), "left", "right"), f"pair-names-{rounds}")
        level = rest.join(given, ["left", "right"]).select("doc_id", "text_sha256", F.col("half").alias("idx"), "name")
        longest = -(-longest // 2)
        rounds += 1
    return table.select("doc_id", "text_sha256").join(finished, ["doc_id", "text_sha256"])


def exact_dedup(docs: DataFrame, size: int = BLOCK_BYTES, bits: int = HASH_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    with scratch(docs.sparkSession) as result, arrow_bytes(docs.sparkSession):
        # written with a number, by which equal rows are told apart
        rows = materialise(identities(docs, size, bits).withColumn("row", F.monotonically_increasing_id()), "identities")
        groups = rows.groupBy("identity").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).cast("long").alias("group_size"))
        # written first, so that the join has two exchanges of its own and a large group's rows can be split
        joined = rows.join(materialise(groups, "groups"), "identity")
        kept = (F.col("row") == F.col("keep.row")).alias("kept")
        return result(joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept, "text_sha256"), "exact")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# A plain restatement over whole texts, for comparison.
ORACLE = """
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, arg_max(r, doc_id) AS keep_r, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, r = keep_r AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
