"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text form a group and stay in one shard, unless the group is more than half a shard:
a group is cut into as many pieces as it has halves of a shard. Each group goes where the dot product
of its vector (bytes, tokens, rows) with the shards' residual capacity is highest, in falling size.
Groups and pieces of at least 1 / ``LARGE`` of any total, at most three times LARGE of them, are
placed first, on the driver. The residual capacity that they leave is shared out evenly to buckets
of all other groups, and each bucket's groups are placed against its own part: the last ones placed
are the smallest, so every bucket ends near even.

Rows are numbered when they are measured. Slots follow from a rank inside a part of a shard, a part
being some of these numbers, plus the sizes of the parts before, so no task holds a whole shard or
a whole group.

Defined cases: a null text counts as empty, with size 1 and no token; an empty table gives an empty
result; repeated rows are separate rows of one group; equal sizes are placed in the order of the
group's hash; a long text counts with all its bytes; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.text import doc_id, text_or_empty
from tessella.plans import materialise, scratch

SHARDS = 16
#: A group of at least 1 / LARGE of all bytes, tokens or rows is placed on the driver.
LARGE = 8192
#: Groups that one bucket places, and rows that one part numbers, on average.
BUCKET_GROUPS, PART_ROWS = 20_000, 50_000
DIMENSIONS = ("size", "tokens", "rows")


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with a number of its own: size in bytes plus one, tokens, checksum and
    the hash of its text."""
    text = text_or_empty()
    ascii_words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(
        doc_id(),
        F.coalesce(F.octet_length(F.col("text").cast("string")) + 1, F.lit(1)).cast("long").alias("size"),
        F.size(ascii_words).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text, F.lit(7)).alias("group"),
        F.monotonically_increasing_id().alias("number"),
    )


def place(vectors: np.ndarray, shards: int, residual: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each row of ``vectors`` (items x dimensions, in units of a shard's capacity) and
    what capacity is left: in falling size, each goes where the dot product with the residual
    capacity is highest, ties to the lowest shard. Residuals may turn negative: the least overfull
    shard then has the highest product."""
    left = np.ones((shards, vectors.shape[1])) if residual is None else residual.copy()
    where = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-vectors.max(1), kind="stable"):
        where[i] = k = int(np.argmax(left @ vectors[i]))
        left[k] -= vectors[i]
    return where, left


def _matrix(rows: list, share: np.ndarray) -> np.ndarray:
    return np.array([[r[k] for k in DIMENSIONS] for r in rows], float).reshape(-1, len(DIMENSIONS)) / share


def place_small(groups: DataFrame, buckets: int, share: np.ndarray, residual: np.ndarray) -> DataFrame:
    """(group, shard) of groups that no one bucket or task need know all of."""
    part = residual / buckets

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("group")
        vectors = np.stack([table.column(k).to_numpy() for k in DIMENSIONS], 1) / share
        return pa.table({"group": table.column("group"), "shard": pa.array(place(vectors, len(part), part)[0], pa.int32())})

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(pack, "group long, shard int")


def slots(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with a gapless ``slot`` in each ``shard``; ``number`` tells rows apart."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(parts)))
    sizes = materialise(dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")), "shard-parts")
    before = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("number"))
    return dealt.withColumn("nth", rank).join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("nth") - 1).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, large: int = LARGE) -> DataFrame:
    """``docs`` with doc_id, size, text_crc32, tokens, group, shard and a gapless slot."""
    spark = docs.sparkSession
    with scratch(spark) as result:
        rows = materialise(measured(docs), "shard-rows")
        sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).cast("long").alias("rows")]
        groups = materialise(rows.groupBy("group").agg(*sums), "shard-groups")
        total = groups.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in DIMENSIONS], F.count(F.lit(1)).alias("groups")).first()
        share = np.array([max(1, total[k]) / shards for k in DIMENSIONS])

        def part(column: str, i: int) -> Column:
            return F.col(column) / F.lit(float(share[i]))

        most = F.greatest(*[part(k, i) for i, k in enumerate(DIMENSIONS)])
        heavy = groups.withColumn("most", most).where(F.col("most") >= shards / large).collect()  # at most three times ``large``
        pieces = {g["group"]: int(np.ceil(2 * g["most"])) for g in heavy}
        cut = spark.createDataFrame(sorted(pieces.items()), "group long, pieces int")
        tagged = rows.join(F.broadcast(cut), "group", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("number", F.lit(3)), F.col("pieces"))).cast("int"))
        tagged = tagged.drop("pieces")
        own = sorted(tagged.where("piece is not null").groupBy("group", "piece").agg(*sums).collect(), key=lambda r: (r["group"], r["piece"]))
        at, residual = place(_matrix(own, share), shards)
        placed = spark.createDataFrame([(r["group"], r["piece"], int(k)) for r, k in zip(own, at, strict=True)], "group long, piece int, shard int")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["groups"] // BUCKET_GROUPS)
        small = place_small(groups.join(F.broadcast(cut), "group", "left_anti"), buckets, share, residual)
        # a small group has less than 1 / large of the rows, a large one is looked up by broadcast
        columns = ["doc_id", "size", "tokens", "text_crc32", "group", "number", "shard"]
        both = tagged.where("piece is null").join(materialise(small, "shard-small"), "group").select(*columns).unionByName(
            tagged.where("piece is not null").join(F.broadcast(placed), ["group", "piece"]).select(*columns)
        )
        numbered = slots(materialise(both, "shard-placed"), max(8, total["rows"] // shards // PART_ROWS))
        return result(numbered.select("doc_id", "size", "tokens", "text_crc32", "group", "shard", "slot"), "shards")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose sums of sizes are near equal (law ``bytes``)."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
