"""Document fingerprints: one-permutation MinHash, packed low-order bits, bias-corrected likeness.

A fingerprint keeps the lowest ``BITS`` bits of each bin of the signature of a text's five-word
shingles, as hexadecimal text. Unlike bins still agree by chance with probability 2 ** -BITS, which
the likeness of two fingerprints takes out.

To compare each document with the next by doc_id, rows are dealt into ranges of doc_id and, among
equal ids, of a hash of the text. There are as many ranges as the text's bytes call for, ``MOST_RANGES``
at most, and the first row of a range is also given to the range before it (the very first to the
last). A task then reads its range in order, sorted by Spark, and holds one row back, so that a
range may be of any size; the text is read twice and shuffled once. The driver holds a sample of at
most ``RANGE_SAMPLE`` rows a range and one row a range.

Defined cases: a null text counts as empty; a text without words has an empty fingerprint, like
only to another such; a text of fewer than five words has one shingle, the whole; rows of equal
doc_id follow each other by the hash of their text, and equal rows by nothing; a long text is
shingled whole; the only document is its own next; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.minhash import low_bits, signatures, walks
from tessella.llm.text import chunks, doc_id, hash_words, shingle_hashes, text_or_empty, words
from tessella.plans import materialise

WORDS = 5
BINS, BITS = 256, 4
#: Bytes of text in a range on average, and rows sampled per range to find the ranges' bounds.
RANGE_BYTES, RANGE_SAMPLE = 8_000_000, 100
#: Ranges at most, whatever the input.
MOST_RANGES = 10_000


def packed(texts: list[str], walk: np.ndarray, bins: int = BINS, bits: int = BITS, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as rows of bytes, and whether each text has words."""
    codes, distinct, offsets = words(pa.array(texts, pa.string()))
    sets = list(shingle_hashes(codes, hash_words(distinct), offsets, k))
    low = low_bits(signatures(sets, bins, walk), bits)
    spread = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(spread.reshape(len(texts), -1), axis=1), np.diff(offsets) > 0


def likeness(a: np.ndarray, b: np.ndarray, a_any: np.ndarray, b_any: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated share of common shingles of two rows of fingerprints, from 0 to 1."""
    ua = np.unpackbits(a, axis=1).reshape(len(a), -1, bits)
    ub = np.unpackbits(b, axis=1).reshape(len(b), -1, bits)
    same = (ua == ub).all(2).mean(1) if len(a) else np.zeros(0)
    chance = 2.0**-bits
    out = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where(a_any & b_any, out, (a_any == b_any).astype(float))


def _placed(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Keys that numpy orders by id, then tie."""
    out = np.empty(len(ids), [("id", np.int64), ("tie", np.int64)])
    out["id"], out["tie"] = ids, ties
    return out


def ranged(docs: DataFrame, ranges: int | None = None) -> tuple[DataFrame, int]:
    """Rows with their range and ``ahead``: true for the copy of a range's first row that the range
    before it gets; and the number of ranges. The driver holds a sample of bounded size, which only
    sets the bounds, and a few numbers per range."""
    spark = docs.sparkSession
    keys = materialise(docs.select(doc_id(), F.xxhash64(text_or_empty()).alias("tie"), F.octet_length(text_or_empty()).alias("size")), "range-keys")
    total = keys.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = ranges or min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["bytes"] // RANGE_BYTES))
    every = max(1, total["rows"] // (ranges * RANGE_SAMPLE))
    sample = keys.where(F.pmod(F.xxhash64("doc_id", "tie", F.lit(9)), F.lit(every)) == 0).select("doc_id", "tie").toArrow()
    known = np.sort(_placed(sample.column("doc_id").to_numpy(), sample.column("tie").to_numpy()))
    bounds = np.unique(known[[i * len(known) // ranges for i in range(1, ranges)]]) if len(known) else known

    def place(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _placed(ids.to_numpy(), ties.to_numpy()), side="right"))

    where = F.pandas_udf(place, "long")
    firsts = sorted(tuple(r["first"]) + (r["range"],) for r in keys.groupBy(where("doc_id", "tie").alias("range")).agg(F.min(F.struct("doc_id", "tie")).alias("first")).collect())
    table = spark.createDataFrame([(d, t, firsts[i - 1][2]) for i, (d, t, _) in enumerate(firsts)], "doc_id long, tie long, before long")
    rows = docs.select(doc_id(), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("range", where("doc_id", "tie"))
    own = F.struct(F.col("range"), F.lit(False).alias("ahead"))
    copy = F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))
    return (
        rows.join(F.broadcast(table), ["doc_id", "tie"], "left")
        .select("doc_id", "tie", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to"))
        .select("to.range", "to.ahead", "doc_id", "tie", "text"),
        len(bounds) + 1,
    )


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by the first as many code points of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likenesses."""
    rows, number = ranged(docs, ranges)
    dealt = rows.repartition(number, "range").sortWithinPartitions("range", "ahead", "doc_id", "tie")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = walks(BINS)
        held: tuple | None = None
        for part in chunks(batches, "text"):
            columns = [part.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text")]
            rows = ([held] if held else []) + list(zip(*columns, strict=True))
            held = rows[-1]
            texts = [r[3] for r in rows]
            prints, any_words = packed(texts, walk)
            # a row with the row after it, where both are of one range; a range's further copies of its end fall out
            at = np.array([i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]], np.int64)
            if not len(at):
                continue
            new = [edited(texts[i], texts[i + 1]) for i in at]
            other, other_any = packed(new, walk)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in at], pa.int64()),
                    pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                    pa.array([prints[i].tobytes().hex() if any_words[i] else "" for i in at], pa.string()),
                    pa.array([p.tobytes().hex() if w else "" for p, w in zip(other, other_any, strict=True)], pa.string()),
                    pa.array(likeness(prints[at], other, any_words[at], other_any), pa.float64()),
                    pa.array(likeness(prints[at], prints[at + 1], any_words[at], any_words[at + 1]), pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.mapInArrow(compare, RESULT)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their likeness to edited and following texts."""
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
