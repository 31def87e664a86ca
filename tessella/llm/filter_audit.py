"""Audit of how filters interact: a table-driven transducer over bytes, then a decision table.

Each text is read once as bytes. A table of 256 entries gives a byte's class and a table of two
classes, the byte's before and its own, gives what the step between them emits: the begin or the end
of a word, a code point, a capital, a symbol. The states are a function of the last byte alone, so
that the pass is a look-up over whole batches. Word spans go into a hash table by a polynomial hash
that follows from sums over the batch, in rounds of open addressing; a span takes a slot as its own
only after its bytes are compared with the slot's first span, so equal hashes of unlike words are told
apart.

What a document fails is a mask of five bits. The masks are counted by part with the labels that they
meet, and these counts, at most 32 a part, are joined on the mask with a table of what happens to it
at each step of each of the 120 orders, a fixed number of rows.

Defined cases: a null text is the empty text, which fails A, and not B, C or D; a null lang is the part of the
empty string; rows without doc_id are never held to be copies and make no row one; rows that share
doc_id and text are not copies of each other, and each is counted; several labels of an id count as
each value that one of them has; long texts are read whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.text import arrow_bytes, chunks, mix64, text_or_empty
from tessella.plans import materialise, scratch

FILTERS = "ABCDE"
#: A: fewest words; B: least share of distinct words; C: largest share of capitals, both in percent.
WORDS, DISTINCT, CAPITALS = 100, 80, 10
SYMBOLS = "#$%&*|"

# classes of bytes
SPACE, PLAIN, CAPITAL, SYMBOL, FOLLOWS = range(5)
# what a step emits, as bits
BEGIN, END, POINT, UPPER, MARK = 1, 2, 4, 8, 16
#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def classes() -> np.ndarray:
    """The class of each byte of UTF-8."""
    out = np.full(256, PLAIN, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[ord("A") : ord("Z") + 1] = CAPITAL
    out[[ord(c) for c in SYMBOLS]] = SYMBOL
    out[0x80:0xC0] = FOLLOWS  # a later byte of a code point
    return out


def transitions() -> np.ndarray:
    """What is emitted at a byte, by the class of the byte before and its own."""
    out = np.zeros((5, 5), np.uint8)
    for before in range(5):
        for now in range(5):
            out[before, now] = (
                BEGIN * (before == SPACE and now != SPACE) + END * (before != SPACE and now == SPACE) + POINT * (now != FOLLOWS) + UPPER * (now == CAPITAL) + MARK * (now == SYMBOL)
            )
    return out


CLASSES, STEPS = classes(), transitions()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b`` of the lengths hold the same bytes; no length is 0."""
    first = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(first, length)
    equal = data[np.repeat(a, length) + inside] == data[np.repeat(b, length) + inside]
    return np.logical_and.reduceat(equal, first) if len(length) else np.zeros(0, bool)


def first_spans(data: np.ndarray, begin: np.ndarray, length: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each span, whether it is the one that stands for its word among its owner's.

    All spans that have no slot yet try theirs at once: the last to be written into a free slot has
    it; those that equal it, byte for byte and in owner, are settled; the others try the next slot."""
    bits = max(4, int(2 * len(begin)).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    waiting = np.arange(len(begin))
    stands = np.zeros(len(begin), bool)
    while len(waiting):
        at = slot[waiting]
        free = table[at] < 0
        table[at[free]] = waiting[free]
        holder = table[at]
        stands[holder[holder == waiting]] = True
        alike = (owner[holder] == owner[waiting]) & (length[holder] == length[waiting]) & (hashes[holder] == hashes[waiting])
        alike[alike] = _same(data, begin[holder[alike]], begin[waiting[alike]], length[waiting[alike]])
        waiting = waiting[~alike]
        slot[waiting] = (slot[waiting] + 1) & ((1 << bits) - 1)
    return stands


def transduce(column: pa.Array, spread: int = (1 << 64) - 1) -> dict[str, np.ndarray]:
    """words, distinct, points, capitals and symbols of each text. ``spread`` masks the hashes; tests
    lower it so that they collide."""
    raw = column.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    base, total = int(offsets[0]), int(offsets[-1] - offsets[0])
    data = np.frombuffer(raw.buffers()[2], np.uint8, total, base) if total else np.zeros(0, np.uint8)
    offsets = offsets - base
    own = CLASSES[data]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = SPACE  # each text begins outside a word
    emitted = STEPS[before, own]

    def per_text(bit: int) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum((emitted & bit) > 0)])[offsets])

    begin = np.flatnonzero(emitted & BEGIN)
    # a word ends at a space, or where its text does
    lasts = offsets[1:][offsets[:-1] < offsets[1:]]
    lasts = lasts[own[lasts - 1] != SPACE] if total else lasts
    ends = np.sort(np.concatenate([np.flatnonzero((emitted & END) > 0), lasts]))
    owner = np.searchsorted(offsets, begin, "right") - 1
    length = ends - begin
    with np.errstate(over="ignore"):
        up, down = _powers(total + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        hashes = mix64(((sums[ends] - sums[begin]) * down[begin] + owner.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) & np.uint64(spread))
    stands = first_spans(data, begin, length, hashes, owner)
    texts = len(offsets) - 1
    return {
        "words": np.bincount(owner, minlength=texts), "distinct": np.bincount(owner[stands], minlength=texts), "points": per_text(POINT), "capitals": per_text(UPPER), "symbols": per_text(MARK),
    }


def failures(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The mask of A to D that each text fails; A is the lowest bit."""
    return (
        (counts["words"] < WORDS) * 1 + (100 * counts["distinct"] < DISTINCT * counts["words"]) * 2
        + (100 * counts["capitals"] > CAPITALS * counts["points"]) * 4 + (counts["symbols"] > 0) * 8
    ).astype(np.int32)


def read(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_sha256 (binary), words, distinct, points, capitals, symbols and mask (A to
    D) of every document."""
    numbers = ("words", "distinct", "points", "capitals", "symbols")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            counts = transduce(part.column("text"))
            shas = [hashlib.sha256(x.as_buffer() or b"").digest() for x in part.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array(shas, pa.binary()), *[pa.array(counts[n], pa.int64()) for n in numbers], pa.array(failures(counts), pa.int32())],
                names=["doc_id", "part", "text_sha256", *numbers, "mask"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    return rows.mapInArrow(own, "doc_id long, part string, text_sha256 binary, " + ", ".join(f"{n} long" for n in numbers) + ", mask int")


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask of all five filters, good and toxic of every document."""
    spark = docs.sparkSession
    with arrow_bytes(spark):
        rows = materialise(read(docs).select("doc_id", "part", "text_sha256", "mask"), "audit-rows")
    groups = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # what is joined is written first, so that a large group's rows, or those without id, can be split
    groups = materialise(groups.select("text_sha256", "first"), "audit-copies")
    known = materialise(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "audit-labels")
    copied = rows.join(groups, "text_sha256", "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    yes = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return materialise(copied, "audit-masks").join(known, "doc_id", "left").select("doc_id", "part", "mask", *yes)


def decisions(filters: str = FILTERS) -> list[tuple]:
    """(mask, filter_order, step, filter, kept, removed, redundant, alone, turns) for each mask, order
    and step; turns: the number of all orders in which the filter removes the mask."""
    out = []
    orders = ["".join(p) for p in permutations(filters)]
    for mask in range(1 << len(filters)):
        failed = [f for i, f in enumerate(filters) if mask >> i & 1]
        for order in orders:
            for step, f in enumerate(order, 1):
                gone = any(x in failed for x in order[: step - 1])
                fails = f in failed
                turns = len(orders) // len(failed) if fails else 0
                out.append((mask, order, step, f, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(failed == [f]), turns))
    return out


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley."""
    spark = documents.sparkSession
    counts = masked(documents, labels).groupBy("part", "mask").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("n", F.lit(True)), ("good", F.col("good")), ("bad", F.col("toxic")))])
    # 32 masks times 600 steps, whatever the input
    table = spark.createDataFrame(decisions(), "mask int, filter_order string, step int, filter string, kept long, removed long, redundant long, alone long, turns long")
    each = materialise(counts, "audit-counts").join(F.broadcast(table), "mask")
    sums = {"kept": ("n", "kept"), "removed": ("n", "removed"), "redundant": ("n", "redundant"), "unique_fails": ("n", "alone"), "good_lost": ("good", "removed"), "toxic_lost": ("bad", "removed"), "shapley": ("n", "turns")}
    return each.groupBy("part", "filter_order", "step").agg(*[F.sum(F.col(a) * F.col(b)).cast("long").alias(n) for n, (a, b) in sums.items()])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents, by language."""
    with scratch(spark) as result:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
        return result(audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "audit")


ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, [len(words) < {WORDS}, 100 * len(list_distinct(words)) < {DISTINCT} * len(words), 100 * len(regexp_extract_all(t, '[A-Z]')) > {CAPITALS} * length(t), regexp_matches(t, '[#$%&*|]'), e] AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS bad, len(list_filter(fails, lambda x: x)) AS failed FROM m GROUP BY part, fails),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT p, array_to_string(list_transform(p, lambda x: 'ABCDE'[x]), '') AS filter_order, f.i AS step FROM o, f),
r AS (SELECT part, filter_order, step, n, good, bad, failed, fails[p[step]] AS own, len(list_filter(p[:step - 1], lambda x: fails[x])) > 0 AS gone FROM c, s)
SELECT part, filter_order, step::int AS step, sum(CASE WHEN own OR gone THEN 0 ELSE n END)::bigint AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::bigint AS removed,
  sum(CASE WHEN own AND gone THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END)::bigint AS unique_fails,
  sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN own AND NOT gone THEN bad ELSE 0 END)::bigint AS toxic_lost,
  sum(CASE WHEN own THEN n * 120 // failed ELSE 0 END)::bigint AS shapley
FROM r GROUP BY part, filter_order, step
"""
