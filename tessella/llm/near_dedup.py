"""Near-duplicates by one-permutation MinHash with banded buckets and star-shaped candidates.

Texts with the same words are one class; one member stands for it from then on. Its shingle set is
hashed once into bins, empty bins are densified, and bins are grouped into bands; classes that
share a band's values share a bucket. In each bucket the member that meets most others, over all
its buckets, is the centre, and the candidates are the pairs of centre and member: at most one per
row of a bucket, however large. A candidate whose sketches are far below the threshold is put off;
the others are confirmed on the full shingle sets. Then the links' components are taken. In buckets
where several components are left, a text may be linked to a member that was no centre, or to one
that was put off: the texts of such buckets are joined exactly. A text's shingles are ordered by the
number of texts that hold them, rarest first; of two texts at the threshold the larger has a common
one among its first n - ceil(0.8 n) + 1 and the smaller among its first n - ceil(8/9 n) + 1, so the
candidates come from an equi-join on those, with bounds by size and place, and each candidate whose
ends are still in different components is confirmed in full. Two texts at the threshold share none
of the ``BANDS`` bands with probability below 3e-6, and at 0.85 below 3e-9.

Only rows that a bucket brings together are read again. Joins are equi-joins that adaptive
execution splits where a text class or bucket is large, because what they join is written before
or dealt anew; no group is collected.

Defined cases: a null or empty text, or one of white space only, has no shingle and is linked with
nothing; fewer words than a shingle make one shingle, the whole sequence; rows with one doc_id and
different words are different nodes, and the component's id is the least doc_id of its rows; texts
of any length are hashed whole; ties in the choice of a centre go by the node's hash; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.minhash import low_bits, signatures, walks
from tessella.llm.text import arrow_bytes, chunks, doc_id, hash_words, mix64, shingle_hashes, text_or_empty, words
from tessella.operators.graph import connected_components
from tessella.plans import broadcast_if_small, materialise, scratch

WORDS, PERCENT = 5, 80
BINS, ROWS = 256, 6
BANDS = BINS // ROWS
#: Bins whose low byte is kept as the sketch, and the agreeing ones below which a candidate of a star
#: is put off to the exact join: six standard deviations under 0.8.
SKETCH, AGREE = 64, 31
#: Bytes of shingle sets and of texts that reach a Python worker at a time.
STEP_BYTES = 8_000_000
#: Rows up to which the list of candidate documents is broadcast to the scan of texts.
SMALL = 100_000


def _node(text: str) -> int:
    """A 63-bit name of a text's sequence of words, from its SHA-256."""
    return int.from_bytes(hashlib.sha256(b" ".join(text.encode().lower().split())).digest()[:8], "little") >> 1


def _bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row; the band's number is part of the key."""
    out = np.zeros((len(values), BANDS), np.uint64)
    for r in range(ROWS):
        out += mix64(values[:, r : BANDS * ROWS : ROWS] + np.uint64(r)) * np.uint64(2 * r + 0x9E3779B97F4A7C15)
    return mix64(out + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def signed(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, text_sha256, n_shingles, node, sketch and bands of every document; node is null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = walks(BINS)
        for part in chunks(batches, "text"):
            codes, distinct, offsets = words(part.column("text"))
            sets = list(shingle_hashes(codes, hash_words(distinct), offsets, k))
            values = signatures(sets, BINS, walk)
            sizes = [len(s) for s in sets]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(_bands(values).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_sha256"),
                    pa.array(sizes, pa.int64()),
                    pa.array([_node(t) if n else None for t, n in zip(part.column("text").to_pylist(), sizes, strict=True)], pa.int64()),
                    pa.array([r.tobytes() for r in low_bits(values[:, :: BINS // SKETCH], 8)], pa.binary()),
                    bands,
                ],
                names=["doc_id", "text_sha256", "n_shingles", "node", "sketch", "bands"],
            )

    rows = docs.select(doc_id(), F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"), text_or_empty().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_sha256 string, n_shingles long, node long, sketch binary, bands array<long>")


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb, sa, sb) whose sizes and sketches allow a link, once each."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, SKETCH) for c in ("sa", "sb"))
            yield part.select(["a", "b"]).filter(pa.array((left == right).sum(1) >= AGREE))

    sized = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "sa", "sb")
    return sized.mapInArrow(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted (doc_id, text_sha256, node), one row each: the sorted distinct
    hashes of the text's shingles as packed 64-bit integers. Ids and texts name a row together, so that
    rows without id, or with one id, meet only their own."""
    rows = docs.select(doc_id(), F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"), text_or_empty().alias("text"))
    rows = rows.join(broadcast_if_small(wanted, SMALL), ["doc_id", "text_sha256"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            codes, distinct, offsets = words(part.column("text"))
            sets = [s.tobytes() for s in shingle_hashes(codes, hash_words(distinct), offsets, k)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(own, "node long, shingles binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) with 100 * common >= percent * union of their full shingle sets."""
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("sa"), part.column("sb"), strict=True):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirm, "a long, b long")


def first_stars(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """One star per bucket; its centre is the member that meets most others over all its buckets."""
    met = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = buckets.join(met, "node").select("bucket", "node", F.struct("met", F.xxhash64("node").alias("h"), "node").alias("place"))
    top = materialise(ranked.groupBy("bucket").agg(F.max("place").alias("top")).select("bucket", F.col("top.node").alias("a")), "centres")
    pairs = buckets.join(top, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    has = classes.select("node", "n_shingles", "sketch")
    return _alike(pairs.join(has.toDF("a", "na", "sa"), "a").join(has.toDF("b", "nb", "sb"), "b"), percent)


def undecided(placed: DataFrame) -> DataFrame:
    """The (node, component) that share a bucket with another component."""
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return placed.join(materialise(several.select("bucket"), "several"), "bucket", "left_semi").select("node", "component").distinct()


def exploded(sets: DataFrame) -> DataFrame:
    """(node, component, n, shingle) of every distinct shingle of the sets (node, component, shingles)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "shingles"):
            sizes = pc.binary_length(part.column("shingles")).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            own = [pa.array(np.repeat(v, sizes)) for v in (part.column("node").to_numpy(), part.column("component").to_numpy(), sizes)]
            flat = np.frombuffer(b"".join(part.column("shingles").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([*own, pa.array(flat)], names=["node", "component", "n", "shingle"])

    return sets.select("node", "component", "shingles").mapInArrow(cut, "node long, component long, n long, shingle long")


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each text that another text holds too, with their place ``i`` among
    all of the text's shingles: of two texts at the threshold the larger has a common one here, and
    the smaller one that is marked ``least``."""
    counts = materialise(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shingle-counts")
    own = Window.partitionBy("node")
    # those that no other text holds come first and can meet nothing; only their number is needed
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "shingle"))
    placed = rows.join(counts, "shingle").withColumn("i", place).where(F.expr(f"i <= n - (n * {percent} + 99) div 100 + 1"))
    least = F.expr(f"i <= n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1")
    return placed.select("shingle", "node", "component", "n", "i", least.alias("least"))


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of different components ca, cb that share a prefix's shingle and that sizes and
    places allow, with the number of such shingles. In a shingle the rows of its largest component
    meet only those outside it, so a large component costs no pairs of its own."""
    shares = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"))
    top = shares.groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("several")).where("several > 1")
    largest = materialise(top.select("shingle", F.col("top.component").alias("of")), "largest")
    met = materialise(rows.join(largest, "shingle"), "met")
    left = met.where("component <> of").drop("of").toDF("shingle", "x", "cx", "nx", "ix", "lx")
    right = met.toDF("shingle", "y", "cy", "ny", "iy", "ly", "of")
    both = left.join(right, "shingle").where("cx <> cy and (cy = of or x < y) and ((lx and nx <= ny) or (ly and ny <= nx))")
    # at the first common shingle of a linked pair, it and what follows in both hold all that is common
    common = F.lit(1) + F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    near = both.where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent).where(common * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent)
    first = F.col("x") < F.col("y")
    ends = [F.when(first, F.col(u)).otherwise(F.col(v)).alias(n) for u, v, n in (("x", "y", "a"), ("y", "x", "b"), ("cx", "cy", "ca"), ("cy", "cx", "cb"))]
    return near.select(*ends).groupBy("a", "b", "ca", "cb").agg(F.count(F.lit(1)).alias("hits"))


def components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_sha256, n_shingles, node, component, component_id and kept of every document. Rows
    that share a component's least doc_id are all kept; ``component`` tells components apart."""
    with scratch(docs.sparkSession) as result, arrow_bytes(docs.sparkSession, STEP_BYTES):
        signatures_ = materialise(signed(docs, k), "signatures")
        members = signatures_.select("doc_id", "text_sha256", "n_shingles", "node")
        classes = materialise(
            signatures_.where("node is not null").groupBy("node")
            .agg(F.min_by(F.struct("doc_id", "text_sha256", "n_shingles", "sketch", "bands"), F.struct("doc_id", "text_sha256")).alias("one")).select("node", "one.*"),
            "classes",
        )
        every = classes.select("node", F.explode("bands").alias("bucket"))
        counted = materialise(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
        buckets = materialise(every.join(counted, "bucket").select("bucket", "node", "n"), "buckets")

        def read(nodes: DataFrame, name: str) -> DataFrame:
            wanted = materialise(nodes.distinct().join(classes.select("node", "doc_id", "text_sha256"), "node"), f"wanted-{name}")
            return materialise(sets_of(docs, wanted, k), f"sets-{name}")

        def confirm(pairs: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
            return materialise(confirmed(pairs, sets, percent), f"links-{turn}")

        pairs = materialise(first_stars(buckets, classes, percent), "pairs-0")
        sets = read(pairs.select(F.explode(F.array("a", "b")).alias("node")), "0")
        links = confirm(pairs, sets, 0)
        labels = connected_components(links)
        placed = materialise(buckets.drop("n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        rows = materialise(undecided(placed), "undecided")
        later = None
        if not rows.isEmpty():
            sets = sets.unionByName(read(rows.select("node").join(sets, "node", "left_anti"), "1"))
            own = exploded(sets.join(broadcast_if_small(rows, SMALL), "node"))
            found = materialise(candidates(materialise(prefixes(own, percent), "prefixes"), percent), "candidates")
            if not found.isEmpty():
                later = further(found, lambda pairs, turn: confirm(pairs, sets, turn))
        named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if later is not None:
            grown = connected_components(later, "ca", "cb").toDF("component", "into")
            named = named.join(grown, "component", "left").withColumn("component", F.coalesce("into", "component"))
        least = materialise(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
        final = named.join(least, "component", "left").select(
            "doc_id", "text_sha256", "n_shingles", "node", "component", F.coalesce("least", "doc_id").alias("component_id"),
            (F.coalesce("least", "doc_id") == F.col("doc_id")).alias("kept"),
        )
        return result(final, "near")


def further(found: DataFrame, confirm: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Links (ca, cb) between components that the candidates ``found`` hold. The likeliest pair of
    two components is confirmed first: where it is a link, their other pairs need no reading."""
    top = F.max(F.struct("hits", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("top")
    likely = materialise(found.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(top).select("top.a", "top.b"), "likely")

    def joins(pairs: DataFrame, turn: int) -> DataFrame:
        return materialise(found.join(confirm(pairs, turn), ["a", "b"]).select("ca", "cb").distinct(), f"joined-{turn}")

    first = joins(likely, 1)
    into = connected_components(first, "ca", "cb")
    rest = found.join(likely, ["a", "b"], "left_anti").join(into.toDF("ca", "ra"), "ca", "left").join(into.toDF("cb", "rb"), "cb", "left")
    rest = materialise(rest.where(F.coalesce("ra", "ca") != F.coalesce("rb", "cb")).select("a", "b"), "rest")
    return first if rest.isEmpty() else first.unionByName(joins(rest, 2))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at 0.8 on four-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return components(docs, k=4).select("doc_id", "n_shingles", "component_id", "kept")
