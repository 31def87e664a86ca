"""Hard negatives by inner product, from an R-tree packed by sort-tile-recursive.

Vectors are integers. The coordinates of largest spread are cut at their quantiles into tiles, rows
are range-partitioned by tile, and within a partition they are sorted and sliced coordinate by
coordinate down to leaves. Consecutive leaves make nodes, and nodes a subtree; a subtree is one row
of a table, with its vectors and the minimum bounding boxes of its leaves. A box bounds an inner
product coordinate by coordinate: q times the nearer or the farther side.

Anchors are searched in rounds of a bounded number, which every task gets. A task puts the roots of
its subtrees into a queue and always opens the box of the highest upper bound, for the anchors that
still need it: a box is passed over where its bounds lie outside the score window or its upper bound
is strictly below the k-th score found so far. Tasks give their best few a slot, and Spark merges
them. The first search finds each anchor's positives; each positive then gives a window for the
second, which finds its negatives. The search is exact.

Defined cases: rows with a null id, label, vector or component, or one that is not finite, take no
part; of rows equal in id, label and integer vector one takes part; rows that share an id and differ
are rows of their own, told apart by a hash, and so are their anchors; shorter vectors count as
filled up with zeros; components beyond 2^23 count as 2^23, so that scores fit a long; ties go by id,
then by that hash; an anchor without positives or a positive without negatives gives no row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.text import arrow_bytes
from tessella.plans import materialise, scratch

#: Rows of a leaf, children of a node, rows of a subtree, and rows that a task sorts at a time.
LEAF, FAN, BLOCK, SLAB = 32, 8, 2048, 8192
#: Coordinates by whose quantiles partitions are cut.
TILES = 3
#: Anchors of a round, and those that a queue serves together.
ANCHORS, GROUP = 4096, 512
POSITIVES, NEGATIVES = 5, 5
#: The window of a negative's score in percent of the positive's.
LOW, HIGH = 80, 100
MOST = 1 << 23
SUBTREE = "ids binary, rows binary, labels binary, vectors binary, low binary, high binary"


def integer_vectors(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component, null where one is null or not finite."""
    whole = F.expr(f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    cut = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    return F.when(whole, cut)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Integer lists as rows of a matrix, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int32)
    out = np.zeros((len(sizes), width), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def tiled(vectors: np.ndarray, coordinates: list[int], leaf: int = LEAF) -> np.ndarray:
    """The sort-tile-recursive order of the rows: consecutive runs of ``leaf`` are leaves."""
    leaves = -(-len(vectors) // leaf)
    if leaves <= 1 or not coordinates:
        return np.arange(len(vectors))
    slices = int(np.ceil(leaves ** (1 / len(coordinates)) - 1e-9))
    size = leaf * -(-leaves // slices)
    order = np.argsort(vectors[:, coordinates[0]], kind="stable")
    return np.concatenate([part[tiled(vectors[part], coordinates[1:], leaf)] for part in (order[i : i + size] for i in range(0, len(order), size))])


def boxes(low: np.ndarray, high: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Boxes around each ``fan`` consecutive boxes."""
    at = np.arange(0, len(low), fan)
    return np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def tree(rows: DataFrame, width: int, spread: list[int], count: int) -> DataFrame:
    """The packed subtrees of rows (vec_id, label, vector, row); ``spread``: coordinates, that of the
    largest spread first."""
    slabs = max(1, -(-count // SLAB))
    first, then = spread[:TILES], spread[TILES:] or spread
    coordinate = [F.coalesce(F.get("vector", F.lit(c)), F.lit(0)) for c in first]
    cuts = max(1, int(np.ceil(slabs ** (1 / max(1, len(first))) - 1e-9)))
    tiles: list[Column] = [F.lit(0)]
    if cuts > 1:
        shares = [i / cuts for i in range(1, cuts)]
        quantiles = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(coordinate)]).first()
        tiles = [sum((F.when(c > int(v), 1).otherwise(0) for v in q or []), F.lit(0)) for c, q in zip(coordinate, quantiles, strict=True)]
    keyed = rows.select("vec_id", "label", "vector", "row", *[t.alias(f"t{i}") for i, t in enumerate(tiles)])
    key = [*[f"t{i}" for i in range(len(tiles))], "vec_id", "row"]

    def packed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, own, labels, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        deep = max(1, int(np.ceil(np.log2(max(2, -(-len(ids) // LEAF))))))
        order = tiled(vectors, then[:deep], LEAF)
        for a in range(0, len(order), BLOCK):
            o = order[a : a + BLOCK]
            low, high = boxes(vectors[o], vectors[o], LEAF)
            columns = [ids[o], own[o], labels[o], vectors[o], low, high]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=["ids", "rows", "labels", "vectors", "low", "high"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
            new = np.ones(len(ids), bool)  # equal rows are neighbours
            new[1:] = (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])
            new[0] = last != (ids[0], own[0])
            last = (ids[-1], own[-1])
            at = np.flatnonzero(new)
            labels, vectors = batch.column("label").to_numpy(), matrix(batch.column("vector"), width)
            for a in range(0, len(at), SLAB):
                o = at[a : a + SLAB]
                if held and held + len(o) > SLAB:
                    yield from packed(parts)
                    parts, held = [], 0
                parts.append((ids[o], own[o], labels[o], vectors[o]))
                held += len(o)
        if parts:
            yield from packed(parts)

    return keyed.repartitionByRange(slabs, *key).sortWithinPartitions(*key).select("vec_id", "label", "vector", "row").mapInArrow(pack, SUBTREE)


class Subtree:
    """A row of the tree's table, with the boxes of all levels; level 0 are the leaves."""

    def __init__(self, record: dict, width: int, kind: type):
        self.ids, self.rows = np.frombuffer(record["ids"], np.int64), np.frombuffer(record["rows"], np.int64)
        self.labels = np.frombuffer(record["labels"], np.int32)
        self.vectors = np.frombuffer(record["vectors"], np.int32).reshape(len(self.ids), width).astype(kind)
        leaves = -(-len(self.ids) // LEAF)
        level = tuple(np.frombuffer(record[c], np.int32).reshape(leaves, width).astype(kind) for c in ("low", "high"))
        self.levels = [level]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(boxes(*self.levels[-1], FAN))

    def bounds(self, level: int, nodes: slice, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the inner products of each query with what lies in each node."""
        low, high = (x[nodes].T for x in self.levels[level])
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ high + down @ low, up @ low + down @ high


class Slots:
    """The best ``k`` rows of each slot so far. A slot is an anchor with a score window; ``same`` says
    whether rows of its label are asked for or all others."""

    def __init__(self, queries: np.ndarray, label: np.ndarray, own: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.queries, self.label, self.own, self.anchor, self.same, self.k = queries, label, own, anchor, same, k
        kind = queries.dtype
        self.none = kind.type(-np.inf) if kind.kind == "f" else np.iinfo(kind).min
        self.low, self.high = low.astype(kind), high.astype(kind)
        n = len(anchor)
        self.score = np.full((n, k), self.none, kind)
        self.id, self.row = (np.full((n, k), np.iinfo(np.int64).max) for _ in range(2))

    def open(self, slots: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Those of the slots that a box with these bounds can still give a row."""
        return slots[(up >= np.maximum(self.low[slots], self.score[slots, -1])) & (down <= self.high[slots])]

    def offer(self, slots: np.ndarray, t: Subtree, a: int, b: int) -> None:
        """Compare rows a to b of a subtree with the slots."""
        anchors, at = np.unique(self.anchor[slots], return_inverse=True)
        s = (self.queries[anchors] @ t.vectors[a:b].T)[at]
        ids, rows = t.ids[None, a:b], t.rows[None, a:b]
        own = self.anchor[slots]
        fits = (t.labels[None, a:b] == self.label[own][:, None]) == self.same
        fits &= (s >= self.low[slots][:, None]) & (s <= self.high[slots][:, None])
        last, last_id, last_row = (x[slots, -1][:, None] for x in (self.score, self.id, self.row))
        fits &= (s > last) | ((s == last) & ((ids < last_id) | ((ids == last_id) & (rows < last_row))))
        fits &= rows != self.own[own][:, None]
        i, j = np.nonzero(fits)
        if not len(i):
            return
        touched = np.unique(slots[i])
        slot = np.concatenate([np.repeat(touched, self.k), slots[i]])
        score, id_, row = (np.concatenate([x[touched].reshape(-1), y]) for x, y in ((self.score, s[i, j]), (self.id, t.ids[a + j]), (self.row, t.rows[a + j])))
        order = np.lexsort((row, id_, -score if score.dtype.kind == "f" else ~score, slot))
        first = np.searchsorted(slot[order], touched)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched], self.row[touched] = score[best], id_[best], row[best]

    def search(self, trees: list[Subtree]) -> None:
        """Best first: the box with the highest upper bound of any open slot is opened next."""
        for g in range(0, len(self.queries), GROUP):
            slots = np.flatnonzero((self.anchor >= g) & (self.anchor < g + GROUP))
            if not len(slots):
                continue
            heap: list[tuple] = []
            for n, t in enumerate(trees):
                self._push(heap, n, t, len(t.levels) - 1, 0, 1, slots)
            while heap:
                _, n, level, node, slots, up, down = heapq.heappop(heap)
                slots = self.open(slots, up, down)  # scores have risen since
                if not len(slots):
                    continue
                t = trees[n]
                if level:
                    self._push(heap, n, t, level - 1, node * FAN, min((node + 1) * FAN, len(t.levels[level - 1][0])), slots)
                else:
                    self.offer(slots, t, node * LEAF, min((node + 1) * LEAF, len(t.ids)))

    def _push(self, heap: list[tuple], n: int, t: Subtree, level: int, a: int, b: int, slots: np.ndarray) -> None:
        anchors, at = np.unique(self.anchor[slots], return_inverse=True)
        ups, downs = t.bounds(level, slice(a, b), self.queries[anchors])
        for j in range(b - a):
            up, down = ups[at, j], downs[at, j]
            left = self.open(slots, up, down)
            if len(left):
                there = np.searchsorted(slots, left)
                heapq.heappush(heap, (-up[there].max(), n, level, a + j, left, up[there], down[there]))


def searched(trees: DataFrame, width: int, slots: dict, k: int, same: bool) -> DataFrame:
    """slot, rank, vec_id, row and score of the best ``k`` rows of each slot. ``slots``: queries, label
    and own (row hash) by anchor; anchor, low and high by slot; their number is bounded by the round."""
    sent = trees.sparkSession.sparkContext.broadcast(slots)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Slots(**sent.value, same=same, k=k)
        for batch in batches:
            own.search([Subtree(r, width, own.queries.dtype.type) for r in batch.to_pylist()])
        slot, place = np.nonzero(own.score > own.none)
        columns = [slot, own.id[slot, place], own.row[slot, place], own.score[slot, place].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "vec_id", "row", "score"])

    found = trees.mapInArrow(search, "slot long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, most: int = ANCHORS) -> DataFrame:
    """For each row that ``anchors`` names and each of its ``positives`` best rows of the same label,
    the ``negatives`` best rows of other labels whose score is within ``low`` to ``high`` percent of the
    positive's. ``rows``: vec_id, label, vector (array of int). Columns: see ``FOUND``."""
    spark = rows.sparkSession
    with scratch(spark) as result, arrow_bytes(spark):
        kept = rows.where("vec_id is not null and label is not null and vector is not null")
        held = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "vector")
        held = materialise(held.withColumn("row", F.xxhash64("vec_id", "label", "vector")), "vectors")
        count, width, largest = held.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))))).first()
        if not count:
            return spark.createDataFrame([], FOUND)
        # as many numbers as a vector has components
        varies = held.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("v")).collect()
        spread = [r["at"] for r in sorted(varies, key=lambda r: (-r["v"], r["at"]))]
        trees = materialise(tree(held, width, spread, count), "tree")
        asked = materialise(held.where(anchors).dropDuplicates(["vec_id", "row"]), "anchors")
        rounds = max(1, -(-asked.count() // most))
        # products are exact as doubles below 2^53, and otherwise as longs
        kind = np.float64 if (largest or 0) ** 2 * max(1, width) < 1 << 53 else np.int64
        out = None
        for i in range(rounds):
            # bounded by the number of anchors of a round
            own = asked.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(rounds)) == i).toArrow()
            if not own.num_rows:
                continue
            found = _round(trees, own, width, kind, positives, negatives, low, high)
            out = found if out is None else out.unionByName(found)
        return spark.createDataFrame([], FOUND) if out is None else result(out, "negatives")


def _round(trees: DataFrame, own: pa.Table, width: int, kind: type, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of one round's anchors."""
    ids, hashes, labels = (own.column(c).to_numpy() for c in ("vec_id", "row", "label"))
    n = len(ids)
    shared = {"queries": matrix(own.column("vector").combine_chunks(), width).astype(kind), "label": labels, "own": hashes}
    none, end = (-np.inf, np.inf) if kind is np.float64 else (np.iinfo(kind).min + 1, np.iinfo(kind).max)
    every = shared | {"anchor": np.arange(n), "low": np.full(n, none, kind), "high": np.full(n, end, kind)}
    best = materialise(searched(trees, width, every, positives, True), "positives").orderBy("slot", "rank").toArrow()
    slot, positive, score = (best.column(c).to_numpy() for c in ("slot", "vec_id", "score"))
    windows = shared | {"anchor": slot, "low": -(-(low * score) // 100), "high": high * score // 100}
    found = searched(trees, width, windows, negatives, False)
    names = trees.sparkSession.createDataFrame(list(zip(range(len(slot)), ids[slot].tolist(), positive.tolist(), score.tolist(), strict=True)), "slot long, anchor_id long, positive_id long, positive_score long")
    done = found.join(F.broadcast(names), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return materialise(done, "found")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), integer_vectors().alias("vector")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_inner_product(a.q, b.q)::bigint AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other))::int AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
