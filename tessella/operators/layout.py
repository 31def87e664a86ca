"""Layouts and feeds: short sequential rules, applied per small group inside Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items that a frame takes; a frame with more is an error, never cut.
MOST_CELLS = 64


class FrameTooSmall(ValueError):
    """A box has fewer than two pixels besides the gap on the side that is to be cut."""


def tiles(weights: np.ndarray, width: int, height: int, gap: int) -> np.ndarray:
    """Rectangles (x, y, w, h) of a frame's items in their order.

    Boxes wait in a stack with the range of items that they hold. A box is cut on its longer side
    (on its width, if it is square) where the running sum of weights is nearest to half, at the last
    such place; both parts get the floor of their share of what the gap leaves, a pixel at least, the
    second one ending at the far edge. A pixel that a starved part got is taken from the other.
    Weights that are not finite and positive count as 0, and a range without weight is uniform."""
    n = len(weights)
    usable = np.where(np.isfinite(weights) & (weights > 0), weights, 0.0)
    by_weight, by_count = (np.concatenate([[0.0], np.cumsum(x)]) for x in (usable, np.ones(n)))
    out = np.zeros((n, 4), np.int64)
    stack = [(0, n, np.array([0, 0, width, height]))]
    while stack:
        lo, hi, box = stack.pop()
        if hi - lo == 1:
            out[lo] = box
            continue
        run = by_weight if by_weight[hi] > by_weight[lo] else by_count
        ahead = run[lo + 1 : hi] - run[lo]
        whole = run[hi] - run[lo]
        k = hi - 1 - int(np.abs(2 * ahead - whole)[::-1].argmin())
        side = 2 if box[2] >= box[3] else 3
        room = int(box[side]) - gap
        if room < 2:
            raise FrameTooSmall(f"{hi - lo} items do not fit a box of {box[2]} x {box[3]} with a gap of {gap}")
        sizes = [max(1, int(room * part // whole)) for part in (run[k] - run[lo], run[hi] - run[k])]
        sizes[0 if sizes[0] >= sizes[1] else 1] -= max(0, sum(sizes) - room)
        first, second = box.copy(), box.copy()
        first[side], second[side] = sizes
        second[side - 2] += box[side] - sizes[1]
        stack += [(lo, k, first), (k, hi, second)]
    return out


def tiles_of_many(sizes: np.ndarray, weights: np.ndarray, width: int, height: int, gap: int) -> np.ndarray:
    """``tiles`` of many frames at once, whose items follow each other in ``weights``: all boxes that are
    still to be cut, of whatever frame, are cut in one step."""
    starts, most = np.cumsum(sizes) - sizes, int(max(sizes, default=0))
    nth = np.arange(len(weights)) - np.repeat(starts, sizes)
    usable = np.zeros((len(sizes), most + 1))
    usable[np.repeat(np.arange(len(sizes)), sizes), nth + 1] = np.where(np.isfinite(weights) & (weights > 0), weights, 0.0)
    by_weight, by_count = np.cumsum(usable, axis=1), np.arange(most + 1.0)
    out = np.zeros((len(weights), 4), np.int64)
    frame, places = np.flatnonzero(sizes), np.arange(most + 1)
    lo, hi = np.zeros(len(frame), np.int64), sizes[frame].astype(np.int64)
    box = np.tile(np.array([0, 0, width, height], np.int64), (len(frame), 1))
    while len(frame):
        single = hi - lo == 1
        out[starts[frame[single]] + lo[single]] = box[single]
        frame, lo, hi, box = (x[~single] for x in (frame, lo, hi, box))
        at = np.arange(len(frame))
        run = by_weight[frame]
        run = np.where((run[at, hi] > run[at, lo])[:, None], run, by_count)
        before, whole = run[at, lo], run[at, hi] - run[at, lo]
        off = np.abs(2 * (run - before[:, None]) - whole[:, None])
        off[(places <= lo[:, None]) | (places >= hi[:, None])] = np.inf
        k = most - off[:, ::-1].argmin(axis=1) if len(frame) else lo
        side = np.where(box[:, 2] >= box[:, 3], 2, 3)
        room = box[at, side] - gap
        if (room < 2).any():
            i = int(np.flatnonzero(room < 2)[0])
            raise FrameTooSmall(f"{hi[i] - lo[i]} items do not fit a box of {box[i, 2]} x {box[i, 3]} with a gap of {gap}")
        first, second = (np.maximum(1, (room * part // whole).astype(np.int64)) for part in (run[at, k] - before, run[at, hi] - run[at, k]))
        over = np.maximum(0, first + second - room)
        first, second = np.where(first >= second, first - over, first), np.where(first >= second, second, second - over)
        left, right = box.copy(), box.copy()
        left[at, side], right[at, side] = first, second
        right[at, side - 2] += box[at, side] - second
        frame, lo, hi, box = np.concatenate([frame, frame]), np.concatenate([lo, k]), np.concatenate([k, hi]), np.concatenate([left, right])
    return out


def slice_cells(items: DataFrame, width: int, height: int) -> DataFrame:
    """frame, item, tie, x, y, w, h of the items of each frame (frame, item, tie, weight), in the
    order of item and tie. A frame of more than ``MOST_CELLS`` items is an error, found by a count
    before they are gathered."""

    gap = max(1, min(width, height) // 32)

    def layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("items")
            sizes, each = lists.value_lengths().to_numpy(), lists.flatten()
            weights = each.field("weight").cast(pa.float64()).to_numpy(zero_copy_only=False)
            cells = tiles_of_many(sizes, weights, width, height, gap)
            frame = part.column("frame").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            columns = [frame, each.field("item"), each.field("tie"), *(pa.array(c) for c in cells.T)]
            types = (pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=["frame", "item", "tie", *"xywh"])

    counted = items.withColumn("_n", F.row_number().over(Window.partitionBy("frame").orderBy("item", "tie")))
    checked = counted.withColumn("frame", F.when(F.col("_n") > MOST_CELLS, F.raise_error(F.lit(f"a frame takes {MOST_CELLS} items")).cast("long")).otherwise(F.col("frame")))
    frames = checked.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("item", "tie", "weight"))).alias("items"))
    return frames.mapInArrow(layout, "frame long, item int, tie long, x int, y int, w int, h int")


def composed(creators: list[str], size: int, longest: int, least: int, window: int) -> list[int]:
    """Positions, in the order in which a feed shows them, of the first ``size`` of ranked items: the
    best that does not make a creator's run longer than ``longest``; while fewer than ``window`` are
    placed and fewer than ``least`` creators seen, one of a new creator if there is any. Where nothing
    fits, the best of the rest."""
    left, out = list(range(len(creators))), []
    while left and len(out) < size:
        tail = [creators[i] for i in out[-longest:]]
        full = tail[-1] if len(tail) == longest and len(set(tail)) == 1 else None
        fits = [i for i in left if full is None or creators[i] != full]
        seen = {creators[i] for i in out}
        new = [i for i in fits if creators[i] not in seen] if len(out) < window and len(seen) < least else []
        best = (new or fits or left)[0]
        out.append(best)
        left.remove(best)
    return out


def feed_order(ranked: DataFrame, size: int = 12, longest: int = 3, least: int = 2, window: int = 6) -> DataFrame:
    """feed, id, place of the first ``size`` items of each feed (feed, id, creator, score): by falling
    score, then id, under the rules of ``composed``.

    The first ``size`` places can only hold the best ``size`` items of the best ``size + 1`` creators,
    so ranks per creator leave a bounded number of items per feed before any are gathered."""
    best = Window.partitionBy("feed", "creator").orderBy(F.desc("score"), "id")
    near = ranked.withColumn("own", F.row_number().over(best)).where(F.col("own") <= size)
    heads = near.where("own = 1").withColumn("rank", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= size + 1)
    few = near.join(heads.select("feed", "creator"), ["feed", "creator"], "left_semi")
    gathered = few.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "creator"))).alias("items"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for feed, own in zip(part.column("feed").to_pylist(), part.column("items").to_pylist(), strict=True):
                rows += [(feed, own[i]["id"], k) for k, i in enumerate(composed([x["creator"] for x in own], size, longest, least, window), 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["feed", "id", "place"])

    return gathered.mapInArrow(order, "feed string, id long, place int")
