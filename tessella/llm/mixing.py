"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are dealt into blocks of equal numbers of rows. With weight w, the j-th
block (from 0) of a source is released at floor(j / w) and due at ceil((j + 1) / w); one block runs a
slot, earliest deadline first among those released. Weights are exact fractions, never rounded, so at
every slot each source has had its weight's share of the slots to within less than one block, however
small the weight and however long the mix. A block has ``block`` rows, whatever the size of the input;
only a caller who states ``most`` gets blocks of as many more rows as keep the schedule to that number.

The schedule is worked out in stretches of ``SLOTS`` slots, each by a task of its own. What waits where
a stretch begins follows without the slots before: at slot t a source has had floor(t w) blocks or one
more, and those one more have run in the slots that the blocks due by t left free. With F(s) the number
of blocks released before slot s, less s, and c(s) the number of sources whose block that is not due
by t was released before s, the slots left free before s number max(c - F) over all slots up to s. So
each stretch gives the least F between the last releases of its sources, and a stretch's start needs
one number of each stretch before it and one of each source.

Without stated weights each source has its share of the blocks, and every document is in the mix.
With weights that a caller states the mix ends where the first of the sources runs out, its
part-filled last block included. Documents beyond it are the surplus of sources with less weight than
rows; they have no slot and ``in_mix`` is false. A source without weight, or not named, has no slots.

Rows are dealt to buckets, which are ranges of a hash of doc_id and text; a row's number in its source
is its rank in the bucket plus the sizes of the buckets before, so no task holds a whole source and
the number of buckets does not alter the order.

Defined cases: a null source is a source of its own; ties in the shuffled order of a source go by
doc_id and text, and equal rows take places of their own; only a hash is taken of a text, however
long; one source takes every slot; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import batched
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.text import doc_id
from tessella.plans import materialise

#: Rows of a block.
BLOCK = 4
#: Slots that one task works out; their number does not alter the schedule.
SLOTS = 1 << 16
#: Rows that a bucket ranks on average, and the fewest buckets.
BUCKET_ROWS = 10_000
BUCKETS = 64
#: Sources that one schedule takes; more are an error, not left out.
MOST_SOURCES = 100_000
NO_SOURCE = "\x00none"
#: The least F of no slots.
NEVER = 1 << 62


def whole(weights: dict[str, float | int | Fraction]) -> dict[str, int]:
    """Positive weights as integers in exactly the same proportion."""
    exact = {k: Fraction(w) for k, w in weights.items() if w > 0}
    common = lcm(*[w.denominator for w in exact.values()])
    return {k: int(w * common) for k, w in exact.items()}


def end_of(blocks: list[int], units: list[int]) -> int:
    """The slot by which the first source has run all its blocks."""
    total = sum(units)
    return min((-(-n * total // u) for n, u in zip(blocks, units, strict=True)), default=0)


def released(blocks: list[int], units: list[int], start: int, stop: int) -> list[tuple[int, int, int]]:
    """Release, source and number of the blocks released from slot ``start`` to before ``stop``."""
    total = sum(units)
    return sorted((j * total // u, k, j) for k, u in enumerate(units) for j in range(-(-start * u // total), min(blocks[k], -(-stop * u // total))))


def order_of(units: list[int], total: int, k: int, j: int) -> tuple[int, int, int, int]:
    """What orders blocks that wait: the deadline, then the later release, then the source."""
    return -(-(j + 1) * total // units[k]), -(j * total // units[k]), k, j


def run(blocks: list[int], units: list[int], start: int, stop: int, waiting: list[tuple] = ()) -> list[tuple[int, int, int]]:
    """The source, block number and slot of each block run from slot ``start`` to before ``stop``, by
    EDF over Pfair windows, where ``waiting`` were released before and have not run."""
    total, tasks, at, out = sum(units), released(blocks, units, start, stop), 0, []
    ready = list(waiting)
    heapq.heapify(ready)
    for slot in range(start, stop):
        while at < len(tasks) and tasks[at][0] <= slot:
            heapq.heappush(ready, order_of(units, total, *tasks[at][1:]))
            at += 1
        if ready:  # the last slot may wait for a block that the source which ran dry has not got
            due, _, k, j = heapq.heappop(ready)
            assert due > slot, "a deadline was missed"
            out.append((k, j, slot))
    return out


def lows(blocks: list[int], units: list[int], stretch: int, slots: int, stretches: int) -> Iterator[tuple[int, int, int, int]]:
    """The number of a later stretch, a slot of this one, the least F from after the slot before in the
    list to it, and the source that there gets a block not due by the later stretch's start, or -1. The
    first row is for this stretch itself: F at slot 0."""
    total, first, last = sum(units), stretch * slots, (stretch + 1) * slots
    yield stretch, 0, 0, -1
    if stretch + 1 >= stretches:
        return
    tasks = released(blocks, units, first, last)
    newest = {k: (r, j) for r, k, j in tasks}
    # with the last stretch that starts before the block's window ends
    cuts = sorted((r, k, ((j + 1) * total - 1) // units[k] // slots) for k, (r, j) in newest.items())
    f = sum(-(-first * u // total) for u in units) - first
    least, pieces, at, before = NEVER, [], 0, first
    for r, k, until in [*cuts, (last, -1, stretches)]:
        for s in range(before + 1, r + 1):
            while at < len(tasks) and tasks[at][0] < s:
                f, at = f + 1, at + 1
            f -= 1
            least = min(least, f)
        pieces.append((r, least, k, until))
        least, before = NEVER, r
    for later in range(stretch + 1, stretches):
        kept, least = [], NEVER
        for r, low, k, until in pieces:
            least = min(least, low)
            if until >= later:
                kept.append((r, least, k, until))
                least = NEVER
        pieces = kept
        yield from ((later, r, low, k) for r, low, k, _ in pieces)


def waiting_at(units: list[int], start: int, found: list[tuple[int, int, int]]) -> list[tuple]:
    """The blocks that wait at slot ``start``, from the slots, least F and sources of ``lows``."""
    total, free, cuts, ready = sum(units), 0, 0, []
    for _, low, k in sorted(found):
        for _ in range(free, max(free, cuts - low)):
            heapq.heappop(ready)
        free = max(free, cuts - low)
        if k >= 0:
            heapq.heappush(ready, order_of(units, total, k, start * units[k] // total))
            cuts += 1
    return ready


def schedule(blocks: dict[str, int], units: dict[str, int]) -> list[tuple[str, int, int]]:
    """The source, block number and slot of each block in one stretch, up to the slot by which the
    first source has run all its blocks."""
    names = sorted(units)
    own, shares = [blocks[k] for k in names], [units[k] for k in names]
    return [(names[k], j, slot) for k, j, slot in run(own, shares, 0, end_of(own, shares))]


def slots_of(spark: SparkSession, blocks: list[int], units: list[int], slots: int = SLOTS) -> DataFrame:
    """``schedule`` as a table of the source's number, block and slot, a stretch by one task."""
    end = end_of(blocks, units)
    stretches = -(-end // slots)
    parts = max(1, min(stretches, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                for rows in batched(lows(blocks, units, int(i), slots, stretches), SLOTS):
                    yield pd.DataFrame(rows, columns=["stretch", "at", "low", "source"], dtype="int64")

    def work(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        start = int(key[0]) * slots
        waiting = waiting_at(units, start, list(zip(found["at"].tolist(), found["low"].tolist(), found["source"].tolist(), strict=True)))
        return pd.DataFrame(run(blocks, units, start, min(end, start + slots), waiting), columns=["at", "block", "slot"], dtype="int64")

    found = spark.range(0, stretches, 1, parts).mapInPandas(give, "stretch long, at long, low long, source long")
    return found.repartition(parts, "stretch").groupBy("stretch").applyInPandas(work, "at long, block long, slot long")


def deviation(run: list[tuple[str, int, int]], units: dict[str, int]) -> Fraction:
    """The largest distance of a source's blocks so far from its exact share, over all slots. It is
    largest just before or after a source's own slots, or at the end."""
    total, end = sum(units.values()), 1 + max((slot for _, _, slot in run), default=-1)
    had = dict.fromkeys(units, 0)
    worst = Fraction(0)
    for name, _, slot in run:
        worst = max(worst, abs(had[name] - Fraction(slot * units[name], total)))
        had[name] += 1
        worst = max(worst, abs(had[name] - Fraction((slot + 1) * units[name], total)))
    return max([worst, *(abs(had[k] - Fraction(end * u, total)) for k, u in units.items())])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """doc_id, text_sha256, source, block, slot, position, weight and in_mix of every document. A block
    has ``block`` rows; with ``most``, as many more as it takes for at most that many full blocks."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialise(
        docs.select(
            doc_id(), F.col("source").cast("string").alias("source"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("name"),
            F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        ).withColumn("shuffled", F.xxhash64("doc_id", "text_sha256")),
        "mix-rows",
    )
    sizes = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; mix groups of sources instead")
    if most is not None:
        block = max(block, -(-sum(sizes.values()) // most))
    blocks = {k: -(-n // block) for k, n in sizes.items()}
    units = whole({k: weights.get(k, 0.0) for k in sizes}) if weights else blocks
    total = sum(units.values())
    names = sorted(units)
    table = slots_of(spark, [blocks[k] for k in names], [units[k] for k in names])
    buckets = max(BUCKETS, sum(sizes.values()) // BUCKET_ROWS)
    # the upper 24 bits of the hash, in the order of the hash
    upper = F.shiftright("shuffled", 40) + (1 << 23)
    dealt = rows.withColumn("bucket", F.shiftright(upper * buckets, 24))
    counts = materialise(dealt.groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = counts.select("name", "bucket", (F.sum("n").over(Window.partitionBy("name").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("name", "bucket").orderBy("shuffled", "doc_id", "text_sha256"))
    own = spark.createDataFrame([(k, i, units[k] / total) for i, k in enumerate(names)], "name string, at long, own double")
    numbered = (
        dealt.withColumn("inner", inner).join(before, ["name", "bucket"]).join(F.broadcast(own), "name", "left")
        .withColumn("nth", F.col("before") + F.col("inner") - 1).withColumn("block", F.floor(F.col("nth") / block).cast("long"))
    )
    # the sources have a bound that is a parameter; the schedule grows with the rows and is shuffled,
    # also where Spark takes it for small by the number of stretches
    placed = numbered.join(table.hint("shuffle_merge"), ["at", "block"], "left")
    return placed.select(
        "doc_id", "text_sha256", "source", "block", "slot", (F.col("slot") * block + F.col("nth") % block).alias("position"),
        F.coalesce("own", F.lit(0.0)).alias("weight"), F.col("slot").isNotNull().alias("in_mix"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their place in a mix of the sources."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("text_sha256")
