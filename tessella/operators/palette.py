"""Dominant colours of each group by k-means, for groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans import broadcast_if_small, materialise

# Centres of a palette, rounds at most, and the distance within which centres are one.
CENTRES, ROUNDS, MERGED = 5, 15, 32.0
#: The most colours of a key whose rounds run in one task.
GATHERED = 1 << 16


def _square(a: Column, b: Column) -> Column:
    return sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "rgb"), F.lit(0.0))


def _merge(found: Column, within: float) -> Column:
    """Centres (r, g, b, n) one after the other: one that lies within the distance of an earlier one is put
    into the first such, weighted by their numbers."""

    def add(kept: Column, c: Column) -> Column:
        near = F.array_position(F.transform(kept, lambda k: _square(k, c) <= within * within), True).cast("int")
        n = lambda k: k["n"] + c["n"]
        both = lambda k: F.struct(*[((k[x] * k["n"] + c[x] * c["n"]) / n(k)).alias(x) for x in "rgb"], n(k).alias("n"))
        return F.when(near == 0, F.concat(kept, F.array(c))).otherwise(F.transform(kept, lambda k, i: F.when(i == near - 1, both(k)).otherwise(k)))

    return F.aggregate(found, F.filter(found, lambda _: F.lit(False)), add)


def palettes(colours: DataFrame, key: str, seed: int = 0, k: int = CENTRES, rounds: int = ROUNDS, most: int = GATHERED) -> DataFrame:
    """key and ``palette``, an array of (r, g, b, share) by falling share, of each key's colours (key, id, and
    r, g, b as whole numbers from 0 to 255).

    The first centres are the colours whose ids a seeded hash puts first. A round adds up colours by
    nearest centre; whole numbers make the means independent of the order. A centre that has lost its
    colours stays where it is, and is left out in the end. A null colour takes no part. Keys of at most
    ``most`` colours are sorted once, and each batch of them does its rounds in its task; a larger key's
    colours stay where they are, and each round is a join with its centres. Both give the same centres."""
    held = materialise(colours.where("r is not null and g is not null and b is not null").select(F.col(key).alias("key"), "id", *[F.col(c).cast("long").alias(c) for c in "rgb"]).where("key is not null"), "colours")
    large = materialise(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "large-keys")
    few = broadcast_if_small(large, 10_000)
    found = _in_tasks(held.join(few, "key", "left_anti"), seed, k, rounds)
    if not large.isEmpty():
        found = found.unionByName(_in_rounds(materialise(held.join(few, "key", "left_semi"), "large-colours"), seed, k, rounds))
    full = F.filter(F.transform("centres", lambda c, j: F.struct(*[F.round(c[x]).alias(x) for x in "rgb"], F.get("numbers", j).alias("n"))), lambda c: c["n"] > 0)
    merged = found.select("key", full.alias("full")).select("key", _merge(F.col("full"), MERGED).alias("found"))
    total = F.aggregate("found", F.lit(0.0), lambda a, c: a + c["n"])
    shared = merged.select("key", F.transform("found", lambda c, i: F.struct((-c["n"]).alias("o"), i.alias("i"), *[F.round(c[x]).cast("int").alias(x) for x in "rgb"], (c["n"] / total).alias("share"))).alias("found"))
    return shared.select(F.col("key").alias(key), F.transform(F.array_sort("found"), lambda c: F.struct(*[c[x].alias(x) for x in ("r", "g", "b", "share")])).alias("palette"))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "id").alias("h")


def _in_tasks(colours: DataFrame, seed: int, k: int, rounds: int) -> DataFrame:
    """key, centres and numbers, the colours of each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # ends with the rows of a key that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0]["key"][0] == batch["key"][batch.num_rows - 1]:
                continue
            rows = pa.concat_batches(held)
            cut = int(np.flatnonzero(_begins(rows["key"]))[-1])
            held = [rows.slice(cut)]
            yield _centres(rows.slice(0, cut), k, rounds)
        if held:
            yield _centres(pa.concat_batches(held), k, rounds)

    kind = colours.schema["key"].dataType.simpleString()
    ordered = colours.select("key", _hash(seed), "id", *"rgb").repartition("key").sortWithinPartitions("key", "h", "id", *"rgb")
    return ordered.mapInArrow(run, f"key {kind}, centres array<struct<r: double, g: double, b: double>>, numbers array<double>")


def _begins(values: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before."""
    if len(values) < 2:
        return np.ones(len(values), bool)
    a, b = values[1:], values[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)])


def _centres(rows: pa.RecordBatch, k: int, rounds: int) -> pa.RecordBatch:
    """The centres of whole keys, whose rows follow each other in the order of their hashes."""
    begins = _begins(rows["key"])
    starts, of = np.flatnonzero(begins), np.cumsum(begins) - 1
    m = len(starts)
    rgb = np.stack([rows[c].to_numpy(zero_copy_only=False).astype(float) for c in "rgb"], axis=1)
    # the first k different rows of a key
    new = begins | _begins(rows["id"])
    new[1:] |= (rgb[1:] != rgb[:-1]).any(axis=1)
    nth = np.cumsum(new)
    nth -= nth[starts][of]
    first = np.flatnonzero(new & (nth < k))
    at = np.full((m, k, 3), np.inf)
    at[of[first], nth[first]] = rgb[first]

    def nearest(own: np.ndarray, colours: np.ndarray) -> np.ndarray:
        """The place of each colour's nearest centre in the table of all."""
        apart = np.zeros((len(own), k))
        for c in range(3):
            gap = at[own, :, c] - colours[:, c, None]
            apart += gap * gap
        return own * k + apart.argmin(axis=1)

    own, colours = of, rgb
    for _ in range(rounds):
        j = nearest(own, colours)
        n = np.bincount(j, minlength=m * k).reshape(m, k)
        sums = np.stack([np.bincount(j, colours[:, c], m * k) for c in range(3)], axis=1).reshape(m, k, 3)
        after = np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], at)
        moves = (after != at).any(axis=(1, 2))
        at = after
        if not moves.any():
            break
        going = moves[own]
        own, colours = own[going], colours[going]
    numbers = np.bincount(nearest(of, rgb), minlength=m * k).astype(float)
    there = np.isfinite(at[..., 0])
    flat, ends = at[there], pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32())
    centres = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], list("rgb"))
    lists = [pa.ListArray.from_arrays(ends, x) for x in (centres, pa.array(numbers[there.ravel()]))]
    return pa.RecordBatch.from_arrays([rows["key"].take(pa.array(starts)), *lists], ["key", "centres", "numbers"])


def _in_rounds(held: DataFrame, seed: int, k: int, rounds: int) -> DataFrame:
    """The same of keys of any size: a round joins each colour with its key's centres, at most ``k``, and
    adds up colours by nearest centre, combined in each task before the shuffle. Keys whose centres no
    longer move are not read again."""
    one = F.struct(_hash(seed), "id", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    first = _least(held.select("key", one.alias("one")), k)
    centres = materialise(first.select("key", F.transform("ones", lambda c: F.struct(*[c[x].alias(x) for x in "rgb"])).alias("centres")), "centres")
    done = None
    for turn in range(rounds):
        sums = _nearest(held, centres).groupBy("key", "j").agg(*[F.sum(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n"))
        moved = sums.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct(*[(F.col(c) / F.col("n")).alias(c) for c in "rgb"])))).alias("to"))
        new = F.transform("centres", lambda c, j: F.coalesce(F.try_element_at("to", j), c))
        after = materialise(centres.join(moved, "key").select("key", new.alias("centres"), (new != F.col("centres")).alias("moves")), f"centres-{turn}")
        rest = after.where("not moves").drop("moves")
        done = rest if done is None else done.unionByName(rest)
        centres = after.where("moves").drop("moves")
        if centres.isEmpty():
            break
    centres = materialise(done.unionByName(centres), "centres-last")
    counts = _nearest(held, centres).groupBy("key", "j").agg(F.count(F.lit(1)).cast("double").alias("n"))
    numbers = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("j", "n"))).alias("of"))
    each = F.transform("centres", lambda c, j: F.coalesce(F.try_element_at("of", j), F.lit(0.0)))
    return centres.join(numbers, "key").select("key", "centres", each.alias("numbers"))


def _least(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` least of each key, in order: taken one after the other by a grouped minimum, so that no
    key's rows are gathered."""
    found = None
    rest = rows
    for _ in range(k):
        now = materialise(rest.groupBy("key").agg(F.min("one").alias("one")), "least")
        found = now if found is None else found.unionByName(now)
        before = now.select("key", F.col("one").alias("had"))
        rest = rows.join(before, "key").where(F.col("one") > F.col("had")).drop("had")
    return found.groupBy("key").agg(F.sort_array(F.collect_list("one")).alias("ones"))


def _nearest(colours: DataFrame, centres: DataFrame) -> DataFrame:
    """Colours of the keys with centres, with ``j``, the place of the nearest; ties go to the first."""
    own = F.struct(*[F.col(c).cast("double").alias(c) for c in "rgb"])
    distances = F.transform("centres", lambda c: _square(c, own))
    joined = colours.join(centres, "key").withColumn("d", distances)
    return joined.withColumn("j", (F.array_position("d", F.array_min("d")) - 1).cast("int")).select("key", "r", "g", "b", "j")
