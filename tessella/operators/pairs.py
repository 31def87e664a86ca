"""The most uncertain pair of a set of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans import materialise

#: Candidates of equal score that are looked at first; doubled while every pair of them is excluded.
FIRST = 64


def _weighted(weights: dict[str, float], value) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + value(name, w)
    return out


def uncertainty(weights: dict[str, float], a: str, b: str) -> Column:
    """1 less the difference of two weighted scores over the largest that their signals allow; 1 where
    the signals do not differ. ``a`` and ``b`` are prefixes of the signals' columns."""
    gap = F.abs(_weighted(weights, lambda s, w: F.lit(w) * (F.col(a + s) - F.col(b + s))))
    spread = _weighted(weights, lambda s, w: abs(w) * F.abs(F.col(a + s) - F.col(b + s)))
    return F.when(spread == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gap / spread)))


def most_uncertain(candidates: DataFrame, weights: dict[str, float], excluded: DataFrame) -> DataFrame:
    """The pair (a < b) of ``candidates`` (id and the weighted signals) with the highest uncertainty
    that is not in ``excluded`` (a, b), ties to the least a, then b; no row if there is none.

    Not all pairs are formed. If candidates of equal score make a pair, that is as uncertain as can be,
    and the first few of each score are enough unless all their pairs are excluded. Otherwise the
    neighbours in score give a pair whose gap over spread is g; as no spread is larger than the signals'
    whole range allows, only pairs with a gap of at most g times that range can be as good, and those
    meet by an equi-join on bands of that width."""
    names = list(weights)
    score = F.round(_weighted(weights, lambda s, w: F.lit(w) * F.col(s)), 9)
    held = materialise(candidates.select("id", *[F.col(s).cast("double").alias(s) for s in names]).withColumn("score", score), "candidates")

    def sides(x: DataFrame, key: str) -> DataFrame:
        left = x.select(key, F.col("id").alias("a"), F.col("score").alias("sa"), *[F.col(s).alias(f"a_{s}") for s in names])
        right = x.select(key, F.col("id").alias("b"), F.col("score").alias("sb"), *[F.col(s).alias(f"b_{s}") for s in names])
        return left.join(right, key)

    def best(pairs: DataFrame) -> DataFrame:
        kept = pairs.join(excluded.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", uncertainty(weights, "a_", "b_").alias("uncertainty"))
        return kept.orderBy(F.desc("uncertainty"), "a", "b").limit(1)

    place = Window.partitionBy("score").orderBy("id")
    ranked = materialise(held.withColumn("nth", F.row_number().over(place)), "ranked")
    most, first = ranked.agg(F.max("nth")).first()[0] or 0, FIRST
    while most > 1:
        equal = sides(ranked.where(F.col("nth") <= first).withColumn("key", F.col("score")), "key").where("a < b")
        found = materialise(best(equal), "equal")
        if not found.isEmpty() or first >= most:
            if not found.isEmpty():
                return found
            break
        first *= 2
    limits = held.agg(*[F.min(s).alias(f"low_{s}") for s in names], *[F.max(s).alias(f"high_{s}") for s in names], F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if limits["n"] < 2:
        return held.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("uncertainty")).where("false")
    range_ = sum(abs(w) * (limits[f"high_{s}"] - limits[f"low_{s}"]) for s, w in weights.items())
    width = max((limits["high"] - limits["low"]) / max(limits["n"], 1), 1e-12)
    while True:
        # each candidate stands in its band and in the next one, so that all within a width meet
        band = F.floor((F.col("score") - limits["low"]) / width).cast("long")
        both = held.withColumn("key", F.explode(F.array(band, band + 1)))
        close = sides(both, "key").where("a < b").where(F.abs(F.col("sa") - F.col("sb")) <= width).dropDuplicates(["a", "b"])
        found = materialise(best(close), "close")
        row = found.first()
        # a pair outside the width has a gap over spread of more than width / range
        if row is not None and 1 - row["uncertainty"] <= width / max(range_, 1e-300) or width > limits["high"] - limits["low"]:
            return found
        width *= 4
