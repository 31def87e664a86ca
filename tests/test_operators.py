"""Cases that the driver's tables do not reach."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.operators.graph import connected_components
from tessella.operators.latest import clamped_replay, folded, latest, nth_latest, upserted
from tessella.operators.layout import FrameTooSmall, composed, feed_order, slice_cells, tiles
from tessella.operators.ordering import numbered_by
from tessella.operators.pairs import most_uncertain
from tessella.operators.similarity import image_clusters, near_hashes, vector_search


def test_components_of_chain_star_loop_and_nothing(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (300, None), (7, 7)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[100 + i] for i in range(20)} == {100} and got[200] == 200
    assert 300 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_latest_upsert_and_fold(spark):
    log = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "x"), ("k", 3, "c", None), ("m", 1, "z", None)], "key string, id long, a string, b string")
    assert {tuple(r) for r in latest(log, ["key"], "id").select("key", "id").collect()} == {("k", 3), ("m", 1)}
    assert {tuple(r) for r in folded(log, ["key"], "id", ["a", "b"]).collect()} == {("k", "c", "x"), ("m", "z", None)}
    assert [r["id"] for r in nth_latest(log, ["key"], "id", 2).collect()] == [2]
    old = spark.createDataFrame([("k", 1, "old"), ("n", 1, "old")], "key string, seq long, v string")
    new = spark.createDataFrame([("k", 0, "new"), ("q", 0, "new")], "key string, seq long, v string")
    assert {(r["key"], r["v"]) for r in upserted(old, new, ["key"], "seq").collect()} == {("k", "new"), ("n", "old"), ("q", "new")}


def test_replay_stops_at_the_bound(spark):
    rows = [("s", i, 0.1) for i in range(150)] + [("s", 150 + i, -0.1) for i in range(3)]
    got = clamped_replay(spark.createDataFrame(rows, "signal string, id long, step double"), ["signal"], "id", "step", 10.0).first()
    assert abs(got["weight"] - 9.7) < 1e-9 and got["version"] == 153


def test_replay_of_many_runs_equals_the_plain_fold(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice((-3.0, -0.5, 0.25, 4.0))) for i in range(400) for k in ("s", "t") if k == "s" or i % 7]
    want = {}
    for k, _, step in rows:
        want[k] = max(-10.0, min(10.0, want.get(k, 0.0) + step))
    got = clamped_replay(spark.createDataFrame(rows, "signal string, id long, step double").repartition(5), ["signal"], "id", "step", 10.0, run=6).collect()
    assert {r["signal"]: round(r["weight"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and {r["signal"]: r["version"] for r in got} == {"s": 400, "t": 342}


def test_numbers_follow_the_whole_order(spark):
    rows = [(i * 37 % 501, i) for i in range(501)]
    got = numbered_by(spark.createDataFrame(rows, "k long, v long").repartition(6), "k").collect()
    assert all(r["place"] == r["k"] + 1 for r in got) and len(got) == 501
    assert numbered_by(spark.createDataFrame([], "k long"), "k").count() == 0


def test_most_uncertain_pair_against_all_pairs(spark):
    rng, weights = random.Random(6), {"x": 1.5, "y": -0.5}
    for values, excluded in ((None, 0), (None, 6), ([0.25], 3), ([0.1, 0.2, 0.9], 2)):
        pick = (lambda: rng.choice(values)) if values else rng.random
        rows = [(i, pick(), pick()) for i in range(40)]

        def unsure(p):
            (_, a, b), (_, c, d) = p
            spread = 1.5 * abs(a - c) + 0.5 * abs(b - d)
            return 1.0 if spread == 0 else 1 - abs(1.5 * (a - c) - 0.5 * (b - d)) / spread

        ordered = sorted(itertools.combinations(rows, 2), key=lambda p: (-round(unsure(p), 12), p[0][0], p[1][0]))
        out = [(p[0][0], p[1][0]) for p in ordered[:excluded]]
        got = most_uncertain(spark.createDataFrame(rows, "id long, x double, y double"), weights, spark.createDataFrame(out, "a long, b long")).first()
        assert abs(got["uncertainty"] - unsure(ordered[excluded])) < 1e-9 and (got["a"], got["b"]) not in out
    few = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5)], "id long, x double, y double")
    assert most_uncertain(few, weights, spark.createDataFrame([(1, 2)], "a long, b long")).count() == 0
    assert most_uncertain(few.where("id = 1"), weights, spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_chain_and_aspect(spark):
    items = [
        ("a", "s1", "aaaaaaaaaaaaaaaa", 100, 100), ("b", "s2", "aaaaaaaaaaaaaaa8", 100, 100), ("c", "s3", "aaaaaaaaaaaaaaa0", 200, 200),
        ("d", "s4", "aaaaaaaaaaaaaaaa", 500, 100), ("e", "s5", None, 10, 10), ("f", "s5", None, 20, 10), ("g", "s6", "5555555555555555", None, None),
    ]
    df = spark.createDataFrame(items, "key string, sha256 string, phash string, width int, height int")
    assert {tuple(r) for r in near_hashes(df, 1).collect()} == {("a", "b"), ("b", "c")}
    got = {r["key"]: tuple(r)[1:] for r in image_clusters(df, 1).collect()}
    assert got["a"] == ("a", "near", False) and got["c"] == ("a", "near", True)  # a and c are joined through b
    assert got["d"] == ("d", "single", True) and got["e"] == ("e", "exact", False) and got["f"] == ("e", "exact", True)
    assert got["g"] == ("g", "single", True)


def test_bands_lose_no_pair(spark):
    import random

    random.seed(5)
    base = random.getrandbits(64)
    hashes = [base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))) for _ in range(60)]
    rows = [(f"{i:03}", f"{i}", f"{h:016x}", 10, 10) for i, h in enumerate(hashes)]
    got = {tuple(r) for r in near_hashes(spark.createDataFrame(rows, "key string, sha256 string, phash string, width int, height int"), 5).collect()}
    want = {(f"{i:03}", f"{j:03}") for i, j in itertools.combinations(range(60), 2) if (hashes[i] ^ hashes[j]).bit_count() <= 5}
    assert got == want


def test_zero_vectors_are_left_out(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 0.0])], "id long, vector array<double>")
    got = vector_search(v.where("id < 2"), v, 5).orderBy("rank").collect()
    assert [(r["query"], r["id"]) for r in got] == [(0, 3), (0, 2)]


def test_scalars(spark):
    row = spark.range(1).select(
        S.clamp01(F.lit(1.5)).alias("a"), S.saturate(F.lit(0.0), 0.0).alias("b"), S.tokens(F.lit("A b-c!É9")).alias("c"), S.filename_date(F.lit("x/IMG_2021-0304.jpg")).alias("d"),
        S.filename_date(F.lit("none")).alias("e"), S.hamming_hex(F.lit("ffffffffffffffff"), F.lit("0000000000000000")).alias("f"), S.wilson(F.lit(0), F.lit(0))[1].alias("g"), S.gutter(F.lit(10), F.lit(20)).alias("h"),
        S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("i"), S.hex_colour(F.lit(255), F.lit(0), F.lit(16)).alias("j"),
    ).first()
    assert list(row) == [1.0, 0.0, ["a", "b", "c", "9"], "2021-03-04", None, 64, 1.0, 1, None, "#ff0010"]


def test_date_proximity_is_null_where_a_date_is_unknown(spark):
    d = spark.createDataFrame([("2024-01-01", "2024-01-16"), ("2024-01-01", None), ("2024-01-01", "2025-01-01")], "a string, b string")
    assert [r[0] for r in d.select(S.date_proximity(F.col("a"), F.col("b"))).collect()] == [0.5, None, 0.0]


def test_schedule_does_not_wrap(spark):
    at = spark.createDataFrame([("2024-01-01 22:30:00",), ("2024-01-01 08:00:00",), ("2024-01-01 20:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [r[0] for r in at.select(S.schedule_open(F.col("t"), [0], (8, 20), None)).collect()] == [False, True, False]
    assert not any(r[0] for r in at.select(S.schedule_open(F.col("t"), None, (22, 6), None)).collect())


def test_cells_stay_apart_and_reach_the_edges(spark):
    for weights in ([1.0] * 7, [3.0, 1, 1, 1], [0.0, 0.0], [5.0], [float("nan"), 2.0, -1.0]):
        cells = tiles(np.array(weights), 1920, 1080, 33).tolist()
        assert max(x + w for x, _, w, _ in cells) == 1920 and max(y + h for _, y, _, h in cells) == 1080
        for (a, b, c, d), (e, f, g, h) in itertools.combinations(cells, 2):
            assert a + c <= e or e + g <= a or b + d <= f or f + h <= b
    assert tiles(np.array([1.0, 1.0]), 1920, 1080, 33).tolist() == [[0, 0, 943, 1080], [977, 0, 943, 1080]]
    with pytest.raises(FrameTooSmall):
        tiles(np.array([1000.0, *[0.001] * 20]), 64, 64, 2)
    frames = spark.createDataFrame([(1, 1, 9, 1.0), (1, 2, 8, 2.0)], "frame long, item int, tie long, weight double")
    assert slice_cells(frames, 64, 64).count() == 2


def test_feed_breaks_runs_and_shows_several_creators(spark):
    rows = [("f", i, "x", 10.0 - i) for i in range(6)] + [("f", 10, "y", 0.5)] + [("g", i, "z", float(i)) for i in range(20)]
    got = feed_order(spark.createDataFrame(rows, "feed string, id long, creator string, score double")).orderBy("place").collect()
    assert [r["id"] for r in got if r["feed"] == "f"] == [0, 10, 1, 2, 3, 4, 5]  # y comes second, so that two are seen; then nothing breaks the run
    assert [r["id"] for r in got if r["feed"] == "g"] == list(range(19, 7, -1))
    assert composed(["x", "x", "x", "y", "x", "z"], 12, 2, 1, 6) == [0, 1, 3, 2, 4, 5]


def test_feed_is_that_of_all_items(spark):
    rng = random.Random(3)
    rows = [("f", i, f"c{rng.randint(0, 30) // rng.randint(1, 9)}", rng.random()) for i in range(400)]
    ranked = sorted(rows, key=lambda r: (-r[3], r[1]))
    want = [ranked[i][1] for i in composed([r[2] for r in ranked], 12, 3, 2, 6)]
    got = feed_order(spark.createDataFrame(rows, "feed string, id long, creator string, score double")).orderBy("place").collect()
    assert [r["id"] for r in got] == want


def test_a_wrong_checksum_is_an_error(spark):
    rows = spark.createDataFrame([("a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("b", "00")], "t string, c string")
    assert rows.where("t = 'a'").select(S.verified(F.col("t"), F.col("c"))).first()[0] == "a"
    with pytest.raises(Exception, match="checksum mismatch"):
        rows.select(S.verified(F.col("t"), F.col("c"))).collect()


def test_near_hashes_at_ten_bits_lose_no_pair(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    hashes = [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(50)]
    rows = [(f"{i:03}", f"{i}", f"{h:016x}", 10, 10) for i, h in enumerate(hashes)]
    got = {tuple(r) for r in near_hashes(spark.createDataFrame(rows, "key string, sha256 string, phash string, width int, height int")).collect()}
    want = {(f"{i:03}", f"{j:03}") for i, j in itertools.combinations(range(50), 2) if (hashes[i] ^ hashes[j]).bit_count() <= 10}
    assert got == want and want
