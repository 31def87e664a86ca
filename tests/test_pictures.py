"""Palettes, stencils and perceptual bits against plain loops, and stores against their rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import grids, palette, stores
from tessella.queries import kept


def plain_palette(rows, k=5, rounds=5):
    """Lloyd's loop over one key's colours, in the order in which the hash puts them."""
    points = np.array([r[1:] for r in sorted(rows)], float)
    centres = points[:k].copy()
    for _ in range(rounds):
        at = np.argmin(((points[:, None] - centres[None]) ** 2).sum(2), 1)
        new = np.array([points[at == j].sum(0) / (at == j).sum() if (at == j).any() else c for j, c in enumerate(centres)])
        if (new == centres).all():
            break
        centres = new
    at = np.argmin(((points[:, None] - centres[None]) ** 2).sum(2), 1)
    out = []
    for j, c in enumerate(centres):
        n = int((at == j).sum())
        c = np.floor(c + 0.5)
        if not n:
            continue
        near = next((i for i, (d, _) in enumerate(out) if ((d - c) ** 2).sum() <= 32.0**2), None)
        if near is None:
            out.append((c, n))
        else:
            d, m = out[near]
            out[near] = ((d * m + c * n) / (m + n), m + n)
    total = sum(n for _, n in out)
    ranked = sorted(range(len(out)), key=lambda i: (-out[i][1], i))
    return [(*[int(math.floor(x + 0.5)) for x in out[i][0]], round(out[i][1] / total, 9)) for i in ranked]


def test_palettes_equal_a_loop_on_every_key(spark):
    rng = np.random.default_rng(6)
    rows = [(key, i, *map(int, rng.integers(0, 256, 3))) for key, n in ((1, 300), (2, 40), (3, 6), (4, 2), (5, 1)) for i in range(n)]
    rows += [(6, i, 10, 20, 30) for i in range(50)] + [(7, i, 10 + 30 * (i % 2), 20, 30) for i in range(9)] + [(8, 0, None, 1, 2)]
    frame = spark.createDataFrame(rows, "key int, id long, r int, g int, b int")
    hashed = {(r["key"], r["id"]): r["h"] for r in frame.select("key", "id", F.xxhash64(F.lit(0), "id").alias("h")).collect()}
    want = {}
    for key in range(1, 8):
        # keys of one hash order: (hash, id) first, then the colour
        own = [(hashed[k, i], i, r, g, b) for k, i, r, g, b in rows if k == key]
        want[key] = plain_palette([((h, i), r, g, b) for h, i, r, g, b in own])
    got = {r["key"]: [(c["r"], c["g"], c["b"], round(c["share"], 9)) for c in r["palette"]] for r in palette.palettes(frame, "key", rounds=5).collect()}
    assert got == want
    assert palette.palettes(frame.where("false"), "key", rounds=2).count() == 0


def test_palettes_in_tasks_and_in_rounds_are_the_same(spark):
    draw = np.random.default_rng(6)
    colours = [(f"k{i}", j, *map(int, draw.integers(0, 256, 3))) for i, n in enumerate([1, 2, 3, 5, 9, 40, 41, 90, 300]) for j in range(n)]
    colours += [("same", j, 7, 7, 7) for j in range(12)] + [("twice", j // 2, j // 2, 0, 9) for j in range(14)] + [("null", 1, None, 2, 3), (None, 1, 1, 2, 3)]
    frame = spark.createDataFrame(colours, "key string, id long, r long, g long, b long")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(size), []
    try:
        for most, rows in ((palette.GATHERED, "10000"), (palette.GATHERED, "7"), (40, "7"), (0, "7")):
            spark.conf.set(size, rows)
            found.append(sorted(map(repr, palette.palettes(frame, "key", most=most).collect())))
    finally:
        spark.conf.set(size, before)
    assert len(found[0]) == 11
    assert found[0] == found[1] == found[2] == found[3]


def test_palettes_of_small_keys_take_no_round_of_joins(spark, monkeypatch):
    monkeypatch.setattr(palette, "_in_rounds", lambda *_: pytest.fail("a job for each round"))
    frame = spark.range(600).selectExpr("id % 50 AS key", "id", "id * 7 % 256 AS r", "id * 11 % 256 AS g", "id % 256 AS b")
    assert palette.palettes(frame, "key").count() == 50


def test_stages_equal_plain_arrays(spark):
    rng = np.random.default_rng(3)
    h, w = 6, 9
    frames = [rng.random((h, w)) for _ in range(20)] + [np.zeros((h, w)), np.full((h, w), 0.5), np.eye(h, w)]
    rows = [(i, f.reshape(-1).tolist(), 0.25, 1920 if i % 2 else None, 1080) for i, f in enumerate(frames)]
    got = {r["key"]: r for r in grids.stages(spark.createDataFrame(rows, "key int, grid array<double>, colourful double, width int, height int"), h, w).collect()}
    kernel = np.array(grids.KERNEL) / 16
    for i, f in enumerate(frames):
        gy, gx = np.gradient(f)
        edge = np.sqrt(gx * gx + gy * gy)
        edge = edge / (edge.max() + 1e-9)
        dense = edge
        for axis in (0, 1):
            padded = np.pad(dense, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            dense = sum(kernel[k] * np.take(padded, range(k, k + dense.shape[axis]), axis) for k in range(5))
        sal = (edge + 0.25 * dense) * np.array(grids.centre(h, w)).reshape(h, w)
        sal = np.round(sal / (sal.max() + 1e-9), 9)
        inside = sal > sal.mean() + 0.4 * sal.std() + (0 if sal.sum() >= 1e-9 else 1)
        margins = [0.5] * 4
        if inside.any():
            ys, xs = np.nonzero(inside)
            margins = [ys.min() / h, (h - 1 - ys.max()) / h, (w - 1 - xs.max()) / w, xs.min() / w]
        lap = (np.gradient(gx, axis=1) + np.gradient(gy, axis=0)).var()
        p10, p90 = np.percentile(f, [10, 90])
        r = got[i]
        assert [r[f"margin_{n}"] for n in grids.NAMES] == pytest.approx(margins, abs=6e-5)
        assert r["sharpness"] == pytest.approx(lap / (lap + 0.001), abs=6e-5)
        assert r["exposure"] == pytest.approx(max(0, 1 - abs((p10 + p90) / 2 - 0.5) * 2), abs=6e-5)
        assert r["enough"] == (i % 2 == 1)
        if sal.sum() >= 1e-9:
            assert r["focal_x"] == pytest.approx((sal * np.arange(w)).sum() / sal.sum() / w, abs=6e-5)
    assert all(got[20][f"safe_{n}"] for n in grids.NAMES)


def test_perceptual_bits(spark):
    rng = np.random.default_rng(9)
    frames = [rng.random((8, 8)) for _ in range(6)] + [np.full((8, 8), 0.25)]
    frame = spark.createDataFrame([(i, f.reshape(-1).tolist()) for i, f in enumerate(frames + frames)], "id int, grid array<double>")
    got = {r["id"]: r for r in grids.perceptual(frame, 8, 8).collect()}
    c = np.cos(np.pi * (2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] / 16)
    for i, f in enumerate(frames):
        waves = np.round(c @ f @ c.T, 9).reshape(-1)
        want = [*(waves > np.median(waves)).astype(int), *(np.roll(f, -1, 1) > f).astype(int).reshape(-1)]
        assert got[i]["bits"] == want
        again = np.dot(got[i]["vector"], got[i + len(frames)]["vector"])
        assert again == pytest.approx(1.0) or not any(got[i]["vector"])


def test_stores(spark, tmp_path):
    at = f"file://{tmp_path}/blobs"
    blobs = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary")
    for _ in range(2):
        stores.put_blobs(blobs, at)
    assert sorted(bytes(r["content"]) for r in stores.stored(spark, at).collect()) == [b"a", b"b"]
    files = set(tmp_path.glob("blobs/*/*.parquet"))
    stores.put_blobs(blobs, at)
    assert set(tmp_path.glob("blobs/*/*.parquet")) == files  # nothing new, nothing written
    at = f"file://{tmp_path}/lists"
    stores.replace_groups(spark.createDataFrame([(g, i) for g in range(40) for i in range(3)], "g int, i int"), at, "g")
    stores.replace_groups(spark.createDataFrame([(7, 9), (40, 1)], "g int, i int"), at, "g")
    got = {}
    for r in stores.stored(spark, at).collect():
        got.setdefault(r["g"], []).append(r["i"])
    assert {g: sorted(x) for g, x in got.items()} == {**{g: [0, 1, 2] for g in range(40)}, 7: [9], 40: [1]}


def test_unknown_keys_of_any_shape(spark):
    rows = [('{"schema_version":"1","k":3,"a":null,"b":[1,{"c":"é"}],"quality":{"sharpness":1.5,"new":2}}',), ('{"schema_version":"9","k":3}',), ("[]",), ("{",), (None,), ('{"schema_version":"1"}',)]
    got = spark.createDataFrame(rows, "t string").select(*kept.opened(F.col("t"))).collect()
    assert got[0]["typed"]["k"] == 3 and got[0]["typed"]["quality"]["sharpness"] == 1.5 and got[0]["error"] is None
    assert got[0]["extra"] == '{"a":null,"b":[1,{"c":"é"}]}'
    assert [r["error"] for r in got[1:]] == ["schema version", "not an object", "not an object", "not an object", None]
    assert got[5]["extra"] == "{}" and got[5]["typed"]["k"] is None
