"""Stencils over small grids of grey values, as expressions of Spark: gradients, saliency, crop margins,
balance, sharpness and perceptual bits.

A grid is an array of doubles in [0, 1], row by row, of a height and width that are parameters. Each
step's result is a column that the next refers to more than once, so that it is worked out once."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import clamp01, saturate

# The least margins of a crop, with a subject near the centre and without; the share of
# the deviation by which content exceeds the mean; the size that is enough for a full screen.
SAFE_MARGIN, NEAR_MARGIN, CONTENT, SCREEN = 0.02, 0.06, 0.4, (1920, 1080)
#: The kernel that spreads edges into a density.
KERNEL = (1, 4, 6, 4, 1)
#: Digits to which saliency is kept, so that thresholds do not depend on the last bits.
DIGITS = 9

NAMES = ("north", "south", "east", "west")


def _cells(h: int, w: int, f: Callable[[Column, Column], Column]) -> Column:
    """A grid with f(y, x) at each cell."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: f(F.floor(i / w).cast("int"), (i % w).cast("int")))


def _at(grid: str, w: int, y: Column, x: Column) -> Column:
    return F.get(grid, y * w + x)


def gradient(grid: str, h: int, w: int, axis: int) -> Column:
    """Central differences along rows (axis 0) or columns (1), one-sided at the edges."""
    n = (h, w)[axis]

    def cell(y: Column, x: Column) -> Column:
        a = (y, x)[axis]
        before, after = F.greatest(a - 1, F.lit(0)), F.least(a + 1, F.lit(n - 1))
        ends = [(before, x), (after, x)] if axis == 0 else [(y, before), (y, after)]
        return (_at(grid, w, *ends[1]) - _at(grid, w, *ends[0])) / (after - before)

    return _cells(h, w, cell)


def blurred(grid: str, h: int, w: int, axis: int) -> Column:
    """The kernel along one axis; beyond the edge the edge's value counts."""
    half, n = len(KERNEL) // 2, (h, w)[axis]

    def cell(y: Column, x: Column) -> Column:
        total = F.lit(0.0)
        for k, weight in enumerate(KERNEL):
            a = F.least(F.greatest((y, x)[axis] + (k - half), F.lit(0)), F.lit(n - 1))
            total = total + _at(grid, w, *((a, x) if axis == 0 else (y, a))) * float(weight)
        return total / float(sum(KERNEL))

    return _cells(h, w, cell)


def centre(h: int, w: int) -> list[float]:
    """How near to the centre each cell is."""
    return [0.35 + 0.65 * math.exp(-(((x - w / 2) / (0.6 * w)) ** 2 + ((y - h / 2) / (0.6 * h)) ** 2)) for y in range(h) for x in range(w)]


def thirds(h: int, w: int) -> list[float]:
    """In how many of the four strips at the thirds each cell lies."""
    out = [0.0] * (h * w)
    for share in (1 / 3, 2 / 3):
        for axis, n in enumerate((h, w)):
            at = round(share * (n - 1))
            for y in range(h):
                for x in range(w):
                    out[y * w + x] += max(0, at - 2) <= (y, x)[axis] < min(n, at + 3)
    return out


def _constants(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def _sum(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(0.0), lambda a, x: a + x)


def _products(grid: str, weights: list[float]) -> Column:
    return _sum(F.zip_with(grid, _constants(weights), lambda a, b: a * b))


def stages(df: DataFrame, h: int, w: int) -> DataFrame:
    """``df`` (with ``grid``, ``colourful``, ``width`` and ``height``) with the measures of an image:
    sharpness, exposure, contrast, technical and aesthetic quality, focal point, the four crop margins, whether
    each side is safe, and whether the size is enough. Rounded to four digits. A flat grid has its
    focal point in the middle and margins of a half, all safe; an unknown size counts as none."""
    ys, xs = [float(i // w) for i in range(h * w)], [float(i % w) for i in range(h * w)]
    n = float(h * w)
    d = df.withColumns({"gy": gradient("grid", h, w, 0), "gx": gradient("grid", h, w, 1)})
    d = d.withColumns({"power": F.zip_with("gy", "gx", lambda a, b: a * a + b * b), "yy": gradient("gy", h, w, 0), "xx": gradient("gx", h, w, 1)})
    d = d.withColumn("edge", F.transform("power", F.sqrt)).withColumn("most", F.array_max("edge") + 1e-9)
    d = d.withColumn("edge", F.transform("edge", lambda e: e / F.col("most")))
    d = d.withColumn("dense", blurred("edge", h, w, 0)).withColumn("dense", blurred("dense", h, w, 1))
    d = d.withColumn("raw", F.zip_with(F.zip_with("edge", "dense", lambda a, b: a + 0.25 * b), _constants(centre(h, w)), lambda a, b: a * b))
    d = d.withColumn("most", F.array_max("raw") + 1e-9).withColumn("saliency", F.transform("raw", lambda s: F.round(s / F.col("most"), DIGITS)))
    d = d.withColumns({"total": _sum(F.col("saliency")), "laplacian": F.zip_with("yy", "xx", lambda a, b: a + b), "sorted": F.array_sort("grid")})
    d = d.withColumns({"mean": F.col("total") / n, "curve": _sum(F.col("laplacian")) / n, "grey": _sum(F.col("grid")) / n})

    def spread(grid: str, mean: str) -> Column:
        return _sum(F.transform(grid, lambda x: (x - F.col(mean)) * (x - F.col(mean)))) / n

    d = d.withColumns({"limit": F.round(F.col("mean") + CONTENT * F.sqrt(spread("saliency", "mean")), DIGITS), "sharp": spread("laplacian", "curve"), "contrast": spread("grid", "grey")})
    places = F.filter(F.transform("saliency", lambda s, i: F.when(s > F.col("limit"), i)), lambda i: i.isNotNull())
    d = d.withColumn("content", F.when(F.col("total") >= 1e-9, places).otherwise(F.array().cast("array<int>")))
    rows, cols = F.transform("content", lambda i: F.floor(i / w).cast("int")), F.transform("content", lambda i: (i % w).cast("int"))
    d = d.withColumns({"top": F.array_min(rows), "bottom": F.array_max(rows), "left": F.array_min(cols), "right": F.array_max(cols)})
    margins = {"north": F.col("top") / h, "south": (h - 1 - F.col("bottom")) / h, "east": (w - 1 - F.col("right")) / w, "west": F.col("left") / w}
    near = F.lit(True)
    for side, size in (("top", h), ("bottom", h), ("left", w), ("right", w)):
        near = near & (F.col(side) / size).between(0.35, 0.65)
    d = d.withColumns({**{f"margin_{k}": F.coalesce(m, F.lit(0.5)) for k, m in margins.items()}, "near": F.coalesce(near, F.lit(False))})

    def percentile(share: float) -> Column:
        at = share * (h * w - 1)
        low = F.get("sorted", F.lit(int(at)))
        return low + (at - int(at)) * (F.get("sorted", F.lit(min(int(at) + 1, h * w - 1))) - low)

    half = [_products("power", [float(x < w // 2) for x in xs]), _products("power", [float(x >= w // 2) for x in xs]), _products("power", [float(y < h // 2) for y in ys]), _products("power", [float(y >= h // 2) for y in ys])]
    d = d.withColumns(dict(zip(("l", "r", "t", "b"), half, strict=True)))
    uneven = F.abs(F.col("l") - F.col("r")) / (F.col("l") + F.col("r") + 1e-9) + F.abs(F.col("t") - F.col("b")) / (F.col("t") + F.col("b") + 1e-9)
    aesthetic = clamp01(0.4 * clamp01(_products("saliency", thirds(h, w)) / (F.col("total") + 1e-9) / 4) + 0.3 * clamp01(1 - 0.5 * uneven) + 0.3 * F.col("colourful"))
    enough = (F.col("width") >= SCREEN[0]) & (F.col("height") >= SCREEN[1])
    size = F.when(F.col("width").isNull() | F.col("height").isNull(), 0.0).when(enough, 1.0).otherwise(clamp01(F.least(F.col("width") / SCREEN[0], F.col("height") / SCREEN[1])))
    sharpness, contrast = clamp01(saturate(F.col("sharp"), 0.001)), clamp01(saturate(F.sqrt("contrast"), 0.5))
    exposure = clamp01(1 - F.abs(0.5 * (percentile(0.1) + percentile(0.9)) - 0.5) * 2)
    technical = clamp01(0.4 * sharpness + 0.3 * exposure + 0.2 * contrast + 0.1 * size)
    found = F.col("total") >= 1e-9
    focal = {"focal_x": F.when(found, clamp01(_products("saliency", xs) / F.col("total") / w)).otherwise(0.5), "focal_y": F.when(found, clamp01(_products("saliency", ys) / F.col("total") / h)).otherwise(0.5)}
    values = {"sharpness": sharpness, "exposure": exposure, "contrast": contrast, "technical": technical, "aesthetic": aesthetic, **focal, **{f"margin_{k}": F.col(f"margin_{k}") for k in NAMES}}
    safe = {f"safe_{k}": F.col(f"margin_{k}") >= F.when(F.col("near"), NEAR_MARGIN).otherwise(SAFE_MARGIN) for k in NAMES}
    kept = [c for c in df.columns if c != "grid"]
    return d.select(*kept, *[F.round(v, 4).alias(k) for k, v in values.items()], *[v.alias(k) for k, v in safe.items()], F.coalesce(enough, F.lit(False)).alias("enough"))


def perceptual(df: DataFrame, h: int, w: int) -> DataFrame:
    """``df`` (with ``grid``) with ``bits``, twice h * w of them, and ``vector``, the bits centred and of
    length one. The first half: whether each coefficient of the cosine transform is above their median;
    the second: whether the cell to the right, around the edge, is brighter."""

    def wave(u: int, v: int) -> list[float]:
        return [round(math.cos(math.pi * (2 * y + 1) * u / (2 * h)) * math.cos(math.pi * (2 * x + 1) * v / (2 * w)), 12) for y in range(h) for x in range(w)]

    basis = F.array(*[_constants(wave(u, v)) for u in range(h) for v in range(w)])
    d = df.withColumn("waves", F.transform(basis, lambda b: F.round(_sum(F.zip_with("grid", b, lambda x, y: x * y)), DIGITS)))
    d = d.withColumn("sorted", F.array_sort("waves"))
    d = d.withColumn("median", (F.get("sorted", F.lit((h * w - 1) // 2)) + F.get("sorted", F.lit(h * w // 2))) / 2)
    brighter = _cells(h, w, lambda y, x: (_at("grid", w, y, (x + 1) % w) > _at("grid", w, y, x)).cast("double"))
    d = d.withColumn("bits", F.concat(F.transform("waves", lambda c: (c > F.col("median")).cast("double")), brighter))
    d = d.withColumn("mean", _sum(F.col("bits")) / float(2 * h * w))
    d = d.withColumn("centred", F.transform("bits", lambda b: b - F.col("mean")))
    d = d.withColumn("norm", F.sqrt(_sum(F.transform("centred", lambda c: c * c))))
    vector = F.transform("centred", lambda c: c / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    return d.select(*[c for c in df.columns if c != "grid"], F.transform("bits", lambda b: b.cast("int")).alias("bits"), vector.alias("vector"))
