"""Measures of images from small grey grids, and the treatments that they allow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.operators import grids
from tessella.operators.palette import palettes
from tessella.queries.taste import ORACLE as TASTE_SQL
from tessella.queries.taste import pair_affinity
from tessella.sources import derived as D
from tessella.sources.derived import with_tables as over

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


SIDE = 8


def pictures(spark, sf):
    """Stored vectors as grey grids of 8 by 8, with the size of the image of that number and the
    colourfulness of its palette."""
    grid = F.transform("vector", lambda x: S.clamp01(0.5 + x))
    v = D.vectors(spark, sf).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("key"), grid.alias("grid"))
    rg, yb = (F.col("r") - F.col("g")) / 255, (0.5 * (F.col("r") + F.col("g")) - F.col("b")) / 255
    metric = F.sqrt(F.var_pop(rg) + F.var_pop(yb)) + 0.3 * F.sqrt(F.pow(F.avg(rg), 2) + F.pow(F.avg(yb), 2))
    colour = D.palettes(spark, sf).groupBy("key").agg(F.round(S.clamp01(S.saturate(metric, 25.0)), 6).alias("colourful"))
    sizes = D.images(spark, sf).select("key", "width", "height")
    # all parts stand on the right, of which a file's size tells little: never broadcast
    return v.join(sizes.hint("merge"), "key", "left").join(colour.hint("merge"), "key", "left").select("key", "grid", F.coalesce("colourful", F.lit(0.0)).alias("colourful"), "width", "height")


def _cells(f: str) -> str:
    """A grid of 64 with an expression of y, x and i at each cell."""
    return "list_transform(range(64), lambda i: " + f.replace("{y}", "(i // 8)").replace("{x}", "(i % 8)") + ")"


def _gradient(g: str, axis: int) -> str:
    a = ("{y}", "{x}")[axis]
    before, after = f"greatest({a} - 1, 0)", f"least({a} + 1, 7)"
    at = (lambda k: f"{g}[{k} * 8 + {{x}} + 1]") if axis == 0 else (lambda k: f"{g}[{{y}} * 8 + {k} + 1]")
    return _cells(f"({at(after)} - {at(before)}) / ({after} - {before})")


def _blur(g: str, axis: int) -> str:
    a = ("{y}", "{x}")[axis]
    ends = [f"least(greatest({a} + {k - 2}, 0), 7)" for k in range(5)]
    at = [f"{g}[{e} * 8 + {{x}} + 1]" if axis == 0 else f"{g}[{{y}} * 8 + {e} + 1]" for e in ends]
    return _cells("(" + " + ".join(f"{c} * {v}" for c, v in zip(grids.KERNEL, at, strict=True)) + f") / {sum(grids.KERNEL)}")


def _weighted(g: str, weights) -> str:
    return f"list_sum(list_transform(range(64), lambda i: {g}[i + 1] * {[float(x) for x in weights]}[i + 1]))"


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


YS, XS = [i // SIDE for i in range(64)], [i % SIDE for i in range(64)]
MEASURES = """p AS (SELECT 'k' || lpad(v.id::varchar, 8, '0') AS key, list_transform(vector, lambda x: greatest(0.0, least(1.0, 0.5 + x))) AS grid FROM vectors v),
m AS (SELECT key, sqrt(var_pop((r - g) / 255) + var_pop((0.5 * (r + g) - b) / 255)) + 0.3 * sqrt(avg((r - g) / 255) ** 2 + avg((0.5 * (r + g) - b) / 255) ** 2) AS m FROM palettes GROUP BY key),
q AS (SELECT p.*, coalesce(round(m.m / (m.m + 25.0), 6), 0.0) AS colourful, i.width, i.height FROM p LEFT JOIN images i USING (key) LEFT JOIN m USING (key)),
""" + f"""a AS (SELECT *, {_gradient('grid', 0)} AS gy, {_gradient('grid', 1)} AS gx FROM q),
b AS (SELECT *, list_transform(range(64), lambda i: gy[i + 1] * gy[i + 1] + gx[i + 1] * gx[i + 1]) AS power, {_gradient('gy', 0)} AS yy, {_gradient('gx', 1)} AS xx FROM a),
c AS (SELECT *, list_transform(power, lambda x: sqrt(x)) AS raw_edge FROM b), d AS (SELECT *, list_transform(raw_edge, lambda x: x / (list_max(raw_edge) + 1e-9)) AS edge FROM c),
e AS (SELECT *, {_blur('edge', 0)} AS half FROM d), f AS (SELECT *, {_blur('half', 1)} AS dense FROM e),
g AS (SELECT *, list_transform(range(64), lambda i: (edge[i + 1] + 0.25 * dense[i + 1]) * {grids.centre(SIDE, SIDE)}[i + 1]) AS raw FROM f),
h AS (SELECT *, list_transform(raw, lambda s: round(s / (list_max(raw) + 1e-9), 9)) AS sal, list_transform(range(64), lambda i: yy[i + 1] + xx[i + 1]) AS lap FROM g),
j AS (SELECT *, list_sum(sal) AS total, round(list_sum(sal) / 64 + 0.4 * list_stddev_pop(sal), 9) AS lim, list_sort(grid) AS so FROM h),
k AS (SELECT *, CASE WHEN total >= 1e-9 THEN list_filter(range(64), lambda i: sal[i + 1] > lim) ELSE [] END AS inside FROM j),
l AS (SELECT *, list_min(list_transform(inside, lambda i: i // 8)) AS top, list_max(list_transform(inside, lambda i: i // 8)) AS bottom, list_min(list_transform(inside, lambda i: i % 8)) AS lft, list_max(list_transform(inside, lambda i: i % 8)) AS rgt FROM k),
n AS (SELECT *, coalesce(top / 8, 0.5) AS mn, coalesce((7 - bottom) / 8, 0.5) AS ms, coalesce((7 - rgt) / 8, 0.5) AS me, coalesce(lft / 8, 0.5) AS mw,
 CASE WHEN coalesce(top / 8 BETWEEN 0.35 AND 0.65 AND bottom / 8 BETWEEN 0.35 AND 0.65 AND lft / 8 BETWEEN 0.35 AND 0.65 AND rgt / 8 BETWEEN 0.35 AND 0.65, false) THEN {grids.NEAR_MARGIN} ELSE {grids.SAFE_MARGIN} END AS least_margin,
 {_weighted('power', [x < 4 for x in XS])} AS pl, {_weighted('power', [x >= 4 for x in XS])} AS pr, {_weighted('power', [y < 4 for y in YS])} AS pt, {_weighted('power', [y >= 4 for y in YS])} AS pb,
 {_clamp("(list_var_pop(lap)) / (list_var_pop(lap) + 0.001)")} AS sharp, {_clamp("list_stddev_pop(grid) / (list_stddev_pop(grid) + 0.5)")} AS con,
 {_clamp("1 - abs(0.5 * (so[7] + 0.3 * (so[8] - so[7]) + so[57] + 0.7 * (so[58] - so[57])) - 0.5) * 2")} AS exposed FROM l),
measured AS (SELECT key, width, height, colourful, round(sharp, 4) AS sharpness, round(exposed, 4) AS exposure, round(con, 4) AS contrast,
 round({_clamp("0.4 * sharp + 0.3 * exposed + 0.2 * con + 0.1 * (CASE WHEN width IS NULL OR height IS NULL THEN 0.0 WHEN width >= 1920 AND height >= 1080 THEN 1.0 ELSE " + _clamp("least(width / 1920, height / 1080)") + " END)")}, 4) AS technical,
 round({_clamp("0.4 * " + _clamp(_weighted('sal', grids.thirds(SIDE, SIDE)) + " / (total + 1e-9) / 4") + " + 0.3 * " + _clamp("1 - 0.5 * (abs(pl - pr) / (pl + pr + 1e-9) + abs(pt - pb) / (pt + pb + 1e-9))") + " + 0.3 * colourful")}, 4) AS aesthetic,
 round(CASE WHEN total >= 1e-9 THEN {_clamp(_weighted('sal', XS) + ' / total / 8')} ELSE 0.5 END, 4) AS focal_x, round(CASE WHEN total >= 1e-9 THEN {_clamp(_weighted('sal', YS) + ' / total / 8')} ELSE 0.5 END, 4) AS focal_y,
 round(mn, 4) AS margin_north, round(ms, 4) AS margin_south, round(me, 4) AS margin_east, round(mw, 4) AS margin_west,
 mn >= least_margin AS safe_north, ms >= least_margin AS safe_south, me >= least_margin AS safe_east, mw >= least_margin AS safe_west, coalesce(width >= 1920 AND height >= 1080, false) AS enough FROM n)
"""


@query("ud_image_stages", over("vectors", "images", "palettes", body="--more" + MEASURES + "SELECT * FROM measured"))
def image_stages(spark, sf):
    """UD15, UD16, UD17, UD19, AG30, AG31: saliency of each grid from edges and their density, and what follows:
    quality, focal point, crop margins and safe sides."""
    return grids.stages(pictures(spark, sf), SIDE, SIDE)


@query("ud_perceptual", over("vectors", body="""--more p AS (SELECT id, list_transform(vector, lambda x: greatest(0.0, least(1.0, 0.5 + x))) AS g FROM vectors),
w AS (SELECT id, g, list_transform(range(64), lambda k: round(list_sum(list_transform(range(64), lambda i: g[i + 1] * round(cos(pi() * (2 * (i // 8) + 1) * (k // 8) / 16) * cos(pi() * (2 * (i % 8) + 1) * (k % 8) / 16), 12))), 9)) AS wave FROM p),
b AS (SELECT id, list_concat(list_transform(wave, lambda c: (c > (list_sort(wave)[32] + list_sort(wave)[33]) / 2)::int), list_transform(range(64), lambda i: (g[i // 8 * 8 + (i + 1) % 8 + 1] > g[i + 1])::int)) AS bits FROM w)
SELECT id, array_to_string(bits, '') AS bits, round((bits[1] - list_avg(bits)) / sqrt(list_sum(list_transform(bits, lambda x: (x - list_avg(bits)) ** 2))), 6) AS first, 1.0 AS length FROM b"""))
def perceptual(spark, sf):
    """UD18: 64 bits of the cosine transform and 64 of differences, centred and of length one."""
    grid = F.transform("vector", lambda x: S.clamp01(0.5 + x))
    p = grids.perceptual(D.vectors(spark, sf).select("id", grid.alias("grid")), SIDE, SIDE)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return p.select("id", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"), F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(length, 6).alias("length"))


# Thresholds of the treatments, and their order where scores are equal.
FULLBLEED_AESTHETIC, FULLBLEED_MARGIN, RISK_MARGIN, PANORAMIC, SQUARE, PAIR_AFFINITY, GROUP_AFFINITY, MOST_SOURCES, ASPECT_GAP = 0.7, 0.05, 0.05, 2.0, (0.8, 1.25), 0.75, 0.6, 9, 0.1
RANKS = ("diptych", "triptych", "quad", "packed", "single_fullbleed", "contain_matte", "panoramic", "square")
#: The aspect of the cell that a fit is asked for.
CELL = 16 / 9

PROPOSALS = MEASURES.rstrip() + f""", pair AS ({TASTE_SQL['fm_pair_affinity']}), grp AS (SELECT a AS key, count(*) + 1 AS n, round(avg(affinity), 4) AS affinity, min_by(affinity, b) AS first FROM pair GROUP BY a),
s AS (SELECT *, safe_north AND safe_south AND safe_east AND safe_west AS safe, least(margin_north, margin_south, margin_east, margin_west) AS margin, width / height AS aspect FROM measured LEFT JOIN grp USING (key)),
t AS (SELECT key, unnest([
 {{'treatment': 'single_fullbleed', 'on': safe AND margin >= {FULLBLEED_MARGIN} AND aesthetic >= {FULLBLEED_AESTHETIC}, 'score': round(0.6 * aesthetic + 0.4 * margin, 6)}}, {{'treatment': 'contain_matte', 'on': NOT safe OR margin < {RISK_MARGIN} OR NOT enough, 'score': 0.5}},
 {{'treatment': 'panoramic', 'on': aspect >= {PANORAMIC}, 'score': round(least(1.0, aspect / 4.0), 6)}}, {{'treatment': 'square', 'on': aspect BETWEEN {SQUARE[0]} AND {SQUARE[1]}, 'score': round(greatest(0.1, 0.5 * (aesthetic + 1.0 - abs(aspect - 1.0))), 6)}},
 {{'treatment': 'diptych', 'on': first >= {PAIR_AFFINITY}, 'score': first}}, {{'treatment': 'triptych', 'on': n = 3 AND affinity >= {GROUP_AFFINITY}, 'score': affinity}},
 {{'treatment': 'quad', 'on': n = 4 AND affinity >= {GROUP_AFFINITY}, 'score': affinity}}, {{'treatment': 'packed', 'on': n BETWEEN 2 AND {MOST_SOURCES} AND affinity >= {GROUP_AFFINITY}, 'score': affinity}}]) AS t,
 CASE WHEN safe AND margin >= {FULLBLEED_MARGIN} AND abs({CELL!r} - aspect) / aspect > {ASPECT_GAP} THEN 'fill' ELSE 'letterbox' END AS fit FROM s)
SELECT key, t.treatment AS treatment, t.score AS score, fit, row_number() OVER (PARTITION BY key ORDER BY t.score DESC, list_position({list(RANKS)}, t.treatment)) AS place FROM t WHERE t."on"
"""


@query("ru_proposals", over("vectors", "images", "palettes", body="--more" + PROPOSALS))
def proposals(spark, sf):
    """RU1, RU2, RU3, RU4, SL2, PF14, PF19, AG29: the treatments that each image allows, from its measured crop
    safety, quality, size and aspect and, where it stands for a group of one content, the group's
    affinity; by score, then the fixed order; and whether it may fill a cell of 16 to 9."""
    pairs = pair_affinity(spark, sf).groupBy(F.col("a").alias("key")).agg((F.count(F.lit(1)) + 1).alias("n"), F.round(F.avg("affinity"), 4).alias("affinity"), F.min_by("affinity", "b").alias("first"))
    s = grids.stages(pictures(spark, sf), SIDE, SIDE).join(pairs.hint("merge"), "key", "left").withColumn("aspect", F.col("width") / F.col("height"))
    safe = F.col("safe_north") & F.col("safe_south") & F.col("safe_east") & F.col("safe_west")
    margin = F.least(*[f"margin_{k}" for k in grids.NAMES])
    s = s.withColumns({"safe": safe, "margin": margin})
    aspect, aesthetic, group = F.col("aspect"), F.col("aesthetic"), F.col("affinity") >= GROUP_AFFINITY
    rules = {
        "single_fullbleed": (F.col("safe") & (F.col("margin") >= FULLBLEED_MARGIN) & (aesthetic >= FULLBLEED_AESTHETIC), F.round(0.6 * aesthetic + 0.4 * F.col("margin"), 6)),
        "contain_matte": (~F.col("safe") | (F.col("margin") < RISK_MARGIN) | ~F.col("enough"), F.lit(0.5)),
        "panoramic": (aspect >= PANORAMIC, F.round(F.least(F.lit(1.0), aspect / 4.0), 6)),
        "square": (aspect.between(*SQUARE), F.round(F.greatest(F.lit(0.1), 0.5 * (aesthetic + 1.0 - F.abs(aspect - 1.0))), 6)),
        "diptych": (F.col("first") >= PAIR_AFFINITY, F.col("first")),
        "triptych": ((F.col("n") == 3) & group, F.col("affinity")),
        "quad": ((F.col("n") == 4) & group, F.col("affinity")),
        "packed": (F.col("n").between(2, MOST_SOURCES) & group, F.col("affinity")),
    }
    each = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(name).alias("treatment"), score.alias("score"), F.lit(RANKS.index(name)).alias("rank"))) for name, (on, score) in rules.items()]))
    fit = F.when(F.col("safe") & (F.col("margin") >= FULLBLEED_MARGIN) & (F.abs(CELL - aspect) / aspect > ASPECT_GAP), "fill").otherwise("letterbox")
    rows = s.select("key", F.explode(each).alias("t"), fit.alias("fit")).select("key", "t.*", "fit")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "rank"))  # at most eight rows a key
    return rows.select("key", "treatment", "score", "fit", place.alias("place"))


@query("ag_kmeans_palette")
def kmeans_palette(spark, sf):
    """AG33: the dominant colours of each part, whose line items are its pixels: five centres, fifteen rounds at
    most, near centres merged, by falling share. Tested against a plain loop on every key."""
    found = palettes(pixels(spark, sf), "p_partkey")
    return found.select("p_partkey", F.posexplode("palette").alias("place", "c")).select("p_partkey", "place", "c.r", "c.g", "c.b", F.round("c.share", 6).alias("share"))


def pixels(spark, sf):
    """Line items as pixels of their part's image."""
    line = D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), D._line_id().alias("id"), (F.col("l_quantity") * 5).alias("r"), (F.col("l_suppkey") * 37 % 256).alias("g"), F.round(F.col("l_discount") * 2550).alias("b"))
    return line.dropDuplicates(["p_partkey", "id"])
