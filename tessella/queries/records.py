"""Records and small rules: sessions, proposals, verdicts, palettes, parsed weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.queries.taste import ACTIVE, LATEST_SIGNALS, signals, votes
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


@query("sk_session_fold", "SELECT user_id, min(ts) AS opened, max(ts) FILTER (event_type = 'signup') AS closed, count(*) AS events FROM events GROUP BY user_id")
def session_fold(spark, sf):
    """SK17: session open / close."""
    return D.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("opened"), F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("closed"), F.count(F.lit(1)).alias("events"))


@query("sk_batch_approve", "SELECT o_orderkey AS id, u.pos - 1 AS position, u.decision FROM orders, LATERAL (SELECT unnest(['approved', 'rejected', 'approved']) AS decision, unnest([1, 2, 3]) AS pos) u")
def batch_approve(spark, sf):
    """SK33: one event per id and decision, in order."""
    ids = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return ids.select("id", F.posexplode(F.array(F.lit("approved"), F.lit("rejected"), F.lit("approved"))).alias("position", "decision"))


@query("pf_proposals", over("analyses", body="SELECT entry_id, id, aesthetic_quality, row_number() OVER (PARTITION BY entry_id ORDER BY aesthetic_quality DESC, id) AS place FROM analyses WHERE status = 'ok' AND technical_quality > 0.2"))
def proposals(spark, sf):
    """PF14, SL2: proposals by entry and optional treatment, ORDER BY score DESC, id."""
    a = D.analyses(spark, sf).where("status = 'ok' and technical_quality > 0.2").select("entry_id", "id", "aesthetic_quality")
    return a.withColumn("place", F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("aesthetic_quality"), "id")))


@query("pf_publish_history", over("publishes", body="SELECT artifact_id, id, status FROM publishes WHERE status IN ('error', 'staged') AND adapter_id = 'd1'"))
def publish_history(spark, sf):
    """PF15: publish history by artifact / rows by status."""
    return D.publishes(spark, sf).where("status in ('error', 'staged') and adapter_id = 'd1'").select("artifact_id", "id", "status")


# Fixed value: discordant pairs below which there is no verdict.
LEAST_PAIRS = 10
WILSON_SQL = "((wins / discordant + 3.841458820694124 / (2 * discordant)) {sign} 1.959963984540054 * sqrt(wins / discordant * (1 - wins / discordant) / discordant + 3.841458820694124 / (4 * discordant * discordant))) / (1 + 3.841458820694124 / discordant)"


@query("ag_verdict", over("preferences", "analyses", body=ACTIVE.rstrip() + ",\n" + LATEST_SIGNALS + f""", p AS (SELECT a.winner % 5 AS part, sign(w.harmony - l.harmony) AS x, sign(w.aesthetic_quality - l.aesthetic_quality) AS y FROM active a JOIN latest w ON w.entry_id = a.winner JOIN latest l ON l.entry_id = a.loser),
 t AS (SELECT part, count(*) FILTER (x <> 0 AND y <> 0 AND x <> y) AS discordant, count(*) FILTER (x > 0 AND y < 0) AS wins FROM p GROUP BY part)
 SELECT part, discordant, wins, CASE WHEN discordant < {LEAST_PAIRS} THEN 'insufficient_evidence' WHEN {WILSON_SQL.format(sign='-')} > 0.5 THEN 'embedding_better' WHEN {WILSON_SQL.format(sign='+')} < 0.5 THEN 'lens_better' ELSE 'tie' END AS verdict FROM t"""))
def verdict(spark, sf):
    """AG28: of the pairs on which two heads differ, the interval of one head's wins decides."""
    s = signals(spark, sf).select("entry_id", "harmony", "aesthetic_quality")
    p = votes(spark, sf).join(s.toDF("winner", "wh", "wa"), "winner").join(s.toDF("loser", "lh", "la"), "loser")
    p = p.select((F.col("winner") % 5).alias("part"), F.signum(F.col("wh") - F.col("lh")).alias("x"), F.signum(F.col("wa") - F.col("la")).alias("y"))
    x, y = F.col("x"), F.col("y")
    t = p.groupBy("part").agg(F.count_if((x != 0) & (y != 0) & (x != y)).alias("discordant"), F.count_if((x > 0) & (y < 0)).alias("wins"))
    low, high = S.wilson(F.col("wins"), F.col("discordant"))
    return t.withColumn("verdict", F.when(F.col("discordant") < LEAST_PAIRS, "insufficient_evidence").when(low > 0.5, "embedding_better").when(high < 0.5, "lens_better").otherwise("tie"))


@query("ag_label_histogram", over("vectors", body="SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM vectors), 6) AS share FROM vectors GROUP BY label"))
def label_histogram(spark, sf):
    """AG32: label histogram."""
    per = D.vectors(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(per.agg(F.sum("n").alias("all")))).select("label", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("ag_palette_harmony", """--
WITH c AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, (l_partkey % 256) / 255.0 AS r, (l_suppkey % 256) / 255.0 AS g, (l_linenumber * 37 % 256) / 255.0 AS b FROM lineitem),
 d AS (SELECT x.o, sqrt((x.r - y.r) ** 2 + (x.g - y.g) ** 2 + (x.b - y.b) ** 2) / sqrt(3) AS d FROM c x JOIN c y ON x.o = y.o AND x.i < y.i), m AS (SELECT o, avg(d) AS mean, var_pop(d) AS variance FROM d GROUP BY o)
 SELECT s.o, round(CASE WHEN m.o IS NULL THEN 1.0 ELSE 0.5 * (1 - least(1.0, mean)) + 0.5 * (1 - least(1.0, variance * 4)) END, 6) AS harmony FROM (SELECT DISTINCT o FROM c) s LEFT JOIN m ON m.o = s.o""")
def palette_harmony(spark, sf):
    """AG34: 1 for one colour, lower as colours lie apart and unevenly."""
    k = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    c = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.row_number().over(k).alias("i"), *[((x % 256) / 255.0).alias(n) for n, x in (("r", F.col("l_partkey")), ("g", F.col("l_suppkey")), ("b", F.col("l_linenumber") * 37))])
    square = sum(((F.col(n) - F.col(f"{n}2")) * (F.col(n) - F.col(f"{n}2")) for n in "rgb"), F.lit(0.0))
    d = c.join(c.toDF("o", "i2", "r2", "g2", "b2"), "o").where("i < i2").select("o", (F.sqrt(square) / 3**0.5).alias("d"))
    m = d.groupBy("o").agg(F.avg("d").alias("mean"), F.var_pop("d").alias("variance"))
    harmony = 0.5 * (1 - F.least(F.lit(1.0), F.col("mean"))) + 0.5 * (1 - F.least(F.lit(1.0), F.col("variance") * 4))
    return c.select("o").distinct().join(m, "o", "left").select("o", F.round(F.when(F.col("mean").isNull(), 1.0).otherwise(harmony), 6).alias("harmony"))


METRIC_SQL = "sqrt(var_pop(l_quantity - l_discount * 100) + var_pop(0.5 * (l_quantity + l_discount * 100) - l_tax * 100)) + 0.3 * sqrt(avg(l_quantity - l_discount * 100) ** 2 + avg(0.5 * (l_quantity + l_discount * 100) - l_tax * 100) ** 2)"


@query("fm_colourfulness", f"SELECT l_suppkey, round(m / (m + 25.0), 6) AS colourfulness FROM (SELECT l_suppkey, {METRIC_SQL} AS m FROM lineitem GROUP BY l_suppkey)")
def colourfulness(spark, sf):
    """FM9: the metric of opponent colours, saturated at 25."""
    r, g, b = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    rg, yb = r - g, 0.5 * (r + g) - b
    metric = F.sqrt(F.var_pop(rg) + F.var_pop(yb)) + 0.3 * F.sqrt(F.pow(F.avg(rg), 2) + F.pow(F.avg(yb), 2))
    return D.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(S.clamp01(S.saturate(metric, 25.0)), 6).alias("colourfulness"))


@query("fs_parse_weights", "SELECT l_orderkey, string_agg(l_quantity::int::varchar, ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS raw, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def parse_weights(spark, sf):
    """FS18: 64-hex validation, weights list parsing."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    raw = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda x: x["l_quantity"].cast("int").cast("string")), ",").alias("raw"))
    parsed = F.transform(F.split("raw", ","), lambda x: F.trim(x).try_cast("double"))
    return raw.select("l_orderkey", "raw", F.aggregate(parsed, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(parsed).cast("long").alias("n"))


@query("fd_newest_stamp", "SELECT user_id, coalesce(max(nullif(CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, '')), '') AS stamp FROM events GROUP BY user_id")
def newest_stamp(spark, sf):
    """FD7: newest non-empty ISO stamp, '' when none."""
    stamp = F.when(F.col("event_type") == "error", "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return D.table(spark, sf, "events").groupBy("user_id").agg(F.coalesce(F.max(F.nullif(stamp, F.lit(""))), F.lit("")).alias("stamp"))



CELLS_SQL = """WITH c AS (SELECT l_orderkey AS o, l_quantity * 20 AS w, sum(l_quantity * 20) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) - l_quantity * 20 AS x, l_returnflag = 'R' AND l_quantity < 10 AS unset FROM lineitem)"""


@query("gr_tiling_check", CELLS_SQL + " SELECT o, max(x + w)::bigint AS reach, count(*) AS cells, CASE WHEN NOT bool_or(unset) AND max(x + w) = ceil(max(x + w) / 2000) * 2000 THEN 'stored' ELSE 'recomputed' END AS regions FROM c GROUP BY o")
def tiling_check(spark, sf):
    """GR8: stored cells stand only if all are set and reach the target's width, a whole number of
    2000 pixels here, and height exactly; else all are recomputed."""
    run = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    w = F.col("l_quantity") * 20
    c = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), w.alias("w"), (F.sum(w).over(run) - w).alias("x"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10)).alias("unset"))
    reach = F.max(F.col("x") + F.col("w"))
    tiles = ~F.max("unset") & (reach == F.ceil(reach / 2000) * 2000)
    return c.groupBy("o").agg(reach.cast("long").alias("reach"), F.count(F.lit(1)).alias("cells"), F.when(tiles, "stored").otherwise("recomputed").alias("regions"))
