"""Profiles, manifests, playlists, connectors and the remaining rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.operators.latest import latest, nth_latest
from tessella.operators.ordering import placed_within
from tessella.queries.taste import LATEST_SIGNALS, signals
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



@query("ru_manifest_checks", """SELECT l_orderkey, concat_ws(',', CASE WHEN count(*) NOT BETWEEN 2 AND 6 THEN 'arity' END, CASE WHEN count(DISTINCT l_partkey) < count(*) THEN 'duplicate' END, CASE WHEN min(l_quantity) < 2 THEN 'weight' END) AS failed
 FROM lineitem GROUP BY l_orderkey""")
def manifest_checks(spark, sf):
    """RU5, RU7: manifest materialisation with arity errors."""
    n = F.count(F.lit(1))
    failed = F.concat_ws(",", F.when(~n.between(2, 6), "arity"), F.when(F.countDistinct("l_partkey") < n, "duplicate"), F.when(F.min("l_quantity") < 2, "weight"))
    return D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(failed.alias("failed"))


# The stages of each profile, in order.
STAGES = {
    "fast": ["perceptual", "technical"],
    "balanced": ["perceptual", "technical", "aesthetic", "saliency"],
    "quality": ["perceptual", "technical", "aesthetic", "saliency", "cropsafety", "colorstory"],
    "max": ["perceptual", "technical", "aesthetic", "saliency", "cropsafety", "colorstory", "pairing"],
}


@query("ru_stage_list", "SELECT c_custkey, unnest(l) AS stage, generate_subscripts(l, 1) - 1 AS rank FROM (SELECT c_custkey, CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(STAGES.values())) + " END AS l FROM customer)")
def stage_list(spark, sf):
    """RU10: the ordered stages of a profile, with their ranks."""
    lists = F.element_at(F.array(*[F.array(*map(F.lit, v)) for v in STAGES.values()]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return D.table(spark, sf, "customer").select("c_custkey", F.posexplode(lists).alias("rank", "stage")).withColumn("rank", F.col("rank").cast("long"))


@query("ss_reconcile", over("files", "publishes", body="SELECT path FROM files WHERE sha256(path) NOT IN (SELECT sha256(path) FROM files WHERE length % 7000 = 0) AND 'a' || (length // 1000) NOT IN (SELECT artifact_id FROM publishes WHERE status <> 'error')"))
def reconcile(spark, sf):
    """JN11, SS7: anti-join."""
    f = D.files(spark, sf).withColumn("sha", F.sha2(F.col("path").cast("binary"), 256)).withColumn("artifact_id", F.concat(F.lit("a"), F.floor(F.col("length") / 1000)))
    known, queued = f.where("length % 7000 = 0").select("sha"), D.publishes(spark, sf).where("status <> 'error'").select("artifact_id")
    return f.join(known, "sha", "left_anti").join(queued, "artifact_id", "left_anti").select("path")


@query("ss_profile_undo", over("approvals", body="SELECT entry_id, id, decision FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY id) AS v, count(*) OVER (PARTITION BY entry_id) AS n FROM approvals) WHERE v = n - 1"))
def profile_undo(spark, sf):
    """SS21: profile history snapshot / replay / undo."""
    return nth_latest(D.approvals(spark, sf), ["entry_id"], "id", 2).select("entry_id", "id", "decision")


@query("pf_capability", over("remote", body="SELECT asset_id, list_contains(tags, 'BUILDING') AND star >= 2 OR star = 5 AND len(tags) > 0 AS capable FROM remote"))
def capability(spark, sf):
    """PF24: capability predicate."""
    return D.remote(spark, sf).select("asset_id", ((F.array_contains("tags", "BUILDING") & (F.col("star") >= 2)) | ((F.col("star") == 5) & (F.size("tags") > 0))).alias("capable"))


@query("pf_layout_arity", "SELECT l_orderkey, count(*) AS n, count(*) = len(list(l_quantity) FILTER (l_quantity > 0)) AND count(*) BETWEEN 2 AND 9 AS lays_out FROM lineitem GROUP BY l_orderkey")
def layout_arity(spark, sf):
    """PF23: layout applicability predicate on stored proposals."""
    n = F.count(F.lit(1))
    return D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(n.alias("n"), ((n == F.count_if(F.col("l_quantity") > 0)) & n.between(2, 9)).alias("lays_out"))


@query("sc_verified_read", "SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS checksum FROM pages WHERE html IS NOT NULL")
def verified_read(spark, sf):
    """SC16, FS1: contents read against the checksums that a manifest names; one that differs is an error."""
    pages = D.table(spark, sf, "pages").where("html is not null")
    manifest = pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("checksum"))
    read = pages.select("page_id", "html").join(manifest, "page_id").withColumn("html", S.verified(F.col("html"), F.col("checksum")))
    return read.select("page_id", F.octet_length("html").cast("long").alias("n"), "checksum")


@query("sc_preview", "SELECT doc_id, md5(encode(coalesce(text, ''))[1:octet_length(encode(coalesce(text, ''))) // 2]) AS preview FROM documents")
def preview(spark, sf):
    """SC17: preview read: the first half of the bytes."""
    t = F.coalesce("text", F.lit("")).cast("binary")
    return D.table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5(F.substr("t", F.lit(1), F.floor(F.octet_length("t") / 2).cast("int"))).alias("preview"))


@query("sc_revision_observation", over("remote", body="SELECT q.asset_id, coalesce(r.revision, 'deleted') AS revision, r.asset_id IS NOT NULL AS available FROM (SELECT DISTINCT 'a-' || lpad((o_custkey * 2)::varchar, 8, '0') AS asset_id FROM orders) q LEFT JOIN (SELECT * FROM remote WHERE available) r ON r.asset_id = q.asset_id"))
def revision_observation(spark, sf):
    """SC6: current revision/availability observation."""
    asked = D.table(spark, sf, "orders").select(F.concat(F.lit("a-"), F.lpad((F.col("o_custkey") * 2).cast("string"), 8, "0")).alias("asset_id")).distinct()
    r = D.remote(spark, sf).where("available").select("asset_id", "revision", F.lit(True).alias("here"))
    return asked.join(r, "asset_id", "left").select("asset_id", F.coalesce("revision", F.lit("deleted")).alias("revision"), F.coalesce("here", F.lit(False)).alias("available"))


@query("sk_playlist_members", over("entries", body="SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1 AS position FROM entries WHERE cluster_id IS NOT NULL AND quality_score IS NOT NULL"))
def playlist_members(spark, sf):
    """SK20: playlist save."""
    e = D.entries(spark, sf).where("cluster_id is not null and quality_score is not null").select("cluster_id", "id")
    return placed_within(e, ["cluster_id"], "id").select("cluster_id", "id", (F.col("place") - 1).alias("position"))


@query("wn_deck_cursor", over("entries", body="SELECT cluster_id, id, lag(id) OVER w AS previous, lead(id) OVER w AS following FROM entries WHERE cluster_id IS NOT NULL WINDOW w AS (PARTITION BY cluster_id ORDER BY quality_score DESC NULLS LAST, id)"))
def deck_cursor(spark, sf):
    """WN15: next/previous deck cursor over the composed feed."""
    e = D.entries(spark, sf).where("cluster_id is not null").select("cluster_id", "id", "quality_score")
    deck = placed_within(e, ["cluster_id"], F.desc_nulls_last("quality_score"), "id").select("cluster_id", "id", "place")
    previous = deck.select("cluster_id", F.col("id").alias("previous"), (F.col("place") + 1).alias("place"))
    following = deck.select("cluster_id", F.col("id").alias("following"), (F.col("place") - 1).alias("place"))
    return deck.join(previous, ["cluster_id", "place"], "left").join(following, ["cluster_id", "place"], "left").select("cluster_id", "id", "previous", "following")



@query("sl_wildcard", over("entries", body="""--more r AS (SELECT connector_id, cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(quality_score, 0) DESC, id) AS r FROM entries WHERE cluster_id IS NOT NULL)
 SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN r <= 2 THEN r ELSE 3 END, CASE WHEN r > 2 THEN md5('seed' || id) END, id) AS place FROM r"""))
def wildcard(spark, sf):
    """SL7: wildcard."""
    e = D.entries(spark, sf).where("cluster_id is not null").select("cluster_id", "id", F.coalesce("quality_score", F.lit(0.0)).alias("s"))
    r = placed_within(e, ["cluster_id"], F.desc("s"), "id", name="r")
    tail = F.when(F.col("r") > 2, F.md5(F.concat(F.lit("seed"), "id").cast("binary")))
    return placed_within(r.select("cluster_id", "id", "r"), ["cluster_id"], F.least("r", F.lit(3)), tail, "id").select("cluster_id", "id", "place")


@query("fm_alignment", over("analyses", body="--more " + LATEST_SIGNALS + " SELECT entry_id, round((2 * technical_quality - pairing_affinity + 0.5 * aesthetic_quality) * 0.7071067811865476, 6) AS alignment, round(greatest(0, least(1, harmony * 2 - 0.5)), 6) AS clamped, round(CASE WHEN pairing_affinity + 0.25 > 0 THEN pairing_affinity / (pairing_affinity + 0.25) ELSE 0 END, 6) AS saturated FROM latest"))
def alignment(spark, sf):
    """FM6, FM7, FM13: clamp to [0,1]."""
    return signals(spark, sf).select(
        "entry_id", F.round((2 * F.col("technical_quality") - F.col("pairing_affinity") + 0.5 * F.col("aesthetic_quality")) * 0.7071067811865476, 6).alias("alignment"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("harmony") * 2 - 0.5)), 6).alias("clamped"), F.round(S.saturate(F.col("pairing_affinity"), 0.25), 6).alias("saturated"),
    )


@query("gr_weight_hygiene", """--
WITH w AS (SELECT l_orderkey AS o, l_linenumber AS i, l_partkey AS t, l_quantity AS q, CASE WHEN l_quantity > 20 THEN l_quantity ELSE 0 END AS v FROM lineitem), s AS (SELECT *, sum(v) OVER (PARTITION BY o) AS total, count(*) OVER (PARTITION BY o) AS n FROM w)
SELECT o, i, t, q, round(CASE WHEN total > 0 THEN v / total ELSE 1.0 / n END, 6) AS share FROM s""")
def weight_hygiene(spark, sf):
    """GR6: weight hygiene."""
    by = Window.partitionBy("o")
    v = F.when(F.col("q") > 20, F.col("q")).otherwise(0.0)
    w = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("t"), F.col("l_quantity").alias("q")).withColumn("v", v)
    total, n = F.sum("v").over(by), F.count(F.lit(1)).over(by)
    return w.select("o", "i", "t", "q", F.round(F.when(total > 0, F.try_divide(F.col("v"), total)).otherwise(1.0 / n), 6).alias("share"))


@query("jn_phash_lookup", over("entries", "images", body="SELECT e.key, i.phash FROM images e JOIN (SELECT DISTINCT sha256, phash FROM images WHERE phash LIKE 'a%') i ON i.sha256 = e.sha256"))
def phash_lookup(spark, sf):
    """PF4, JN1: image signature by hash."""
    hit = D.images(spark, sf).where(F.col("phash").startswith("a")).select("sha256", "phash").distinct()
    return D.images(spark, sf).select("key", "sha256").join(hit, "sha256").select("key", "phash")


@query("jn_affinity_fallback", over("images", body="SELECT a.key, coalesce(b.v, a.height / 2000.0) AS affinity FROM images a LEFT JOIN (SELECT key, width / 4000.0 AS v FROM images WHERE phash IS NOT NULL AND width IS NOT NULL) b ON b.key = a.key"))
def affinity_fallback(spark, sf):
    """JN29: affinity lookup with fallback to the stored self value on any error."""
    i = D.images(spark, sf)
    known = i.where("phash is not null and width is not null").select("key", (F.col("width") / 4000.0).alias("v"))
    return i.select("key", "height").join(known, "key", "left").select("key", F.coalesce("v", F.col("height") / 2000.0).alias("affinity"))


@query("fd_dms", "SELECT c_custkey, round((c_custkey % 90 + (c_custkey * 7 % 60) / 60.0 + (c_custkey * 13 % 60) / 3600.0) * CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE -1 END, 6) AS degrees FROM customer")
def dms(spark, sf):
    """FD8: GPS degrees-minutes-seconds → decimal."""
    k = F.col("c_custkey")
    return D.table(spark, sf, "customer").select("c_custkey", F.round((k % 90 + (k * 7 % 60) / 60.0 + (k * 13 % 60) / 3600.0) * F.when(F.col("c_nationkey") % 2 == 0, 1).otherwise(-1), 6).alias("degrees"))


@query("ag_inventory_counts", over("files", body="""SELECT count(*) AS files, count(*) FILTER (lower(path) LIKE '%.jpg') AS photos, count(*) FILTER (lower(path) LIKE '%.nef' OR path LIKE '%.dng') AS raw,
 count(*) FILTER (regexp_matches(lower(path), '[.](xmp|json|txt|md)$')) AS sidecars, sum(length)::bigint AS bytes, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS folders FROM files"""))
def inventory_counts(spark, sf):
    """SC18, AG7, AG36: directory inventory scan."""
    p, s = F.col("path"), S.suffix(F.col("path"))
    return D.files(spark, sf).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(s == "jpg").alias("photos"), F.count_if(s.isin("nef", "dng")).alias("raw"), F.count_if(s.isin(*S.SIDECARS)).alias("sidecars"),
        F.sum("length").alias("bytes"), F.countDistinct(S.folder(p)).alias("folders"),
    )


@query("jn_latest_before", "SELECT e.event_id, o.o_orderkey AS newest FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts")
def latest_before(spark, sf):
    """The newest order of the event's user at the event's time: both sides in one sorted run per user."""
    o = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.max("o_orderkey").alias("known"))
    e = D.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    both = o.withColumn("event_id", F.lit(None).cast("long")).unionByName(e.withColumn("known", F.lit(None).cast("long")))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("newest", F.last("known", ignorenulls=True).over(w)).where("event_id is not null").select("event_id", "newest")
