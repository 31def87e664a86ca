"""Scans, journals, latest-per-key views, diffs and counts over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.operators.latest import assert_reference, assert_unique, clamped_replay, folded, latest, nth_latest, numbered, upserted
from tessella.operators.ordering import numbered_by
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


WALL = """--more score AS (SELECT entry_id, max_by(aesthetic_quality, id) AS score FROM analyses WHERE status = 'ok' GROUP BY entry_id),
decided AS (SELECT entry_id, max_by(decision, id) AS decision FROM approvals GROUP BY entry_id),
hung AS (SELECT r.entry_id, count(*) AS n_hung FROM publishes p JOIN renders r ON p.sha = r.artifact_sha WHERE p.status = 'applied' AND r.entry_id IS NOT NULL GROUP BY r.entry_id),
wall AS (SELECT e.id, e.asset_id, regexp_replace(e.asset_id, '/[^/]*$', '') AS folder, s.score, coalesce(d.decision, 'pending') AS decision, coalesce(h.n_hung, 0) AS n_hung
  FROM entries e LEFT JOIN score s ON e.id = s.entry_id LEFT JOIN decided d ON e.id = d.entry_id LEFT JOIN hung h ON e.id = h.entry_id)
"""


def wall(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry with its latest score and decision and how often it hangs."""
    scored = D.analyses(spark, sf, placed=True).where("status = 'ok'").select("entry_id", "id", "at", F.col("aesthetic_quality").alias("score"))
    scores = latest(scored, ["entry_id"], "id", "at").drop("id")
    decided = latest(D.approvals(spark, sf, placed=True).select("entry_id", "id", "at", "decision"), ["entry_id"], "id", "at").drop("id")
    # the hung list is m:n: each journal row counts once per render of its hash
    applied = D.publishes(spark, sf).where("status = 'applied'").groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    hung = D.renders(spark, sf).where("entry_id is not null").join(applied, F.col("artifact_sha") == F.col("sha")).groupBy("entry_id").agg(F.sum("n").alias("n_hung"))
    e = D.entries(spark, sf).select("id", "asset_id", S.folder(F.col("asset_id")).alias("folder"))
    out = e
    for side in (scores, decided, hung):
        out = out.join(side.withColumnRenamed("entry_id", "id"), "id", "left")
    return out.select("id", "asset_id", "folder", "score", F.coalesce("decision", F.lit("pending")).alias("decision"), F.coalesce("n_hung", F.lit(0)).alias("n_hung"))


@query("sl_wall_order", over("entries", "analyses", "approvals", "publishes", "renders", body=WALL + "SELECT row_number() OVER (ORDER BY coalesce(score, -1.0) DESC, asset_id, id) AS place, * FROM wall"))
def wall_order(spark, sf):
    """SL1: all entries by falling score, those without one last, then by name."""
    return numbered_by(wall(spark, sf), F.coalesce("score", F.lit(-1.0)).desc(), F.asc_nulls_last("asset_id"), F.asc_nulls_last("id"))


@query("jn_wall_state", over("entries", "analyses", "approvals", "publishes", "renders", body=WALL + "SELECT * FROM wall"))
def wall_state(spark, sf):
    """PF11, JN5, JN14: grid filter all or decision equality, in the page."""
    return wall(spark, sf)


@query("ag_wall_counts", over("entries", "analyses", "approvals", "publishes", "renders", body=WALL + """SELECT count(*) AS loaded, count(score) AS scored,
 count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (n_hung > 0) AS hung FROM wall"""))
def wall_counts(spark, sf):
    """AG5: conditional counts."""
    return wall(spark, sf).agg(
        F.count(F.lit(1)).alias("loaded"), F.count("score").alias("scored"), F.count_if(F.col("decision") == "approved").alias("approved"),
        F.count_if(F.col("decision") == "rejected").alias("rejected"), F.count_if(F.col("n_hung") > 0).alias("hung"),
    )


@query("st_folders", over("entries", body="SELECT DISTINCT regexp_replace(asset_id, '/[^/]*$', '') AS folder FROM entries"))
def folders(spark, sf):
    """ST9: distinct folders, sorted."""
    return D.entries(spark, sf).select(S.folder(F.col("asset_id")).alias("folder")).distinct()


@query("pf_by_source_newest", over("entries", body="SELECT connector_id, asset_id, max(id) AS id, max_by(sha256, id) AS sha256, max_by(revision, id) AS revision FROM entries GROUP BY ALL"))
def by_source(spark, sf):
    """SC25, PF1, PF5: full catalog scan, id order."""
    return latest(D.entries(spark, sf).select("connector_id", "asset_id", "id", "sha256", "revision"), ["connector_id", "asset_id"], "id")


@query("pf_by_hash", over("entries", body="SELECT sha256, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM entries GROUP BY sha256 HAVING count(*) > 1"))
def by_hash(spark, sf):
    """PF2: all entries of one hash."""
    return D.entries(spark, sf).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


@query("pf_by_cluster", over("entries", body="SELECT id, asset_id, revision FROM entries WHERE cluster_id = 'cl-7'"))
def by_cluster(spark, sf):
    """PF3: all entries of one cluster."""
    return D.entries(spark, sf).where("cluster_id = 'cl-7'").select("id", "asset_id", "revision")


@query("pf_latest_ok_analysis", over("analyses", body="SELECT entry_id, max(id) AS id, max_by(technical_quality, id) AS technical_quality, max_by(harmony, id) AS harmony FROM analyses WHERE status = 'ok' GROUP BY entry_id"))
def latest_ok(spark, sf):
    """PF6, JN2: newest ok analysis of one entry."""
    return latest(D.analyses(spark, sf, placed=True).where("status = 'ok'").select("entry_id", "id", "at", "technical_quality", "harmony"), ["entry_id"], "id", "at")


@query("jn_vote_candidates", over("entries", "analyses", body="""SELECT e.id, coalesce(e.quality_score, 0.0) AS baseline, a.aesthetic_quality FROM entries e
 JOIN (SELECT entry_id, max_by(aesthetic_quality, id) AS aesthetic_quality FROM analyses WHERE status = 'ok' GROUP BY entry_id) a ON a.entry_id = e.id"""))
def vote_candidates(spark, sf):
    """JN6: three-way."""
    a = latest(D.analyses(spark, sf, placed=True).where("status = 'ok'").select("entry_id", "id", "at", "aesthetic_quality"), ["entry_id"], "id", "at").select(F.col("entry_id").alias("id"), "aesthetic_quality")
    return D.entries(spark, sf).join(a, "id").select("id", F.coalesce("quality_score", F.lit(0.0)).alias("baseline"), "aesthetic_quality")


@query("jn_unscored", over("entries", "analyses", body="SELECT id, asset_id FROM entries WHERE id NOT IN (SELECT entry_id FROM analyses WHERE status = 'ok')"))
def unscored(spark, sf):
    """JN9: anti-join."""
    ok = D.analyses(spark, sf).where("status = 'ok'").select(F.col("entry_id").alias("id"))
    return D.entries(spark, sf).join(ok, "id", "left_anti").select("id", "asset_id")


@query("jn_hung_artifacts", over("publishes", "renders", body="""SELECT r.entry_id, p.adapter_id, count(*) AS n, max(p.id) AS last_id FROM publishes p JOIN renders r ON p.sha = r.artifact_sha
 WHERE p.status = 'applied' AND r.entry_id IS NOT NULL GROUP BY ALL"""))
def hung_artifacts(spark, sf):
    """JN7: inner join publish journal ⋈ renders on artifact sha, applied, entry not null."""
    # one journal row hangs once per render with its hash: count the journal before the m:n join
    per = D.publishes(spark, sf).where("status = 'applied'").groupBy("sha", "adapter_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    rows = D.renders(spark, sf).where("entry_id is not null").select(F.col("artifact_sha").alias("sha"), "entry_id").join(per, "sha")
    return rows.groupBy("entry_id", "adapter_id").agg(F.sum("n").alias("n"), F.max("last").alias("last_id"))


@query("jn_scan_diff", over("entries", "remote", body="""--more newest AS (SELECT asset_id, max_by(sha256, id) AS sha, max_by(connector_id, id) AS c FROM entries GROUP BY asset_id),
 source AS (SELECT 'dir' || (s % 17) || '/img' || s || '.jpg' AS asset_id, sha256('s' || ((s * 5 + s % 3) % 4001)) AS sha FROM (SELECT c_custkey AS s FROM customer WHERE c_custkey % 4 <> 0))
 SELECT coalesce(s.asset_id, n.asset_id) AS asset_id, CASE WHEN n.asset_id IS NULL THEN 'new' WHEN s.asset_id IS NULL THEN 'missing' ELSE 'changed' END AS state
 FROM source s FULL JOIN newest n ON s.asset_id = n.asset_id WHERE n.asset_id IS NULL OR s.asset_id IS NULL OR s.sha <> n.sha"""))
def scan_diff(spark, sf):
    """JN13, ST1: full-outer diff."""
    newest = D.entries(spark, sf).groupBy("asset_id").agg(F.max_by("sha256", "id").alias("known"))
    key = F.col("c_custkey")
    source = D.table(spark, sf, "customer").where(key % 4 != 0).select(
        F.concat(F.lit("dir"), key % 17, F.lit("/img"), key, F.lit(".jpg")).alias("asset_id"),
        F.sha2(F.concat(F.lit("s"), (key * 5 + key % 3) % 4001).cast("binary"), 256).alias("seen"),
    )
    state = F.when(F.col("known").isNull(), "new").when(F.col("seen").isNull(), "missing").when(F.col("seen") != F.col("known"), "changed")
    return source.join(newest, "asset_id", "full_outer").select("asset_id", state.alias("state")).where("state is not null")


@query("jn_tombstones", over("entries", "remote", body="""SELECT s.asset_id FROM remote s WHERE NOT s.available AND s.asset_id NOT IN (SELECT asset_id FROM remote WHERE revision = 'r1')"""))
def tombstones(spark, sf):
    """JN12: anti-join."""
    r = D.remote(spark, sf)
    seen, open_now = r.where("revision = 'r1'").select("asset_id"), r.where("available").select("asset_id")
    return r.select("asset_id").join(seen, "asset_id", "left_anti").join(open_now, "asset_id", "left_anti")


@query("jn_semi_exists", over("entries", "images", body="SELECT count(*) AS n FROM entries WHERE sha256 IN (SELECT sha256('s' || p_partkey) FROM part)"))
def semi_exists(spark, sf):
    """JN15, JN26: key-list semi-join id IN."""
    known = D.table(spark, sf, "part").select(F.sha2(F.concat(F.lit("s"), "p_partkey").cast("binary"), 256).alias("sha256"))
    return D.entries(spark, sf).join(known, "sha256", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("ag_status", over("entries", body="SELECT count(*) AS entries, count(DISTINCT cluster_id) AS clusters, count(DISTINCT sha256) AS contents FROM entries"))
def status(spark, sf):
    """AG1, AG2, AG35: counts of entries and clusters."""
    return D.entries(spark, sf).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("cluster_id").alias("clusters"), F.countDistinct("sha256").alias("contents"))


@query("ag_cluster_kinds", over("entries", body="""SELECT kind, count(*) AS clusters, sum(n)::bigint AS members FROM (SELECT cluster_id, count(*) AS n,
 CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT sha256) = 1 THEN 'exact' ELSE 'near' END AS kind FROM entries WHERE cluster_id IS NOT NULL GROUP BY cluster_id) GROUP BY kind"""))
def cluster_kinds(spark, sf):
    """AG6: ingest counters by status and cluster kind."""
    per = D.entries(spark, sf).where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sha256").alias("d"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("d") == 1, "exact").otherwise("near")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("members"))


@query("ag_states", over("publishes", body="SELECT status, adapter_id, count(*) AS n FROM publishes GROUP BY ALL"))
def states(spark, sf):
    """AG4: count by state."""
    return D.publishes(spark, sf).groupBy("status", "adapter_id").agg(F.count(F.lit(1)).alias("n"))


@query("wn_history", over("approvals", body="SELECT entry_id, id, decision, row_number() OVER (PARTITION BY entry_id ORDER BY id) AS seq FROM approvals"))
def history(spark, sf):
    """SK15, WN1: approval append."""
    return numbered(D.approvals(spark, sf).select("entry_id", "id", "decision"), ["entry_id"], "id")


@query("wn_current", over("approvals", body="SELECT entry_id, max(id) AS id, max_by(decision, id) AS decision FROM approvals GROUP BY entry_id"))
def current(spark, sf):
    """JN3, AG3, WN2: same latest-per-key for approvals."""
    return latest(D.approvals(spark, sf).select("entry_id", "id", "decision"), ["entry_id"], "id")


@query("wn_undo", over("approvals", body="SELECT entry_id, CASE WHEN max_by(decision, id) = 'approved' THEN 'rejected' ELSE 'approved' END AS decision FROM approvals GROUP BY entry_id"))
def undo(spark, sf):
    """WN3: undo = flip of latest."""
    now = latest(D.approvals(spark, sf).select("entry_id", "id", "decision"), ["entry_id"], "id")
    return now.select("entry_id", F.when(F.col("decision") == "approved", "rejected").otherwise("approved").alias("decision"))


@query("wn_redo", over("approvals", body="SELECT entry_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY id DESC) AS n FROM approvals) WHERE n = 2"))
def redo(spark, sf):
    """WN4: redo = second-latest decision."""
    return nth_latest(D.approvals(spark, sf), ["entry_id"], "id", 2).select("entry_id", "decision")


@query("wn_newest_publish", over("publishes", body="""SELECT artifact_id, adapter_id, max(id) AS id, max_by(status, id) AS status, max_by(sha, id) AS sha,
 max_by(status, id) = 'applied' AS already_applied FROM publishes GROUP BY ALL"""))
def newest_publish(spark, sf):
    """WN5, WN6: newest journal row per."""
    now = latest(D.publishes(spark, sf).select("artifact_id", "adapter_id", "id", "status", "sha"), ["artifact_id", "adapter_id"], "id")
    return now.withColumn("already_applied", F.col("status") == "applied")


@query("sk_publish_todo", over("publishes", "renders", body="""--more last AS (SELECT artifact_id, adapter_id, max_by(status, id) AS status, max_by(sha, id) AS sha FROM publishes GROUP BY ALL)
 SELECT w.artifact_id, w.adapter_id, w.sha FROM (SELECT DISTINCT 'a' || p_partkey AS artifact_id, 'd' || (p_partkey % 4) AS adapter_id, 'h' || (p_partkey % 50) || '-1' AS sha FROM part) w
 LEFT JOIN last l ON l.artifact_id = w.artifact_id AND l.adapter_id = w.adapter_id AND l.status = 'applied' AND l.sha = w.sha WHERE l.artifact_id IS NULL"""))
def publish_todo(spark, sf):
    """SK28: idempotent journalled publish."""
    last = latest(D.publishes(spark, sf).select("artifact_id", "adapter_id", "id", "status", "sha"), ["artifact_id", "adapter_id"], "id")
    key = F.col("p_partkey")
    wanted = D.table(spark, sf, "part").select(
        F.concat(F.lit("a"), key).alias("artifact_id"), F.concat(F.lit("d"), key % 4).alias("adapter_id"), F.concat(F.lit("h"), key % 50, F.lit("-1")).alias("sha")
    ).distinct()
    return wanted.join(last.where("status = 'applied'"), ["artifact_id", "adapter_id", "sha"], "left_anti")


@query("sk_journal_fold", over("publishes", body="""SELECT artifact_id, max_by(status, id) AS status, max_by(CASE WHEN status <> 'error' THEN sha END, CASE WHEN status <> 'error' THEN id END) AS sha
 FROM publishes GROUP BY artifact_id"""))
def journal_fold(spark, sf):
    """SK7, PF9: journal transition with COALESCE."""
    log = D.publishes(spark, sf).select("artifact_id", "id", "status", F.when(F.col("status") != "error", F.col("sha")).alias("sha"))
    return folded(log, ["artifact_id"], "id", ["status", "sha"])


@query("sk_upsert", over("remote", body="""SELECT asset_id, star, 'kept' AS origin FROM remote WHERE star < 3 AND NOT (star >= 2 AND available)
 UNION ALL SELECT asset_id, star + 10, 'new' FROM remote WHERE star >= 2 AND available"""))
def upsert(spark, sf):
    """SK3: catalog upsert."""
    r = D.remote(spark, sf)
    old = r.where("star < 3").select("asset_id", "star", F.lit("kept").alias("origin"), F.lit(0).alias("seq"))
    new = r.where("star >= 2 and available").select("asset_id", (F.col("star") + 10).alias("star"), F.lit("new").alias("origin"), F.lit(1).alias("seq"))
    return upserted(old, new, ["asset_id"], "seq").drop("seq")


@query("sk_blob_store", over("images", body="SELECT sha256, count(*) AS offered, 'blobs/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 AS blob_path FROM images GROUP BY sha256"))
def blob_store(spark, sf):
    """SK1, FS20: content-addressed blob put."""
    return D.images(spark, sf).groupBy("sha256").agg(F.count(F.lit(1)).alias("offered")).withColumn(
        "blob_path", F.concat_ws("/", F.lit("blobs"), F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), "sha256")
    )


@query("constraint_unique", over("entries", body="SELECT sha256, connector_id, count(*) AS n FROM entries GROUP BY ALL HAVING count(*) > 1"))
def unique(spark, sf):
    """The keys of entries that stand more than once, which a unique constraint would refuse."""
    return assert_unique(D.entries(spark, sf), ["sha256", "connector_id"])


@query("constraint_reference", over("analyses", "entries", body="SELECT entry_id, id FROM (SELECT entry_id + 1000 AS entry_id, id FROM analyses) WHERE entry_id NOT IN (SELECT id FROM entries)"))
def reference(spark, sf):
    """The analyses whose entry does not exist, which a reference would refuse."""
    a = D.analyses(spark, sf).select((F.col("entry_id") + 1000).alias("entry_id"), "id")
    return assert_reference(a, "entry_id", D.entries(spark, sf), "id")


MEDIA_SQL, RAW_SQL = (", ".join(f"'{s}'" for s in suffixes) for suffixes in (S.MEDIA, S.RAW))


@query("sc_local_scan", over("files", body="""--more f AS (SELECT path, length, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS suffix FROM files)
 SELECT path, length, suffix, CASE WHEN suffix IN (""" + RAW_SQL + """) THEN 'unsupported' ELSE 'ok' END AS status FROM f
 WHERE suffix IN (""" + RAW_SQL + ", " + MEDIA_SQL + """) AND path > 'lib/brand1'"""))
def local_scan(spark, sf):
    """SC1, SC2, SC3: recursive local file scan, sorted by path, media + RAW suffixes only, resumable with path > cursor."""
    f = D.files(spark, sf).withColumn("suffix", S.suffix(F.col("path"))).where(F.col("suffix").isin(*S.MEDIA, *S.RAW) & (F.col("path") > "lib/brand1"))
    return f.select("path", "length", "suffix", F.when(F.col("suffix").isin(*S.RAW), "unsupported").otherwise("ok").alias("status"))


@query("sc_name_collisions", over("files", body="SELECT regexp_extract(path, '[^/]*$') AS name, count(*) AS n, min(path) AS first_path FROM files GROUP BY 1 HAVING count(*) > 1"))
def name_collisions(spark, sf):
    """AG9: name-collision groups."""
    return D.files(spark, sf).groupBy(S.basename(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


@query("sc_legacy_categories", over("files", body="""--more c AS (SELECT unnest(list_filter([CASE WHEN path LIKE '%.json' THEN 'document' END, CASE WHEN length % 3000 = 0 THEN 'panel' END,
 CASE WHEN lower(path) LIKE '%.jpg' THEN 'photo' END, CASE WHEN lower(path) LIKE '%.nef' OR path LIKE '%.dng' THEN 'raw' END], lambda x: x IS NOT NULL)) AS category FROM files)
 SELECT k.category, count(c.category) AS n FROM (SELECT unnest(['document', 'panel', 'photo', 'raw', 'sidecar']) AS category) k LEFT JOIN c ON c.category = k.category GROUP BY k.category"""))
def legacy_categories(spark, sf):
    """SC19, AG10: legacy-folder scan into five overlapping categories."""
    p = F.lower("path")
    found = F.array_compact(F.array(
        F.when(F.col("path").endswith(".json"), "document"), F.when(F.col("length") % 3000 == 0, "panel"), F.when(p.endswith(".jpg"), "photo"),
        F.when(p.endswith(".nef") | F.col("path").endswith(".dng"), "raw"),
    ))
    counts = D.files(spark, sf).select(F.explode(found).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(c,) for c in ("document", "panel", "photo", "raw", "sidecar")], "category string")
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


@query("sc_browse_page", over("remote", body="""--more page AS (SELECT * FROM remote WHERE available AND asset_id > 'a-00000100' AND list_has_all(tags, ['BUILDING']) ORDER BY asset_id LIMIT 26)
 SELECT asset_id, star, (SELECT CASE WHEN count(*) = 26 THEN max(asset_id) FILTER (asset_id <> (SELECT max(asset_id) FROM page)) END FROM page) AS next_cursor FROM page ORDER BY asset_id LIMIT 25"""))
def browse_page(spark, sf):
    """SC9, SC12, SC14: in-memory remote source."""
    want, size = ["BUILDING"], 25
    hit = D.remote(spark, sf).where(F.col("available") & (F.col("asset_id") > "a-00000100") & (F.size(F.array_except(F.array(*map(F.lit, want)), "tags")) == 0))
    page = hit.orderBy("asset_id").limit(size + 1).select("asset_id", "star")
    w = Window.orderBy("asset_id")
    all_of = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = page.withColumn("n", F.row_number().over(w))
    cursor = F.when(F.max("n").over(all_of) > size, F.max(F.when(F.col("n") <= size, F.col("asset_id"))).over(all_of))
    return placed.withColumn("next_cursor", cursor).where(F.col("n") <= size).drop("n")


@query("sc_smart_search", over("remote", body="SELECT asset_id FROM remote WHERE contains(lower(asset_id), 'n1') OR len(list_filter(tags, lambda x: contains(lower(x), 'n1'))) > 0"))
def smart_search(spark, sf):
    """SC13: smart search."""
    return D.remote(spark, sf).where(F.contains(F.lower("asset_id"), F.lit("n1")) | F.exists("tags", lambda x: F.contains(F.lower(x), F.lit("n1")))).select("asset_id")


@query("sc_revision_history", over("entries", body="SELECT asset_id, revision, 'r' || row_number() OVER (PARTITION BY asset_id ORDER BY id) || CASE WHEN quality_score IS NULL THEN '-tomb' ELSE '' END AS token FROM entries"))
def revision_history(spark, sf):
    """SC10, SC11: append-only upsert/tombstone of the remote fixture, revision r{n} / r{n}-tomb."""
    n = numbered(D.entries(spark, sf), ["asset_id"], "id")
    return n.select("asset_id", "revision", F.concat(F.lit("r"), "seq", F.when(F.col("quality_score").isNull(), "-tomb").otherwise("")).alias("token"))


@query("sc_vectors_by_label", over("vectors", body="SELECT label, count(*) AS n, min(id) AS first_id, max(len(vector)) AS dim FROM vectors GROUP BY label"))
def vectors_by_label(spark, sf):
    """SC26: vector matrix scan of one model version, sha order, BLOB → float32[]."""
    return D.vectors(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max(F.size("vector").cast("long")).alias("dim"))


@query("fs_paths", over("files", body="""SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS folder, substr(path, 5) AS relative,
 regexp_extract(path, '(\\d{4})[-_]?(\\d{2})[-_]?(\\d{2})', 1) || '-' || regexp_extract(path, '(\\d{4})[-_]?(\\d{2})[-_]?(\\d{2})', 2) || '-' || regexp_extract(path, '(\\d{4})[-_]?(\\d{2})[-_]?(\\d{2})', 3) AS taken FROM files"""))
def paths(spark, sf):
    """FS8, FS10, FS11: date in file name."""
    p = F.col("path")
    return D.files(spark, sf).select("path", S.basename(p).alias("name"), S.folder(p).alias("folder"), F.substring(p, 5, 1 << 20).alias("relative"), S.filename_date(p).alias("taken"))


@query("fs_job_keys", over("remote", body="SELECT asset_id, 'sync:{\"asset\":\"' || asset_id || '\",\"rev\":\"' || revision || '\"}' AS key FROM remote"))
def job_keys(spark, sf):
    """FS13: canonical idempotency key kind."""
    return D.remote(spark, sf).select("asset_id", F.concat(F.lit("sync:"), F.to_json(F.struct(F.col("asset_id").alias("asset"), F.col("revision").alias("rev")))).alias("key"))


@query("fs_json_keys", "SELECT event_id, props::json->>'k' AS k, len(json_keys(props)) AS n_keys FROM events")
def json_keys(spark, sf):
    """FS19: key set of a JSON object, lower-cased."""
    return D.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("ss_job_fold", over("publishes", body="""SELECT artifact_id, count(*) FILTER (status = 'staged') AS attempts, max_by(status, id) AS state,
 max_by(CASE WHEN status = 'applied' THEN sha END, CASE WHEN status = 'applied' THEN id END) AS known_good FROM publishes GROUP BY artifact_id"""))
def job_fold(spark, sf):
    """SS13: known-good result per phase, highest phase name when none given."""
    good = F.col("status") == "applied"
    return D.publishes(spark, sf).groupBy("artifact_id").agg(
        F.count_if(F.col("status") == "staged").alias("attempts"), F.max_by("status", "id").alias("state"), F.max_by(F.when(good, F.col("sha")), F.when(good, F.col("id"))).alias("known_good")
    )


@query("ss_enqueue", over("entries", "remote", body="SELECT DISTINCT asset_id, revision FROM remote WHERE available AND revision NOT IN ('r1', 'r2') AND asset_id NOT IN (SELECT asset_id FROM remote WHERE star = 5)"))
def enqueue(spark, sf):
    """SS3: idempotent enqueue."""
    r = D.remote(spark, sf)
    live, done = r.where("star = 5").select("asset_id"), spark.createDataFrame([("r1",), ("r2",)], "revision string")
    return r.where("available").select("asset_id", "revision").dropDuplicates(["asset_id", "revision"]).join(live, "asset_id", "left_anti").join(F.broadcast(done), "revision", "left_anti")


@query("ss_ingest_resume", over("files", "publishes", body="SELECT path FROM files WHERE 'a' || (length // 1000) NOT IN (SELECT artifact_id FROM publishes WHERE status = 'applied')"))
def ingest_resume(spark, sf):
    """SS14: ingest resume from journal."""
    done = D.publishes(spark, sf).where("status = 'applied'").select("artifact_id")
    return D.files(spark, sf).withColumn("artifact_id", F.concat(F.lit("a"), F.floor(F.col("length") / 1000))).join(done, "artifact_id", "left_anti").select("path")


@query("fd_schedule", "SELECT event_id, isodow(ts) - 1 IN (0, 2, 4, 5) AND hour(ts) + minute(ts) / 60 + second(ts) / 3600 >= 8 AND hour(ts) + minute(ts) / 60 + second(ts) / 3600 < 20 AND month(ts) BETWEEN 1 AND 3 AS open FROM events")
def schedule(spark, sf):
    """PF17: schedule window predicate."""
    return D.table(spark, sf, "events").select("event_id", S.schedule_open(F.col("ts"), [0, 2, 4, 5], (8, 20), (1, 3)).alias("open"))


@query("fd_interval_elapsed", "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) >= 3600::bigint * 1000000, true) AS elapsed FROM events")
def interval_elapsed(spark, sf):
    """FD4: rotation interval elapsed."""
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return D.table(spark, sf, "events").select("event_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp")) >= 3600 * 1000000, F.lit(True)).alias("elapsed"))


@query("fd_proximity", "SELECT o_orderkey, round(greatest(0, 1 - least(abs(epoch_us(o_orderdate) - epoch_us(timestamp '1998-06-01')) / 86400e6 / 30, 1)), 6) AS near FROM orders")
def proximity(spark, sf):
    """FD3: date proximity."""
    return D.table(spark, sf, "orders").select("o_orderkey", F.round(S.date_proximity(F.col("o_orderdate"), F.lit("1998-06-01").cast("timestamp")), 6).alias("near"))
