"""Journals that are written and folded again: votes, consolidation, profile versions; and lookups that fail
where something is missing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.operators import stores, strict
from tessella.operators.latest import numbered
from tessella.operators.ordering import placed_within
from tessella.plans.materialise import shared_dir
from tessella.queries.catalog import WALL, wall
from tessella.queries.taste import LATEST_SIGNALS, signals, votes_of, weights_of
from tessella.queries.taste import ORACLE as TASTE_SQL
from tessella.sources import derived as D
from tessella.sources.derived import with_tables as over
from tessella.streaming import consolidate as moves

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _store(spark, name):
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


@query("sk_vote_record", f"SELECT 'personal' AS uid, signal, weight, version, 2 AS saved FROM ({TASTE_SQL['ag_vote_replay']})")
def vote_record(spark, sf):
    """SK13, SK14, AG21: votes added to the stored journal in two runs, each of which rebuilds the profile from all
    that is stored and saves it in place of the last."""
    p, store, profiles = D.preferences(spark, sf), _store(spark, "votes"), _store(spark, "profiles")
    cut = F.lit("2024-01-15").cast("timestamp")
    for run, rows in ((1, p.where(F.col("created_at").cast("timestamp") < cut)), (2, p)):
        stores.add_new(rows, store, ["id"])
        rebuilt = weights_of(votes_of(stores.stored(spark, store)), signals(spark, sf))
        saved = rebuilt.select(F.lit("personal").alias("uid"), "signal", F.round("weight", 6).alias("weight"), "version", F.lit(run).alias("saved"))
        stores.replace_groups(saved, profiles, "uid")
    return stores.stored(spark, profiles)


@query("ss_consolidate", """SELECT doc_id::varchar AS asset_id, 'promoted' AS status, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS staged, CASE lang WHEN 'en' THEN 1 ELSE 3 END AS promoted,
 (SELECT count(DISTINCT coalesce(text, '')) FROM documents) AS library FROM documents""")
def consolidate(spark, sf):
    """SS15, SS16, SK28: texts consolidated by content: one run that ends well, one that ends when its files are
    staged, and one over all that skips, resumes and stages; the library holds each content once."""
    docs, root = D.table(spark, sf, "documents"), _store(spark, "consolidated")
    files = docs.select(F.col("doc_id").cast("string").alias("asset_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "lang")
    moves.consolidate(files.where("lang = 'en'").drop("lang"), root, 1)
    moves.consolidate(files.where("lang = 'de'").drop("lang"), root, 2, until="staged")
    moves.consolidate(files.drop("lang"), root, 3)
    log = moves.journal(spark, root).groupBy("asset_id").agg(
        F.max_by("status", F.struct("run", "step")).alias("status"), F.min(F.when(F.col("status") == "staged", F.col("run"))).alias("staged"), F.min(F.when(F.col("status") == "promoted", F.col("run"))).alias("promoted")
    )
    held = stores.stored(spark, f"{root}/library").agg(F.count(F.lit(1)).alias("library"))
    return log.join(F.broadcast(held))


@query("ss_profile_history", over("approvals", body="""--more v AS (SELECT entry_id, id, decision, row_number() OVER (PARTITION BY entry_id ORDER BY id) AS version FROM approvals),
 h AS (SELECT entry_id, max(version) FILTER (decision = 'approved') AS head, count(*) FILTER (decision = 'approved') AS n FROM v GROUP BY entry_id)
 SELECT h.entry_id, coalesce(head, 0) AS head, CASE WHEN n < 2 THEN 'nothing to undo' WHEN v.id IS NULL THEN 'no snapshot at version ' || (head - 1) END AS error, CASE WHEN n >= 2 THEN v.id END AS undone
 FROM h LEFT JOIN v ON v.entry_id = h.entry_id AND v.version = h.head - 1 AND v.decision = 'approved'"""))
def profile_history(spark, sf):
    """SS21: snapshots by version, of which the rejected ones are deleted; undo is the version before the newest,
    an error where that was deleted or where there are fewer than two."""
    v = numbered(D.approvals(spark, sf).select("entry_id", "id", "decision"), ["entry_id"], "id", "version").withColumn("kept", F.col("decision") == "approved")
    head = F.max(F.when(F.col("kept"), F.col("version"))).alias("head")
    ids = F.map_from_entries(F.collect_list(F.when(F.col("kept"), F.struct("version", "id")))).alias("ids")
    h = v.groupBy("entry_id").agg(head, F.count_if("kept").alias("n"), ids)
    before = F.when(F.col("n") >= 2, F.try_element_at("ids", (F.col("head") - 1).cast("int")))
    error = F.when(F.col("n") < 2, "nothing to undo").when(before.isNull(), F.concat(F.lit("no snapshot at version "), F.col("head") - 1))
    return h.select("entry_id", F.coalesce("head", F.lit(0)).cast("long").alias("head"), error.alias("error"), before.alias("undone"))


@query("pf_hash_entries", over("entries", body="SELECT DISTINCT e.sha256, e.id, e.asset_id FROM entries e JOIN part ON e.sha256 = sha256('s' || p_partkey)"))
def hash_entries(spark, sf):
    """PF2, JN15: all entries of the asked hashes."""
    asked = D.table(spark, sf, "part").select(F.sha2(F.concat(F.lit("s"), "p_partkey").cast("binary"), 256).alias("sha256"))
    return D.entries(spark, sf).select("sha256", "id", "asset_id").join(asked, "sha256", "left_semi")


@query("pf_grid", over("entries", "analyses", "approvals", "publishes", "renders", body=WALL + "SELECT id, decision FROM wall WHERE decision = 'approved'"))
def grid(spark, sf, decision="approved"):
    """PF11: the grid's filter: all, or the entries whose decision is the asked one."""
    rows = wall(spark, sf).select("id", "decision")
    return rows if decision == "all" else rows.where(F.col("decision") == decision)


@query("jn_strict_lookup", over("entries", body="SELECT l_partkey * 100000 + l_linenumber * 1000 + l_quantity::bigint AS place, l_orderkey AS id, asset_id FROM lineitem JOIN entries ON id = l_orderkey"))
def strict_lookup(spark, sf):
    """JN16, PF5: the entries that a list of ids names, each with its place in it; an id that is not there fails."""
    place = F.col("l_partkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long")
    asked = D.table(spark, sf, "lineitem").select(place.alias("place"), F.col("l_orderkey").alias("id"))
    return strict.looked_up(asked, D.entries(spark, sf).select("id", "asset_id"), "id", "place", "entry").select("place", "id", "asset_id")


@query("sc_asset_history", over("entries", body="SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY id) AS seq, revision, 'r' || row_number() OVER (PARTITION BY asset_id ORDER BY id) || CASE WHEN quality_score IS NULL THEN '-tomb' ELSE '' END AS token FROM entries WHERE connector_id = 'c1'"))
def asset_history(spark, sf):
    """SC11, SC10: every observation of the assets of one connector, in order; an unknown asset fails."""
    e = D.entries(spark, sf).select("asset_id", "id", "revision", "connector_id", F.col("quality_score").isNull().alias("gone"))
    h = strict.history(e.drop("connector_id"), e.where("connector_id = 'c1'"), "asset_id", "id", "asset")
    return h.select("asset_id", "seq", "revision", F.concat(F.lit("r"), "seq", F.when(F.col("gone"), "-tomb").otherwise("")).alias("token"))


@query("st_veto_drop", over("analyses", body="--more " + LATEST_SIGNALS + " SELECT entry_id, row_number() OVER (PARTITION BY entry_id % 10 ORDER BY entry_id) AS place FROM latest WHERE NOT harmony > 0.5"))
def veto_drop(spark, sf):
    """ST12: vetoed candidates dropped, the others in their order."""
    s = signals(spark, sf).where("not harmony > 0.5").select("entry_id", (F.col("entry_id") % 10).alias("part"))
    return placed_within(s, ["part"], "entry_id").drop("part")
