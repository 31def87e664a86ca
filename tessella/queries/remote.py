"""The remote library: paged reads, browse filters and incremental sync through the data source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.plans.materialise import shared_dir
from tessella.sources import connector
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


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tessella/remote-{uuid.uuid4().hex}"


@query("sc_connector_read", over("listing", body="SELECT asset_id, revision, checksum, size_bytes, favorite, star, array_to_string(tags, ',') AS tags, date FROM listing WHERE available"))
def connector_read(spark, sf):
    """SC8, SC9, SC15: all available assets of the remote, read in pages of each key range by the data
    source, with favourite mark, star, tags and date in ``extra``."""
    at = _folder(spark)
    connector.publish_listing(D.listing(spark, sf), at)
    return connector.browse(spark, at).select("asset_id", "revision", "checksum", "size_bytes", "extra.favorite", "extra.star", F.array_join("extra.tags", ",").alias("tags"), "extra.date")


@query("sc_connector_browse", over("listing", body="""SELECT asset_id, star FROM listing WHERE available AND favorite AND star >= 2 AND list_contains(tags, 'BUILDING')
 AND (date IS NULL OR date >= '1995-02-01') AND (date IS NULL OR date <= '1996-06-30') AND asset_id > 'a-19950110'"""))
def connector_browse(spark, sf):
    """SC14, SC12: what the remote's filter gives after a cursor: favourite, least star, required tags,
    and a range of dates that an unknown date passes."""
    at = _folder(spark)
    connector.publish_listing(D.listing(spark, sf), at)
    found = connector.browse(spark, at, favorite="true", star="2", tags='["BUILDING"]', since="1995-02-01", until="1996-06-30")
    return found.where("asset_id > 'a-19950110'").select("asset_id", "extra.star")


#: A remote as it was: what had come by then, with more of it available.
EARLIER = "1996-01-01"


@query("ss_connector_sync", over("listing", body=f"""--more before AS (SELECT * REPLACE (balance > -500 AS available, 'r' || (length(tags[1]) % 5) AS revision) FROM listing WHERE day < '{EARLIER}'),
seen AS (SELECT asset_id, revision, 1 AS run FROM before WHERE available), cursor AS (SELECT coalesce(max(asset_id), '') AS last_id FROM before),
later AS (SELECT asset_id, revision, 2 AS run FROM listing, cursor WHERE available AND asset_id > last_id), known AS (SELECT * FROM seen UNION ALL SELECT * FROM later)
SELECT k.asset_id, k.revision, l.available, CASE WHEN l.available THEN k.run ELSE 2 END AS run FROM known k JOIN listing l USING (asset_id)"""))
def connector_sync(spark, sf):
    """SS8, SC8, SK29: two syncs of a remote that grows and loses assets in between. The second starts at the
    cursor, so that changed revisions of old assets stay unseen; assets that are gone are marked."""
    at, store = _folder(spark), _folder(spark)
    now = D.listing(spark, sf)
    before = now.where(F.col("day") < EARLIER).withColumns({"available": F.col("balance") > -500, "revision": F.concat(F.lit("r"), F.length(F.element_at("tags", 1)) % 5)})
    for run, listing in ((1, before), (2, now)):
        connector.publish_listing(listing, at)
        connector.sync(spark, at, store, run)
    return connector.state(spark, store).select("asset_id", "revision", "available", "run")
