"""Stores that are written and read back, and payloads whose unknown keys are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.operators import stores
from tessella.operators.ordering import placed_within
from tessella.plans.materialise import shared_dir
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


def _store(spark) -> str:
    return f"{shared_dir(spark)}/tessella/store-{uuid.uuid4().hex}"


@query("sk_put", "SELECT sha256(coalesce(text, '')) AS sha256, octet_length(encode(any_value(coalesce(text, ''))))::bigint AS n, CASE WHEN bool_or(lang = 'en') THEN 1 ELSE 2 END AS run FROM documents GROUP BY ALL")
def put(spark, sf):
    """SK1, SK2, FS20: texts stored by content, those of one language first and then all: what is there is not
    written again, so that each is stored once, by the run that first had it."""
    at, docs = _store(spark), D.table(spark, sf, "documents").select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    for run, rows in ((1, docs.where("lang = 'en'")), (2, docs)):
        stores.put_blobs(rows.select("content", F.lit(run).alias("run")), at)
    return stores.stored(spark, at).select("sha256", F.octet_length("content").cast("long").alias("n"), "run")


@query("sk_catalog_write", over("entries", body="""SELECT 'connector' AS kind, connector_id AS id, min(created_at >= TIMESTAMP '1998-01-01')::int + 1 AS run FROM entries GROUP BY ALL
 UNION ALL SELECT 'asset', connector_id || '/' || asset_id, min(created_at >= TIMESTAMP '1998-01-01')::int + 1 FROM entries GROUP BY ALL
 UNION ALL SELECT 'cluster', cluster_id, min(created_at >= TIMESTAMP '1998-01-01')::int + 1 FROM entries WHERE cluster_id IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'entry', id::varchar, (created_at >= TIMESTAMP '1998-01-01')::int + 1 FROM entries"""))
def catalog_write(spark, sf):
    """SK3: entries written in two runs with their dimensions: connectors, assets and clusters that are there
    already are left as they are, new ones are added."""
    at, e = _store(spark), D.entries(spark, sf)
    late = F.col("created_at") >= F.lit("1998-01-01").cast("timestamp")
    for run, rows in ((1, e.where(~late)), (2, e)):
        each = {
            "connector": rows.select(F.col("connector_id").alias("id")), "asset": rows.select(F.concat_ws("/", "connector_id", "asset_id").alias("id")),
            "cluster": rows.where("cluster_id is not null").select(F.col("cluster_id").alias("id")), "entry": rows.select(F.col("id").cast("string").alias("id")),
        }
        for kind, ids in each.items():
            stores.add_new(ids.withColumn("run", F.lit(run)), f"{at}/{kind}", ["id"])
    found = [stores.stored(spark, f"{at}/{kind}").select(F.lit(kind).alias("kind"), "id", "run") for kind in each]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("sk_playlist_save", over("entries", body="""--more c AS (SELECT *, bool_or(quality_score IS NULL) OVER (PARTITION BY cluster_id) AS again FROM entries WHERE cluster_id IS NOT NULL)
 SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN again THEN -id ELSE id END) - 1 AS position, CASE WHEN again THEN 2 ELSE 1 END AS run FROM c WHERE NOT again OR quality_score IS NOT NULL"""))
def playlist_save(spark, sf):
    """SK20: all clusters saved as playlists, then those with an unscored entry saved again without it and in
    the other order: a save replaces its playlists' members and leaves the others."""
    at, e = _store(spark), D.entries(spark, sf).where("cluster_id is not null").select("cluster_id", "id", "quality_score")
    first = placed_within(e, ["cluster_id"], "id").select("cluster_id", "id", (F.col("place") - 1).alias("position"), F.lit(1).alias("run"))
    stores.replace_groups(first, at, "cluster_id")
    again = e.join(e.where("quality_score is null").select("cluster_id").distinct(), "cluster_id", "left_semi").where("quality_score is not null")
    second = placed_within(again, ["cluster_id"], F.desc("id")).select("cluster_id", "id", (F.col("place") - 1).alias("position"), F.lit(2).alias("run"))
    stores.replace_groups(second, at, "cluster_id")
    return stores.stored(spark, at).select("cluster_id", "id", "position", "run")


#: The typed part of a payload, and the version that is read.
KNOWN = "schema_version string, k long, quality struct<sharpness:double,tags:array<string>>"
VERSION = "1"


def opened(text, known: str = KNOWN, version: str = VERSION):
    """A JSON payload as (typed, extra, error): the known fields typed, all other keys with their values as JSON
    text of any shape, and what is wrong: not an object, or another version, which is not read further."""
    names = [field.split()[0] for field in known.split(", ")]
    whole = F.from_json(text, "map<string,variant>", {"mode": "PERMISSIVE"})
    typed = F.from_json(text, known)
    keys = F.json_object_keys(text)
    error = F.when(keys.isNull(), "not an object").when(~typed["schema_version"].eqNullSafe(F.lit(version)), "schema version")
    extra = F.to_json(F.map_filter(whole, lambda k, _: ~k.isin(*names)))
    return F.when(error.isNull(), typed).alias("typed"), F.when(error.isNull(), extra).alias("extra"), error.alias("error")


@query("fs_payload_unknown", """SELECT event_id, CASE WHEN error IS NULL THEN (props::json->>'k')::bigint END AS k, CASE WHEN error IS NULL THEN event_type END AS tag, error,
 CASE WHEN error IS NULL THEN list_sort(['added', 'later']) END AS unknown, CASE WHEN error IS NULL THEN event_id % 7 END AS nested, CASE WHEN error IS NULL THEN true END AS same FROM (
 SELECT *, CASE event_type WHEN 'error' THEN 'schema version' WHEN 'view' THEN 'not an object' END AS error FROM events)""")
def payload_unknown(spark, sf):
    """SC28, FS15, FS14, UD7: payloads with keys that no schema names: the known ones typed, the unknown ones kept as
    variants and written back with them; another version or no object is an error row."""
    e = D.table(spark, sf, "events").select("event_id", "props", F.round("value", 6).alias("value"), "event_type")
    later = F.struct(F.array(F.struct((F.col("event_id") % 7).alias("deep"))).alias("list"))
    body = F.struct(
        F.when(F.col("event_type") == "error", "2").otherwise("1").alias("schema_version"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.struct(F.col("value").alias("sharpness"), F.array("event_type", F.lit("é\"")).alias("tags")).alias("quality"), later.alias("later"), F.lit(True).alias("added"),
    )
    text = e.select("event_id", F.when(F.col("event_type") == "view", F.lit("[1]")).otherwise(F.to_json(body)).alias("payload"))
    read = text.select("event_id", "payload", *opened(F.col("payload")))
    # written back, typed and unknown together give the payload's values again
    typed, extra = F.try_parse_json(F.to_json("typed")), F.try_parse_json("extra")
    whole = F.try_parse_json("payload")
    same = F.lit(True)
    for name in ("k", "schema_version", "quality"):
        same = same & F.to_json(F.try_variant_get(whole, f"$.{name}", "variant")).eqNullSafe(F.to_json(F.try_variant_get(typed, f"$.{name}", "variant")))
    for name in ("later", "added"):
        same = same & F.to_json(F.try_variant_get(whole, f"$.{name}", "variant")).eqNullSafe(F.to_json(F.try_variant_get(extra, f"$.{name}", "variant")))
    nested = F.try_variant_get(extra, "$.later.list[0].deep", "bigint")
    return read.select("event_id", "typed.k", F.get("typed.quality.tags", F.lit(0)).alias("tag"), "error", F.array_sort(F.json_object_keys("extra")).alias("unknown"), nested.alias("nested"), F.when(F.col("error").isNull(), same).alias("same"))
