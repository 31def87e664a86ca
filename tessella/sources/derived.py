"""The catalog's tables, derived by Spark from the given star-schema tables.

Each function returns one table of the catalog model; ``SQL`` states the same derivations for the
comparison queries. Nothing is synthesised: every row follows from a row of the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalar as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place():
    """Where a row stands in its table: SQL's ``max_by`` and ``any_value`` keep the first of rows that tie."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _line_id():
    """An id of a line item that keeps the order of its order's lines."""
    return ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1009 + F.col("l_partkey") % 1009) * 64 + F.rint("l_quantity").cast("long") % 64


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries: one per order; a customer is an asset and its orders are its revisions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("connector_id"),
        F.concat(F.lit("dir"), F.col("o_custkey") % 17, F.lit("/img"), F.col("o_custkey"), F.lit(".jpg")).alias("asset_id"),
        F.concat(F.lit("r"), "o_orderkey").alias("revision"),
        F.sha2(F.concat(F.lit("s"), (F.col("o_custkey") * 5 + F.col("o_orderkey") % 3) % 4001).cast("binary"), 256).alias("sha256"),
        F.when(F.col("o_orderstatus") != "F", S.rounded(F.col("o_totalprice") / 1e6, 6)).alias("quality_score"),
        F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("cl-"), F.col("o_custkey") % 211)).alias("cluster_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def analyses(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Analysis results: one per line item, the later lines of an order being its later results. Ids of
    two line items can be equal; ``placed`` adds ``at``, by which the first of them in the table is known."""
    return table(spark, sf_dir, "lineitem").select(
        _line_id().alias("id"),
        F.col("l_orderkey").alias("entry_id"),
        F.when(F.col("l_returnflag") == "R", "corrupt").otherwise("ok").alias("status"),
        F.round(F.col("l_quantity") / 50, 6).alias("technical_quality"),
        F.round(F.col("l_discount") * 10, 6).alias("pairing_affinity"),
        F.round(F.col("l_tax") * 12.5, 6).alias("colorfulness"),
        F.round((F.col("l_suppkey") % 101) / 100, 6).alias("harmony"),
        F.round((F.col("l_partkey") % 97) / 96, 6).alias("aesthetic_quality"), *([_place().alias("at")] if placed else []),
    )


def approvals(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Approval events, in event order; ``placed`` adds where each stands in the table."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error", "click")).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entry_id"),
        F.when(F.col("event_type") == "error", "rejected").otherwise("approved").alias("decision"), F.col("ts").alias("created_at"),
        *([_place().alias("at")] if placed else []),
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes: two events make a vote, the first naming the winner; some are retracted or have no group."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entry_id"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("preference"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("v"), F.floor(F.col("event_id") / 2))).alias("vote_group"),
        F.when(F.col("event_type") == "signup", F.col("ts")).alias("retracted_at"), F.col("ts").alias("created_at"),
    )


def publishes(spark: SparkSession, sf_dir: str, shipped: bool = False, placed: bool = False) -> DataFrame:
    """Destination journal: one row per line item; ``shipped`` adds the year of its shipping, ``placed``
    where it stands in the table."""
    return table(spark, sf_dir, "lineitem").select(
        _line_id().alias("id"),
        F.concat(F.lit("d"), F.col("l_suppkey") % 4).alias("adapter_id"), F.concat(F.lit("a"), "l_partkey").alias("artifact_id"),
        F.concat(F.lit("h"), F.col("l_partkey") % 50, F.lit("-"), F.col("l_linenumber") % 2).alias("sha"),
        F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_linestatus") == "O", "staged").otherwise("applied").alias("status"),
        *([F.year("l_shipdate").alias("shipped")] if shipped else []), *([_place().alias("at")] if placed else []),
    )


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders: artifact hashes with the entry that they show, if known."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("h"), F.col("p_partkey") % 50, F.lit("-"), F.col("p_partkey") % 2).alias("artifact_sha"),
        F.when(F.col("p_size") > 5, F.col("p_partkey") % 500).alias("entry_id"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image signatures: perceptual hashes whose last bits vary within a part type."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("k"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("key"),
        F.sha2(F.concat("p_brand", "p_type", F.col("p_partkey") % 9).cast("binary"), 256).alias("sha256"),
        F.when(F.col("p_partkey") % 13 != 0, F.concat(F.substring(F.sha2(F.concat("p_type", "p_brand").cast("binary"), 256), 1, 14), F.substring(F.sha2(F.col("p_partkey").cast("string").cast("binary"), 256), 1, 2))).alias("phash"),
        F.when(F.col("p_partkey") % 29 != 0, F.col("p_size") * 40).alias("width"), ((F.col("p_partkey") % 7 + 1) * 200).cast("int").alias("height"),
    )


def remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote assets: customers with tags, favourite mark and star."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("a-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("asset_id"), (F.col("c_acctbal") > 5000).alias("favorite"),
        (F.col("c_custkey") % 6).cast("double").alias("star"), F.array("c_mktsegment", F.concat(F.lit("n"), "c_nationkey")).alias("tags"),
        (F.col("c_acctbal") > 0).alias("available"), F.concat(F.lit("r"), F.col("c_custkey") % 5).alias("revision"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote's assets as it lists them, named by the day of a customer's first order, so that later
    assets have greater ids; with the customer's balance and that day."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first"), F.count(F.lit(1)).alias("n"))
    asset = F.concat(F.lit("a-"), F.date_format("first", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return table(spark, sf_dir, "customer").join(first, "c_custkey").select(
        asset.alias("asset_id"), F.concat(F.lit("r"), F.col("n") % 5).alias("revision"), F.sha2(F.concat(F.lit("s"), "c_custkey").cast("binary"), 256).alias("checksum"),
        (F.col("n") * 1000 + F.col("c_custkey") % 997).alias("size_bytes"), (F.col("c_acctbal") > 0).alias("available"), (F.col("c_acctbal") > 5000).alias("favorite"),
        (F.col("c_custkey") % 6).cast("double").alias("star"), F.array("c_mktsegment", F.concat(F.lit("n"), "c_nationkey")).alias("tags"),
        F.when(F.col("c_custkey") % 4 != 0, F.date_format("first", "yyyy-MM-dd")).alias("date"), F.col("c_acctbal").alias("balance"), F.date_format("first", "yyyy-MM-dd").alias("day"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's files: parts with a suffix by key, some in other case, some raw or unknown. Of parts with
    one path the first in the table whose size is known is the file, as SQL's ``any_value`` skips nulls."""
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".JPG", ".png", ".dng", ".txt", ".heic", ".NEF", ".webp", ".json"))), (F.col("p_partkey") % 9 + 1).cast("int"))
    named = table(spark, sf_dir, "part").select(
        F.concat(F.lit("lib/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/IMG_2021"), F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0"), F.lit("15_"), F.col("p_partkey") % 700, suffix).alias("path"),
        (F.col("p_size") * 1000).cast("long").alias("length"), F.col("p_partkey").alias("mtime"), _place().alias("at"),
    )
    first = F.struct(F.col("length").isNull().alias("unknown"), "at")
    return named.groupBy("path").agg(F.min_by(F.struct("length", "mtime"), first).alias("f")).select("path", "f.*")


#: What a turn says of an image before its own text.
REMARKS = (
    "Love the quiet light here.", "A warm room, beautiful.", "Too busy and crowded, hate it.", "Don't like the heavy texture.", "Minimal and geometric.", "A lone tree in negative space.",
    "Great contrast and motion.", "Awful, chaotic repetition.", "Nostalgic, organic movement.", "I like the breathing space.", "Symmetric and repeating, gorgeous.", "Ugly light.", "Nothing to say.",
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue observations: turns of conversations, each with a remark and, mostly, an image."""
    c, t = F.col("conv_id"), F.col("turn")
    remark = F.element_at(F.array(*map(F.lit, REMARKS)), ((c * 5 + t * 3) % len(REMARKS) + 1).cast("int"))
    stamp = F.concat(F.lit("2024-01-"), F.lpad((c % 28 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad((t % 24).cast("string"), 2, "0"), F.lit(":00:00+00:00"))
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat(remark, F.lit(" "), F.coalesce("text", F.lit(""))).alias("verbatim"), "role",
        stamp.alias("created_at"), F.when(t % 3 != 2, F.sha2(F.concat(F.lit("s"), (c * 5 + t) % 4001).cast("binary"), 256)).alias("image"),
    )


def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image palettes: three colours with shares per part."""
    k, j = F.col("p_partkey"), F.col("j")
    each = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("k"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("key"), F.explode(F.array(*map(F.lit, range(3)))).alias("j"))
    return each.select("key", "j", *[((k * a + j * b) % 256).cast("double").alias(c) for c, a, b in (("r", 7, 91), ("g", 13, 53), ("b", 29, 17))], ((k + j) % 5 + 1).cast("double").alias("share"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


#: The same derivations, for DuckDB.
SQL = {
    "entries": """SELECT o_orderkey AS id, 'c' || (o_custkey % 3) AS connector_id,
        'dir' || (o_custkey % 17) || '/img' || o_custkey || '.jpg' AS asset_id, 'r' || o_orderkey AS revision,
        sha256('s' || ((o_custkey * 5 + o_orderkey % 3) % 4001)) AS sha256,
        CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice / 1e6, 6) END AS quality_score,
        CASE WHEN o_custkey % 11 <> 0 THEN 'cl-' || (o_custkey % 211) END AS cluster_id, o_orderdate AS created_at FROM orders""",
    "analyses": """SELECT ((l_orderkey * 8 + l_linenumber) * 1009 + l_partkey % 1009) * 64 + l_quantity::bigint % 64 AS id, l_orderkey AS entry_id,
        CASE WHEN l_returnflag = 'R' THEN 'corrupt' ELSE 'ok' END AS status, round(l_quantity / 50, 6) AS technical_quality,
        round(l_discount * 10, 6) AS pairing_affinity, round(l_tax * 12.5, 6) AS colorfulness,
        round((l_suppkey % 101) / 100, 6) AS harmony, round((l_partkey % 97) / 96, 6) AS aesthetic_quality FROM lineitem""",
    "approvals": """SELECT event_id AS id, user_id AS entry_id, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END AS decision,
        ts AS created_at FROM events WHERE event_type IN ('purchase', 'error', 'click')""",
    "preferences": """SELECT event_id AS id, user_id AS entry_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS preference,
        CASE WHEN event_type <> 'error' THEN 'v' || (event_id // 2) END AS vote_group,
        CASE WHEN event_type = 'signup' THEN ts END AS retracted_at, ts AS created_at FROM events""",
    "publishes": """SELECT ((l_orderkey * 8 + l_linenumber) * 1009 + l_partkey % 1009) * 64 + l_quantity::bigint % 64 AS id, 'd' || (l_suppkey % 4) AS adapter_id, 'a' || l_partkey AS artifact_id,
        'h' || (l_partkey % 50) || '-' || (l_linenumber % 2) AS sha,
        CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_linestatus = 'O' THEN 'staged' ELSE 'applied' END AS status FROM lineitem""",
    "renders": """SELECT p_partkey AS id, 'h' || (p_partkey % 50) || '-' || (p_partkey % 2) AS artifact_sha,
        CASE WHEN p_size > 5 THEN p_partkey % 500 END AS entry_id FROM part""",
    "images": """SELECT 'k' || lpad(p_partkey::varchar, 8, '0') AS key, sha256(p_brand || p_type || (p_partkey % 9)) AS sha256,
        CASE WHEN p_partkey % 13 <> 0 THEN substr(sha256(p_type || p_brand), 1, 14) || substr(sha256(p_partkey::varchar), 1, 2) END AS phash,
        CASE WHEN p_partkey % 29 <> 0 THEN p_size * 40 END AS width, ((p_partkey % 7 + 1) * 200)::int AS height FROM part""",
    "remote": """SELECT 'a-' || lpad(c_custkey::varchar, 8, '0') AS asset_id, c_acctbal > 5000 AS favorite, (c_custkey % 6)::double AS star,
        [c_mktsegment, 'n' || c_nationkey] AS tags, c_acctbal > 0 AS available, 'r' || (c_custkey % 5) AS revision FROM customer""",
    "listing": """SELECT 'a-' || strftime(first, '%Y%m%d') || '-' || lpad(c_custkey::varchar, 8, '0') AS asset_id, 'r' || (n % 5) AS revision, sha256('s' || c_custkey) AS checksum,
        n * 1000 + c_custkey % 997 AS size_bytes, c_acctbal > 0 AS available, c_acctbal > 5000 AS favorite, (c_custkey % 6)::double AS star, [c_mktsegment, 'n' || c_nationkey] AS tags,
        CASE WHEN c_custkey % 4 <> 0 THEN strftime(first, '%Y-%m-%d') END AS date, c_acctbal AS balance, strftime(first, '%Y-%m-%d') AS day
        FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS first, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "files": """SELECT path, any_value(length) AS length FROM (SELECT 'lib/' || lower(replace(p_brand, '#', '')) || '/IMG_2021' || lpad((p_partkey % 12 + 1)::varchar, 2, '0') || '15_' || (p_partkey % 700)
        || ['.jpg', '.JPG', '.png', '.dng', '.txt', '.heic', '.NEF', '.webp', '.json'][(p_partkey % 9 + 1)::int] AS path, (p_size * 1000)::bigint AS length FROM part) GROUP BY path""",
    "observations": "SELECT conv_id * 1000 + turn AS id, 's' || conv_id AS session_id, [" + ", ".join("'" + r.replace("'", "''") + "'" for r in REMARKS) + f"""][((conv_id * 5 + turn * 3) % {len(REMARKS)} + 1)::int] || ' ' || coalesce(text, '') AS verbatim, role,
        '2024-01-' || lpad((conv_id % 28 + 1)::varchar, 2, '0') || 'T' || lpad((turn % 24)::varchar, 2, '0') || ':00:00+00:00' AS created_at, CASE WHEN turn % 3 <> 2 THEN sha256('s' || ((conv_id * 5 + turn) % 4001)) END AS image FROM conversations""",
    "palettes": """SELECT 'k' || lpad(p_partkey::varchar, 8, '0') AS key, j::int AS j, ((p_partkey * 7 + j * 91) % 256)::double AS r, ((p_partkey * 13 + j * 53) % 256)::double AS g, ((p_partkey * 29 + j * 17) % 256)::double AS b, ((p_partkey + j) % 5 + 1)::double AS share
        FROM part, (SELECT unnest([0, 1, 2]) AS j)""",
    "vectors": """SELECT vec_id AS id, embedding::double[] AS vector, label FROM embeddings""",
}


def with_tables(*names: str, body: str) -> str:
    """A statement over the named derived tables."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + (",\n" if body.lstrip().startswith("--more") else "\n") + body.replace("--more", "")
