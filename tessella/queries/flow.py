"""Review lists, policies, evidence, layouts, rotations and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.operators.latest import latest, numbered
from tessella.operators.layout import feed_order, slice_cells
from tessella.operators.ordering import placed_within
from tessella.operators.pairs import uncertainty
from tessella.operators.similarity import image_clusters, vector_search
from tessella.queries.taste import ORACLE as TASTE_SQL
from tessella.queries.taste import ACTIVE, COS, FIXED, LATEST_SIGNALS, signals, votes
from tessella.plans import materialise
from tessella.sources import derived as D
from tessella.sources.derived import with_tables as over
from tessella.streaming import journal

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


@query("pf_review_pending", over("entries", "approvals", body="""SELECT e.id, e.asset_id FROM entries e LEFT JOIN (SELECT entry_id, max_by(decision, id) AS decision FROM approvals GROUP BY entry_id) d ON d.entry_id = e.id
 WHERE coalesce(d.decision, 'pending') = 'pending'"""))
def review_pending(spark, sf):
    """PF10: review list with status filter, pending ⇔ decision IS NULL."""
    d = latest(D.approvals(spark, sf).select("entry_id", "id", "decision"), ["entry_id"], "id").select(F.col("entry_id").alias("id"), "decision")
    return D.entries(spark, sf).join(d, "id", "left").where(F.coalesce("decision", F.lit("pending")) == "pending").select("id", "asset_id")


@query("sk_update_flags", over("entries", body="SELECT id, asset_id, CASE WHEN id = max(id) OVER (PARTITION BY connector_id, asset_id) THEN 0.9 ELSE quality_score END AS quality_score FROM entries"))
def update_flags(spark, sf):
    """SK5: update quality flags on one revision or on the newest row."""
    e = D.entries(spark, sf)
    newest = e.groupBy("connector_id", "asset_id").agg(F.max("id").alias("newest"))
    return e.join(newest, ["connector_id", "asset_id"]).select("id", "asset_id", F.when(F.col("id") == F.col("newest"), 0.9).otherwise(F.col("quality_score")).alias("quality_score"))


@query("pf_exclusion_policy", over("remote", body="""SELECT asset_id, NOT (list_contains(x, 'all') OR list_contains(x, 'n3')) AS allowed FROM (SELECT asset_id, list_sort(list_distinct(list_concat(tags, CASE WHEN star = 0 THEN ['all'] ELSE ['n7'] END))) AS x FROM remote)"""))
def exclusion_policy(spark, sf):
    """PF16, ST7: exclusion policy."""
    x = F.array_union("tags", F.when(F.col("star") == 0, F.array(F.lit("all"))).otherwise(F.array(F.lit("n7"))))
    return D.remote(spark, sf).select("asset_id", (~F.array_contains(x, "all") & ~F.array_contains(x, "n3")).alias("allowed"))


@query("pf_eligible_works", over("remote", body="SELECT asset_id FROM remote WHERE available AND asset_id NOT IN (SELECT 'a-' || lpad(o_custkey::varchar, 8, '0') FROM orders WHERE o_orderstatus = 'P')"))
def eligible_works(spark, sf):
    """PF18: works eligible = creator available and not denied."""
    denied = D.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("a-"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("asset_id"))
    return D.remote(spark, sf).where("available").join(denied, "asset_id", "left_anti").select("asset_id")


@query("jn_group_pool", over("entries", body="SELECT sha256, max(id) AS id FROM entries WHERE sha256 IN (SELECT sha256('s' || p_partkey) FROM part) GROUP BY sha256 ORDER BY id DESC LIMIT 256"))
def group_pool(spark, sf):
    """JN8: join + group."""
    embedded = D.table(spark, sf, "part").select(F.sha2(F.concat(F.lit("s"), "p_partkey").cast("binary"), 256).alias("sha256"))
    return D.entries(spark, sf).join(embedded, "sha256", "left_semi").groupBy("sha256").agg(F.max("id").alias("id")).orderBy(F.desc("id")).limit(256)


@query("jn_missing_vectors", over("entries", body="SELECT DISTINCT sha256 FROM entries WHERE sha256 NOT IN (SELECT sha256('s' || p_partkey) FROM part)"))
def missing_vectors(spark, sf):
    """JN10: anti-join."""
    embedded = D.table(spark, sf, "part").select(F.sha2(F.concat(F.lit("s"), "p_partkey").cast("binary"), 256).alias("sha256"))
    return D.entries(spark, sf).select("sha256").distinct().join(embedded, "sha256", "left_anti")


@query("jn_liked_shas", over("entries", "preferences", body=ACTIVE + "SELECT DISTINCT sha256 FROM entries WHERE id IN (SELECT winner FROM active WHERE NOT retracted)"))
def liked_shas(spark, sf):
    """JN23: the contents of entries that a vote which stands has won, the liked subset of exemplars."""
    liked = votes(spark, sf).where("not retracted").select(F.col("winner").alias("id")).distinct()
    return D.entries(spark, sf).join(liked, "id", "left_semi").select("sha256").distinct()


@query("jn_ordered_lookup", over("entries", body="SELECT q.pos, e.id, e.asset_id, e.id IS NOT NULL AS found FROM (SELECT o_custkey AS id, o_orderkey AS pos FROM orders) q LEFT JOIN entries e ON e.id = q.id"))
def ordered_lookup(spark, sf):
    """JN16: entries by a list of keys, each with its place in the list and whether it was found."""
    asked = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("asked"), F.col("o_orderkey").alias("pos"))
    return asked.join(D.entries(spark, sf).select("id", "asset_id"), F.col("asked") == F.col("id"), "left").select("pos", "id", "asset_id", F.col("id").isNotNull().alias("found"))


@query("jn_vote_vectors", over("preferences", "vectors", body=ACTIVE + "SELECT vote_group, w.label AS winner_label, l.label AS loser_label, round(list_dot_product(w.vector, l.vector), 6) AS agreement FROM active a JOIN vectors w ON w.id = a.winner JOIN vectors l ON l.id = a.loser WHERE NOT a.retracted"))
def vote_vectors(spark, sf):
    """JN17: two-sided role join."""
    v = D.vectors(spark, sf).select("id", "vector", "label")
    p = votes(spark, sf).where("not retracted").join(v.toDF("winner", "w", "winner_label"), "winner").join(v.toDF("loser", "l", "loser_label"), "loser")
    return p.select("vote_group", "winner_label", "loser_label", F.round(S.dot(F.col("w"), F.col("l")), 6).alias("agreement"))


@query("jn_exemplars", over("preferences", "vectors", body=ACTIVE.rstrip() + f""", liked AS (SELECT DISTINCT winner FROM active WHERE NOT retracted)
 SELECT query, id, rank FROM (SELECT q.id AS query, v.id, row_number() OVER (PARTITION BY q.id ORDER BY {COS.format(a='v.vector', b='q.vector')} DESC, v.id DESC) AS rank
 FROM vectors q JOIN vectors v ON v.id <> q.id WHERE q.id % 100 = 0 AND v.id IN (SELECT winner FROM liked)) WHERE rank <= 3"""))
def exemplars(spark, sf):
    """JN23, SL3: the three most alike of the liked for each query, ties to the higher id."""
    v = D.vectors(spark, sf)
    liked = votes(spark, sf).where("not retracted").select(F.col("winner").alias("id")).distinct()
    return vector_search(v.where("id % 100 = 0"), v.join(liked, "id", "left_semi"), 3, ties="-id").select("query", "id", "rank")


@query("ag_attribution", over("preferences", "vectors", body=ACTIVE.rstrip() + """, t AS (SELECT a.vote_group, list_dot_product(w.vector, q.vector) - list_dot_product(l.vector, q.vector) AS c FROM active a JOIN vectors w ON w.id = a.winner JOIN vectors l ON l.id = a.loser, (SELECT vector FROM vectors WHERE id = 0) q WHERE NOT a.retracted)
 SELECT vote_group, round(c * least(1.0, (SELECT count(*) FROM t) / 50.0) / (SELECT count(*) FROM t), 6) AS contribution FROM t"""))
def attribution(spark, sf):
    """AG24, FM16: additive attribution per vote."""
    v = D.vectors(spark, sf).select("id", "vector")
    q = v.where("id = 0").select(F.col("vector").alias("q"))
    t = votes(spark, sf).where("not retracted").join(v.toDF("winner", "w"), "winner").join(v.toDF("loser", "l"), "loser").join(F.broadcast(q)).select("vote_group", (S.dot(F.col("w"), F.col("q")) - S.dot(F.col("l"), F.col("q"))).alias("c"))
    n = t.agg(F.count(F.lit(1)).alias("n"))
    return t.join(F.broadcast(n)).select("vote_group", F.round(F.col("c") * F.least(F.lit(1.0), F.col("n") / 50.0) / F.col("n"), 6).alias("contribution"))



@query("ag_duplicate_groups", over("images", body="SELECT i.sha256, i.key, g.n AS members, i.key = g.best AS best FROM images i JOIN (SELECT sha256, count(*) AS n, arg_min(key, (-coalesce(width * height, 0), -coalesce(width, 0), key)) AS best FROM images GROUP BY sha256 HAVING count(*) > 1) g ON g.sha256 = i.sha256"))
def duplicate_groups(spark, sf):
    """AG8, AG19, FM5: groups of equal content, one row per member, and the best original of each."""
    area, wide = F.coalesce(F.col("width") * F.col("height"), F.lit(0)), F.coalesce("width", F.lit(0))
    best = F.min_by("key", F.struct((-area).alias("a"), (-wide).alias("w"), "key"))
    groups = materialise(D.images(spark, sf).groupBy("sha256").agg(F.count(F.lit(1)).alias("members"), best.alias("one")).where("members > 1"), "groups")
    return D.images(spark, sf).select("sha256", "key").join(groups, "sha256").select("sha256", "key", "members", (F.col("key") == F.col("one")).alias("best"))



@query("ag_duplicate_report", over("images", body="--more x AS (" + TASTE_SQL["gr_image_clusters"] + """)
 SELECT x.cluster, count(*) AS members, CASE WHEN count(DISTINCT i.sha256) = 1 THEN 'exact' ELSE 'near' END AS kind, max(x.key) FILTER (x.best) AS best FROM x JOIN images i USING (key) GROUP BY x.cluster HAVING count(*) > 1"""))
def duplicate_report(spark, sf):
    """AG8, AG19, GR1: groups of two members or more: exact where all have one content, else near, with the best
    original."""
    i = D.images(spark, sf)
    return image_clusters(i).groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.min("kind").alias("kind"), F.max(F.when(F.col("best"), F.col("key"))).alias("best")).where("members > 1")


@query("wn_entry_position", over("approvals", body="SELECT entry_id, list(id ORDER BY id)[2] AS second_id, list_position(list(id ORDER BY id), max(id)) - 1 AS last_position FROM approvals GROUP BY entry_id"))
def entry_position(spark, sf):
    """WN12: position of entry in member list."""
    n = numbered(D.approvals(spark, sf).select("entry_id", "id"), ["entry_id"], "id")
    return n.groupBy("entry_id").agg(F.max(F.when(F.col("seq") == 2, F.col("id"))).alias("second_id"), (F.max("seq").cast("long") - 1).alias("last_position"))


@query("sl_rotation_order", over("entries", body="SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score IS NOT NULL DESC, md5(id || '-17'), id) AS place FROM entries WHERE cluster_id IS NOT NULL"))
def rotation_order(spark, sf):
    """SL8: rotation order."""
    e = D.entries(spark, sf).where("cluster_id is not null").select("cluster_id", "id", F.col("quality_score").isNotNull().alias("favourite"))
    turn = F.md5(F.concat(F.col("id").cast("string"), F.lit("-17")).cast("binary"))
    return placed_within(e, ["cluster_id"], F.desc("favourite"), turn, "id").select("cluster_id", "id", "place")


@query("sl_next_job", over("publishes", body="SELECT adapter_id, min(id) AS id FROM publishes WHERE status = 'staged' GROUP BY adapter_id"))
def next_job(spark, sf):
    """SL13: next runnable job."""
    return D.publishes(spark, sf).where("status = 'staged'").groupBy("adapter_id").agg(F.min("id").alias("id"))


@query("st_decisions_union", over("approvals", "preferences", body="SELECT 0 AS source, entry_id, decision = 'approved' AS liked FROM (SELECT entry_id, max_by(decision, id) AS decision FROM approvals GROUP BY entry_id) UNION ALL SELECT 1, entry_id, preference > 0 FROM preferences WHERE retracted_at IS NULL AND preference <> 0"))
def decisions_union(spark, sf):
    """ST5: union of approvals and pairwise decisions."""
    a = latest(D.approvals(spark, sf).select("entry_id", "id", "decision"), ["entry_id"], "id").select(F.lit(0).alias("source"), "entry_id", (F.col("decision") == "approved").alias("liked"))
    return a.unionByName(D.preferences(spark, sf).where("retracted_at is null and preference <> 0").select(F.lit(1).alias("source"), "entry_id", (F.col("preference") > 0).alias("liked")))


@query("st_first_category_wins", over("files", body="SELECT path, min_by(c, r) AS category FROM (SELECT path, 'panel' AS c, 0 AS r FROM files WHERE length % 3000 = 0 UNION ALL SELECT path, 'photo', 1 FROM files WHERE lower(path) LIKE '%.jpg' UNION ALL SELECT path, 'any', 2 FROM files) GROUP BY path"))
def first_category(spark, sf):
    """ST10: order-preserving dedupe by relative path."""
    f = F.when(F.col("length") % 3000 == 0, "panel").when(F.lower("path").endswith(".jpg"), "photo").otherwise("any")
    return D.files(spark, sf).select("path", f.alias("category"))


# The sources that each treatment takes, fewest and most.
ARITY = {"single_fullbleed": (1, 1), "diptych": (2, 2), "triptych": (3, 3), "quad": (4, 4), "packed": (2, 9)}
#: The treatment that an order's priority asks for.
ASKED = dict(zip("12345", ARITY, strict=True))


@query("ru_manifests", "WITH a(p, treatment, low, high) AS (VALUES " + ", ".join(f"('{p}', '{t}', {ARITY[t][0]}, {ARITY[t][1]})" for p, t in ASKED.items()) + """),
m AS (SELECT l_orderkey, left(o_orderpriority, 1) AS p, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_returnflag <> 'R') AS regions, count(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS named, bool_or(l_returnflag <> 'R' AND l_quantity <= 2) AS flat
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT l_orderkey, treatment, CASE WHEN parts <> n THEN 'duplicate sources' WHEN n NOT BETWEEN low AND high THEN 'arity: ' || n || ' of ' || low || ' to ' || high WHEN regions > 0 AND regions <> n THEN 'one region per source: ' || regions || ' of ' || n WHEN flat THEN 'geometry' END AS error,
 CASE WHEN parts = n AND n BETWEEN low AND high AND regions IN (0, n) AND NOT flat THEN regions END AS regions FROM m JOIN a USING (p)""")
def manifests(spark, sf):
    """RU5, RU7, ST11: a manifest of each order's parts under the treatment that its priority asks for: the first
    of its errors (sources twice, too few or many for the treatment, regions that are not those of the sources,
    regions without extent), or the number of its regions."""
    line = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_returnflag") != "R").alias("set"), "l_quantity")
    asked = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).alias("p"))
    treatment = F.create_map(*[F.lit(x) for kv in ASKED.items() for x in kv])[F.col("p")]
    bounds = F.create_map(*[x for t, (a, b) in ARITY.items() for x in (F.lit(t), F.array(F.lit(a), F.lit(b)))])[F.col("treatment")]
    region = F.col("set")
    m = line.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), F.count_if(region).alias("regions"), F.max(region & (F.col("l_quantity") <= 2)).alias("flat")
    ).join(asked, "l_orderkey").withColumn("treatment", treatment).withColumns({"low": bounds[0], "high": bounds[1]})
    error = (
        F.when(F.col("parts") != F.col("n"), "duplicate sources").when(~F.col("n").between(F.col("low"), F.col("high")), F.concat(F.lit("arity: "), "n", F.lit(" of "), "low", F.lit(" to "), "high"))
        .when((F.col("regions") > 0) & (F.col("regions") != F.col("n")), F.concat(F.lit("one region per source: "), "regions", F.lit(" of "), "n")).when(F.col("flat"), "geometry")
    )
    return m.select("l_orderkey", "treatment", error.alias("error"), F.when(error.isNull(), F.col("regions")).alias("regions"))


@query("st_region_checks", "SELECT l_orderkey, len(list_distinct(list(l_suppkey))) <> count(*) AS repeats, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def region_checks(spark, sf):
    """ST11: region–source set equality checks, duplicate detection."""
    return D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_suppkey") != F.count(F.lit(1))).alias("repeats"), F.countDistinct("l_partkey").alias("parts"))



# The fields of a manifest, and those that are merged key by key.
FIELDS, NESTED = ("layout_treatment", "background", "processing_intent"), ("background", "processing_intent")
BASE = '{"layout_treatment":"contain_matte","background":{"mode":"solid","color":"#101010"},"processing_intent":{"sharpen":"none","upscale":"2"}}'


def overridden(base, override):
    """A manifest with an override, both JSON text: (fields, error). Known scalar fields are replaced, those of
    ``NESTED`` merged key by key, and an unknown field is an error; no override leaves the base."""
    keys = F.coalesce(F.json_object_keys(override), F.array().cast("array<string>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, FIELDS))))
    error = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field: "), F.array_join(unknown, ",")))
    out = {}
    for name in FIELDS:
        if name in NESTED:
            old, new = (F.coalesce(F.from_json(F.get_json_object(t, f"$.{name}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for t in (base, override))
            out[name] = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)  # noqa: B023
        else:
            out[name] = F.coalesce(F.get_json_object(override, f"$.{name}"), F.get_json_object(base, f"$.{name}"))
    return {k: F.when(error.isNull(), v) for k, v in out.items()}, error


@query("fs_override_merge", f"""SELECT c_custkey, CASE WHEN error IS NULL THEN m->>'layout_treatment' END AS treatment, CASE WHEN error IS NULL THEN m->'background'->>'mode' END AS mode, CASE WHEN error IS NULL THEN m->'background'->>'color' END AS color,
 CASE WHEN error IS NULL THEN m->'processing_intent'->>'sharpen' END AS sharpen, CASE WHEN error IS NULL THEN m->'processing_intent'->>'upscale' END AS upscale, error
 FROM (SELECT c_custkey, json_merge_patch('{BASE}', coalesce(o, '{{}}')) AS m, CASE WHEN c_nationkey = 7 THEN 'unknown field: crop' END AS error FROM (SELECT c_custkey, c_nationkey,
  CASE WHEN c_nationkey = 7 THEN '{{"crop":1,"background":{{"mode":"x"}}}}' WHEN c_nationkey % 3 = 0 THEN '{{"layout_treatment":"' || c_mktsegment || '","background":{{"color":"c' || c_nationkey || '"}}}}'
   WHEN c_nationkey % 3 = 1 THEN '{{"processing_intent":{{"upscale":"' || c_nationkey || '","denoise":"1"}}}}' END AS o FROM customer))""")
def override_merge(spark, sf):
    """FS16: a target's override over its manifest: scalar fields replaced, two nested ones merged by key, an
    unknown field an error."""
    n = F.col("c_nationkey")
    o = F.when(n == 7, F.lit('{"crop":1,"background":{"mode":"x"}}')).when(
        n % 3 == 0, F.to_json(F.struct(F.col("c_mktsegment").alias("layout_treatment"), F.struct(F.concat(F.lit("c"), n).alias("color")).alias("background")))
    ).when(n % 3 == 1, F.to_json(F.struct(F.struct(n.cast("string").alias("upscale"), F.lit("1").alias("denoise")).alias("processing_intent"))))
    c = D.table(spark, sf, "customer").select("c_custkey", F.lit(BASE).alias("base"), o.alias("o"))
    fields, error = overridden(F.col("base"), F.col("o"))
    merged = c.select("c_custkey", *[v.alias(k) for k, v in fields.items()], error.alias("error"))
    keys = (("background", "mode"), ("background", "color"), ("processing_intent", "sharpen"), ("processing_intent", "upscale"))
    return merged.select("c_custkey", F.col("layout_treatment").alias("treatment"), *[F.element_at(f, k).alias(k) for f, k in keys], "error")


@query("fs_signed_template", over("analyses", body="--more " + LATEST_SIGNALS + " SELECT entry_id, CASE WHEN harmony - 0.5 >= 0 THEN '+' ELSE '-' END || printf('%.3f', abs(round(harmony - 0.5, 2))) || ' harmony' AS text FROM latest"))
def signed_template(spark, sf):
    """FS7: text templates."""
    x = F.round(F.col("harmony") - 0.5, 2)
    text = F.concat(F.when(F.col("harmony") - 0.5 >= 0, "+").otherwise("-"), F.format_string("%.3f", F.abs(x)), F.lit(" harmony"))
    return signals(spark, sf).select("entry_id", F.when(x.isNotNull(), text).alias("text"))


# The formats of a stated date, in the order in which they are tried.
FORMATS = (("%Y:%m:%d %H:%M:%S", "yyyy:MM:dd HH:mm:ss"), ("%Y%m%d", "yyyyMMdd"), ("%Y-%m-%d", "yyyy-MM-dd"), ("%Y%m%d%H%M%S", "yyyyMMddHHmmss"))


@query("fd_parse_formats", """SELECT o_orderkey, CASE WHEN s LIKE ' %' THEN NULL ELSE epoch(coalesce(""" + ", ".join(f"try_strptime(s, '{f}')" for f, _ in FORMATS) + """)) END::bigint AS seconds
 FROM (SELECT o_orderkey, CASE o_orderkey % 5 """ + " ".join(f"WHEN {i} THEN strftime(t, '{f}')" for i, (f, _) in enumerate(FORMATS)) + """ ELSE 'unknown' END AS s FROM (SELECT o_orderkey, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS t FROM orders))""")
def parse_formats(spark, sf):
    """FD1: four-format date parse → epoch seconds, local time zone, first match wins, whole text only."""
    k, d = F.col("o_orderkey") % 5, F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    s = F.lit("unknown")
    for i, (_, form) in reversed(list(enumerate(FORMATS))):
        s = F.when(k == i, F.date_format(d, form)).otherwise(s)
    # a format is only tried on texts of its own length, as the parser may stop early
    parsed = F.coalesce(*[F.when(F.length("s") == len(form), F.try_to_timestamp("s", F.lit(form))) for _, form in FORMATS])
    return D.table(spark, sf, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", F.unix_seconds(parsed).alias("seconds"))


@query("fm_palette_distance", """WITH c AS (SELECT l_orderkey AS o, l_linenumber % 2 AS side, l_linenumber AS i, l_quantity AS share, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_linenumber * 37 % 256 AS b FROM lineitem),
 near AS (SELECT x.o, x.i, x.share, x.r, x.g, min(sqrt((x.r - y.r) ** 2 + (x.g - y.g) ** 2 + (x.b - y.b) ** 2)) AS d FROM c x JOIN c y ON x.o = y.o AND x.side = 0 AND y.side = 1 GROUP BY ALL)
 SELECT s.o, round(coalesce(least(1.0, sum(n.share * n.d / sqrt(3)) / (sum(n.share) + 1e-9)), 1.0), 6) AS distance FROM (SELECT DISTINCT o FROM c) s LEFT JOIN near n ON n.o = s.o GROUP BY s.o""")
def palette_distance(spark, sf):
    """FM10: of two palettes of 0 to 255; 1 where one has no colours."""
    c = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") % 2).alias("side"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("share"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), (F.col("l_linenumber") * 37 % 256).alias("b"))
    x, y = c.where("side = 0").drop("side"), c.where("side = 1").select("o", *[F.col(n).alias(f"{n}2") for n in "rgb"])
    d = F.sqrt(F.pow(F.col("r") - F.col("r2"), 2) + F.pow(F.col("g") - F.col("g2"), 2) + F.pow(F.col("b") - F.col("b2"), 2))
    near = x.join(y, "o").groupBy("o", "i", "share", "r", "g").agg(F.min(d).alias("d"))
    return c.select("o").distinct().join(near, "o", "left").groupBy("o").agg(F.round(S.palette_distance_of(F.col("d"), F.col("share")), 6).alias("distance"))


UNSURE_SQL = "abs(" + " + ".join(f"({w}) * (w.{s} - l.{s})" for s, w in FIXED.items()) + ") AS gap, " + " + ".join(f"{abs(w)} * abs(w.{s} - l.{s})" for s, w in FIXED.items()) + " AS spread"


@query("fm_uncertainty", over("preferences", "analyses", body=ACTIVE.rstrip() + ",\n" + LATEST_SIGNALS + f", p AS (SELECT a.vote_group, {UNSURE_SQL} FROM active a JOIN latest w ON w.entry_id = a.winner JOIN latest l ON l.entry_id = a.loser) SELECT vote_group, round(CASE WHEN spread = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - gap / spread)) END, 6) AS uncertainty FROM p"))
def fm_uncertainty(spark, sf):
    """FM14: how near a tie each vote's pair was."""
    s = signals(spark, sf)
    w, l = s.select(*[F.col(c).alias(f"w_{c}") for c in s.columns]), s.select(*[F.col(c).alias(f"l_{c}") for c in s.columns])
    p = votes(spark, sf).join(w, F.col("winner") == F.col("w_entry_id")).join(l, F.col("loser") == F.col("l_entry_id"))
    return p.select("vote_group", F.round(uncertainty(FIXED, "w_", "l_"), 6).alias("uncertainty"))


@query("gr_bisect", """WITH p AS (SELECT l_orderkey AS o, row_number() OVER w AS k, sum(l_quantity) OVER w AS prefix, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)) SELECT o, arg_max(k, (-abs(2 * prefix - total), k)) AS k FROM p WHERE k < n GROUP BY o""")
def bisect(spark, sf):
    """GR5: weighted bisect index, last tie wins."""
    by = Window.partitionBy("o").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("o")
    p = D.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o").select(
        "o", F.row_number().over(Window.partitionBy("o").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("k"),
        F.sum("l_quantity").over(by).alias("prefix"), F.sum("l_quantity").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("n"),
    )
    return p.where("k < n").groupBy("o").agg(F.max_by("k", F.struct((-F.abs(2 * F.col("prefix") - F.col("total"))).alias("b"), "k")).cast("long").alias("k"))


@query("gr_slice_cells")
def cells(spark, sf):
    """GR4: Cells of each order's lines, by weight, in a frame of 1920 x 1080."""
    items = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("item"), F.col("l_partkey").alias("tie"), F.col("l_quantity").alias("weight"))
    return slice_cells(items, 1920, 1080)


@query("wn_feed_order")
def feed(spark, sf):
    """WN10: the first twelve of each cluster's feed, without long runs of one connector."""
    e = D.entries(spark, sf).where("cluster_id is not null").select(F.col("cluster_id").alias("feed"), "id", F.col("connector_id").alias("creator"), F.coalesce("quality_score", F.lit(0.0)).alias("score"))
    return feed_order(e)


@query("ru_cell_fit", over("images", body="SELECT key, CASE WHEN height >= 600 AND abs(width / height - 16.0 / 9) / (16.0 / 9) > 0.1 THEN 'fill' ELSE 'contain' END AS fit FROM images WHERE width IS NOT NULL"))
def cell_fit(spark, sf):
    """RU2: cell fit rule."""
    gap = F.abs(F.col("width") / F.col("height") - 16.0 / 9) / (16.0 / 9)
    return D.images(spark, sf).where("width is not null").select("key", F.when((F.col("height") >= 600) & (gap > 0.1), "fill").otherwise("contain").alias("fit"))


@query("ru_routing", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND value > 5 THEN 'cloud' ELSE 'local' END AS provider, event_type IN ('click', 'view') AND value <= 5 AS paused FROM events")
def routing(spark, sf):
    """RU8: provider routing by kind, cloud outage → local + pause record."""
    cloud, up = F.col("event_type").isin("click", "view"), F.col("value") > 5
    return D.table(spark, sf, "events").select("event_id", F.when(cloud & up, "cloud").otherwise("local").alias("provider"), (cloud & ~up).alias("paused"))


@query("ru_corrections", over("approvals", body="SELECT entry_id, CASE WHEN max(id) FILTER (decision = 'rejected') = max(id) THEN 'disputed' ELSE 'pinned' END AS state, count(*) FILTER (decision = 'approved') AS edits FROM approvals GROUP BY entry_id"))
def corrections(spark, sf):
    """RU12: correction replay on claims."""
    return D.approvals(spark, sf).groupBy("entry_id").agg(
        F.when(F.max_by("decision", "id") == "rejected", "disputed").otherwise("pinned").alias("state"), F.count_if(F.col("decision") == "approved").alias("edits")
    )


@query("ru_rotation", """WITH t AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
 SELECT event_id, CASE WHEN event_type = 'signup' THEN 'override' WHEN hour(ts) < 8 THEN 'closed' WHEN last IS NOT NULL AND epoch_us(ts) - epoch_us(last) < 86400000000 THEN 'wait' ELSE 'next' END AS decision FROM t""")
def rotation(spark, sf):
    """RU14, SS19: rotation decision."""
    ts = F.col("ts").cast("timestamp")
    t = D.table(spark, sf, "events").withColumn("ts", ts).withColumn("last", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")))
    early = F.col("last").isNotNull() & (F.unix_micros("ts") - F.unix_micros("last") < 86400000000)
    return t.select("event_id", F.when(F.col("event_type") == "signup", "override").when(F.hour("ts") < 8, "closed").when(early, "wait").otherwise("next").alias("decision"))


# How a failure's reason is classed; others are permanent.
OUTCOMES = {"timeout": "transient", "denied": "policy_blocked", "unsupported": "capability_unsupported", "unresolved": "unresolved_external", "cancelled": "user_cancelled"}
REASONS = ("timeout", "denied", "unsupported", "unresolved", "cancelled", "broken", "timeout")


@query("ss_failure_classes", over("publishes", body="SELECT adapter_id, outcome, count(*) AS n FROM (SELECT adapter_id, CASE [" + ", ".join(f"'{r}'" for r in REASONS) + "][length(artifact_id) * 3 % 7 + 1] " + " ".join(f"WHEN '{r}' THEN '{o}'" for r, o in OUTCOMES.items()) + " ELSE 'permanent' END AS outcome FROM publishes WHERE status = 'error') GROUP BY ALL"))
def failure_classes(spark, sf):
    """SS12: failures by adapter and one of six outcomes."""
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.length("artifact_id") * 3 % 7 + 1).cast("int"))
    outcome = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), reason), F.lit("permanent"))
    return D.publishes(spark, sf).where("status = 'error'").groupBy("adapter_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("ss_cursor_sync", over("remote", body="SELECT asset_id, revision FROM remote WHERE asset_id > 'a-00000050' AND revision IS DISTINCT FROM CASE WHEN star < 2 THEN revision WHEN star = 2 THEN NULL ELSE 'r0' END"))
def cursor_sync(spark, sf):
    """SS8: incremental cursor sync with tombstones."""
    r = D.remote(spark, sf)
    prev = r.select("asset_id", F.when(F.col("star") < 2, F.col("revision")).when(F.col("star") == 2, F.lit(None)).otherwise("r0").alias("had"))
    return r.where("asset_id > 'a-00000050'").join(prev, "asset_id").where(~F.col("revision").eqNullSafe(F.col("had"))).select("asset_id", "revision")


@query("ss_stream_first_seen", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_first_seen(spark, sf):
    """SS2, SS9: poll once."""
    return journal.first_seen(spark, f"{sf}/events.parquet")


@query("ss_stream_job_state", "SELECT user_id, count(*) AS attempts, max_by(event_type, event_id) AS state, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def stream_job_state(spark, sf):
    """SS5, SS10: done / error transition."""
    return journal.job_states(spark, f"{sf}/events.parquet")


@query("ss_stream_windows", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    """Events per six hours and type, late ones within a day included."""
    return journal.window_counts(spark, f"{sf}/events.parquet")
