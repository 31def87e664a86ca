"""Dialogue observations: attributes, patterns, tensions, profiles, citations and probes.

Evidence stays one row per observation: claims carry its count, so no claim gathers a corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.functions import vocabulary as V
from tessella.operators.latest import latest
from tessella.operators.ordering import numbered_by
from tessella.queries.taste import FIXED, LATEST_SIGNALS, SIGNAL_NAMES, signals
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


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(words) -> str:
    return " OR ".join(f"contains(low, {_q(w)})" for w in words)


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


ATTRIBUTED = (
    "--more lowered AS (SELECT *, lower(verbatim) AS low FROM observations), flat AS (SELECT *, flatten(["
    + ", ".join(f"CASE WHEN {_any(ws)} THEN {_list(tags)} ELSE [] END" for ws, tags in V.ATTRIBUTE_RULES)
    + "]) AS flat FROM lowered), attributed AS (SELECT id, session_id, verbatim, created_at, image, list_filter(flat, lambda x, i: list_position(flat, x) = i) AS attributes,\n"
    + f" CASE WHEN {_any(V.DISLIKE_CUES)} THEN 'dislike' WHEN {_any(V.LIKE_CUES)} THEN 'like' ELSE 'conflicted' END AS polarity FROM flat)\n"
)
TAGGED = ATTRIBUTED.rstrip() + ",\n tagged AS (SELECT id, session_id, verbatim, created_at, image, polarity, unnest(attributes) AS attribute FROM attributed)\n"
WORDS_SQL = "(VALUES " + ", ".join(f"({_q(w)}, {_q(tag)}, {i})" for w, tags in V.WORD_ATTRIBUTES for i, tag in enumerate(tags)) + ") w(word, attribute, rank)"
CONFIDENCE_SQL = "CASE polarity WHEN 'dislike' THEN 0.85 WHEN 'like' THEN 0.9 ELSE 0.3 END"
PATTERNS = (
    TAGGED.rstrip() + f""", held AS (SELECT attribute, count(*) AS n, max(created_at) AS created_at FROM tagged WHERE image IS NOT NULL GROUP BY attribute HAVING count(*) >= {V.LEAST_USES}),
 spoken AS (SELECT DISTINCT t.attribute, w.word FROM (SELECT attribute, unnest(string_split_regex(lower(verbatim), '[^a-z0-9]+')) AS word FROM tagged WHERE image IS NOT NULL) t JOIN {WORDS_SQL} ON w.word = t.word AND w.attribute = t.attribute),
 said AS (SELECT attribute, string_agg(word, ', ' ORDER BY word) AS words FROM spoken GROUP BY attribute),
 patterns AS (SELECT 'pattern:' || h.attribute AS id, h.attribute, 'you favor ' || h.attribute || coalesce(' — ' || s.words, '') || ' (' || h.n || ' uses)' AS text, h.n AS evidence, h.created_at FROM held h LEFT JOIN said s ON s.attribute = h.attribute)
"""
)
TENSIONS = (
    PATTERNS.rstrip() + """, poles AS (SELECT attribute, count(*) FILTER (polarity = 'like') AS likes, count(*) FILTER (polarity = 'dislike') AS dislikes, max(created_at) FILTER (polarity IN ('like', 'dislike')) AS both_at,
  max(created_at) FILTER (polarity = 'like') AS liked_at FROM tagged WHERE image IS NOT NULL GROUP BY attribute),
 tensions AS (SELECT 'tension:' || attribute || ':polarity' AS id, 'you describe ' || attribute || ' as both liked (' || likes || ' uses) and disliked (' || dislikes || ' uses) — surfaced, not smoothed.' AS text, likes + dislikes AS evidence, both_at AS created_at
   FROM poles WHERE likes > 0 AND dislikes > 0
  UNION ALL SELECT 'tension:' || a.attribute || ':' || b.attribute, 'you describe taste as ' || a.attribute || ' but also favor ' || b.attribute || ' scenes (' || a.likes || '/' || b.likes || ' uses) — surfaced, not smoothed.', a.likes + b.likes, greatest(a.liked_at, b.liked_at)
   FROM poles a JOIN (VALUES """ + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in V.CONTRAST_PAIRS) + """) c(a, b) ON c.a = a.attribute JOIN poles b ON c.b = b.attribute WHERE a.likes > 0 AND b.likes > 0)
"""
)
HISTORY = (
    LATEST_SIGNALS + """, picks AS (SELECT 'approval' AS source, entry_id, max_by(decision, id) = 'approved' AS liked FROM approvals GROUP BY entry_id UNION ALL SELECT 'pairwise', entry_id, preference > 0 FROM preferences WHERE retracted_at IS NULL AND preference <> 0),
 long AS (SELECT p.source, s.signal, p.liked, s.v FROM picks p JOIN latest l ON l.entry_id = p.entry_id, LATERAL (VALUES """ + ", ".join(f"('{s}', l.{s})" for s in SIGNAL_NAMES) + f""") s(signal, v)),
 leans AS (SELECT source, signal, count(*) FILTER (liked) AS picks, count(*) FILTER (NOT liked) > 0 AS contrasted, round(avg(v) FILTER (liked) - coalesce(avg(v) FILTER (NOT liked), {V.NEUTRAL}), 6) AS lean FROM long GROUP BY source, signal),
 history AS (SELECT 'history:' || source || ':' || signal AS id, signal, sign(lean) AS direction, source || (CASE source WHEN 'approval' THEN ' history' ELSE ' voting history' END) || ' suggests you lean toward ' || (CASE WHEN lean > 0 THEN 'high ' ELSE 'low ' END) || replace(signal, '_', ' ')
   || ' (' || picks || ' picks, ' || (CASE WHEN lean >= 0 THEN '+' ELSE '-' END) || printf('%.2f', abs(lean)) || ' vs ' || (CASE WHEN contrasted THEN 'the ones you passed on' ELSE 'neutral' END) || ') — inferred from history, not your words' AS text
   FROM leans WHERE picks >= {V.LEAST_PICKS} AND abs(lean) >= {V.LEAST_LEAN})
"""
)


def attributed(obs):
    """Each observation's tags in the rules' order, and its polarity."""
    low = F.lower("verbatim")

    def has(words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    tags = F.array_distinct(F.flatten(F.array(*[F.when(has(ws), F.array(*map(F.lit, ts))).otherwise(F.array().cast("array<string>")) for ws, ts in V.ATTRIBUTE_RULES])))
    polarity = F.when(has(V.DISLIKE_CUES), "dislike").when(has(V.LIKE_CUES), "like").otherwise("conflicted")
    return obs.select("id", "session_id", "verbatim", "created_at", "image", tags.alias("attributes"), polarity.alias("polarity"))


def confidence():
    return F.when(F.col("polarity") == "dislike", 0.85).when(F.col("polarity") == "like", 0.9).otherwise(0.3)


def tagged(obs):
    return attributed(obs).withColumn("attribute", F.explode("attributes")).drop("attributes")


def word_table(spark):
    return F.broadcast(spark.createDataFrame([(w, tag, i) for w, tags in V.WORD_ATTRIBUTES for i, tag in enumerate(tags)], "word string, attribute string, rank int"))


def patterns_of(obs):
    """Claims of tags that at least two observations with an image hold."""
    t = tagged(obs).where("image is not null")
    held = t.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("created_at")).where(F.col("n") >= V.LEAST_USES)
    spoken = t.select("attribute", F.explode(F.array_distinct(S.tokens(F.col("verbatim")))).alias("word")).join(word_table(obs.sparkSession), ["word", "attribute"]).groupBy("attribute")
    words = spoken.agg(F.array_join(F.array_sort(F.collect_set("word")), ", ").alias("words"))  # of the vocabulary's words
    text = F.concat(F.lit("you favor "), "attribute", F.coalesce(F.concat(F.lit(" — "), "words"), F.lit("")), F.lit(" ("), "n", F.lit(" uses)"))
    return held.join(words, "attribute", "left").select(F.concat(F.lit("pattern:"), "attribute").alias("id"), "attribute", text.alias("text"), F.col("n").alias("evidence"), "created_at")


def tensions_of(obs):
    """Tags both liked and disliked, and opposed tags both liked, among observations with an image."""
    like, dislike = F.col("polarity") == "like", F.col("polarity") == "dislike"
    poles = (
        tagged(obs).where("image is not null").groupBy("attribute")
        .agg(F.count_if(like).alias("likes"), F.count_if(dislike).alias("dislikes"), F.max(F.when(like | dislike, F.col("created_at"))).alias("both_at"), F.max(F.when(like, F.col("created_at"))).alias("liked_at"))
    )
    own = F.concat(F.lit("you describe "), "attribute", F.lit(" as both liked ("), "likes", F.lit(" uses) and disliked ("), "dislikes", F.lit(" uses) — surfaced, not smoothed."))
    one = poles.where("likes > 0 and dislikes > 0").select(F.concat(F.lit("tension:"), "attribute", F.lit(":polarity")).alias("id"), own.alias("text"), (F.col("likes") + F.col("dislikes")).alias("evidence"), F.col("both_at").alias("created_at"))
    liked = poles.where("likes > 0").select("attribute", "likes", "liked_at")
    pairs = F.broadcast(obs.sparkSession.createDataFrame(list(V.CONTRAST_PAIRS), "a string, b string"))
    both = liked.toDF("a", "la", "ta").join(pairs, "a").join(liked.toDF("b", "lb", "tb"), "b")
    text = F.concat(F.lit("you describe taste as "), "a", F.lit(" but also favor "), "b", F.lit(" scenes ("), "la", F.lit("/"), "lb", F.lit(" uses) — surfaced, not smoothed."))
    two = both.select(F.concat(F.lit("tension:"), "a", F.lit(":"), "b").alias("id"), text.alias("text"), (F.col("la") + F.col("lb")).alias("evidence"), F.greatest("ta", "tb").alias("created_at"))
    return one.unionByName(two)


def vocabulary_of(obs, *keys):
    """Uses of the vocabulary's words in all observations, with the word's own tag; by ``keys`` too."""
    own = word_table(obs.sparkSession).where("rank = 0").drop("rank")
    return obs.select(*keys, F.explode(S.tokens(F.col("verbatim"))).alias("word")).join(own, "word").groupBy(*keys, "word", "attribute").agg(F.count(F.lit(1)).alias("uses"))


VOCABULARY_SQL = f"(SELECT w.word, w.attribute, count(*) AS uses FROM (SELECT unnest(string_split_regex(lower(verbatim), '[^a-z0-9]+')) AS word FROM observations) t JOIN {WORDS_SQL} ON w.word = t.word AND w.rank = 0 GROUP BY ALL)"


def leans_of(spark, sf):
    a = latest(D.approvals(spark, sf).select("entry_id", "id", "decision"), ["entry_id"], "id").select(F.lit("approval").alias("source"), "entry_id", (F.col("decision") == "approved").alias("liked"))
    p = D.preferences(spark, sf).where("retracted_at is null and preference <> 0").select(F.lit("pairwise").alias("source"), "entry_id", (F.col("preference") > 0).alias("liked"))
    long = a.unionByName(p).join(signals(spark, sf), "entry_id").select("source", "liked", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in SIGNAL_NAMES])).alias("x")).select("source", "liked", "x.*")
    lean = F.avg(F.when(F.col("liked"), F.col("v"))) - F.coalesce(F.avg(F.when(~F.col("liked"), F.col("v"))), F.lit(V.NEUTRAL))
    return long.groupBy("source", "signal").agg(F.count_if("liked").alias("picks"), (F.count_if(~F.col("liked")) > 0).alias("contrasted"), F.round(lean, 6).alias("lean"))


def history_of(spark, sf):
    """Claims from approvals and votes: how the liked lean, where there are enough and the lean is large."""
    kept = leans_of(spark, sf).where((F.col("picks") >= V.LEAST_PICKS) & (F.abs("lean") >= V.LEAST_LEAN))
    label = F.concat("source", F.when(F.col("source") == "approval", " history").otherwise(" voting history"))
    text = F.concat(
        label, F.lit(" suggests you lean toward "), F.when(F.col("lean") > 0, "high ").otherwise("low "), F.replace("signal", F.lit("_"), F.lit(" ")), F.lit(" ("), "picks", F.lit(" picks, "),
        F.when(F.col("lean") >= 0, "+").otherwise("-"), F.format_string("%.2f", F.abs("lean")), F.lit(" vs "), F.when(F.col("contrasted"), "the ones you passed on").otherwise("neutral"), F.lit(") — inferred from history, not your words"),
    )
    return kept.select(F.concat_ws(":", F.lit("history"), "source", "signal").alias("id"), "signal", F.signum("lean").alias("direction"), text.alias("text"))


@query("fs_attributes", over("observations", body=ATTRIBUTED + f"SELECT id, attributes, polarity, {CONFIDENCE_SQL} AS confidence FROM attributed"))
def attributes(spark, sf):
    """FS4, FS5."""
    return attributed(D.observations(spark, sf)).select("id", "attributes", "polarity", confidence().alias("confidence"))


@query("ag_vocabulary", over("observations", body=f"SELECT * FROM {VOCABULARY_SQL}"))
def vocabulary(spark, sf):
    """AG11: uses of the controlled vocabulary's words."""
    return vocabulary_of(D.observations(spark, sf))


@query("ag_patterns", over("observations", body=PATTERNS + "SELECT id, text, evidence, created_at FROM patterns"))
def patterns(spark, sf):
    """AG12, FS3, FS7: pattern claims with their supporting words and newest stamp."""
    return patterns_of(D.observations(spark, sf)).drop("attribute")


@query("ag_tensions", over("observations", body=TENSIONS + "SELECT * FROM tensions"))
def tensions(spark, sf):
    """AG13: tensions of polarity and of opposed tags."""
    return tensions_of(D.observations(spark, sf))


@query("ag_evidence", over("observations", body=TAGGED + f"SELECT attribute, id, image, created_at, {CONFIDENCE_SQL} AS confidence, row_number() OVER (PARTITION BY attribute ORDER BY created_at, id) AS place FROM tagged WHERE image IS NOT NULL"))
def evidence(spark, sf):
    """AG37: each tag's evidence in order; a tag's rows are numbered across partitions."""
    t = tagged(D.observations(spark, sf)).where("image is not null").select("attribute", "id", "image", "created_at", confidence().alias("confidence"))
    n = numbered_by(t, "attribute", "created_at", "id", name="at")
    first = n.groupBy("attribute").agg(F.min("at").alias("first"))
    return n.join(F.broadcast(first), "attribute").select("attribute", "id", "image", "created_at", "confidence", (F.col("at") - F.col("first") + 1).alias("place"))


@query("ag_newest_citation", over("observations", body=TAGGED + f"SELECT attribute, arg_max(id, (created_at, image, id)) AS id, arg_max(md5(verbatim), (created_at, image, id)) AS quote, arg_max({CONFIDENCE_SQL}, (created_at, image, id)) AS confidence FROM tagged WHERE image IS NOT NULL GROUP BY attribute"))
def newest_citation(spark, sf):
    """AG16: the newest evidence of each tag, by stamp, image and id."""
    t = tagged(D.observations(spark, sf)).where("image is not null").withColumn("confidence", confidence()).withColumn("quote", F.md5(F.col("verbatim").cast("binary")))
    newest = F.max_by(F.struct("id", "quote", "confidence"), F.struct("created_at", "image", "id"))
    return t.groupBy("attribute").agg(newest.alias("x")).select("attribute", "x.id", "x.quote", "x.confidence")


CITED_SQL = """, top AS (SELECT id, attribute, evidence FROM patterns ORDER BY evidence DESC, id LIMIT 2),
 cited AS (SELECT top.id AS claim_id, top.evidence AS usage_count, arg_max(t.verbatim, (t.created_at, t.image, t.id)) AS quote, arg_max(""" + CONFIDENCE_SQL + """, (t.created_at, t.image, t.id)) AS confidence FROM top JOIN tagged t ON t.attribute = top.attribute AND t.image IS NOT NULL GROUP BY ALL)
"""


def cited(spark, sf, limit=2):
    """The best backed claims with their newest words; all patterns are spoken, so the most evidence comes first, then the id."""
    top = patterns_of(D.observations(spark, sf)).orderBy(F.desc("evidence"), "id").limit(limit).select("id", "attribute", "evidence")
    t = tagged(D.observations(spark, sf)).where("image is not null").withColumn("confidence", confidence())
    newest = F.max_by(F.struct(F.col("verbatim").alias("quote"), "confidence"), F.struct("created_at", "image", t["id"]))
    rows = t.join(F.broadcast(top.select(F.col("id").alias("claim_id"), "attribute", F.col("evidence").alias("usage_count"))), "attribute")
    return rows.groupBy("claim_id", "usage_count").agg(newest.alias("x")).select("claim_id", "usage_count", "x.quote", "x.confidence")


@query("sl_citations", over("observations", body=PATTERNS.rstrip() + CITED_SQL + "SELECT claim_id, usage_count, quote, confidence, 'high' AS provenance FROM cited"))
def citations(spark, sf):
    """SL5: two citations."""
    return cited(spark, sf).withColumn("provenance", F.lit("high"))


@query("jn_leanings", over("observations", body=PATTERNS.rstrip() + ", l AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{s}', {v})" for a, ls in V.ATTRIBUTE_SIGNALS.items() for s, v in (ls | ({"vibrancy": ls["colorfulness"]} if "colorfulness" in ls else {})).items()) + ") l(attribute, signal, leaning))\nSELECT p.id, l.signal, l.leaning::double AS leaning FROM patterns p JOIN l ON l.attribute = p.attribute"))
def leanings(spark, sf):
    """JN27, FM26: the signals that each pattern leans on."""
    return leanings_of(spark, sf).select("id", "signal", "leaning")


def leaning_table(spark):
    rows = [(a, s, v) for a, ls in V.ATTRIBUTE_SIGNALS.items() for s, v in (ls | ({"vibrancy": ls["colorfulness"]} if "colorfulness" in ls else {})).items()]
    return F.broadcast(spark.createDataFrame(rows, "attribute string, signal string, leaning double"))


def leanings_of(spark, sf):
    return patterns_of(D.observations(spark, sf)).join(leaning_table(spark), "attribute")


@query("ag_cold_start", over("approvals", "preferences", "analyses", body="--more " + HISTORY + f"SELECT l.source, l.signal, l.picks, l.lean, h.text FROM leans l LEFT JOIN history h ON h.id = 'history:' || l.source || ':' || l.signal"))
def cold_start(spark, sf):
    """AG14, JN4: leans per source and signal, with the claim's text where the lean makes one."""
    h = history_of(spark, sf).select("id", "text")
    l = leans_of(spark, sf).withColumn("id", F.concat_ws(":", F.lit("history"), "source", "signal"))
    return l.join(h, "id", "left").select("source", "signal", "picks", "lean", "text")


@query("st_seed_claims", over("observations", "approvals", "preferences", "analyses", body=PATTERNS.rstrip() + ",\n " + HISTORY + "SELECT id, 'spoken' AS origin FROM patterns UNION ALL SELECT id, 'seeded' FROM history WHERE id NOT IN (SELECT id FROM patterns)"))
def seed_claims(spark, sf):
    """ST6: history claims are added where no claim has their id."""
    p = patterns_of(D.observations(spark, sf)).select("id", F.lit("spoken").alias("origin"))
    return p.unionByName(history_of(spark, sf).select("id", F.lit("seeded").alias("origin")).join(p.select("id"), "id", "left_anti"))


TOTALS_SQL = ", l AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{s}', {v})" for a, ls in V.ATTRIBUTE_SIGNALS.items() for s, v in (ls | ({"vibrancy": ls["colorfulness"]} if "colorfulness" in ls else {})).items()) + f""") l(attribute, signal, leaning)),
 pull AS (SELECT signal, sum(w) AS w FROM (SELECT l.signal, l.leaning::double AS w FROM patterns p JOIN l ON l.attribute = p.attribute UNION ALL SELECT signal, {V.UNSPOKEN} * direction FROM history) GROUP BY signal)
"""


@query("fm_profile_fit", over("observations", "approvals", "preferences", "analyses", body=PATTERNS.rstrip() + ",\n " + HISTORY.rstrip() + TOTALS_SQL + " SELECT e.entry_id, round(coalesce(sum(p.w * e.v), 0.0)::decimal(18,8), 4)::double AS fit FROM (SELECT entry_id, s.signal, s.v FROM latest l, LATERAL (VALUES " + ", ".join(f"('{s}', l.{s})" for s in SIGNAL_NAMES) + ", ('vibrancy', l.colorfulness)) s(signal, v)) e LEFT JOIN pull p ON p.signal = e.signal GROUP BY e.entry_id"))
def profile_fit(spark, sf):
    """FM19: how each entry's signals fit the claims; unspoken claims weigh a quarter."""
    spoken = leanings_of(spark, sf).select("signal", F.col("leaning").alias("w"))
    pull = spoken.unionByName(history_of(spark, sf).select("signal", (V.UNSPOKEN * F.col("direction")).alias("w"))).groupBy("signal").agg(F.sum("w").alias("w"))
    # at most six signals
    table = F.broadcast(pull.agg(F.map_from_entries(F.collect_list(F.struct("signal", "w"))).alias("pull")))
    parts = [F.coalesce(F.element_at("pull", F.lit(s)), F.lit(0.0)) * F.col(c) for s, c in (*((s, s) for s in SIGNAL_NAMES), ("vibrancy", "colorfulness"))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return signals(spark, sf).join(table).select("entry_id", F.round(total.cast("decimal(18,8)"), 4).cast("double").alias("fit"))


@query("wn_dimension_order", over("observations", body=PATTERNS + "SELECT attribute AS dimension, row_number() OVER (ORDER BY id) AS place FROM patterns"))
def dimension_order(spark, sf):
    """WN16: the dimensions that the profile names, in its order; at most as many as tags."""
    return patterns_of(D.observations(spark, sf)).select(F.col("attribute").alias("dimension"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("place"))


@query("wn_dial_reversal", over("observations", body=PATTERNS + "SELECT d.dial, attribute AS dimension, row_number() OVER (PARTITION BY d.dial ORDER BY CASE WHEN d.dial > 0 THEN r ELSE -r END DESC) AS place FROM (SELECT attribute, row_number() OVER (ORDER BY id) AS r FROM patterns), (VALUES (-1.0::double), (0.0::double), (0.5::double)) d(dial)"))
def dial_reversal(spark, sf):
    """WN14: the profile's dimensions forwards on the familiar side of the dial, backwards beyond it."""
    r = patterns_of(D.observations(spark, sf)).select("attribute", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("r"))
    dials = F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.5)))
    w = Window.partitionBy("dial").orderBy(F.when(F.col("dial") > 0, F.col("r")).otherwise(-F.col("r")).desc())
    return r.withColumn("dial", dials).select("dial", F.col("attribute").alias("dimension"), F.row_number().over(w).alias("place"))


ITEMS_SQL = f"SELECT 'word' AS kind, word AS name, uses AS n FROM {VOCABULARY_SQL} UNION ALL SELECT 'pattern', attribute, evidence FROM patterns UNION ALL SELECT 'tension', id, evidence FROM tensions"
#: A profile is built before this day and again with all observations.
BEFORE = "2024-01-15"
NEW_SQL = over("observations", body=TENSIONS + ITEMS_SQL)
OLD_SQL = f"WITH observations AS (SELECT * FROM ({D.SQL['observations']}) WHERE created_at < '{BEFORE}'),\n" + (TENSIONS + ITEMS_SQL).replace("--more", "")
CHANGES = {"word": ("added '", "' to vocabulary", "dropped '", "' from vocabulary"), "pattern": ("new pattern: ", "", "retired pattern: ", ""), "tension": ("new tension surfaced: ", "", "tension resolved: ", "")}


def items_of(obs):
    """What a profile holds: words, patterns and tensions, each with its uses. No more than the
    vocabulary allows."""
    words = vocabulary_of(obs).select(F.lit("word").alias("kind"), F.col("word").alias("name"), F.col("uses").alias("n"))
    patterns = patterns_of(obs).select(F.lit("pattern").alias("kind"), F.col("attribute").alias("name"), F.col("evidence").alias("n"))
    return words.unionByName(patterns).unionByName(tensions_of(obs).select(F.lit("tension").alias("kind"), F.col("id").alias("name"), F.col("evidence").alias("n")))


@query("st_vocabulary_evolution", "SELECT coalesce(n.kind, o.kind) AS kind, CASE coalesce(n.kind, o.kind) " + " ".join(
    f"WHEN '{k}' THEN CASE WHEN o.name IS NULL THEN {_q(a)} || n.name || {_q(b)} ELSE {_q(c)} || o.name || {_q(d)} END" for k, (a, b, c, d) in CHANGES.items()
) + f" END AS summary FROM ({NEW_SQL}) n FULL JOIN ({OLD_SQL}) o ON o.kind = n.kind AND o.name = n.name WHERE n.name IS NULL OR o.name IS NULL")
def vocabulary_evolution(spark, sf):
    """ST2: words, patterns and tensions that the profile of all observations has gained or lost
    against that of those before a day."""
    obs = D.observations(spark, sf)
    now, then = items_of(obs), items_of(obs.where(F.col("created_at") < BEFORE))
    both = now.select("kind", "name", F.lit(True).alias("new")).join(then.select("kind", "name", F.lit(True).alias("old")), ["kind", "name"], "full")
    summary = F.lit(None).cast("string")
    for k, (a, b, c, d) in CHANGES.items():
        text = F.when(F.col("old").isNull(), F.concat(F.lit(a), "name", F.lit(b))).otherwise(F.concat(F.lit(c), "name", F.lit(d)))
        summary = F.when(F.col("kind") == k, text).otherwise(summary)
    return both.where("new is null or old is null").select("kind", summary.alias("summary"))


@query("st_session_delta", over("observations", body=TAGGED.rstrip() + f""", words AS (SELECT 'word' AS kind, t.session_id, t.word AS name, count(*) AS own FROM (SELECT session_id, unnest(string_split_regex(lower(verbatim), '[^a-z0-9]+')) AS word FROM observations) t JOIN {WORDS_SQL} ON w.word = t.word AND w.rank = 0 GROUP BY ALL),
 tags AS (SELECT 'pattern', session_id, attribute, count(*) FROM tagged WHERE image IS NOT NULL GROUP BY ALL), parts AS (SELECT * FROM words UNION ALL SELECT * FROM tags), whole AS (SELECT kind, name, sum(own) AS n FROM parts GROUP BY ALL)
 SELECT session_id, summary FROM (SELECT p.session_id, CASE WHEN p.kind = 'word' AND w.n = p.own THEN 'added ''' || p.name || ''' to vocabulary' WHEN p.kind = 'pattern' AND w.n >= 2 AND w.n - p.own < 2 THEN 'new pattern: ' || p.name
  WHEN p.kind = 'pattern' AND w.n >= 2 THEN p.name || ' reinforced (' || w.n::bigint || ' evidence refs)' END AS summary FROM parts p JOIN whole w USING (kind, name)) WHERE summary IS NOT NULL"""))
def session_delta(spark, sf):
    """ST3, ST4: what each session adds, as the profile with its observations against that without."""
    obs = D.observations(spark, sf)
    words = vocabulary_of(obs, "session_id").select(F.lit("word").alias("kind"), "session_id", F.col("word").alias("name"), F.col("uses").alias("own"))
    tags = tagged(obs).where("image is not null").groupBy("session_id", "attribute").agg(F.count(F.lit(1)).alias("own")).select(F.lit("pattern").alias("kind"), "session_id", F.col("attribute").alias("name"), "own")
    parts = words.unionByName(tags)
    whole = F.broadcast(parts.groupBy("kind", "name").agg(F.sum("own").alias("n")))  # of the vocabulary's words and tags
    n, own, name = F.col("n"), F.col("own"), F.col("name")
    summary = (
        F.when((F.col("kind") == "word") & (n == own), F.concat(F.lit("added '"), name, F.lit("' to vocabulary")))
        .when((F.col("kind") == "pattern") & (n >= 2) & (n - own < 2), F.concat(F.lit("new pattern: "), name))
        .when((F.col("kind") == "pattern") & (n >= 2), F.concat(name, F.lit(" reinforced ("), n, F.lit(" evidence refs)")))
    )
    return parts.join(whole, ["kind", "name"]).select("session_id", summary.alias("summary")).where("summary is not null")


@query("ag_profile_document", over("observations", body=TENSIONS + f"""SELECT 1 AS version, (SELECT max(created_at) FROM observations) AS created_at,
 (SELECT list(word || ':' || attribute || ':' || uses ORDER BY word) FROM {VOCABULARY_SQL}) AS vocabulary,
 (SELECT list(id || '|' || text || '|active|high|' || evidence || '|' || created_at ORDER BY id) FROM patterns) AS patterns,
 (SELECT list(id || '|' || text || '|active|high|' || evidence || '|' || created_at ORDER BY id) FROM tensions) AS tensions,
 'initial profile: ' || (SELECT count(*) FROM patterns) || ' patterns, ' || (SELECT count(*) FROM tensions) || ' tensions, ' || (SELECT count(*) FROM {VOCABULARY_SQL}) || ' vocabulary words' AS evolution"""))
def profile_document(spark, sf):
    """AG38: the profile of all observations as one nested row; its lists are no longer than the
    vocabulary, and evidence is counted."""
    obs = D.observations(spark, sf)

    def listed(df, name, first, rest):
        ordered = F.array_sort(F.collect_list(F.struct(first, rest.alias("x"))))
        return df.agg(F.transform(ordered, lambda r: r["x"]).alias(name))

    claim = F.concat_ws("|", "id", "text", F.lit("active"), F.lit("high"), "evidence", "created_at")
    words = listed(vocabulary_of(obs), "vocabulary", "word", F.concat_ws(":", "word", "attribute", "uses"))
    one = obs.agg(F.max("created_at").alias("created_at")).join(words).join(listed(patterns_of(obs), "patterns", "id", claim)).join(listed(tensions_of(obs), "tensions", "id", claim))  # one row each
    text = F.concat(F.lit("initial profile: "), F.size("patterns"), F.lit(" patterns, "), F.size("tensions"), F.lit(" tensions, "), F.size("vocabulary"), F.lit(" vocabulary words"))
    lists = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("vocabulary", "patterns", "tensions")]
    return one.select(F.lit(1).alias("version"), "created_at", *lists, text.alias("evolution"))


PARTS_SQL = ", parts AS (SELECT entry_id, p.signal, p.c FROM latest, LATERAL (VALUES " + ", ".join(f"('{s}', round(({w}) * {s}, 6))" for s, w in FIXED.items()) + """) p(signal, c)),
 strongest AS (SELECT entry_id, round(sum(c)::decimal(18,6), 3)::double AS delta, arg_max(signal, (abs(c), signal)) AS signal, max(abs(c)) AS size FROM parts GROUP BY entry_id)
"""


@query("ru_explain_rank", over("observations", "analyses", body=PATTERNS.rstrip() + ",\n " + LATEST_SIGNALS + PARTS_SQL.rstrip() + CITED_SQL + """SELECT entry_id, delta, (CASE WHEN delta > 0 THEN 'ranked up' WHEN delta < 0 THEN 'ranked down' ELSE 'unchanged' END) || ' (' || (CASE WHEN delta < 0 THEN '-' ELSE '+' END) || printf('%.3f', abs(delta)) || ')'
 || (CASE WHEN size = 0 THEN '' ELSE ' — strongest signal ' || replace(signal, '_', ' ') END) AS rationale, coalesce((SELECT string_agg('you''ve called this ''' || md5(quote) || ''' ' || usage_count || (CASE WHEN usage_count = 1 THEN ' time' ELSE ' times' END), '; ' ORDER BY usage_count DESC, claim_id) FROM cited), '') AS citations FROM strongest"""))
def explain_rank(spark, sf):
    """RU13, AG17, FS7: each entry's delta, the words for it, and the profile's citations (their quotes
    by hash, as the same ones stand at each entry)."""
    parts = F.array(*[F.struct(F.abs(F.round(F.lit(w) * F.col(s), 6)).alias("size"), F.lit(s).alias("signal"), F.round(F.lit(w) * F.col(s), 6).alias("c")) for s, w in FIXED.items()])
    total = F.round(F.aggregate(parts, F.lit(0.0), lambda x, p: x + p["c"]).cast("decimal(18,6)"), 3).cast("double")
    each = signals(spark, sf).select("entry_id", total.alias("delta"), F.array_max(parts).alias("top"))
    d = F.col("delta")
    signed = F.concat(F.when(d < 0, "-").otherwise("+"), F.format_string("%.3f", F.abs(d)))
    way = F.when(d > 0, "ranked up").when(d < 0, "ranked down").otherwise("unchanged")
    strongest = F.when(F.col("top.size") == 0, "").otherwise(F.concat(F.lit(" — strongest signal "), F.replace("top.signal", F.lit("_"), F.lit(" "))))
    times = F.when(F.col("usage_count") == 1, " time").otherwise(" times")
    said = cited(spark, sf).select((-F.col("usage_count")).alias("o"), "claim_id", F.concat(F.lit("you've called this '"), F.md5(F.col("quote").cast("binary")), F.lit("' "), "usage_count", times).alias("text"))
    quotes = F.broadcast(said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "claim_id", "text"))), lambda x: x["text"]), "; ").alias("citations")))  # two at most
    return each.join(quotes).select("entry_id", "delta", F.concat(way, F.lit(" ("), signed, F.lit(")"), strongest).alias("rationale"), "citations")


@query("ru_probe_questions", over("observations", body=ATTRIBUTED.rstrip() + ", probes AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(c)}, {_q(g)}, {_q(t)})" for i, (c, g, t) in enumerate(V.PROBES)) + f""") p(o, cue, gap, text)),
 fits AS (SELECT a.id, p.gap, min(p.o) AS o, arg_min(p.text, p.o) AS text FROM attributed a JOIN probes p ON list_contains(a.attributes, p.cue) AND NOT list_contains(a.attributes, p.gap) GROUP BY a.id, p.gap),
 numbered AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM fits)
 SELECT * FROM numbered WHERE n <= 2 UNION ALL SELECT id, {_q(V.OPENING_PROBE)}, 1 FROM attributed WHERE len(attributes) = 0"""))
def probe_questions(spark, sf):
    """RU11: two questions about tags that are missing beside those that are there, one per gap."""
    a = attributed(D.observations(spark, sf)).select("id", "attributes")
    probes = F.array(*[F.struct(F.lit(c).alias("cue"), F.lit(g).alias("gap"), F.lit(t).alias("text")) for c, g, t in V.PROBES])
    fits = F.filter(probes, lambda p: F.array_contains("attributes", p["cue"]) & ~F.array_contains("attributes", p["gap"]))
    first = F.filter(F.col("fits"), lambda p, i: F.array_position(F.transform("fits", lambda q: q["gap"]), p["gap"]) == i + 1)
    texts = F.when(F.size("attributes") == 0, F.array(F.lit(V.OPENING_PROBE))).otherwise(F.slice(F.transform(first, lambda p: p["text"]), 1, 2))
    asked = a.withColumn("fits", fits).select("id", F.posexplode(texts).alias("pos", "text"))
    return asked.select("id", "text", (F.col("pos") + 1).cast("long").alias("n"))


@query("fs_claim_dimension", over("observations", body=TENSIONS + "SELECT id, CASE WHEN id LIKE 'pattern:%' THEN substr(id, 9) WHEN id LIKE 'history:%' THEN split_part(id, ':', 3) ELSE '' END AS dimension FROM (SELECT id FROM patterns UNION ALL SELECT id FROM tensions UNION ALL SELECT DISTINCT 'history:' || session_id || ':' || polarity FROM tagged)"))
def claim_dimension(spark, sf):
    """FS6: what a claim's id names."""
    obs = D.observations(spark, sf)
    other = tagged(obs).select(F.concat_ws(":", F.lit("history"), "session_id", "polarity").alias("id")).distinct()
    ids = patterns_of(obs).select("id").unionByName(tensions_of(obs).select("id")).unionByName(other)
    name = F.when(F.col("id").startswith("pattern:"), F.substring("id", 9, 1 << 20)).when(F.col("id").startswith("history:"), F.substring_index("id", ":", -1)).otherwise("")
    return ids.select("id", name.alias("dimension"))
