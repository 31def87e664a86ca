"""URL filtering by a path-template tree per host.

Listed rules decide the urls they fit and label them. For all others a tree is learnt per host:
a url's path is a chain of segments; a segment with a digit, or one whose siblings are many and
thinly spread, is generalised into a wildcard. The other siblings are put in the order of their shares
of blocked and allowed urls, and neighbours are merged where they are statistically alike: none of
their shares of blocked, allowed and unlabelled urls differs by more than ``Z`` standard errors. So
unlike branches stay apart, however many of each kind there are, and alike ones share what is known
of them. Each remaining node is a template with a purity, the share of blocked urls among its labelled
ones, smoothed towards ``NEUTRAL`` so that a template without labels is not rejected. A url takes the
purity of its deepest template and is blocked at ``reject`` or more.

The tree is built level by level with grouped counts, so a host with a third of all pages is
combined before each shuffle, and urls of one host never meet in one task. What urls and chains are
joined with is written first, so that adaptive execution can split a host of many chains.

Defined cases: a url that is null or has no ``://`` has empty host and path and is judged by the
root of the empty host; repeated urls count as often as they stand; of fitting rules of equal length
the later listed wins; the segments below the last level of a long path are one segment, and no url
is cut; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans import materialise, scratch

#: Rules of the query: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Levels of the tree; the segments below the last are one segment of it. Levels that no url reaches
#: are not built.
DEPTH = 8
#: A parent with more distinct children than this, each seen less than ``THIN`` times on average, varies.
CHILDREN, THIN = 16, 8.0
#: The purity that no label gives, its weight in labelled urls, and the standard errors of a
#: difference that counts.
NEUTRAL, PRIOR, Z = 0.25, 8.0, 3.0
REJECT = 0.5
WILD = "*"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #``, then up to ``? #``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, written host then path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The path's non-empty segments, wildcards put for those with digits, the last of ``depth``
    taking all that follow."""
    own = F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), F.lit(WILD)).otherwise(s)
    )
    return F.when(F.size(own) <= depth, own).otherwise(
        F.concat(F.slice(own, 1, depth - 1), F.array(F.array_join(F.slice(own, depth, 1 << 20), "/")))
    )


def shares(of: dict[str, Column]) -> list[Column]:
    """The smoothed shares of a branch's urls (n, labelled, blocked) that are blocked, allowed and
    unlabelled."""
    return [(k + 1.0) / (of["n"] + 3.0) for k in (of["blocked"], of["labelled"] - of["blocked"], of["n"] - of["labelled"])]


def unlike(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the urls of two branches differ in any share."""
    out = F.lit(False)
    for p, q in zip(shares(a), shares(b), strict=True):
        out = out | (F.abs(p - q) > Z * F.sqrt(p * (1 - p) / (a["n"] + 3.0) + q * (1 - q) / (b["n"] + 3.0)))
    return out


COUNTS = ("n", "labelled", "blocked")


def judged(pages: DataFrame, rules=RULES, depth: int = DEPTH, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    with scratch(pages.sparkSession) as result:
        rows = materialise(
            split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), segments(F.col("path"), depth).alias("segments")),
            "urls",
        )
        # the counts of each distinct chain are all that the tree needs
        counts = [F.sum(k).alias(k) for k in COUNTS]
        chains = rows.groupBy("host", "segments").agg(
            F.count(F.lit(1)).alias("n"), F.count("listed").alias("labelled"), F.count_if(F.col("listed") == "block").alias("blocked")
        )
        chains = materialise(chains, "chains")
        purity = (F.col("blocked") + PRIOR * NEUTRAL) / (F.col("labelled") + PRIOR)
        roots = materialise(chains.groupBy("host").agg(*counts).select("host", F.lit("").alias("template"), purity.alias("purity")), "roots")
        tree = materialise(chains.join(roots, "host"), "tree-0")
        own = {k: F.col(k) for k in COUNTS}
        for level in range(depth):
            here = tree.withColumn("segment", F.get("segments", F.lit(level)))
            children = materialise(here.where("segment is not null").groupBy("host", "template", "segment").agg(*counts), f"children-{level}")
            if children.isEmpty():
                break
            fixed = F.col("segment") != WILD
            spread = children.groupBy("host", "template").agg(
                ((F.count_if(fixed) > CHILDREN) & (F.coalesce(F.sum(F.when(fixed, F.col("n"))), F.lit(0)) < THIN * F.count_if(fixed))).alias("thin")
            )
            named = children.join(materialise(spread, f"spread-{level}"), ["host", "template"]).withColumn("varies", F.col("thin") | ~fixed)
            # siblings that stay: as each stands for THIN urls or there are CHILDREN at most, far fewer than urls
            order = Window.partitionBy("host", "template", "varies").orderBy(*shares(own)[:2], "segment")
            before = {k: F.lag(k).over(order) for k in COUNTS}
            begins = F.when(F.col("varies") | before["n"].isNull(), F.lit(0)).otherwise(unlike(own, before).cast("int"))
            named = named.withColumn("begins", begins).withColumn("part", F.when(F.col("varies"), -1).otherwise(F.sum("begins").over(order)))
            named = materialise(named.select("host", "template", "segment", "part", *COUNTS), f"named-{level}")
            # a path holds no #, so that a merged branch's name is no segment's
            several = F.when(F.count(F.lit(1)) > 1, F.concat(F.lit("#"), F.count(F.lit(1)))).otherwise("")
            name = F.when(F.col("part") < 0, WILD).otherwise(F.concat(F.min("segment"), several))
            branches = named.groupBy("host", "template", "part").agg(*counts, name.alias("branch"))
            branches = materialise(branches.select("host", "template", "part", "branch", purity.alias("b_purity")), f"branches-{level}")
            given = materialise(named.select("host", "template", "segment", "part").join(branches, ["host", "template", "part"]).drop("part"), f"given-{level}")
            tree = materialise(
                here.join(given, ["host", "template", "segment"], "left").select(
                    "host", "segments", *COUNTS,
                    F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch")).alias("template"),
                    F.coalesce("b_purity", "purity").alias("purity"),
                ),
                f"tree-{level + 1}",
            )
        placed = rows.join(tree.select("host", "segments", "template", "purity"), ["host", "segments"])
        final = placed.select(
            "page_id", "host", "path", "rule",
            F.coalesce("listed", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity",
        )
        return result(final, "judged")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
