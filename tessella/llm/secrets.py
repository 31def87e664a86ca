"""Secret scans over a content-addressed ledger.

Every version of a text is a blob named by its SHA-256. A ledger holds which (blob, rule, version)
triples were scanned and what was found. A run scans each unseen triple once, whatever number of
paths carry the blob, appends to the ledger, and joins the findings back to all paths. Raising a
rule's version rescans all blobs with that rule only.

A ledger is kept in a folder: a run asks it first, by hash, and only texts of unseen pairs are moved
and scanned; with nothing new no text is read twice or shuffled. What is missing is appended. A run
that ends in the middle may leave some of its rows, and two runs at once the same rows: a later run
scans what is missing, and rows of one blob, rule and version count once.

Defined cases: a null text counts as empty and finds nothing; copies are scanned once and each
gets the findings; spans count code points, the end is exclusive; of spans with one start the kinds
are listed in the rules' order; a long text is scanned whole; repeated rows are rows of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.text import arrow_bytes, chunks, doc_id, text_or_empty
from tessella.plans import broadcast_if_small, materialise
from tessella.plans.materialise import shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost, not overlapping, and dropped where ``group`` is
    shorter than ``least``. ``marks`` are lower-case strings, one of which any match contains."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    marks: tuple[str, ...] = ()
    flags: int = re.ASCII
    version: int = 1


#: The kinds in the order in which spans of one start are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("passw", "secret", "token", "api"), re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 20, marks=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, marks=("-----begin ",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, marks=("eyj",)),
    Rule("forge", r"\bgh[pousr]_[A-Za-z0-9]+", 40, marks=("gh",)),
    Rule("bearer", r"\bbearer\x20+([A-Za-z0-9+/_.~-]+=*)", 16, 1, ("bearer",), re.ASCII | re.IGNORECASE),
    Rule("userinfo", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/@]+)@", 6, 1, ("://",)),
)
BASE = ("assign", "access", "hex")
_HEXES = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))

#: Unseen blobs up to which their list is broadcast to the scan of texts.
SMALL = 1_000_000

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def find(rule: Rule, compiled: re.Pattern, text: str, lowered: str, raw: bytes) -> list[tuple[int, int]]:
    """The spans of one rule. The marks only spare the pattern where it cannot match."""
    if rule.kind == "hex":
        if b"x" * rule.least not in raw.translate(_HEXES):
            return []
    elif rule.marks and not any(m in lowered for m in rule.marks):
        return []
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id and blob (the text's SHA-256) of every row; no text."""
    text = text_or_empty()
    return docs.select(doc_id(), F.sha2(text.cast("binary"), 256).alias("blob"))


def distinct_blobs(docs: DataFrame) -> DataFrame:
    """One row per distinct text: blob and text. Copies inside a task go before the shuffle."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in chunks(batches, "text"):
            keep, names = [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                name = hashlib.sha256(text.encode()).digest()
                if name not in seen:
                    seen.add(name)
                    keep.append(i)
                    names.append(name.hex())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), part.column("text").take(pa.array(keep, pa.int64()))], names=["blob", "text"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(named, "blob string, text string").dropDuplicates(["blob"])


def unseen(names: DataFrame, seen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, done) of the blobs of ``names`` that lack a rule's present version in ``seen`` (blob, kind,
    version); done: the kinds that they have."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    had = seen.where(F.array_contains(current, F.struct("kind", "version"))).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    every = names.select("blob").distinct().join(had, "blob", "left")
    return every.withColumn("done", F.coalesce("done", F.array().cast("array<string>"))).where(F.size("done") < len(rules))


def scan(content: DataFrame, rules: tuple[Rule, ...] = RULES, seen: DataFrame | None = None) -> DataFrame:
    """New ledger rows of ``content`` (blob, text): one per blob and rule version not in ``seen``
    (blob, kind, version). Blobs whose pairs are all seen are never shipped to Python."""
    todo = content.withColumn("done", F.array().cast("array<string>")) if seen is None else content.join(unseen(content, seen, rules), "blob")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern, r.flags)) for r in rules]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for part in chunks(batches, "text"):
            out: list[tuple] = []
            for blob, text, done in zip(*(part.column(c).to_pylist() for c in ("blob", "text", "done")), strict=True):
                lowered, raw = text.lower(), text.encode()
                for rule, pattern in compiled:
                    if rule.kind not in done:
                        out.append((blob, rule.kind, rule.version, [{"start": a, "end": b} for a, b in find(rule, pattern, text, lowered, raw)]))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), span), strict=True)], names=["blob", "kind", "version", "spans"])

    return todo.select("blob", "text", "done").mapInArrow(scanned, LEDGER)


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All paths (any columns and ``blob``) with ``found``: the current rules' spans as an array of
    (start, rank, kind, end) in order; empty where nothing was found."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", i)])
    current = ledger.withColumn("rank", F.element_at(rank, F.concat_ws(":", "kind", "version"))).where("rank is not null and size(spans) > 0")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end")))
    per = current.dropDuplicates(["blob", "kind", "version"]).select("blob", spans.alias("s")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("found"))
    # at most one ledger row per rule is gathered; written first, so that the paths of one frequent blob can be split
    per = materialise(per, "found")
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return paths.join(per, "blob", "left").withColumn("found", F.coalesce("found", nothing))


def read_ledger(spark: SparkSession, at: str) -> DataFrame:
    """The ledger in the folder ``at``; empty if it holds none yet."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(at)
    return spark.read.schema(LEDGER).parquet(at)


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The paths with their findings, and the ledger in the folder ``at`` (a new one if none is
    named) with this run's rows appended: one per unseen blob and rule version, found or not."""
    spark = docs.sparkSession
    at = at or f"{shared_dir(spark)}/tessella/ledger-{uuid.uuid4().hex}"
    seen = read_ledger(spark, at)
    with arrow_bytes(spark):
        if seen.isEmpty():
            scan(distinct_blobs(docs), rules).write.mode("append").parquet(at)
        else:
            # the ledger is asked by hash; texts follow only where something is missing
            todo = materialise(unseen(blobs(docs), seen.select("blob", "kind", "version"), rules), "unseen")
            if not todo.isEmpty():
                named = docs.withColumn("blob", F.sha2(text_or_empty().cast("binary"), 256)).select("blob", text_or_empty().alias("text"))
                own = named.join(broadcast_if_small(todo.select("blob"), SMALL), "blob", "left_semi")
                scan(distinct_blobs(own), rules, seen.select("blob", "kind", "version")).write.mode("append").parquet(at)
    ledger = spark.read.schema(LEDGER).parquet(at)
    return findings_by_path(blobs(docs), ledger, rules), ledger


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found, _ = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
