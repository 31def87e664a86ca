"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case;
128 bits of hash stand for it. A batch of documents gives a sorted run: each key's hash and the number
of the batch's documents that hold it. Before it is added, the batch is merge-anti-joined with the
runs that are there: a key that one of them shows in ``settle`` documents is decided and is neither
counted nor written again. When a level has ``fanout`` runs they are merged into one run of the next
level, so a key is rewritten a logarithmic number of times. With ``settle`` 1 this is incremental
deduplication: ``add`` gives the keys that no earlier batch had.

Runs are tables in the shared folder, bucketed and sorted by hash: a batch is shuffled once, by hash,
and all joins and merges with runs read bucket by bucket without another shuffle. Copies of a key are
combined in each task first, so a very common line is one row a task. In the end the lines of each
document are looked up among the keys of ``settle`` documents or more, and a document's dropped
places, one small array, are joined back to it.

Everything is DataFrame functions. Defined cases: a null or empty text is one empty line; a key of
fewer than ``least`` code points stays; a document counts once for a key however often it repeats it;
equal rows are documents of their own; a document all of whose lines go is the empty text; long texts
are split whole; ids, null ones too, and other columns come back as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.text import text_or_empty
from tessella.plans import broadcast_if_small, materialise, scratch
from tessella.plans.materialise import remove, shared_dir

#: Documents that must hold a key for its lines to go, and the code points that a key has at least.
DOCUMENTS, LEAST = 10, 1
#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Batches that the query cuts its table into, by file.
BATCHES = 4
#: Rows of keys up to which they are broadcast; beyond it the join shuffles.
SMALL = 100_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    # lower() does the same as translate() where all characters are ASCII, and is much faster
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))


def _hashes(*columns: str) -> tuple[Column, Column]:
    """Two 64-bit hashes with unlike seeds."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def counted(batch: DataFrame, least: int = LEAST) -> DataFrame:
    """h1, h2 and n: the keys of a batch and the number of its documents that hold them."""
    each = batch.select(F.explode(F.array_distinct(keys(text_or_empty()))).alias("key")).where(F.char_length("key") >= least)
    h1, h2 = _hashes("key")
    return each.groupBy(h1.alias("h1"), h2.alias("h2")).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """Sorted runs of line hashes by level; ``close`` removes them."""

    def __init__(self, spark: SparkSession, settle: int = DOCUMENTS, fanout: int = FANOUT, least: int = LEAST):
        self.spark, self.settle, self.fanout, self.least = spark, settle, fanout, least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        """A run as a table with one sorted file per bucket of hashes."""
        name = f"tessella_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{shared_dir(self.spark)}/tessella/{name}"
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch's run and give it: the keys that no run had decided, with their counts."""
        own = counted(batch, self.least)
        for run in self.runs():
            own = own.join(run.where(F.col("n") >= self.settle), ["h1", "h2"], "left_anti")
        name = self._write(own)
        self._place(name, 0)
        return self.spark.table(name)

    def _place(self, name: str, level: int) -> None:
        """Put a run on its level. The runs of a full level are merged only when the next one comes,
        so that a run just added can still be read."""
        if level == len(self.levels):
            self.levels.append([])
        full = self.levels[level] if len(self.levels[level]) >= self.fanout else []
        if full:
            self.levels[level] = []
            self._place(self._merge(full), level + 1)
        self.levels[level].append(name)

    def _merge(self, names: list[str]) -> str:
        """One run in place of several, two at a time: each is written again as buckets."""

        def both(a: str, b: str) -> str:
            name = self._write(merged(self.spark.table(a), self.spark.table(b)))
            self._drop(a)
            self._drop(b)
            return name

        return reduce(both, names)

    def decided(self) -> DataFrame:
        """h1 and h2 of the keys that ``settle`` documents or more hold; all runs become one."""
        names = [name for level in reversed(self.levels) for name in level][::-1]
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        self.levels = [[self._merge(names)]]  # the smallest first
        return self.runs()[0].where(F.col("n") >= self.settle).select("h1", "h2")

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)
        self.levels = []


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """One run of two: a merge join, bucket by bucket, that adds up the counts of equal keys."""
    joined = a.join(b.withColumnRenamed("n", "m"), ["h1", "h2"], "full_outer")
    return joined.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def without(docs: DataFrame, dropped: DataFrame, least: int = LEAST) -> DataFrame:
    """The columns of ``docs`` with kept_text in place of text, n_lines and n_dropped: lines whose
    key's hash is among ``dropped`` (h1, h2; a written table) are left out."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "kept_text", "n_lines", "n_dropped")])
    own = docs.select(others.alias("own"), "doc_id", text_or_empty().alias("text"))
    r1, r2 = _hashes("doc_id", "text")
    own = own.select("own", "text", r1.alias("r1"), r2.alias("r2"))
    lines = own.select("r1", "r2", F.posexplode(keys(F.col("text"))).alias("pos", "key")).where(F.char_length("key") >= least)
    h1, h2 = _hashes("key")
    hashed = lines.select("r1", "r2", "pos", h1.alias("h1"), h2.alias("h2"))
    hit = hashed.join(broadcast_if_small(dropped, SMALL), ["h1", "h2"], "left_semi")
    # written first, so that the join has two exchanges of its own and equal rows can be split
    gone = materialise(hit.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    cut = own.select("own", "r1", "r2", F.split("text", "\n", -1).alias("all")).join(gone, ["r1", "r2"], "left")
    # what stays lies between the dropped places, so that each line is copied once
    n = F.size("all")
    stays = F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(n)), lambda a, b: F.slice("all", a + 2, b - a - 1)))
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("all")).otherwise(stays), "\n")
    return cut.select("own.*", kept.alias("kept_text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, batches: Iterable[DataFrame], settle: int = DOCUMENTS, least: int = LEAST, fanout: int = FANOUT) -> DataFrame:
    """``docs`` as ``without`` gives them, where the runs of ``batches``, which together
    are ``docs``, decide the lines that go."""
    runs = LineRuns(docs.sparkSession, settle, fanout, least)
    try:
        for batch in batches:
            runs.add(batch)
        dropped = materialise(runs.decided(), "decided-lines")
    finally:
        runs.close()
    return without(docs, dropped, least)


def by_file(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """A table's batches: its files, dealt by a hash of their paths; each file is read for its own
    batch only."""
    path = F.xxhash64(F.col("_metadata.file_path"))
    return [docs.where(F.pmod(path, F.lit(batches)) == i) for i in range(batches)]


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents or more hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with scratch(spark) as result:
        done = line_dedup(docs, by_file(docs))
        return result(done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")), "lines")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key AS gone FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT r) >= {DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON gone = key GROUP BY r, doc_id
"""
