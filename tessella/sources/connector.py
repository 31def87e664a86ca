"""A remote library's listing as a Spark data source, and its incremental sync.

A listing is a folder of Parquet files, sorted by asset id within each; a later state of the remote
takes the place of the earlier one, and new assets have greater ids. ``RemoteAssets`` reads it in pages
by key range: a partition is one row group, whose first and last ids stand in the file's footer, so that
a cursor passes over what lies before it without reading it. As a stream, the offset is the cursor, the
last id that was seen, and each batch is read by the executors as partitions of the ids between two
cursors. The folder is reached through Arrow's file systems, by a URI that all executors share.

``sync`` drains the stream into a log and adds tombstones. What holds: an id at or before the cursor
is never enumerated again, so a changed revision of an old asset is missed; an asset that is gone is
marked unavailable and never deleted; a batch that runs twice writes the same partition again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, InputPartition

from tessella.plans import materialise

FORMAT = "tessella_remote"
#: Rows of a page.
PAGE = 1000
SCHEMA = "asset_id string, revision string, checksum string, size_bytes long, available boolean, extra struct<favorite:boolean,star:double,tags:array<string>,date:string>"
#: Columns of a listing, from which ``extra`` is put together.
COLUMNS = ("asset_id", "revision", "checksum", "size_bytes", "available", "favorite", "star", "tags", "date")
_EXTRA = pa.struct([("favorite", pa.bool_()), ("star", pa.float64()), ("tags", pa.list_(pa.string())), ("date", pa.string())])


@dataclass(frozen=True)
class Browse:
    """Which assets are asked for; a field that is unset asks for nothing. An unknown date passes."""

    favorite: bool | None = None
    star: float | None = None
    tags: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    page: int = PAGE

    @classmethod
    def of(cls, options: dict) -> Browse:
        favorite, star = options.get("favorite"), options.get("star")
        return cls(
            None if favorite is None else favorite.lower() == "true", None if star is None else float(star), tuple(json.loads(options.get("tags", "[]"))),
            options.get("since"), options.get("until"), int(options.get("page", PAGE)),
        )

    def rows(self, page: pa.RecordBatch, after: str | None, until: str | None) -> pa.RecordBatch:
        """The rows of a page that are available, lie between the ids and are asked for."""
        import pyarrow.compute as pc

        keep = pc.fill_null(page["available"], False)
        for bound, compare in ((after, pc.greater), (until, pc.less_equal)):
            if bound is not None:
                keep = pc.and_(keep, compare(page["asset_id"], bound))
        if self.favorite is not None:
            keep = pc.and_(keep, pc.fill_null(pc.equal(page["favorite"], self.favorite), False))
        if self.star is not None:
            keep = pc.and_(keep, pc.fill_null(pc.greater_equal(page["star"], self.star), False))
        for bound, compare in ((self.since, pc.greater_equal), (self.until, pc.less_equal)):
            if bound is not None:
                keep = pc.and_(keep, pc.fill_null(compare(page["date"], bound), True))
        if self.tags:
            has = [set(self.tags) <= set(t or ()) for t in page["tags"].to_pylist()]
            keep = pc.and_(keep, pa.array(has, pa.bool_()))
        return page.filter(keep)


@dataclass
class KeyRange(InputPartition):
    """One row group of a listing, between two ids: after the first, up to and with the last."""

    file: str
    group: int
    after: str | None
    until: str | None


def key_ranges(path: str, after: str | None = None, until: str | None = None) -> list[tuple[KeyRange, str]]:
    """The row groups of a listing that hold ids between the two, each with its last id, by footers."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    out = []
    for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda i: i.path):
        if not info.is_file or not info.base_name.endswith(".parquet"):
            continue
        with system.open_input_file(info.path) as f:
            footer = pq.ParquetFile(f).metadata
        at = footer.schema.names.index("asset_id")
        for g in range(footer.num_row_groups):
            held = footer.row_group(g).column(at).statistics
            if not footer.row_group(g).num_rows or (after is not None and held.max <= after) or (until is not None and held.min > until):
                continue
            out.append((KeyRange(info.path, g, after, until), held.max))
    return out


class _Pages:
    """Reading the pages of a key range."""

    def __init__(self, options: dict):
        self.path, self.browse = options["path"], Browse.of(options)

    def pages(self, part: KeyRange) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with system.open_input_file(part.file) as f:
            for page in pq.ParquetFile(f).iter_batches(self.browse.page, row_groups=[part.group], columns=list(COLUMNS)):
                rows = self.browse.rows(page, part.after, part.until)
                if rows.num_rows:
                    extra = pa.StructArray.from_arrays([rows[n.name].cast(n.type) for n in _EXTRA], fields=list(_EXTRA))
                    yield pa.RecordBatch.from_arrays([*[rows[c] for c in COLUMNS[:5]], extra], names=[*COLUMNS[:5], "extra"])


class KeysetReader(DataSourceReader):
    """A batch read: all key ranges after ``after``, which is an option or a filter on asset_id."""

    def __init__(self, options: dict):
        self.source, self.after, self.only = _Pages(options), options.get("after"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("asset_id",):
                self.after = max(filter(None, [self.after, f.value]))
            elif isinstance(f, EqualTo) and f.attribute == ("asset_id",):
                self.only = f.value
                yield f  # ranges are chosen by it, rows still compared
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        ranges = [r for r, last in key_ranges(self.source.path, self.after, self.only) if self.only is None or last >= self.only]
        return ranges or [KeyRange("", 0, None, None)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        return self.source.pages(partition) if partition.file else iter(())


class CursorReader(DataSourceStreamReader):
    """A stream read: the offset is the last id, and a batch the ranges between two offsets."""

    def __init__(self, options: dict):
        self.source, self.begin = _Pages(options), options.get("after", "")

    def initialOffset(self) -> dict:
        return {"cursor": self.begin}

    def latestOffset(self) -> dict:
        return {"cursor": max([self.begin, *(last for _, last in key_ranges(self.source.path))])}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        if end["cursor"] <= start["cursor"]:
            return []
        return [r for r, _ in key_ranges(self.source.path, start["cursor"], end["cursor"])]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        return self.source.pages(partition)


class RemoteAssets(DataSource):
    """``spark.read.format("tessella_remote")`` or ``readStream``; options: path, page, after, favorite,
    star, tags (a JSON list), since, until."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KeysetReader:
        return KeysetReader(dict(self.options))

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(dict(self.options))


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteAssets)


def browse(spark: SparkSession, path: str, **query: str) -> DataFrame:
    """Available assets of a listing that the query's options ask for."""
    _register(spark)
    return spark.read.format(FORMAT).options(path=unquote(path), **query).load()


def publish_listing(assets: DataFrame, path: str) -> None:
    """Write a state of the remote: files of sorted key ranges, in place of the state before."""
    parts = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assets.select(*COLUMNS).repartitionByRange(parts, "asset_id").sortWithinPartitions("asset_id").write.mode("overwrite").parquet(path)


LOG = "asset_id string, revision string, checksum string, available boolean, run int, batch long"


def state(spark: SparkSession, store: str) -> DataFrame:
    """What the store knows: the last observation of each asset, and the run that made it."""
    log = spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{store}/log")
    last = F.max_by(F.struct("revision", "checksum", "available", "run"), F.struct("run", "batch"))
    return log.groupBy("asset_id").agg(last.alias("s")).select("asset_id", "s.*")


#: The batch number of a run's tombstones, after all batches of the stream.
TOMBSTONES = 1 << 40


def sync(spark: SparkSession, path: str, store: str, run: int, **query: str) -> None:
    """One sync: assets after the stored cursor are logged where their revision is new, and known
    assets that the remote no longer has are logged as unavailable. ``run`` numbers syncs of a store;
    the same run again, after a failure, writes the same folders again."""
    _register(spark)
    own = f"{store}/log/run={run}"
    columns = [F.lit(run).alias("run")]

    def write(df: DataFrame, batch: int) -> None:
        df.select("asset_id", "revision", "checksum", "available", *columns, F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{own}/batch={batch}")

    if run == 1:  # an empty log, so that it can be read
        write(spark.createDataFrame([], LOG), 0)

    def add(df: DataFrame, batch: int) -> None:
        before = state(spark, store).where(F.col("run") < run).select("asset_id", F.col("revision").alias("had"))
        new = df.join(before, "asset_id", "left").where(~F.col("revision").eqNullSafe(F.col("had")))
        write(new, batch + 1)

    stream = spark.readStream.format(FORMAT).options(path=path, **query).load()
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{store}/cursor").trigger(availableNow=True).start().awaitTermination()
    known = state(spark, store).where("available").select("asset_id", "revision", "checksum")
    there = browse(spark, path).select("asset_id")
    gone = materialise(known.join(there, "asset_id", "left_anti").withColumn("available", F.lit(False)), "tombstones")
    write(gone, TOMBSTONES)
