"""Work that must happen once although runs end at any point: publishing to a destination, and draining
a queue. What was done stands in a log of small folders that a repeated step writes again, not twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.ordering import numbered_by
from tessella.plans import materialise

#: The steps of a publish, in order; a row of the journal is one step of one publish.
STAGED, VERIFIED, DONE = 1, 2, 3
JOURNAL = "artifact_id string, adapter_id string, row_id string, sha string, status string, error string, batch long, step int"
#: Gives artifact_id, adapter_id and the content that the destination then holds, null and an ``error``
#: where it refused: (rows with data) -> rows with written binary and error string.
Adapter = Callable[[DataFrame], DataFrame]


def _folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows under a folder, which may not be there yet."""
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/none")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _steps(spark: SparkSession, store: str) -> DataFrame:
    """The rows of the journal that can be the newest: of a batch that has ended its last step, in which
    every row of the batch stands, only those of that step."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    every = [str(f.getPath()) for f in files.globStatus(path(f"{store}/journal/batch=*")) or []]
    ended = [str(f.getPath().getParent().getParent()) for f in files.globStatus(path(f"{store}/journal/batch=*/step={DONE}/_SUCCESS")) or []]
    paths = [f"{b}/step={DONE}" for b in ended] + sorted(set(every) - set(ended))
    if not paths:
        return spark.createDataFrame([], JOURNAL)
    return spark.read.schema(JOURNAL).option("recursiveFileLookup", "true").parquet(*paths)


def journal(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The newest step of each publish, or that of the batches before a number."""
    rest = F.struct("sha", "status", "error", "batch", "step")
    rows = _steps(spark, store)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    rows = rows.groupBy("artifact_id", "adapter_id", "row_id").agg(F.max_by(rest, F.struct("batch", "step")).alias("row"))
    return rows.select("artifact_id", "adapter_id", "row_id", "row.*")


def publish(batch: DataFrame, number: int, store: str, adapter: Adapter) -> None:
    """Publish one batch of (artifact_id, adapter_id, seq, data) and journal it.

    Of several contents of one artifact in a batch the last counts. An artifact whose newest row is
    applied with the same hash is skipped; one whose newest row is staged, verified or in error goes
    on in that row; the others get a new one. Each step is a folder of the batch's number, written
    before the next begins, and what came before is read from earlier batches only. So a batch that
    runs again, whichever step it ended at, writes the same rows."""
    spark = batch.sparkSession
    keys = ["artifact_id", "adapter_id"]
    last = batch.groupBy(*keys).agg(F.max_by("data", "seq").alias("data")).withColumn("sha", F.sha2("data", 256))
    earlier = _steps(spark, store).where(F.col("batch") < number)
    before = earlier.groupBy(*keys).agg(F.max_by(F.struct("row_id", "sha", "status"), F.struct("batch", "row_id", "step")).alias("had"))
    new_id = F.concat_ws("/", F.lpad(F.lit(str(number)), 9, "0"), *keys)
    row_id = F.when(F.col("had.status") != "applied", F.col("had.row_id"))
    todo = last.join(before, keys, "left").where("had is null or had.status <> 'applied' or had.sha <> sha")
    todo = materialise(todo.select(*keys, F.coalesce(row_id, new_id).alias("row_id"), "sha", "data"), "publish")

    def log(rows: DataFrame, step: int, status, error) -> None:
        columns = [status.alias("status"), error.cast("string").alias("error"), F.lit(number).cast("long").alias("batch"), F.lit(step).alias("step")]
        rows.select(*keys, "row_id", "sha", *columns).write.mode("overwrite").parquet(f"{store}/journal/batch={number}/step={step}")

    log(todo, STAGED, F.lit("staged"), F.lit(None))
    log(todo, VERIFIED, F.lit("verified"), F.lit(None))
    written = f"{store}/content/batch={number}"
    adapter(todo.select(*keys, "row_id", "data")).select(*keys, "row_id", "written", "error").write.mode("overwrite").parquet(written)
    back = spark.read.parquet(written).withColumn("actual", F.sha2("written", 256))
    ended = todo.drop("data").join(back, [*keys, "row_id"], "left")
    error = F.coalesce("error", F.when(F.col("actual").isNull() | (F.col("actual") != F.col("sha")), F.lit("published content differs")))
    log(ended.withColumn("error", error), DONE, F.when(error.isNull(), "applied").otherwise("error"), F.col("error"))


def publish_stream(stream: DataFrame, store: str, adapter: Adapter) -> None:
    """Publish what a stream has, each batch under its number."""
    sink = stream.writeStream.foreachBatch(lambda rows, number: publish(rows, number, store, adapter))
    sink.option("checkpointLocation", f"{store}/offsets").trigger(availableNow=True).start().awaitTermination()


MOVES = "id long, state string, attempt long, run int, batch long, step int"
#: Rows that are in work at a time.
BATCH_ROWS = 10_000


def queue(spark: SparkSession, store: str) -> DataFrame:
    """The newest state of each row that was ever taken: id, state, attempt, run."""
    moves = _folder(spark, f"{store}/moves", MOVES)
    return moves.groupBy("id").agg(F.max_by(F.struct("state", "attempt", "run"), F.struct("run", "batch", "step")).alias("m")).select("id", "m.*")


def drain(rows: DataFrame, store: str, run: int, process: Callable[[DataFrame], DataFrame], batch_rows: int = BATCH_ROWS) -> None:
    """Process the queued rows (with ``id``) in the order of their ids, a batch at a time.

    A batch is marked as processing, processed, and marked done or in error by the ``ok`` that ``process`` gives for
    each id. Rows that an earlier run left in processing are reclaimed: they are queued again, with one
    more attempt; rows that are done or in error stay."""
    spark = rows.sparkSession
    had = materialise(queue(spark, store), "queue")
    todo = rows.join(had.hint("merge"), "id", "left").where("state is null or state in ('queued', 'processing')").drop("state", "run")
    # written with its places, in their order, so that a batch reads its own rows and not the queue
    todo = materialise(numbered_by(todo.select(*rows.columns, (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt")), "id"), "to-drain")
    total = todo.agg(F.max("place")).first()[0] or 0

    def move(df: DataFrame, batch: int, step: int, state) -> None:
        numbers = [F.lit(run).alias("run"), F.lit(batch).cast("long").alias("batch"), F.lit(step).alias("step")]
        df.select("id", state.alias("state"), F.col("attempt").cast("long"), *numbers).write.mode("overwrite").parquet(f"{store}/moves/run={run}/batch={batch}/step={step}")

    for batch in range(-(-total // batch_rows)):
        own = todo.where((F.col("place") > batch * batch_rows) & (F.col("place") <= (batch + 1) * batch_rows))
        move(own, batch, 1, F.lit("processing"))
        done = process(own.drop("place", "attempt")).select("id", "ok")
        move(own.join(done.hint("merge"), "id", "left"), batch, 2, F.when(F.col("ok"), "done").otherwise("error"))
