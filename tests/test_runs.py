"""What goes on from run to run: cursors, job phases, settling files, publishing, draining and turns."""

import json

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessella.queries import machines
from tessella.sources import connector
from tessella.operators import stores, strict
from tessella.streaming import consolidate, delivery, journal


def assets(spark, rows):
    schema = "asset_id string, revision string, checksum string, size_bytes long, available boolean, favorite boolean, star double, tags array<string>, date string"
    return spark.createDataFrame([(i, r, f"c-{i}", 3, ok, fav, star, tags, date) for i, r, ok, fav, star, tags, date in rows], schema)


FIRST = [("a-1", "r1", True, True, 5.0, ["city", "sea"], "2024-01-01"), ("b-2", "r1", True, False, 2.0, [], None), ("c-3", "r1", False, True, 4.0, ["city"], "2024-06-01"), ("d-4", "r1", True, True, None, None, "2024-03-01")]


def test_browse_pages_filters_and_cursor(spark, tmp_path):
    at = f"file://{tmp_path}/remote"
    connector.publish_listing(assets(spark, FIRST), at)

    def ids(**query):
        return sorted(r["asset_id"] for r in connector.browse(spark, at, **query).collect())

    assert ids() == ["a-1", "b-2", "d-4"] and ids(page="1") == ids()
    assert ids(after="a-1") == ["b-2", "d-4"] and ids(favorite="false") == ["b-2"] and ids(star="2") == ["a-1", "b-2"]
    assert ids(tags=json.dumps(["city", "sea"])) == ["a-1"] and ids(since="2024-02-01") == ["b-2", "d-4"] and ids(until="2024-02-01") == ["a-1", "b-2"]
    found = connector.browse(spark, at).where("asset_id > 'a-1' and asset_id = 'd-4'")
    assert [r["extra"]["date"] for r in found.collect()] == ["2024-03-01"]
    ranges = connector.key_ranges(at, "a-1")
    assert ranges and all(last > "a-1" for _, last in ranges)  # what lies before the cursor is not opened
    connector.publish_listing(assets(spark, []), at)
    assert ids() == []


def test_sync_from_the_cursor_with_tombstones(spark, tmp_path):
    at, store = f"file://{tmp_path}/remote", f"file://{tmp_path}/store"

    def known():
        return sorted(tuple(r) for r in connector.state(spark, store).select("asset_id", "revision", "available", "run").collect())

    connector.publish_listing(assets(spark, FIRST), at)
    connector.sync(spark, at, store, 1)
    first = known()
    assert first == [("a-1", "r1", True, 1), ("b-2", "r1", True, 1), ("d-4", "r1", True, 1)]
    connector.sync(spark, at, store, 2)
    assert known() == first  # nothing new, nothing written twice
    later = [("a-1", "r1", False, True, 5.0, [], None), ("b-2", "r9", True, False, 2.0, [], None), ("d-4", "r1", True, True, None, None, None), ("e-5", "r1", True, True, 1.0, [], None), ("a-0", "r1", True, True, 1.0, [], None)]
    connector.publish_listing(assets(spark, later), at)
    connector.sync(spark, at, store, 3)
    # an old asset's new revision and a new asset before the cursor stay unseen; what is gone is kept and marked
    assert known() == [("a-1", "r1", False, 3), ("b-2", "r1", True, 1), ("d-4", "r1", True, 1), ("e-5", "r1", True, 3)]


@pytest.mark.parametrize("name", ["jobs", "settle", "turns"])
def test_a_restart_goes_on_where_the_last_run_ended(spark, tmp_path, name):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    cuts = events.select(F.percentile_approx("event_id", [0.3, 0.6])).first()[0]
    parts = [events.where(F.col("event_id") <= cuts[0]), events.where((F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1])), events.where(F.col("event_id") > cuts[1])]

    def run(at):
        stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
        if name == "jobs":
            return journal.job_phases(machines.job_commands(stream), [(p, machines.work) for p in machines.PHASES], machines.on_failure, at)
        if name == "settle":
            return journal.settled(machines.snapshots(stream), machines.CALLS, machines.TIMEOUT, "1 hours", at)
        rows = stream.withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))).select(F.col("user_id").alias("playlist"), "event_id", "at", (F.col("value") > 9).alias("open"), F.lit(None).cast("long").alias("override"), F.array(*[F.lit(x).cast("long") for x in (3, 1, 2)]).alias("members"), F.array(*[F.lit(x).cast("long") for x in (2, 3, 1)]).alias("order"))
        return journal.rotated(rows, machines.INTERVAL, at)

    for part in parts:
        part.write.mode("append").parquet(f"file://{tmp_path}/in")
        several = run(f"file://{tmp_path}/several")
    assert sorted(map(repr, several.collect())) == sorted(map(repr, run(f"file://{tmp_path}/once").collect()))


def test_a_publish_that_ends_at_any_step_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d", i, bytes([65 + i // 2])) for i in range(4)] + [("b", "d", 9, b"x!"), ("c", "e", 1, b"y")], "artifact_id string, adapter_id string, seq long, data binary")

    def ended(store):
        return sorted(tuple(r) for r in delivery.journal(spark, store).select("artifact_id", "adapter_id", "row_id", "status", "error", "step").collect())

    whole = f"file://{tmp_path}/whole"
    for number in (0, 1):  # the same content again is skipped, the refused one goes on in its row
        delivery.publish(rows, number, whole, machines.destination)
    want = ended(whole)
    assert [(r[0], r[3], r[4]) for r in want] == [("a", "applied", None), ("b", "error", "refused"), ("c", "applied", None)]

    def broken(own):
        raise machines.Killed

    def half(own):
        return machines.destination(own).where("artifact_id <> 'c'")

    store = f"file://{tmp_path}/store"
    with pytest.raises(machines.Killed):
        delivery.publish(rows, 0, store, broken)
    assert {(r[3], r[5]) for r in ended(store)} == {("verified", 2)}
    delivery.publish(rows, 0, store, half)
    assert {r[0]: r[4] for r in ended(store)} == {"a": None, "b": "refused", "c": "published content differs"}
    delivery.publish(rows, 0, store, machines.destination)
    delivery.publish(rows, 1, store, machines.destination)
    delivery.publish(rows, 1, store, machines.destination)
    assert ended(store) == want


def test_a_drain_reclaims_and_does_each_row_once(spark, tmp_path):
    rows, store = spark.range(10), f"file://{tmp_path}/queue"
    taken = []

    def process(own):
        ids = [r["id"] for r in own.collect()]
        taken.extend(ids)
        if 5 in ids and taken.count(5) == 1:
            raise machines.Killed
        return own.select("id", (F.col("id") != 7).alias("ok"))

    with pytest.raises(machines.Killed):
        delivery.drain(rows, store, 1, process, 3)
    assert {r["id"]: r["state"] for r in delivery.queue(spark, store).collect()} == {0: "done", 1: "done", 2: "done", 3: "processing", 4: "processing", 5: "processing"}
    delivery.drain(rows, store, 2, process, 4)
    delivery.drain(rows, store, 3, process, 4)
    got = {r["id"]: (r["state"], r["attempt"], r["run"]) for r in delivery.queue(spark, store).collect()}
    assert got == {i: ("error" if i == 7 else "done", 2 if 3 <= i <= 5 else 1, 1 if i < 3 else 2) for i in range(10)}
    assert sorted(taken) == sorted([*range(10), 3, 4, 5])


def test_consolidation_resumes_at_any_step_and_checks_bytes(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    files = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", b"one")], "asset_id string, content binary")

    def ended():
        return {r["asset_id"]: r["status"] for r in consolidate.checkpoints(spark, root).collect()}

    consolidate.consolidate(files, root, 1, until="staged")
    assert set(ended().values()) == {"staged"}
    consolidate.consolidate(files, root, 2, until="verified")
    assert set(ended().values()) == {"verified"}
    # staged bytes that are lost are an error, and staged anew by the next run
    lost = stores.stored(spark, f"{root}/staging").where("content <> cast('two' as binary)").collect()
    spark.createDataFrame(lost, "sha256 string, content binary").withColumn("_part", F.substring("sha256", 1, 2)).write.mode("overwrite").partitionBy("_part").parquet(f"{root}/staging")
    consolidate.consolidate(files, root, 3)
    assert ended() == {"a": "promoted", "b": "error", "c": "promoted"}
    consolidate.consolidate(files, root, 4)
    assert set(ended().values()) == {"promoted"}
    assert sorted(bytes(r["content"]) for r in stores.stored(spark, f"{root}/library").collect()) == [b"one", b"two"]
    before = consolidate.journal(spark, root).count()
    consolidate.consolidate(files, root, 5)
    assert consolidate.journal(spark, root).count() == before  # all are skipped


def test_what_is_missing_fails(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, v string")
    asked = spark.createDataFrame([(0, 2), (1, 1)], "place long, id long")
    assert sorted((r["place"], r["v"]) for r in strict.looked_up(asked, rows, "id", "place", "entry").collect()) == [(0, "b"), (0, "c"), (1, "a")]
    assert [(r["seq"], r["v"]) for r in strict.history(rows, asked.where("id = 2"), "id", "v", "asset").orderBy("seq").collect()] == [(1, "b"), (2, "c")]
    for missing in (7, None):
        more = spark.createDataFrame([(0, missing)], "place long, id long")
        for job in (strict.looked_up(more, rows, "id", "place", "entry"), strict.history(rows, more, "id", "v", "asset")):
            with pytest.raises(Exception, match="not found: " + ("7" if missing else "null")):
                job.collect()
