"""What must not change as tables grow: plans without broadcasts of exploded sides, batches, ties, blocks."""

import random

import pytest
from conftest import DATA, same


from tessella.operators.similarity import near_hashes


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_near_hashes_broadcast_nothing_and_lose_no_pair(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(6)]
    hashes = [b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 7))) for b in base for _ in range(12)]
    hashes += hashes[:10]
    rows = [(f"k{i:03}", f"{h:016x}", draw.choice([None, 400, 1000, 2000]), draw.choice([300, 900])) for i, h in enumerate(hashes)] + [("none", None, 1, 1)]
    items = spark.createDataFrame(rows, "key string, phash string, width int, height int")

    def near(x, y):
        fits = x[2] is None or y[2] is None or max(x[2] / x[3], y[2] / y[3]) / min(x[2] / x[3], y[2] / y[3]) <= 2
        return x[1] and y[1] and bin(int(x[1], 16) ^ int(y[1], 16)).count("1") <= 10 and fits

    found = near_hashes(items)
    assert sorted(map(tuple, found.collect())) == sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y))
    assert "BroadcastExchange" not in plan_of(found)


@pytest.mark.parametrize(("block", "dense"), [(5, 0), (5, 2), (4096, 1 / 8)])
def test_items_of_near_hashes_meet_in_blocks_and_lose_no_pair(spark, monkeypatch, block, dense):
    from tessella.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK", block, raising=False)
    monkeypatch.setattr(similarity, "DENSE", dense, raising=False)
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(4)]
    hashes = [b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 9))) for b in base for _ in range(8)]
    rows = [(f"k{n:03}{i}", f"{h:016x}", w, 900) for n, h in enumerate(hashes) for i, w in enumerate(draw.sample([None, 300, 400, 800, 1000, 2000, 4000], draw.randint(1, 6)))]
    draw.shuffle(rows)
    found = near_hashes(spark.createDataFrame(rows, "key string, phash string, width int, height int"))

    def near(x, y):
        return bin(int(x[1], 16) ^ int(y[1], 16)).count("1") <= 10 and (x[2] is None or y[2] is None or max(x[2], y[2]) <= 2 * min(x[2], y[2]))

    assert sorted(map(tuple, found.collect())) == sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y))
    assert not any("/near-hashes-" in f for f in found.inputFiles())  # items are not repeated by pair of hashes


def test_pictures_and_affinity_broadcast_no_table_of_parts(spark):
    from tessella.queries.pictures import pictures
    from tessella.queries.taste import pair_affinity

    assert "BroadcastExchange" not in plan_of(pictures(spark, DATA))
    assert "Generate" not in plan_of(pair_affinity(spark, DATA)).split("== Physical Plan ==")[-1]


def test_the_rest_of_a_queue_is_drained_in_few_batches(spark, tmp_path, monkeypatch):
    from tessella.queries import machines

    monkeypatch.setattr(machines, "DRAINED_ROWS", 100)
    monkeypatch.setattr(machines, "_store", lambda spark, name: str(tmp_path / name))
    assert machines.drain(spark, DATA).groupBy("run", "attempt").count().orderBy("run", "attempt").collect() == [(1, 1, 100), (2, 1, 1300), (2, 2, 100)]
    assert len(list((tmp_path / "drain/moves/run=2").glob("batch=*"))) == 1


def tied(spark, tmp_path, name, rows):
    """Rows as a table of one file, and the same in DuckDB with one thread."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{name}.parquet")
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    return duck


def test_the_first_of_analyses_with_one_id_counts(spark, tmp_path):
    from tessella import registry

    one = {"l_linenumber": 4, "l_quantity": 9.0, "l_discount": 0.05, "l_tax": 0.04, "l_returnflag": "A"}
    rows = [{**one, "l_orderkey": o, "l_partkey": 13637 + 1009 * (i + o), "l_suppkey": 7 * o + 31 * i} for i in range(3) for o in range(40)]
    duck = tied(spark, tmp_path, "lineitem", rows)
    for name in ("pf_signals", "pf_latest_ok_analysis", "pf_summary", "fm_personal_delta", "fm_alignment", "fm_blend", "fm_strong_veto", "ag_largest_contribution"):
        got = registry.queries()[name](spark, str(tmp_path))
        left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()[name]))
        assert left == right, name


def test_missing_values_of_analyses_are_passed_over(spark, tmp_path):
    """SQL's ``max_by`` skips a null value, and a row whose id is null."""
    import duckdb
    import pyarrow.parquet as pq

    from tessella import registry

    draw = random.Random(8)
    names = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_returnflag")
    rows = [{**r, **{c: None for c in names if draw.random() < 0.2}} for r in pq.read_table(f"{DATA}/lineitem.parquet").to_pylist()]
    tied(spark, tmp_path, "lineitem", rows)
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    for name, path in (("lineitem", tmp_path), ("events", DATA)):
        duck.execute(f"create view {name} as select * from '{path}/{name}.parquet'")
    (tmp_path / "events.parquet").symlink_to(f"{DATA}/events.parquet")
    queries = ("pf_signals", "pf_latest_ok_analysis", "fm_personal_delta", "fm_alignment", "fm_blend", "ag_strongest_vote", "ag_verdict", "ag_evaluate", "ag_largest_contribution")
    for name in queries:
        got = registry.queries()[name](spark, str(tmp_path))
        left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()[name]))
        assert left == right, name


def test_a_template_of_a_missing_value_is_missing(spark, tmp_path):
    from tessella import registry

    one = {"l_linenumber": 1, "l_quantity": 9.0, "l_discount": 0.05, "l_tax": 0.04, "l_returnflag": "A"}
    duck = tied(spark, tmp_path, "lineitem", [{**one, "l_orderkey": o, "l_partkey": o, "l_suppkey": None if o % 3 == 0 else 7 * o} for o in range(60)])
    got = registry.queries()["fs_signed_template"](spark, str(tmp_path))
    left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()["fs_signed_template"]))
    assert left == right and sum("None" in row for row in left) == 20


def test_the_wall_takes_the_first_of_tied_rows_and_lists_what_has_no_name_last(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessella import registry

    one = {"l_linenumber": 4, "l_quantity": 9.0, "l_discount": 0.05, "l_tax": 0.04, "l_returnflag": "A", "l_linestatus": "F"}
    tables = {
        "lineitem": [{**one, "l_orderkey": o, "l_partkey": 13637 + 1009 * (i + o), "l_suppkey": 7 * o + 31 * i} for i in range(3) for o in range(40)],
        "orders": [{"o_orderkey": o, "o_custkey": None if o % 5 == 2 else o % 8, "o_orderstatus": "O", "o_totalprice": 9.0, "o_orderdate": None} for o in range(100)],
        "events": [{"event_id": i % 70, "user_id": i % 70, "event_type": ("error", "click")[i // 70], "ts": None} for i in range(140)],
        "part": [{"p_partkey": k, "p_size": k % 9} for k in range(90)],
    }
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    for name, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{name}.parquet")
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for name in ("jn_wall_state", "sl_wall_order"):
        got = registry.queries()[name](spark, str(tmp_path))
        left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()[name]))
        assert left == right, name


def test_journal_rows_without_an_id_come_last(spark, tmp_path):
    from tessella import registry

    rows = [{"l_orderkey": None if i == 3 else i, "l_linenumber": 1, "l_partkey": p, "l_suppkey": 2, "l_quantity": 0.5 * (i + p), "l_returnflag": "ANR"[(i + p) % 3], "l_linestatus": "OF"[i % 2]} for p in range(30) for i in range(9)]
    duck = tied(spark, tmp_path, "lineitem", rows)
    got = registry.queries()["pf_journal_by_run"](spark, str(tmp_path))
    left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()["pf_journal_by_run"]))
    assert left == right and sum("None" in row for row in left) == 30


def test_journal_rows_of_one_id_keep_the_order_of_the_table(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessella import registry

    (tmp_path / "lineitem.parquet").mkdir()
    one = {"l_orderkey": 5, "l_linenumber": 1, "l_partkey": 3, "l_suppkey": 2, "l_quantity": 4.0, "l_linestatus": "F"}
    for name, flags in (("a", "R"), ("b", "AARA" * 50)):  # Spark reads the larger file first
        pq.write_table(pa.Table.from_pylist([{**one, "l_returnflag": x} for x in flags]), tmp_path / f"lineitem.parquet/{name}.parquet")
    got = registry.queries()["pf_journal_by_run"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r["status"] for r in got] == [{"R": "error", "A": "applied"}[x] for x in "R" + "AARA" * 50]


def test_scores_are_rounded_as_in_the_sql(spark, tmp_path):
    from tessella import registry

    draw = random.Random(12)
    prices = [252935.5, 142399.5, 1e305, float("inf"), float("nan"), 0.5, -252935.5, 1e22] + [draw.randrange(1, 50_000_000) / 100 for _ in range(20_000)]
    tied(spark, tmp_path, "orders", [{"o_orderkey": i, "o_custkey": i, "o_orderstatus": "O", "o_totalprice": x, "o_orderdate": None} for i, x in enumerate(prices)])
    duck = tied(spark, tmp_path, "lineitem", [{"l_orderkey": i, "l_linenumber": 1, "l_partkey": i, "l_suppkey": i, "l_quantity": 1.0, "l_discount": 0.1, "l_tax": 0.0, "l_returnflag": "N"} for i in range(len(prices))])
    duck.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    got = registry.queries()["jn_vote_candidates"](spark, str(tmp_path))
    left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()["jn_vote_candidates"]))
    assert len(left) == len(prices) and left == right


def test_the_first_of_parts_with_one_path_is_the_file(spark, tmp_path):
    from tessella import registry

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "part.parquet").mkdir()
    for name, turns in (("a", range(1)), ("b", range(1, 9))):  # Spark reads the larger file first
        rows = [{"p_partkey": k + 6300 * i, "p_brand": "Brand#12", "p_size": (k * 7 + 11 * i) % 50} for i in turns for k in range(60)]
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"part.parquet/{name}.parquet")
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    for name in ("sc_local_scan", "sc_legacy_categories", "ag_inventory_counts"):
        got = registry.queries()[name](spark, str(tmp_path))
        left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()[name]))
        assert left == right, name


def test_sizes_of_parts_that_are_missing_are_passed_over(spark, tmp_path):
    from tessella import registry

    rows = [{"p_partkey": k, "p_brand": None if k % 50 == 7 else "Brand#12", "p_size": None if k % 3 == 1 else (k * 7 + k // 6300) % 50} for k in range(25_200)]
    duck = tied(spark, tmp_path, "part", rows)
    for name in ("ag_inventory_counts", "sc_legacy_categories", "sc_local_scan"):
        got = registry.queries()[name](spark, str(tmp_path))
        left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()[name]))
        assert left == right, name


def test_a_file_without_a_path_has_a_class(spark, tmp_path):
    from tessella import registry

    rows = [{"p_partkey": k, "p_brand": [None, "Brand#12", "Brand#3"][k % 3], "p_size": k % 50} for k in range(12_600)]
    duck = tied(spark, tmp_path, "part", rows)
    got = registry.queries()["sc_inventory_classes"](spark, str(tmp_path))
    left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(registry.oracle_sql()["sc_inventory_classes"]))
    assert left == right and sum("None" in row for row in left) == 1


@pytest.mark.parametrize("ties", ["id", "-id"])
def test_vector_search_by_matrices_keeps_ties_and_uneven_vectors(spark, ties):
    from tessella.operators.similarity import vector_search

    draw = random.Random(4)
    vectors = [[draw.randint(-2, 2) / 3 for _ in range(6)] for _ in range(70)]
    vectors += vectors[:40] + [[2 * x for x in v] for v in vectors[:20]] + [[0.0] * 6, [1e200] * 6, [-1e200] * 6]
    rows = list(enumerate(vectors))

    def cosine(a, b):
        dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
        return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)

    table = spark.createDataFrame(rows, "id long, vector array<double>")
    usual, sign = [(i, v) for i, v in rows if any(v) and max(v) < 1e9 and min(v) > -1e9], 1 if ties == "id" else -1
    want = [(q, i, n) for q, u in usual if q % 10 == 0 for n, i in enumerate(sorted((i for i, _ in usual if i != q), key=lambda i: (-cosine(vectors[i], u), sign * i))[:4], 1)]
    asked = table.where("id % 10 = 0 and id < 130")
    found = vector_search(asked, table.where("id <= 130"), 4, ties)
    assert "MapInArrow" in plan_of(found)
    assert sorted(map(tuple, found.select("query", "id", "rank").collect())) == sorted(want)
    huge = vector_search(table.where("id = 5"), table, 200, ties)  # vectors whose length is infinite are scored by the formula
    assert {131, 132} <= {r["id"] for r in huge.collect()} and huge.count() == len(rows) - 2


def test_many_frames_are_cut_as_one_by_one():
    import numpy as np

    from tessella.operators.layout import FrameTooSmall, tiles, tiles_of_many

    draw = np.random.default_rng(5)
    sizes = np.concatenate([draw.integers(1, 14, 400), [0, 30, 1]])
    weights = draw.choice([0.0, 1.0, 2.0, 0.1, 7.5, np.nan, np.inf, -3.0], sizes.sum())
    weights[: sizes[:100].sum()] = draw.random(sizes[:100].sum())
    ends = np.cumsum(sizes)
    one = [tiles(weights[e - n : e], 3840, 2160, 3) for n, e in zip(sizes, ends, strict=True) if n]
    assert (tiles_of_many(sizes, weights, 3840, 2160, 3) == np.concatenate(one)).all()
    with pytest.raises(FrameTooSmall):
        tiles_of_many(np.array([9]), np.ones(9), 4, 4, 1)


def test_the_neighbours_of_a_mask_are_not_broadcast(spark, monkeypatch):
    from tessella.queries import stores

    seen, before = [], stores.connected_components
    monkeypatch.setattr(stores, "connected_components", lambda edges: seen.append(plan_of(edges)) or before(edges))
    stores.mask_components(spark, DATA)
    assert seen and "BroadcastExchange" not in seen[0]


def test_the_duplicate_report_reads_the_images_once(spark):
    from tessella.queries.flow import duplicate_report

    assert "part.parquet" not in plan_of(duplicate_report(spark, DATA))


def test_a_publish_reads_the_last_step_of_what_has_ended(spark, tmp_path):
    from tessella.queries.machines import destination
    from tessella.streaming import delivery

    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "d", 1, b"one"), ("b", "d", 2, b"two!")], "artifact_id string, adapter_id string, seq long, data binary")
    delivery.publish(rows, 0, store, destination)
    delivery.publish(rows.where("seq = 2"), 1, store, destination)
    (tmp_path / "store/journal/batch=1/step=3/_SUCCESS").unlink()  # the second has not ended
    files = delivery.journal(spark, store).inputFiles()
    assert {f.split("journal/")[1].rsplit("/", 1)[0] for f in files} == {"batch=0/step=3", "batch=1/step=1", "batch=1/step=2", "batch=1/step=3"}
    found = delivery.journal(spark, store).select("artifact_id", "status", "batch", "step").orderBy("artifact_id").collect()
    assert [tuple(r) for r in found] == [("a", "applied", 0, 3), ("b", "error", 1, 3)]


def test_a_store_writes_a_small_part_in_one_file(spark, tmp_path):
    from tessella.operators import stores

    blobs = spark.range(0, 2000, 1, 8).selectExpr("CAST(id % 1500 AS STRING) AS content").selectExpr("CAST(content AS BINARY) AS content")
    for _ in range(2):
        stores.put_blobs(blobs, str(tmp_path / "blobs"))
        assert stores.stored(spark, str(tmp_path / "blobs")).count() == 1500
        parts = list((tmp_path / "blobs").glob("_part=*"))
        assert len(parts) > 200 and all(len(list(p.glob("*.parquet"))) == 1 for p in parts)
