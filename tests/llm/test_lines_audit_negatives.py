"""Line dedup, the filter audit and hard negatives against plain versions on small rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import filter_audit, hard_negatives, line_dedup

WHITE = " \t\n\x0b\x0c\r"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    common = ["Share this page", "  share THIS page\t", "ÉTÉ et Été", "x", "", " \x0b ", "Zürich K", "kelvin K"]
    out = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own {i} {rng.randint(0, 3)}" for _ in range(rng.randint(0, 12))]
        out.append((i if i % 9 else None, "\n".join(lines) if i % 7 else None, ("en", "de", None, "")[i % 4], i))
    out += [(3, "\n\n", "en", 0), (3, "\n\n", "en", 0), (4, "", "de", 0), (5, "a\n" * 3000 + "Share this page\r", "de", 0), (6, "share this page", "fr", 0)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, own long")


@pytest.mark.parametrize("settle,least,cut", [(10, 1, 3), (2, 4, 6), (1, 1, 1)])
def test_lines_that_many_documents_hold_go(spark, rows, settle, least, cut):
    held = [(t or "").split("\n") for _, t, _, _ in rows]
    keys = [[lowered(line.strip(WHITE)) for line in lines] for lines in held]
    n = Counter(k for own in keys for k in set(own))
    want = []
    for (d, _, lang, own), lines, ks in zip(rows, held, keys, strict=True):
        kept = [line for line, k in zip(lines, ks, strict=True) if len(k) < least or n[k] < settle]
        want.append((d, lang, own, "\n".join(kept), len(lines), len(lines) - len(kept)))
    docs = frame(spark, rows).withColumnRenamed("own", "gone")  # a column with a name of the operator's own
    batches = [frame(spark, rows[i::cut]) for i in range(cut)]
    got = line_dedup.line_dedup(docs, batches, settle, least)
    assert got.columns == ["doc_id", "lang", "gone", "kept_text", "n_lines", "n_dropped"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessella_run_")]


def test_batches_are_anti_joined_and_levels_merged(spark, rows):
    runs = line_dedup.LineRuns(spark, settle=1)
    seen: set = set()
    try:
        for i in range(5):
            own = {r[0] for r in line_dedup.counted(frame(spark, rows[i::5])).collect()}
            assert {r["h1"] for r in runs.add(frame(spark, rows[i::5])).collect()} == own - seen
            seen |= own
        assert [len(level) for level in runs.levels] == [1, 2]
        plan = line_dedup.merged(*runs.runs()[1:])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Exchange" not in plan
        assert runs.decided().count() == len(seen)
        assert len(runs.paths) == 1
    finally:
        runs.close()
    assert line_dedup.line_dedup(frame(spark, []), []).count() == 0


def plain_audit(rows, labels):
    texts = {}
    for d, t, _, _ in rows:
        if d is not None:
            texts[t or ""] = min(d, texts.get(t or "", d))
    out = {}
    for d, t, lang, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            f for f, x in zip("ABCDE", (
                len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > texts[t]), strict=True) if x
        )
        mine = [x for x in labels if x[0] == d and d is not None]
        good, bad = any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)
        for p in itertools.permutations("ABCDE"):
            first = next((f for f in p if f in fails), None)
            for step, f in enumerate(p, 1):
                c = out.setdefault((lang or "", "".join(p), step), [0] * 7)
                c[0] += not set(p[:step]) & set(fails)
                c[1] += first == f
                c[2] += f in fails and first != f
                c[3] += fails == f
                c[4] += first == f and good
                c[5] += first == f and bad
                c[6] += f in fails and 120 // len(fails)
    return out


def test_audit_of_filters(spark, rows):
    rng = random.Random(8)
    more = [(100 + i, " ".join(rng.choice(["A", "b", "cd", "#e", "été", "Été"]) + str(rng.randint(0, 200)) for _ in range(130)), "en", 0) for i in range(30)]
    every = rows + more + [(200 + i, more[i][1], "de", 1) for i in range(9)]
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 240, 2)] + [(4, None, 1), (100, 0, 0), (None, 1, 1)]
    want = plain_audit(every, labels)
    got = filter_audit.audit(frame(spark, every), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want
    assert filter_audit.audit(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("spread", [(1 << 64) - 1, 1, 0])
def test_transducer_and_word_table(spread):
    rng = random.Random(2)
    texts = ["", " ", "a", "A b A", " x 　", "é" * 50, *("".join(rng.choice("aAé \n\t#|€𝄞") for _ in range(rng.randint(0, 90))) for _ in range(80)), "word " * 5000]
    column = pa.array(["skipped", *texts]).slice(1)
    got = filter_audit.transduce(column, spread)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert got["words"].tolist() == list(map(len, words))
    assert got["distinct"].tolist() == [len(set(w)) for w in words]
    assert got["points"].tolist() == list(map(len, texts))
    assert got["capitals"].tolist() == [len(re.findall("[A-Z]", t)) for t in texts]
    assert got["symbols"].tolist() == [len(re.findall("[#$%&*|]", t)) for t in texts]


def plain_negatives(rows, positives=5, negatives=5, low=80, high=100):
    held = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        held.append((i, label, tuple(max(-(1 << 23), min(1 << 23, math.floor(256 * x))) for x in v)))
    held = list(dict.fromkeys(held))

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2], strict=False))

    out = []
    for a in held:
        if a[0] % 100:
            continue
        ranked = sorted(((-score(a, b), b[0], b) for b in held if b != a), key=lambda x: x[:2])
        for s, p, _ in [x for x in ranked if x[2][1] == a[1]][:positives]:
            fits = [x for x in ranked if x[2][1] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a[0], p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, rows):
    from pyspark.sql import functions as F

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return v.select("vec_id", label.alias("label"), hard_negatives.integer_vectors().alias("vector"))


@pytest.mark.parametrize("scale,most", [(1.0, 4096), (20000.0, 5)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, scale, most):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hard_negatives, "SLAB", 150)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        v = (rng.normal(size=6) * scale + 0.5).astype(np.float32).tolist()
        rows.append((i * 5 if i else 0, v if i % 40 else [0.5] * 6, int(rng.integers(0, 4))))
    rows += [(90001 + i, [0.5] * 6, 1) for i in range(200)]  # many of one vector
    rows += [(None, [1.0] * 6, 1), (100_100, None, 1), (100_200, [1.0] * 6, None), (100_300, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (100_400, [float("nan")] * 6, 1), (100_500, [float("inf")] * 6, 1)]
    rows += [rows[3], rows[20], (100_600, [1.0, 2.0], 2), (100_700, [], 2), (-100, [1.0] * 6, 3)]
    want = plain_negatives([(i, label, v) for i, v, label in rows])
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0, most=most)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_boxes_bound_and_prune():
    rng = np.random.default_rng(3)
    v = rng.integers(-100, 100, (1000, 4), dtype=np.int32)
    order = hard_negatives.tiled(v, [2, 0, 1])
    assert sorted(order.tolist()) == list(range(1000))
    low, high = hard_negatives.boxes(v[order], v[order], hard_negatives.LEAF)
    t = hard_negatives.Subtree({"ids": order.astype(np.int64).tobytes(), "rows": order.astype(np.int64).tobytes(), "labels": np.ones(1000, np.int32).tobytes(), "vectors": v[order].tobytes(), "low": low.tobytes(), "high": high.tobytes()}, 4, np.float64)
    q = rng.integers(-50, 50, (3, 4)).astype(float)
    up, down = t.bounds(0, slice(0, len(low)), q)
    s = q @ t.vectors.T
    for i in range(len(low)):
        own = s[:, i * hard_negatives.LEAF : (i + 1) * hard_negatives.LEAF]
        assert (own.max(1) <= up[:, i]).all() and (own.min(1) >= down[:, i]).all()
    offered = []
    slots = hard_negatives.Slots(q, np.ones(3, np.int32), np.full(3, -1), np.arange(3), np.full(3, -np.inf), np.full(3, np.inf), True, 5)
    take = slots.offer
    slots.offer = lambda own, tree, a, b: (offered.append(len(own)), take(own, tree, a, b))
    slots.search([t])
    assert (np.sort(s, 1)[:, ::-1][:, :5] == slots.score).all()
    assert sum(offered) < 3 * len(low) / 2
