"""The Pitman-Yor model against plain samplers and exact sums."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import language_model as lm


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sentences(seed, n, words=60):
    """Texts in which a word depends on the one before."""
    rng = random.Random(seed)
    names = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(words)]
    out = []
    for _ in range(n):
        at, own = rng.randrange(words), []
        for _ in range(rng.randint(3, 30)):
            own.append(names[at])
            at = (at * 7 + rng.choice((1, 1, 1, 2, 3, rng.randrange(words)))) % words
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("words", [8, 1500])
def test_probabilities_sum_to_one(spark, words):
    table, m = lm.fit(corpus(spark, sentences(8, 60 if words < 100 else 300, words)), 1)
    c = lm.merged(lm._columns(table.toArrow()), m.lex)
    assert len(c.words) == m.lex.types and (words == 8) == (len(m.lex.hot) == m.lex.types)
    score = lm.Scorer(c, m)
    every = np.arange(len(c.words) + 1)  # the last is an unknown word
    for context in (0, 5, lm.CLASSES, lm.CLASSES + 3, m.lex.restaurants - 1):
        assert abs(score(every, np.full(len(every), context)).sum() - 1) < 1e-9


def test_scores_do_not_depend_on_buckets_or_partitions(spark):
    docs = corpus(spark, sentences(3, 200, 900))
    one = {r["doc_id"]: tuple(r) for r in lm.scores(docs, docs.where("doc_id % 5 > 0"), 2)[0].collect()}
    two = {r["doc_id"]: tuple(r) for r in lm.scores(docs.repartition(7), docs.where("doc_id % 5 > 0").repartition(3), 11)[0].collect()}
    assert one.keys() == two.keys()
    assert all(np.allclose(one[k][1:], two[k][1:], rtol=0, atol=1e-8) for k in one)


def test_tables_follow_the_exact_conditional():
    d, keys = 0.5, lm.mix64(np.arange(40_000, dtype=np.uint64))
    exact = lm.log_stirling(d, 1200)
    for customers, weight in ((2, 0.3), (4, 0.7), (60, 2.0), (256, 5.0), (300, 1.0), (1200, 0.4), (1200, 20.0), (1200, 500.0)):
        t = np.arange(1, customers + 1)
        logs = np.log(weight) * t + exact[customers, t]
        p = np.exp(logs - logs.max())
        p /= p.sum()
        drawn = lm.seat(np.full(len(keys), customers), np.full(len(keys), weight), d, keys)
        assert abs(drawn.mean() / (p @ t) - 1) < (0.01 if customers <= lm.TABLE else 0.03)
        if customers <= lm.TABLE:
            assert np.abs(np.bincount(drawn, minlength=customers + 1)[1:] / len(keys) - p).max() < 0.01
    assert lm.seat(np.array([0, 1]), np.array([1.0, 1.0]), d, keys[:2]).tolist() == [0, 1]


def test_tables_follow_a_plain_sampler():
    """Customers of one dish leave and come back one at a time."""
    rng, d, weight, tables = random.Random(5), 0.6, 1.3, [12]
    seen = []
    for turn in range(30_000):
        at = rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        tables = [n for n in tables if n]
        k = rng.choices(range(len(tables) + 1), [n - d for n in tables] + [weight])[0]
        tables = tables + [1] if k == len(tables) else [n + (i == k) for i, n in enumerate(tables)]
        if turn > 500:
            seen.append(len(tables))
    keys = lm.mix64(np.arange(30_000, dtype=np.uint64))
    drawn = lm.seat(np.full(30_000, 12), np.full(30_000, weight), d, keys)
    assert abs(drawn.mean() - np.mean(seen)) < 0.15 and abs(drawn.std() - np.std(seen)) < 0.15


def plain(train, contexts, classes, discounts, strengths, sweeps=40, burn=15, seed=1):
    """Customers of three levels seated one at a time; the averaged predictive probability."""
    rng = random.Random(seed)
    rooms = defaultdict(lambda: defaultdict(list))  # restaurant -> dish -> tables
    total, tables = defaultdict(int), defaultdict(int)
    types = len({w for t in train for w in t})

    def parent(r):
        return {"leaf": ("class", classes[r[1]]) if r[0] == "leaf" else None, "class": ("root", 0), "root": None}[r[0]]

    def level(r):
        return {"leaf": 0, "class": 1, "root": 2}[r[0]]

    def prob(r, w):
        if r is None:
            return 1 / (types + 1)
        d, s = discounts[level(r)], strengths[level(r)]
        own = rooms[r].get(w, ())
        return (sum(own) - d * len(own) + (s + d * tables[r]) * prob(parent(r), w)) / (s + total[r])

    def enter(r, w):
        if r is None:
            return
        d, s = discounts[level(r)], strengths[level(r)]
        own = rooms[r][w]
        k = rng.choices(range(len(own) + 1), [n - d for n in own] + [(s + d * tables[r]) * prob(parent(r), w)])[0]
        total[r] += 1
        if k == len(own):
            own.append(1)
            tables[r] += 1
            enter(parent(r), w)
        else:
            own[k] += 1

    def leave(r, w):
        if r is None:
            return
        own = rooms[r][w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        total[r] -= 1
        if not own[k]:
            own.pop(k)
            tables[r] -= 1
            leave(parent(r), w)

    tokens = [(("leaf", p) if p in contexts else ("class", classes[p]), w) for t in train for p, w in zip([t[-1], *t], t, strict=False)]
    for r, w in tokens:
        enter(r, w)
    states = []
    for turn in range(sweeps):
        for r, w in tokens:
            leave(r, w)
            enter(r, w)
        if turn >= burn and turn % 5 == 0:
            states.append(({r: {w: list(x) for w, x in v.items()} for r, v in rooms.items()}, dict(total), dict(tables)))

    def average(p, w):
        out = 0.0
        for r0, t0, k0 in states:
            rooms.clear(), total.clear(), tables.clear()
            for r, v in r0.items():
                rooms[r].update(v)
            total.update(t0), tables.update(k0)
            out += prob(("leaf", p) if p in contexts else ("class", classes[p]), w)
        return out / len(states)

    return average


def test_scores_are_near_a_plain_sampler(spark):
    texts = sentences(11, 160, 40)
    docs = corpus(spark, texts)
    got, m = lm.scores(docs, docs.where("doc_id % 4 > 0"), 3)
    own = {r["doc_id"]: r["score"] for r in got.where("doc_id % 4 = 0").collect()}
    split = [[*t.split(), None] for t in texts]
    known = {w for t in split for w in t}
    classes = {w: 0 if w is None else int(lm._classes(lm.pa.array([w]))[0]) for w in known}
    train = [t for i, t in enumerate(split) if i % 4]
    probability = plain(train, {w for t in train for w in t}, classes, m.discounts, m.totals[-1].strengths)
    want = {i: sum(np.log10(probability(p, w)) for p, w in zip([None, *t], t, strict=False)) for i, t in enumerate(split) if i % 4 == 0}
    assert abs(sum(own.values()) / sum(want.values()) - 1) < 0.02
    assert all(abs(own[i] - want[i]) < 0.05 * abs(want[i]) + 0.3 for i in want)


def test_context_restaurants_help_held_out_text(spark):
    docs = corpus(spark, sentences(2, 400))
    got, _ = lm.scores(docs, docs.where("doc_id % 4 > 0"))
    r = got.where("doc_id % 4 = 0").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.75 * r["b"]


def test_clashing_columns_nulls_and_long_texts(spark):
    rows = [(0, None, 1.0, 2), (1, "", 1.0, 2), (None, "word " * 30_000, 1.0, 2), (3, "word other", 1.0, 2), (3, "word other", 1.0, 2), (3, "more", 1.0, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, kind int")
    clean = docs.select(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "score", "kind")
    got = sorted(tuple(r) for r in lm.scores(clean, clean, 2)[0].select("doc_id", "n_tokens", "score").collect())
    assert [(r[0], r[1]) for r in got] == [(-1, 30_001), (0, 1), (1, 1), (3, 2), (3, 3), (3, 3)]
    assert got[1][2] == got[2][2] and got[4][2] == got[5][2]


def test_buckets_are_dealt_evenly(spark):
    for least in (1, 9, 30, 100):
        keys = lm.even_keys(spark, least)
        parts = spark.createDataFrame([(int(k),) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(4)).alias("p")).groupBy("p").count().collect()
        assert len(set(keys.tolist())) == len(keys) >= least
        if least <= 64:
            assert len(parts) == 4 and len({r["count"] for r in parts}) == 1
