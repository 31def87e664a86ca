"""Each query itself over the smallest tables: its columns, and what plain code says of them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA

import corpus_pipeline
from tessella.llm import fingerprints, packing, queries, secrets

COLUMNS = {
    "op1_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op2_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_mixing": "doc_id bigint, source string, block bigint, slot bigint, position bigint",
    "op9_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name: (dict(df.dtypes), df.collect()) for name, df in ((n, q(spark, DATA)) for n, q in queries.queries().items())}


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(results, documents, name):
    types, rows = results[name]
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert types[c] == kind, c
    if "doc_id" in types and name != "op6_packing":
        assert sorted(r["doc_id"] for r in rows) == sorted(documents)


def test_language_model_query(results, documents):
    train, counts = {}, Counter()
    for d, t in documents.items():
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), None]
        train[d] = (zlib.crc32(str(d).encode()) % 10 != 0, tokens)
        if train[d][0]:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    for r in results["op2_language_model"][1]:
        taught, tokens = train[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not taught, len(tokens), sum(t in counts for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel=1e-9)
        assert r["score"] < 0
    held = [r for r in results["op2_language_model"][1] if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_sharding_query(results, documents):
    rows = results["op3_sharding"][1]
    shards, texts = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = documents[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append(r)
        texts[raw].add(r["shard"])
    assert set(shards) <= set(range(16)) and all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in shards.values())
    sizes = [sum(r["size"] for r in shards[i]) for i in range(16)]
    assert max(sizes) < 1.25 * sum(sizes) / 16
    total = sum(sizes)
    assert all(len(s) == 1 for raw, s in texts.items() if Counter(documents.values())[raw.decode()] * (len(raw) + 1) < total / 32)


def test_secrets_query(spark):
    larger = DATA.replace("sf0.001", "sf0.01")
    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    some = 0
    for r in queries.queries()["op4_secrets"](spark, larger).collect():
        found = sorted((m.start(), i, k, m.end()) for i, (k, p, g, least) in enumerate(kinds) for m in p.finditer(documents[r["doc_id"]]) if len(m[g]) >= least)
        joined = [f"{k}:{a}:{b}" for a, _, k, b in found]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(f[2] == k for f in found) for k, *_ in kinds)
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in secrets.BASE] == joined
        some += len(joined)
    assert some


def test_packing_query(results, documents):
    w = packing.tokenizer()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in results["op6_packing"][1]:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in documents.items():
        ids = np.array([*w.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_fingerprint_query(results, documents):
    ids = sorted(documents)
    by = {r["doc_id"]: r for r in results["op10_fingerprints"][1]}
    for d, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t = documents[d]
        assert by[d]["n_chars"] == len(t) and by[d]["edited_sha256"] == hashlib.sha256(fingerprints.edited(t, documents[after]).encode()).hexdigest()
        assert 0 <= by[d]["near_next"] <= 1 and 0 <= by[d]["near_edited"] <= 1
    prints = defaultdict(set)
    for d, t in documents.items():
        prints[t].add(by[d]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_near_query_links_all_pairs(results, documents):
    """Recall against all pairs of the table."""
    sets = {}
    for d, t in documents.items():
        w = lowered(t).encode().split()
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    got = {r["doc_id"]: r for r in results["op9_near_dedup"][1]}
    ids = sorted(sets)
    linked = 0
    for i, a in enumerate(ids):
        assert got[a]["n_shingles"] == len(sets[a])
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                linked += 1
                assert got[a]["component_id"] == got[b]["component_id"]
    assert linked and all(r["kept"] == (r["component_id"] == d) for d, r in got.items())


def test_mixing_query(results):
    rows = results["op8_mixing"][1]
    assert all(r["in_mix"] for r in rows) and len({r["position"] for r in rows}) == len(rows)
    slots = {r["slot"]: r["source"] for r in rows}
    assert sorted(slots) == list(range(len(slots)))
    for s in set(slots.values()):
        share = sum(x == s for x in slots.values()) / len(slots)
        had = 0
        for slot in sorted(slots):
            had += slots[slot] == s
            assert abs(had - share * (slot + 1)) < 1


def test_pipeline_query(spark, documents):
    """The pipeline as it is registered: its pieces tile the documents that are left, one of each group of copies."""
    pieces = defaultdict(int)
    tokens = {}
    for r in corpus_pipeline.queries()["pipeline"](spark, DATA).collect():
        pieces[r["doc_id"]] += r["length"]
        tokens[r["doc_id"]] = r["doc_tokens"]
    assert pieces == tokens and set(pieces) <= set(documents)
    assert len({lowered(documents[d]) for d in pieces}) == len(pieces) > len(documents) / 2
