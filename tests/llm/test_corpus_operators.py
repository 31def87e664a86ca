"""Corpus operators against plain versions on small fixtures."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, fingerprints, language_model, minhash, mixing, near_dedup, packing, quality, queries, secrets, sharding, text, urls
from tessella.plans import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, kept int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies, clashing columns."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([2, 3, 4, 30, 200]))) for _ in range(40)]
    base[7] = " ".join(rng.choices(words, k=8000))
    rows = list(enumerate(base))
    for i in range(30):  # copies, case copies and near copies
        t = base[i % 10 + 20].split()
        if i % 3 == 1:
            t = [w.upper() for w in t]
        elif i % 3 == 2:
            t[len(t) // 2] = "changed"
        rows.append((100 + i, " ".join(t)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "one"), (205, "É ß x"), (206, "é ß x"), (None, "nameless text here"), (3, base[3]), (3, "same id other text")]
    return spark.createDataFrame([(d, t, None, None if i % 5 == 0 else f"s{i % 3}", None, "x", 1) for i, (d, t) in enumerate(rows)], DOCS)


def plain(docs):
    return [(-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect()]


def lowered(t):
    return t.encode().lower().decode()


def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("bits", [63, 2])
def test_exact_dedup(docs, bits):
    rows = plain(docs)
    keep, size = {}, {}
    for d, t in rows:
        k = lowered(t)
        keep[k], size[k] = max(keep.get(k, -1), d), size.get(k, 0) + 1
    stays = {(keep[k], k): 1 for k in keep}  # of rows equal in id and text one stays
    want = sorted((d, keep[lowered(t)], size[lowered(t)], stays.pop((d, lowered(t)), 0) == 1, hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t in rows)
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(docs, size=64, bits=bits).collect())  # two-bit hashes collide throughout
    assert got == want
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0


def test_near_dedup_finds_all_components(docs):
    rows = plain(docs)
    for k in (4, 5):
        sets = []
        for _, t in rows:
            w = lowered(t).encode().split()
            sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
        parent = list(range(len(rows)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in itertools.combinations(range(len(rows)), 2):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
        least = {}
        for i, (d, _) in enumerate(rows):
            least[find(i)] = min(least.get(find(i), d), d)
        want = sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.components(docs, k=k).collect())
        assert got == want
    assert near_dedup.components(empty(docs)).count() == 0


def test_chain_of_near_texts_is_one_component(spark):
    rng = random.Random(9)
    w = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
    rows = []
    for i in range(12):  # each step changes five words: neighbours are linked, the ends are not
        rows.append((i, " ".join(w)))
        for j in range(5):
            w[20 * i + j] = f"new{i}-{j}"
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), k=5).collect()
    assert {r["component_id"] for r in got} == {0}


def test_pairs_among_texts_that_share_a_passage_are_found(spark):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(89)]
    rows = []
    for i in range(150):  # 85 shingles of the passage; a pair has 89 of 111 in common, others 85 of 115
        own = [f"o{i}-{j}" for j in range(4)]
        for side in (0, 1):
            rows.append((2 * i + side, " ".join([*passage, *own, *(f"x{rng.randint(0, 10**9)}" for _ in range(11))])))
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), k=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d // 2 * 2 for d, _ in rows}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    walk = minhash.walks(64)
    for size in (5, 40, 2000):
        a = np.unique(rng.integers(0, 2**63, size * 2, dtype=np.uint64) * np.uint64(2))
        got = []
        for _ in range(60):
            common, own = rng.permutation(a)[: int(size * 0.8)], np.unique(rng.integers(0, 2**63, int(size * 0.2) + 1, dtype=np.uint64))
            x, y = np.unique(common), np.unique(np.concatenate([common, own]))
            s = minhash.signatures([x, y], 64, walk)
            got.append((s[0] == s[1]).mean() - len(x) / len(y))
        assert abs(np.mean(got)) < 0.05


def test_fingerprints(docs):
    """Against a plain version that holds all rows in order; rows that share an id are told apart by
    their number of characters, and any order among them may stand."""
    rows = sorted(plain(docs))
    got = fingerprints.compared(docs, ranges=7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    walk = minhash.walks(fingerprints.BINS)

    def alike(a, b):
        p, some = fingerprints.packed([a, b], walk)
        return fingerprints.likeness(p[:1], p[1:], some[:1], some[1:])[0], [x.tobytes().hex() if s else "" for x, s in zip(p, some, strict=True)]

    def shared(a, b):
        x, y = (lowered(t).split() for t in (a, b))
        u, v = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (x, y))
        return len(u & v) / len(u | v) if u | v else 1.0

    errors = []
    for i, (d, t) in enumerate(rows):
        follows = [x for j, (e, x) in enumerate(rows) if e == d and j != i] if len(by[d]) > 1 else []
        after = rows[(i + 1) % len(rows)][0]
        follows += [x for e, x in rows if e == after]
        mine = [r for r in by[d] if r["n_chars"] == len(t)]
        ok = False
        for r in mine:
            for x in follows:
                e = fingerprints.edited(t, x)
                (near, (own, other)), (next_, _) = alike(t, e), alike(t, x)
                if (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (own, other, hashlib.sha256(e.encode()).hexdigest()) and (r["near_edited"], r["near_next"]) == (near, next_):
                    ok = True
                    errors.append(near - shared(t, e))
        assert ok, (d, t[:40])
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.3
    assert fingerprints.compared(empty(docs)).count() == 0
    many = docs.sparkSession.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    assert fingerprints.compared(many, ranges=8).count() == 400  # one id, split by the texts' hashes
    assert fingerprints.ranged(many, 8)[0].groupBy("range").count().count() == 8


def test_single_shingles_do_not_agree_by_chance():
    walk = minhash.walks(fingerprints.BINS)
    texts = [f"only these words {i}" for i in range(40)]
    p, some = fingerprints.packed(texts, walk)
    a, b = map(list, zip(*itertools.combinations(range(40), 2), strict=True))
    assert fingerprints.likeness(p[a], p[b], some[a], some[b]).max() < 0.2


def test_sharding(docs):
    got = sharding.shard(docs, shards=4, large=64).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in plain(docs))
    for k in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty(docs)).count() == 0


def test_groups_stay_whole_unless_they_are_more_than_half_a_shard(docs):
    got = sharding.shard(docs, shards=4, large=64).collect()
    total = {k: sum(r[k] for r in got) / 4 for k in ("size", "tokens")}
    groups = {}
    for r in got:
        groups.setdefault(r["group"], []).append(r)
    for own in groups.values():
        part = max(len(own) * 4 / len(got), *(sum(r[k] for r in own) / total[k] for k in total))
        assert len({r["shard"] for r in own}) <= np.ceil(2 * part)


def test_placing_against_a_plain_loop():
    rng = np.random.default_rng(3)
    items = rng.random((60, 3)) ** 3
    items /= items.sum(0) / 5
    where, left = sharding.place(items, 5)
    free = [[1.0] * 3 for _ in range(5)]
    for i in sorted(range(60), key=lambda i: -max(items[i])):
        best = max(range(5), key=lambda k: (sum(a * b for a, b in zip(free[k], items[i], strict=True)), -k))
        assert where[i] == best
        free[best] = [a - b for a, b in zip(free[best], items[i], strict=True)]
    assert np.allclose(left, free)


def test_sharding_is_balanced_with_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id", F.lit(" x"))).alias("text"))
    got = sharding.shard(rows, shards=16).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert len(got) == 16 and max(r["s"] for r in got) <= 1.05 * min(r["s"] for r in got)


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "api_key", "ApiKey", "token", '"', "'", " ", " ", ":", "=", "abc", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOP12", "deadbeef", "0123456789abcdef", "é", "\n", "K", "ſecret"]
    texts = ["".join(rng.choices(bits, k=30)) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
    found, ledger = secrets.scan_documents(docs)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["found"] if s["kind"] in secrets.BASE] for r in found.collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), "assign", m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(got[i]) == sorted(want)
    assert ledger.count() == (len(set(texts) - {None, ""}) + 1) * len(secrets.RULES)


def test_ledger_is_kept_and_only_unseen_pairs_are_scanned(spark, tmp_path):
    at = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "secret=abcdefgh"), (2, "plain"), (3, "secret=abcdefgh")], "doc_id long, text string")
    _, ledger = secrets.scan_documents(first, at=at)
    assert ledger.count() == 2 * len(secrets.RULES)
    more = spark.createDataFrame([(900, "token: qwertyuiop"), (901, "plain"), (902, None)], "doc_id long, text string")
    found, whole = secrets.scan_documents(more, at=at)
    assert whole.count() == 4 * len(secrets.RULES)
    assert {r["doc_id"]: len(r["found"]) for r in found.collect()} == {900: 1, 901: 0, 902: 0}
    raised = (secrets.Rule(secrets.RULES[0].kind, secrets.RULES[0].pattern, 6, 2, (), secrets.RULES[0].flags, 2), *secrets.RULES[1:])
    assert secrets.scan(secrets.distinct_blobs(more), raised, secrets.read_ledger(spark, at)).count() == 3
    _, again = secrets.scan_documents(more, at=at)
    assert again.count() == whole.count()
    again.limit(1000).coalesce(1).write.mode("append").parquet(at)  # what two runs at once would leave
    found, _ = secrets.scan_documents(more, at=at)
    assert {r["doc_id"]: len(r["found"]) for r in found.collect()} == {900: 1, 901: 0, 902: 0}


def test_a_run_with_nothing_new_moves_no_text(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(i, f"secret=abcdefgh{i}") for i in range(30)], "doc_id long, text string")
    secrets.scan_documents(docs, at=at)
    moved = []
    first = secrets.distinct_blobs
    monkeypatch.setattr(secrets, "distinct_blobs", lambda d: moved.append(sorted(r["blob"] for r in d.select("blob").collect())) or first(d))
    secrets.scan_documents(docs, at=at)
    assert moved == []
    one = spark.createDataFrame([(77, "token=unseen-one")], "doc_id long, text string")
    found, ledger = secrets.scan_documents(docs.unionByName(one), at=at)
    assert [len(x) for x in moved] == [1] and ledger.count() == 31 * len(secrets.RULES)
    assert sum(len(r["found"]) for r in found.collect()) == 31


def test_ranges_and_sample_have_bounds(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1)
    monkeypatch.setattr(fingerprints, "MOST_RANGES", 5)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text"))
    parts, number = fingerprints.ranged(rows)
    assert number <= 5 and parts.groupBy("range").count().count() <= 5
    assert fingerprints.compared(rows).count() == 3000


def test_repeated_ids_teach_the_network_once(spark, monkeypatch):
    rows = [(i % 2, f"a text of words {i % 2}") for i in range(500)]
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    taught = []
    monkeypatch.setattr(quality, "train", lambda x, y: taught.append(len(x)))
    quality._fitted(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert taught == [2]


def test_urls(spark):
    rows = [
        (1, "https://shop.Example.COM/en/7x?q"), (2, "http://a.com/en/81"), (3, "x://net/de/1"), (4, "http://example.net/de/81#f"), (5, "http://b.example.net/de/9"), (6, None),
        (7, "no scheme/en/"), (8, "http://com/en"), (9, "http://notcom/en/1"), (10, "http://h.org/es/"), (11, "http://fresh.dev/a/b/c/d/e/f"),
    ]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    want = {1: ("shop.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("a.com", "/en/81", "com/en/", "block"), 3: ("net", "/de/1", "net/de/", "allow"), 4: ("example.net", "/de/81", "example.net/de/8", "block"), 5: ("b.example.net", "/de/9", "net/de/", "allow"), 10: ("h.org", "/es/", "org/es/", "block")}
    for k, v in want.items():
        assert tuple(got[k][c] for c in ("host", "path", "rule", "verdict")) == v
    for k in (6, 7):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == ("", "", None, "allow")
    assert got[9]["rule"] is None and got[11]["verdict"] == "allow"
    many = [(i, f"http://site.com/{'en' if i % 2 else 'fr'}/{i}") for i in range(400)] + [(500, "http://site.com/en")]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(many, "page_id long, url string")).collect()}
    assert got[500]["verdict"] == "block" and got[2]["verdict"] == "allow"  # learnt from the labelled branch, and not beyond it
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_urls(rows):
    """The template tree of one host at a time, by recursion over lists."""
    hosts = {}
    for i, url in rows:
        u = url or ""
        rest = u[u.index("://") + 3 :] if "://" in u else ""
        raw = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(raw) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        fits = [(len(h + p), k, w) for k, (w, h, p) in enumerate(urls.RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        listed = max(fits)[2] if fits else None
        parts = ["*" if re.search("[0-9]", x) else x for x in path.split("/") if x]
        if len(parts) > urls.DEPTH:
            parts = [*parts[: urls.DEPTH - 1], "/".join(parts[urls.DEPTH - 1 :])]
        hosts.setdefault(host, []).append((i, listed, parts))
    out = {}

    def counts(own):
        return len(own), sum(x[1] is not None for x in own), sum(x[1] == "block" for x in own)

    def walk(own, level):
        n, labelled, blocked = counts(own)
        for i, listed, parts in own:
            if len(parts) <= level:
                purity = (blocked + urls.PRIOR * urls.NEUTRAL) / (labelled + urls.PRIOR)
                out[i] = listed or ("block" if purity >= urls.REJECT else "allow")
        kids = {}
        for x in own:
            if len(x[2]) > level:
                kids.setdefault(x[2][level], []).append(x)
        fixed = {k: v for k, v in kids.items() if k != "*"}
        thin = len(fixed) > urls.CHILDREN and sum(map(len, fixed.values())) < urls.THIN * len(fixed)
        merged, last = {}, None

        def shares(v):
            c = counts(v)
            return c[0], [(x + 1) / (c[0] + 3) for x in (c[2], c[1] - c[2], c[0] - c[1])]

        for k, v in sorted(kids.items(), key=lambda x: (*shares(x[1])[1][:2], x[0])):
            if k == "*" or thin:
                merged.setdefault("*", []).extend(v)
                continue
            differs = False
            if last is not None:
                (m, p), (w, q) = shares(v), shares(last[1])
                differs = any(abs(x - y) > urls.Z * (x * (1 - x) / (m + 3) + y * (1 - y) / (w + 3)) ** 0.5 for x, y in zip(p, q, strict=True))
            name = k if last is None or differs else last[0]
            last = (name, v)
            merged.setdefault(name + "#", []).extend(v)
        for v in merged.values():
            walk(v, level + 1)

    for own in hosts.values():
        walk(own, 0)
    return out


def test_urls_against_a_plain_tree(spark):
    rng = random.Random(17)
    rows = []
    for i in range(1500):
        host = rng.choice(["a.com", "Shop.com", "b.org", "example.net", "c.dev"])
        path = "/".join(rng.choice(["en", "fr", "es", "de", "news", "x1", f"p{rng.randint(0, 99)}", rng.choice("abcdefghijklmnopqrstuv") * 2]) for _ in range(rng.randint(0, 6)))
        rows.append((i, f"http://{host}/{path}" + rng.choice(["", "?q=1", "#top"])))
    rows += [(9000, None), (9001, "nothing"), (9002, "http://a.com/" + "en/" * 3000)] + [(9100 + k, rows[5][1]) for k in range(3)]
    d = spark.createDataFrame([(i, u, "h", "v", 1) for i, u in rows], "page_id long, url string, host string, verdict string, n int")
    assert {r["page_id"]: r["verdict"] for r in urls.judged(d).collect()} == plain_urls(rows)


def test_alike_branches_are_merged_and_unlike_ones_stay(spark):
    # six sections, half of them with blocked pages; a section that is not listed itself follows its own kind
    rules = [("block", "h.com", f"/bad{x}/l/") for x in "abc"] + [("allow", "h.com", f"/good{x}/l/") for x in "abc"]
    rows, i = [], 0
    for x in "abc":
        for kind in ("bad", "good"):
            for j in range(60):
                rows.append((i, f"http://h.com/{kind}{x}/l/{j}"))
                i += 1
            rows.append((10_000 + i, f"http://h.com/{kind}{x}"))
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    for p, url in rows:
        assert got[p]["verdict"] == ("block" if "/bad" in url else "allow"), url
    assert {r["template"].split("/")[1] for r in got.values()} == {"bada#3", "gooda#3"}


def test_tokenizer_equals_the_library():
    rng = random.Random(3)
    chars = [chr(c) for c in [*range(0, 0x250), 0x3A3, 0x301, 0x308, 0x1E9E, 0x212A, 0x2028, 0x3000, 0x4E2D, 0xAC00, 0x1100, 0x1161, 0x660, 0x1F600]]
    texts = ["".join(rng.choice(chars + [" ", "'", "s", "_"] * 60) for _ in range(120)) for _ in range(400)] + ["a<|endoftext|>b", "", "İ Σ"]
    w = packing.tokenizer()
    ids, offsets = w.encode(pa.array(texts))
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(docs):
    w = packing.tokenizer()
    got = packing.pack(docs, with_ids=True).collect()
    whole = {}
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(bytes(r["ids"])) == 4 * r["length"]
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = sorted([*w.tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t in plain(docs))
    built = []
    for group in whole.values():
        for r in sorted(group, key=lambda r: (r["start"], r["ids_crc32"])):
            if r["start"] == 0:
                built.append([])
        texts = {}
        for r in group:
            texts.setdefault(r["start"], []).append(r)
        assert sum(r["length"] for r in group) == group[0]["doc_tokens"] * len(texts[0])
    assert sum(len(t) for t in want) == sum(r["length"] for r in got)
    single = {k: g for k, g in whole.items() if len([r for r in g if r["start"] == 0]) == 1}
    assert all(list(itertools.chain.from_iterable(struct.unpack(f"<{r['length']}I", bytes(r["ids"])) for r in sorted(g, key=lambda r: r["start"]))) in want for g in single.values())
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(empty(docs)).count() == 0


def test_cuts_cover_and_bins_waste_little():
    reciprocals = {2048 // m for m in range(1, 33)}
    for n in (1, 63, 64, 65, 682, 683, 1500, 2047, 2048, 2049, 100_000):
        assert all(m in reciprocals or m < 64 for _, m in packing.cuts(n)) and sum(m < 64 for _, m in packing.cuts(n)) <= 1
        parts = list(packing.cuts(n))
        assert parts[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(parts, parts[1:], strict=False)) and sum(m for _, m in parts) == n
    assert all(2048 - 2048 // n * n < 64 for n in (*range(1, 64), *reciprocals))


def plain_mix(rows, units, block, deviation=None):
    """Slots by a scheduler that looks at all sources anew in each slot."""
    total, out, had = sum(units.values()), [], dict.fromkeys(units, 0)
    slots = max(-(-sum(x == k for x in rows) // block) * total // u for k, u in units.items()) + total
    for slot in range(slots):
        ready = [(-(-(had[k] + 1) * total // u), -(had[k] * total // u), k) for k, u in units.items() if had[k] * total // u <= slot]
        k = min(ready)[2]
        out.append((k, had[k]))
        had[k] += 1
    return {x: i for i, x in enumerate(out)}


def test_mixing(docs):
    assert mixing.whole({"a": 0.75, "b": 0.25, "c": 2**-20, "d": 0.0}) == {"a": 3 << 18, "b": 1 << 18, "c": 1}
    got = mixing.mix(docs, block=2).collect()
    assert len(got) == docs.count()
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], r["source"]) == r["source"]
    assert len({r["position"] for r in got}) == len(got)
    assert mixing.mix(empty(docs)).count() == 0


def test_shares_are_exact_at_any_number_of_blocks():
    blocks = {"a": 30_000, "b": 20_000, "c": 10_000, "d": 4_103, "tiny": 10, "one": 1}
    run = mixing.schedule(blocks, blocks)
    assert sorted((k, j) for k, j, _ in run) == sorted((k, j) for k, n in blocks.items() for j in range(n))
    assert [slot for _, _, slot in run] == list(range(sum(blocks.values())))
    assert mixing.deviation(run, blocks) < 1
    rng = random.Random(11)
    for _ in range(30):
        blocks = {str(i): rng.choice([1, 3, 40, 900, 5000]) for i in range(rng.randint(1, 12))}
        units = mixing.whole({k: rng.random() ** 4 + 1e-4 for k in blocks})
        run = mixing.schedule(blocks, units)
        assert mixing.deviation(run, units) < 1
        last = {k: max((j for x, j, _ in run if x == k), default=-1) for k in blocks}
        assert any(last[k] == blocks[k] - 1 for k in blocks)


def test_blocks_grow_with_the_input_within_the_bound(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 7, "tiny").otherwise("rest").alias("source"))
    got = mixing.mix(rows, most=100).collect()
    assert {r["in_mix"] for r in got} == {True} and len({r["position"] for r in got}) == 5000
    assert len({(r["source"], r["block"]) for r in got}) == 101 and max(r["slot"] for r in got) == 100


def test_blocks_have_one_length_at_any_size(spark):
    own = F.when(F.col("id") < 9, "tiny").when(F.col("id") % 3 == 0, "third").otherwise("rest")
    rows = spark.range(540_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), own.alias("source"))
    got = materialise(mixing.mix(rows).groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("slot"), F.max("slot").alias("to"), F.sum(F.col("in_mix").cast("int")).alias("in_mix")))
    assert got.where("slot != to or n != in_mix").count() == 0
    counts = {(r["source"], r["n"]): r["count"] for r in got.groupBy("source", "n").count().collect()}
    assert counts == {("tiny", 4): 2, ("tiny", 1): 1, ("third", 4): 44_999, ("third", 1): 1, ("rest", 4): 89_998, ("rest", 2): 1}
    want = {(k, j): slot for k, j, slot in mixing.schedule({"tiny": 3, "third": 45_000, "rest": 89_999}, {"tiny": 3, "third": 45_000, "rest": 89_999})}
    assert {(r["source"], r["block"]): r["slot"] for r in got.collect()} == want and len(want) > 2 * mixing.SLOTS


def test_stretches_give_one_schedule(spark):
    rng = random.Random(5)
    for _ in range(150):
        blocks = [rng.choice([1, 1, 2, 3, 9, 40, 200, rng.randint(1, 400)]) for _ in range(rng.randint(1, 12))]
        exact = list(mixing.whole({i: rng.random() ** 4 + 1e-4 for i in range(len(blocks))}).values())
        units = rng.choice([blocks, exact, [rng.randint(1, 30) for _ in blocks]])
        end, slots = mixing.end_of(blocks, units), rng.choice([1, 2, 7, 50])
        found, got = defaultdict(list), []
        for i in range(-(-end // slots)):
            for later, *row in mixing.lows(blocks, units, i, slots, -(-end // slots)):
                found[later].append(tuple(row))
        for i in range(-(-end // slots)):
            got += mixing.run(blocks, units, i * slots, min(end, (i + 1) * slots), mixing.waiting_at(units, i * slots, found[i]))
        assert got == mixing.run(blocks, units, 0, end)
    rows = mixing.slots_of(spark, blocks, units, slots=max(1, end // 9)).collect()
    assert sorted(map(tuple, rows)) == sorted(got)


def test_order_of_a_source_does_not_depend_on_its_buckets(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 700, "a").otherwise("b").alias("source"))
    want = sorted(mixing.mix(rows).collect())
    for each in (20, 7):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", each)
        assert sorted(mixing.mix(rows).collect()) == want


def test_mixing_against_a_plain_schedule(spark):
    names = ["a"] * 33 + ["b"] * 70 + ["c"] * 8 + [None] * 5 + ["unnamed"] * 4
    rows = spark.createDataFrame([(i, "t", s) for i, s in enumerate(names)], "doc_id long, text string, source string")
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, mixing.NO_SOURCE: 1.0}
    got = mixing.mix(rows, weights, block=3).collect()
    filled = [mixing.NO_SOURCE if s is None else s for s in names]
    want = plain_mix(filled, {k: int(w) for k, w in weights.items()}, 3)
    for r in got:
        if r["source"] == "unnamed":
            assert r["slot"] is None and not r["in_mix"] and r["weight"] == 0
        elif not r["in_mix"]:
            assert r["slot"] is None and r["weight"] == weights[r["source"] or mixing.NO_SOURCE] / 10
        else:
            assert r["slot"] == want[r["source"] or mixing.NO_SOURCE, r["block"]]
    end = max(r["slot"] for r in got if r["in_mix"]) + 1
    for name in weights:
        own = {r["slot"] for r in got if r["in_mix"] and (r["source"] or mixing.NO_SOURCE) == name}
        share = next(r["weight"] for r in got if (r["source"] or mixing.NO_SOURCE) == name)
        assert all(abs(sum(s < t for s in own) - t * share) < 1 for t in range(1, end + 1))


def test_mixing_many_sources_and_a_hot_one(spark):
    own = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50))
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), own.alias("source"))
    got = mixing.mix(rows, block=2).where("in_mix").collect()
    assert len(got) == 3000
    end = max(r["slot"] for r in got) + 1
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(len({r["slot"] for r in own}) - end * own[0]["weight"]) < 1


def test_mixing_without_weights_leaves_nothing_out(spark):
    own = F.when(F.col("id") < 330, "large").when(F.col("id") < 990, "larger").otherwise("small")
    rows = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), own.alias("source"))
    assert mixing.mix(rows).where("in_mix").count() == 1003
    assert mixing.mix(rows, {"large": 1.0, "larger": 1.0, "small": 1.0}).where("not in_mix").count() > 0


def test_language_model_scores(docs):
    df = docs.select(text.doc_id(), text.text_or_empty().alias("text"))
    got, model = language_model.scores(df, df.where("doc_id % 2 = 0"), 5)
    rows = plain(docs)
    counts, n = {}, 0
    for d, t in rows:
        if d % 2 == 0:
            for w in [*lowered(t).encode().split(), None]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
    z = n + 0.1 * (len(counts) + 1)
    want = sorted((d, len(w), sum(x in counts for x in w), round(sum(np.log10((counts.get(x, 0) + 0.1) / z) for x in w), 6)) for d, w in ((d, [*lowered(t).encode().split(), None]) for d, t in rows))
    found = got.collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found) == want
    assert model.lex.tokens == n and all(r["score"] < 0 for r in found)
    assert language_model.scores(empty(df), df, 2)[0].count() == 0
    assert language_model.scores(df, empty(df), 2)[0].count() == len(rows)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95


def test_quality_without_labels_and_with_odd_texts(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = docs.select(text.doc_id(), "text")
    scores = quality.scored(d, quality.fit(d, none)).collect()
    assert len(scores) == docs.count() and all(r["score"] == 0.5 for r in scores)


def test_quality_with_a_score_column_and_repeated_rows(spark):
    rows = [(i, f"some words here {i % 5} and there", "mine", 3) for i in range(40)] + [(1, "some words here 1 and there", "mine", 3), (50, "word " * 60_000, "mine", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1)], "doc_id long, quality int")
    got = quality.scored(d, quality.fit(d, labels))
    assert got.columns.count("score") == 1 and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["text"], set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values())


def test_queries_against_sql(spark, duck):
    sql = queries.oracle_sql()
    for name, statement in sql.items():
        got = queries.queries()[name](spark, DATA)
        left, right = same([tuple(r) for r in got.collect()], got.columns, duck.execute(statement))
        assert left == right


def grouped(rows, linked):
    """Sets of positions that chains of links join."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if linked(i, j):
            parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def test_pipeline(spark, docs):
    """Each stage keeps what a plain version keeps of its own input, in all columns."""
    import corpus_pipeline as p

    def after(stage, d):
        rows = stage(spark, d, DATA)
        assert rows.columns == d.columns
        return spark.createDataFrame(rows.collect(), d.schema)

    assert [name for name, _ in p.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    d = docs.unionByName(spark.createDataFrame([(None, "another nameless text", "e", "s1", 7, "x", 1), (105, "Shared id", None, None, None, "y", 2), (105, "shared ID", None, "s0", None, "z", 3)], DOCS))
    model = quality.fit(d, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = d.collect()
    scores = model.score([r["text"] or "" for r in rows], quality.index_vectors())
    passed = after(p.quality, d)
    assert sorted(map(repr, passed.collect())) == sorted(repr(r) for r, s in zip(rows, scores, strict=True) if s >= p.REJECT_BELOW)

    kept = after(p.exact, d)  # of all rows, whatever the classifier says
    largest = {}
    for i, t in plain(d):
        largest[lowered(t)] = max(i, largest.get(lowered(t), i))
    assert sorted((i, lowered(t)) for i, t in plain(kept)) == sorted((i, t) for t, i in largest.items())

    rows = plain(kept)
    sets = []
    for _, t in rows:
        w = lowered(t).encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    groups = grouped(rows, lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    want = [min((rows[i][0], hashlib.sha256(rows[i][1].encode()).hexdigest(), rows[i]) for i in g)[2] for g in groups]
    fewer = after(p.near, kept)
    assert sorted(plain(fewer)) == sorted(want) and len(want) < len(rows)

    mixed = after(p.mixing, fewer)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, fewer.collect()))

    w = packing.tokenizer()
    got = {}
    for r in p.packing(spark, mixed, DATA).collect():
        got.setdefault(r["doc_id"], []).append(r["length"])
    tokens = {}
    for i, t in plain(mixed):
        tokens[i] = tokens.get(i, 0) + len(w.tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert {i: sum(x) for i, x in got.items()} == tokens
    for _, stage in p.STAGES:
        stage(spark, docs.where("false"), DATA).count()


def test_columns_of_any_name_survive(spark):
    import corpus_pipeline as p

    names = ("_id", "_sha", "_position", "id", "sha", "row", "position")
    rows = [(i, f"a text of its own {i}", "s", *[f"keep-{i}-{n}" for n in names]) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for stage in (p.exact, p.near, p.mixing):
        got = stage(spark, d, DATA)
        assert got.columns == d.columns and sorted(map(tuple, got.collect())) == sorted(rows)


def test_equal_rows_keep_one_and_rows_without_id_stay_linear(spark):
    rows = [(5, "same"), (5, "same"), (4, "Same"), (None, "same")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(-1, 5, 4, False), (4, 5, 4, False), (5, 5, 4, False), (5, 5, 4, True)]
    nameless = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{j}-"), F.floor(F.col("id") / 2)) for j in range(12)], F.col("id").cast("string")).alias("text"))
    wanted = near_dedup.signed(nameless).select("doc_id", "text_sha256", "node")
    assert near_dedup.sets_of(nameless, wanted, 5).count() == 3000
    joined = near_dedup.sets_of(nameless, materialise(wanted), 5)._jdf.queryExecution().executedPlan().toString()
    assert "text_sha256" in joined.split("Join")[1]
    got = near_dedup.components(nameless).groupBy("component").count().collect()
    assert {r["count"] for r in got} == {2} and len(got) == 1500


def test_sequences_follow_the_mix(spark):
    import corpus_pipeline as p

    own = F.when(F.col("id") < 1500, "large").when(F.col("id") < 1900, "middle").otherwise("small")
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (F.col("id") % 7 * 60 + 20).cast("int")), lambda i: F.concat(F.lit("w"), F.col("id") * 7 + i)))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), words.alias("text"), own.alias("source"))
    place = {r["doc_id"]: r["position"] for r in mixing.mix(docs).collect()}
    mixed = materialise(p.mixing(spark, docs, DATA))
    order = [r["doc_id"] for r in p.in_order(mixed).orderBy("place").collect()]
    assert order == sorted(place, key=place.get)
    got = p.packing(spark, mixed, DATA).collect()
    at = {d: i for i, d in enumerate(order)}
    ids = sorted({r["sequence_id"] for r in got})
    assert ids == list(range(len(ids)))
    buckets = 8
    first = {}
    for r in got:
        first.setdefault(r["sequence_id"], []).append(at[r["doc_id"]])
    starts = [min(first[i]) * buckets // len(order) for i in ids]
    assert starts == sorted(starts) and len(set(starts)) == buckets  # sequences go through the mix from begin to end
    without = packing.pack(docs).collect()
    assert sum(r["length"] for r in without) == sum(r["length"] for r in got)
    parts = [r for r in got if r["sequence_id"] < len(ids) // 4]
    share = sum(r["length"] for r in parts if r["doc_id"] < 1500) / sum(r["length"] for r in parts)
    assert abs(share - 0.75) < 0.05  # each stretch of sequences holds the sources by their shares


def test_pipeline_keeps_every_distinct_text(spark):
    import corpus_pipeline as p

    rows = [(None, "first nameless"), (None, "second nameless"), (3, "one text"), (3, "Shared"), (2, "shared"), (3, "one text"), (1, "ONE TEXT")]
    d = spark.createDataFrame([(i, t, None, "s", None, "x", 1) for i, t in rows], DOCS)
    want = sorted({lowered(t) for _, t in rows})
    for stage in (p.exact, p.near, p.mixing):
        d = spark.createDataFrame(stage(spark, d, DATA).collect(), DOCS)
        assert sorted(lowered(r["text"]) for r in d.collect()) == want
