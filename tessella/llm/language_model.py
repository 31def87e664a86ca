"""Language-model scores from a hierarchical Pitman-Yor model.

Three levels of Chinese restaurants: the root over a uniform base, one restaurant per class of the
word before (its last three characters, hashed into ``CLASSES``), and under each class one per word
before that holds at least ``SHARE`` of the training tokens, so there are at most 1 / SHARE of
those. Rarer words before seat their customers in the class directly. Customers are the training
tokens; the tables of a restaurant are the customers of its parent.

Seating is sampled by Gibbs sweeps: given a restaurant's totals and its parent's probability of a
dish, the number of the dish's tables is drawn from its conditional, which is exact up to ``TABLE``
customers (by generalised Stirling numbers); further customers come in runs of doubling size by the same
conditional's rate of new tables. After each sweep the restaurants' totals are
added up and the levels' strengths are drawn anew given them. The predictive probabilities of
``SAMPLES`` states after ``BURN_IN`` sweeps are averaged, and the sum of their log10 over a text is
its score. Every draw follows from the word, its context and the sweep, so scores do not depend on
how rows are dealt.

Everything about a word (its counts per context, its tables, its root customers) lies in one bucket
of the words' hash, so a sweep is a narrow pass over buckets. A word with 1 / HOT of the tokens is
dealt by word and class instead, and its root tables are drawn with the totals. Pairs of a word
before and a word with 1 / HOT of the tokens (at most HOT of them) are scored where the text is
read. The number of buckets follows the number of training tokens.

Words are identified by a 64-bit hash. Defined cases: a null or empty text has the end token alone;
without training rows every probability is that of the base; rows of one doc_id are separate, and
equal texts have equal scores; a long text is cut nowhere, its tokens being summed per bucket; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.text import arrow_bytes, chunks, doc_id, hash_words, mix64, text_or_empty, words
from tessella.plans import materialise

CLASSES = 2048
SUFFIX = 3
#: Least share of the training tokens of a word that has a restaurant of its own as a context.
SHARE = 2.0**-20
SAMPLES, BURN_IN = 3, 1
TABLE = 256
HOT = 512
FOLDS = 10
#: Bytes of text whose tokens are counted together before they are shuffled.
STEP_BYTES = 4_000_000
#: Training tokens that a bucket holds on average.
BUCKET_TOKENS = 2_000_000
SEED = 20

PACKED = "bucket long, kind int, chunk long, words binary, per binary, contexts binary, numbers binary"
_FIELDS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("per", pa.binary()), ("contexts", pa.binary()), ("numbers", pa.binary())])
MODEL, TOKENS, LOCAL = 0, 1, 2


def _end() -> np.uint64:
    """The end token's hash: that of a space, which no word contains."""
    return hash_words(pa.array([" "]))[0]


def _known(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among the sorted ``places``, and where (0 if not)."""
    at = np.searchsorted(places, values)
    at = np.where(at < len(places), at, 0)
    return (places[at] == values if len(places) else np.zeros(len(values), bool)), at


@dataclass
class Lexicon:
    """What all tasks know of the training words: their number of tokens and types, the words with
    a restaurant of their own and those words' classes, and the hot words with their counts."""

    tokens: int
    types: int
    contexts: np.ndarray
    classes: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray
    buckets: np.ndarray  # their keys

    def class_of(self, contexts: np.ndarray) -> np.ndarray:
        """The class of each context number: classes come first, then the words."""
        own = contexts.astype(np.int64)
        return np.concatenate([np.arange(CLASSES), self.classes])[own]

    @property
    def restaurants(self) -> int:
        return CLASSES + len(self.contexts)


def _classes(distinct: pa.Array) -> np.ndarray:
    """The words' classes, from 1."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    tail = hash_words(pc.utf8_slice_codeunits(distinct, start=-SUFFIX))
    return (tail % np.uint64(CLASSES - 1) + np.uint64(1)).astype(np.int64)


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, class, n) of every distinct training word; the end token has class 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            codes, distinct, _ = words(part.column("text"))
            n = np.bincount(codes, minlength=len(distinct)) if len(codes) else np.zeros(0, np.int64)
            hashes = np.concatenate([hash_words(distinct), [_end()]]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(np.concatenate([_classes(distinct), [0]])), pa.array(np.concatenate([n, [part.num_rows]]).astype(np.int64))], names=["word", "class", "n"]
            )

    return training.select("text").mapInArrow(count, "word long, class long, n long").groupBy("word").agg(F.max("class").alias("class"), F.sum("n").alias("n"))


def lexicon(training: DataFrame, buckets: int | None = None) -> Lexicon:
    """At most 1 / SHARE contexts and HOT words reach the driver."""
    table = materialise(vocabulary(training), "words")
    tokens, types = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    own = table.where(F.col("n") >= tokens * SHARE).toArrow()
    hashes = own.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], own.column("n").to_numpy()[order]
    hot = counts * HOT >= tokens
    keys = even_keys(training.sparkSession, int(tokens) // BUCKET_TOKENS + 1) if buckets is None else np.arange(buckets)
    return Lexicon(int(tokens), int(types), hashes, own.column("class").to_numpy()[order].astype(np.int64), hashes[hot], counts[hot], keys)


def even_keys(spark: SparkSession, least: int) -> np.ndarray:
    """Keys of at least ``least`` buckets. While there are few per partition, they are numbers that
    Spark's hash deals to all partitions alike; many are even by themselves."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = -(-least // partitions)
    if each > 16:
        return np.arange(each * partitions)
    tried = spark.range(partitions * (40 + 4 * each)).select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("part")).toArrow()
    ids, parts = tried.column("id").to_numpy(), tried.column("part").to_numpy()
    order = np.lexsort((ids, parts))
    nth = np.arange(len(order)) - np.searchsorted(parts[order], parts[order])
    return np.sort(ids[order][nth < each])


@dataclass
class Step:
    """Tokens of some texts in a row: codes into ``hashes``, each token's context, bucket (by its place
    among the buckets) and text."""

    hashes: np.ndarray
    codes: np.ndarray
    contexts: np.ndarray
    buckets: np.ndarray
    rows: np.ndarray


def step(column: pa.Array, lex: Lexicon) -> Step:
    codes, distinct, offsets = words(column)
    n = len(offsets) - 1
    hashes = np.concatenate([hash_words(distinct), [_end()]])
    classes = np.concatenate([_classes(distinct), [0]])
    known, at = _known(lex.contexts, hashes)
    context = np.where(known, CLASSES + at, classes)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    sequence = np.full(len(codes) + n, len(hashes) - 1, np.int64)
    sequence[np.arange(len(codes)) + rows] = codes
    before = np.concatenate([[len(hashes) - 1], sequence[:-1]]) if len(sequence) else sequence
    # a frequent word is dealt by word and class, any other by word
    mixed, many = mix64(hashes), np.uint64(len(lex.buckets))
    place = (mix64(mixed) % many).astype(np.int64)[sequence]
    at = np.flatnonzero(_known(lex.hot, hashes)[0][sequence])
    place[at] = mix64(mixed[sequence[at]] + mix64(classes[before[at]].astype(np.uint64) + np.uint64(1))) % many
    return Step(hashes, sequence, context[before], place, np.repeat(np.arange(n), np.diff(offsets) + 1))


def _split(s: Step, lex: Lexicon, keep: np.ndarray, numbers: np.ndarray, kind: int, chunk: int) -> Iterator[dict]:
    """Packed rows per bucket of the tokens ``keep``, each with a number; numbers below 2^16 take two
    bytes."""
    order = keep[np.argsort(s.buckets[keep] * len(s.hashes) + s.codes[keep], kind="stable")]
    width = np.uint16 if len(order) == 0 or numbers[keep].max() < 1 << 16 else np.uint32
    codes, buckets, numbers = s.codes[order], s.buckets[order], numbers[order]
    starts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(buckets, prepend=-1) != 0))
    per = np.diff(np.append(starts, len(codes)))
    bounds = np.flatnonzero(np.diff(buckets[starts], prepend=-1))
    for a, b in zip(bounds, [*bounds[1:], len(starts)], strict=True):
        lo, hi = starts[a], starts[b] if b < len(starts) else len(codes)
        yield {
            "bucket": int(lex.buckets[buckets[lo]]), "kind": kind, "chunk": chunk, "words": s.hashes[codes[starts[a:b]]].tobytes(), "per": per[a:b].astype(np.uint32).tobytes(),
            "contexts": s.contexts[order[lo:hi]].astype(np.uint32).tobytes(), "numbers": numbers[lo:hi].astype(width).tobytes(),
        }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def counted(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Packed counts of (word, context) of the documents' tokens, per step of the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            s = step(part.column("text"), shared.value)
            _, first, n = np.unique(s.codes * shared.value.restaurants + s.contexts, return_index=True, return_counts=True)
            numbers = np.zeros(len(s.codes), np.int64)
            numbers[first] = n
            yield _batch(list(_split(s, shared.value, first, numbers, MODEL, 0)))

    return docs.select("text").mapInArrow(count, PACKED)


@dataclass
class Counts:
    """A bucket's merged counts in order of word, class and context: distinct words, and each
    entry's word (its index), context and count; groups are the entries of one word and class."""

    words: np.ndarray
    index: np.ndarray
    contexts: np.ndarray
    counts: np.ndarray
    group: np.ndarray
    group_word: np.ndarray
    group_class: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.group, values, len(self.group_word)).astype(np.int64)


def unpacked(columns: dict[str, list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, entries per word, contexts and numbers of several packed rows, one after the other."""
    own, per, contexts = (np.frombuffer(b"".join(columns[c]), t) for c, t in (("words", np.uint64), ("per", np.uint32), ("contexts", np.uint32)))
    numbers = [np.frombuffer(x, np.uint16 if len(x) * 2 == len(c) else np.uint32).astype(np.uint32) for x, c in zip(columns["numbers"], columns["contexts"], strict=True)]
    return own, per, contexts, np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)


def merged(columns: dict[str, list[bytes]], lex: Lexicon, more: np.ndarray | None = None) -> Counts:
    """The sums of packed counts; ``more`` are words that are listed even if they have no entry."""
    own, per, contexts, numbers = unpacked(columns)
    distinct = np.unique(own) if more is None else np.union1d(own, more)
    inverse = np.searchsorted(distinct, own)
    word, contexts = np.repeat(inverse, per).astype(np.int64), contexts.astype(np.int64)
    pair = word * CLASSES + lex.class_of(contexts)
    order = np.lexsort((contexts, pair))
    pair, contexts = pair[order], contexts[order]
    first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(contexts, prepend=-1) != 0))
    counts = np.add.reduceat(numbers[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    pair, contexts = pair[first], contexts[first]
    groups, group = np.unique(pair, return_inverse=True)
    return Counts(distinct, pair // CLASSES, contexts, counts, group, groups // CLASSES, groups % CLASSES)


def _columns(table: pa.Table | pa.RecordBatch, keep: np.ndarray | None = None) -> dict[str, list[bytes]]:
    part = table if keep is None else table.filter(pa.array(keep))
    return {c: part.column(c).to_pylist() for c in ("words", "per", "contexts", "numbers")}


def bucketed(packed: DataFrame, lex: Lexicon) -> DataFrame:
    """One packed row of merged counts per bucket."""
    shared = packed.sparkSession.sparkContext.broadcast(lex)

    def merge(table: pa.Table) -> pa.Table:
        c = merged(_columns(table), shared.value)
        row = {"bucket": table.column("bucket")[0].as_py(), "kind": MODEL, "chunk": 0, "words": c.words.tobytes(), "per": np.bincount(c.index, minlength=len(c.words)).astype(np.uint32).tobytes(), "contexts": c.contexts.astype(np.uint32).tobytes(), "numbers": c.counts.astype(np.uint32).tobytes()}
        return pa.Table.from_pylist([row], schema=_FIELDS)

    return packed.groupBy("bucket").applyInArrow(merge, PACKED)


@functools.lru_cache(maxsize=8)
def log_stirling(discount: float, most: int = TABLE) -> np.ndarray:
    """Logs of generalised Stirling numbers: ways, weighted by the discount, of c customers at t
    tables; row c, column t."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        stay = out[c, t] + np.log(np.maximum(c - discount * t, 1e-300))
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def uniform(keys: np.ndarray, turn: int) -> np.ndarray:
    """A number above 0 and below 1 that follows from each key and the turn."""
    bits = mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, keys: np.ndarray, turn: int) -> np.ndarray:
    """Binomial draws: by inversion for small means, else rounded from the normal distribution."""
    mean, u = n * p, uniform(keys, 2 * turn)
    out = np.zeros(len(n), np.int64)
    large = mean >= 30
    spread = np.sqrt(-2 * np.log(u[large])) * np.cos(2 * np.pi * uniform(keys[large], 2 * turn + 1))
    out[large] = np.rint(mean[large] + spread * np.sqrt(mean[large] * (1 - p[large])))
    at = np.flatnonzero(~large)
    term = np.exp(n[at] * np.log1p(-np.minimum(p[at], 1 - 1e-12)))
    total, k = term.copy(), 0
    while len(at):
        more = (u[at] > total) & (k < n[at])
        at, term, total = at[more], term[more], total[more]
        term = term * (n[at] - k) / (k + 1) * p[at] / (1 - p[at])
        total, k = total + np.maximum(term, 1e-300), k + 1
        out[at] = k
    return np.clip(out, 0, n)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of each dish given its customers and the weight of a new table, which is the
    restaurant's (strength + discount * tables) times the parent's probability of the dish.

    A table makes each later customer's staying less likely by discount / customers, so one that
    opens before the last customers counts for less, by the ratio of customers then and at the end
    to the power of the discount."""
    table = log_stirling(discount)

    def lessened(at: np.ndarray, seated: np.ndarray | float) -> np.ndarray:
        ratio = (seated + weight[at]) / (customers[at] + weight[at])
        return weight[at] * np.minimum(ratio, 1.0) ** discount

    tables = np.minimum(customers, 1).astype(np.int64)
    exact = np.minimum(customers, TABLE)
    order = np.argsort(exact, kind="stable")
    bounds = np.searchsorted(exact[order], np.arange(2, TABLE + 2))
    u = uniform(keys, 0)
    for c in range(2, TABLE + 1):
        at = order[bounds[c - 2] : bounds[c - 1]]
        if not len(at):
            continue
        t = np.arange(1, c + 1)
        for lo in range(0, len(at), 400_000 // c):
            own = at[lo : lo + 400_000 // c]
            logs = np.log(lessened(own, float(c)))[:, None] * t + table[c, t]
            share = np.exp(logs - logs.max(1, keepdims=True)).cumsum(1)
            tables[own] = 1 + (share < u[own][:, None] * share[:, -1:]).sum(1)
    at = np.flatnonzero(customers > TABLE)
    seated, turn = np.full(len(at), TABLE, np.int64), 1
    while len(at):
        run = np.minimum(seated, customers[at] - seated)
        new = lessened(at, seated + run / 2)
        chance = new / (new + np.maximum(seated + run / 2 - discount * tables[at], 1e-9))
        tables[at] += binomial(run, chance, keys[at], turn)
        seated, turn = seated + run, turn + 1
        left = seated < customers[at]
        at, seated = at[left], seated[left]
    return np.minimum(tables, customers)


@dataclass
class Totals:
    """The restaurants' totals after a sweep: tables of each context, customers and tables of each
    class, those of the root, each hot word's root customers and tables, and the levels' strengths
    (of contexts, classes and the root)."""

    tables: np.ndarray
    class_customers: np.ndarray
    class_tables: np.ndarray
    root_customers: float
    root_tables: float
    hot_customers: np.ndarray
    hot_tables: np.ndarray
    strengths: tuple[float, float, float] = (1.0, 1.0, 1.0)


@dataclass
class Model:
    """The lexicon, the levels' discounts, each context's customers, and the totals at the start and
    after each sweep."""

    lex: Lexicon
    discounts: tuple[float, float, float]
    customers: np.ndarray
    totals: list[Totals]

    @property
    def base(self) -> float:
        return 1.0 / (self.lex.types + 1)


@dataclass
class State:
    """A bucket's tables: of each entry, of each group, and root customers and tables per word."""

    entries: np.ndarray
    groups: np.ndarray
    customers: np.ndarray
    tables: np.ndarray


def _root(m: Model, t: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    d, s = m.discounts[2], t.strengths[2]
    return (customers - d * tables + (s + d * t.root_tables) * m.base) / (s + t.root_customers)


def _in_class(m: Model, t: Totals, customers: np.ndarray, tables: np.ndarray, classes: np.ndarray, parent: np.ndarray) -> np.ndarray:
    d, s = m.discounts[1], t.strengths[1]
    return (customers - d * tables + (s + d * t.class_tables[classes]) * parent) / (s + t.class_customers[classes])


def _with_hot(c: Counts, m: Model, state: State, t: Totals) -> State:
    """The state with hot words' root customers and tables, which lie in several buckets, from the totals."""
    hot, at = _known(m.lex.hot, c.words)
    if not hot.any():
        return state
    customers, tables = state.customers.copy(), state.tables.copy()
    customers[hot], tables[hot] = t.hot_customers[at[hot]], t.hot_tables[at[hot]]
    return State(state.entries, state.groups, customers, tables)


def sweeps(c: Counts, m: Model, number: int) -> Iterator[State]:
    """The states after 1, 2, ... ``number`` sweeps, each drawn given the totals after the one before."""
    leaf = c.contexts >= CLASSES
    classes = c.group_class
    own = mix64(c.words)[c.index] + mix64(c.contexts.astype(np.uint64) + np.uint64(SEED))
    between = mix64(c.words)[c.group_word] + mix64(classes.astype(np.uint64) + np.uint64(SEED << 32))
    ones = np.ones(len(c.counts), np.int64)
    state = State(ones, np.ones(len(classes), np.int64), np.bincount(c.group_word, minlength=len(c.words)), np.ones(len(c.words), np.int64))
    for turn in range(number):
        t = m.totals[turn]
        state = _with_hot(c, m, state, t)
        root = _root(m, t, state.customers, state.tables)
        inside = _in_class(m, t, c.sums(np.where(leaf, state.entries, c.counts)), state.groups, classes, root[c.group_word])
        salt = np.uint64(mix64(np.array([SEED + turn], np.uint64))[0])
        entries = c.counts.copy()
        at = np.flatnonzero(leaf)
        if len(at):
            weight = (t.strengths[0] + m.discounts[0] * t.tables[c.contexts[at] - CLASSES]) * inside[c.group[at]]
            entries[at] = seat(c.counts[at], weight, m.discounts[0], own[at] ^ salt)
        groups = seat(c.sums(entries), (t.strengths[1] + m.discounts[1] * t.class_tables[classes]) * root[c.group_word], m.discounts[1], between ^ salt)
        customers = np.bincount(c.group_word, groups, len(c.words)).astype(np.int64)
        tables = seat(customers, np.full(len(customers), _new_root(m, t)), m.discounts[2], mix64(c.words) ^ salt)
        state = State(entries, groups, customers, tables)
        yield state


def _new_root(m: Model, t: Totals) -> float:
    return (t.strengths[2] + m.discounts[2] * t.root_tables) * m.base


def _strength(customers: np.ndarray, tables: np.ndarray, discount: float, now: float, rng: np.random.Generator) -> float:
    """A level's strength from its gamma conditional given the restaurants' totals; of the
    auxiliary variables the beta ones are drawn and the sums of indicators taken at their mean."""
    used = customers >= 2
    c, t = customers[used].astype(float), tables[used].astype(float)
    if not len(c):
        return now
    logs = np.log(np.maximum(rng.beta(now + 1, c - 1), 1e-300)).sum()
    ones = (now / discount * np.log((now / discount + np.maximum(t, 1) - 0.5) / (now / discount + 0.5))).sum()
    return float(np.clip(rng.gamma(1 + ones, 1 / (1 - logs)), 1e-3, 1e6))


def _sums(table: DataFrame, lex: Lexicon, per_bucket: Callable[[Counts], list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """Sums over buckets of (names, pairs of values); names are those of the classes, contexts and
    hot words, in this order, and three more."""
    size = lex.restaurants + len(lex.hot) + 3

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 2))
        for part in batches:
            for i in range(part.num_rows):
                for names, values in per_bucket(merged(_columns(part.slice(i, 1)), lex)):
                    total[names] += values
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used, 0]), pa.array(total[used, 1])], names=["name", "x", "y"])

    got = table.mapInArrow(emit, "name long, x double, y double").groupBy("name").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toArrow()
    out = np.zeros((size, 2))
    for i, c in enumerate("xy"):
        out[got.column("name").to_numpy(), i] = got.column(c).to_numpy()
    return out


def _dense(names: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The used names and their sums of each of the values."""
    used, inverse = np.unique(names, return_inverse=True)
    return used, np.stack([np.bincount(inverse, v, len(used)) for v in values], 1)


def fit(training: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Model]:
    """The bucketed counts of (word, context), and the model's numbers over ``BURN_IN + SAMPLES`` sweeps."""
    spark = training.sparkSession
    lex = lexicon(training, buckets)
    table = materialise(bucketed(counted(training, lex), lex), "model")
    n, hot = lex.restaurants, len(lex.hot)

    def first(c: Counts):
        leaf = c.contexts >= CLASSES
        customers, groups = c.sums(np.where(leaf, 1, c.counts)), np.ones(len(c.group_word))
        spread = np.bincount(c.group_word, minlength=len(c.words))
        is_hot, at = _known(lex.hot, c.words)
        few = np.array([[(x == 1).sum(), (x == 2).sum()] for x in (c.counts[leaf], customers, spread[~is_hot])], float)
        return [
            _dense(c.contexts[leaf], c.counts[leaf], np.ones(leaf.sum())), _dense(c.group_class, customers, groups),
            (n + at[is_hot], np.stack([spread[is_hot], 0 * spread[is_hot]], 1)), (n + hot + np.arange(3), few),
        ]

    got = _sums(table, lex, first)
    discounts = tuple(float(np.clip(one / max(one + 2 * two, 1.0), 0.1, 0.95)) for one, two in got[n + hot : n + hot + 3])
    start = Totals(got[CLASSES:n, 1], got[:CLASSES, 0], got[:CLASSES, 1], float(got[:CLASSES, 1].sum()), float(lex.types), got[n : n + hot, 0], np.ones(hot))
    m = Model(lex, discounts, got[CLASSES:n, 0], [start])

    def after(c: Counts):
        state = list(sweeps(c, m, len(m.totals)))[-1]
        leaf = c.contexts >= CLASSES
        is_hot, at = _known(lex.hot, c.words)
        return [
            _dense(c.contexts[leaf], state.entries[leaf], np.zeros(leaf.sum())), _dense(c.group_class, c.sums(state.entries), state.groups),
            (n + at[is_hot], np.stack([state.customers[is_hot], 0 * state.customers[is_hot]], 1)), (np.array([n + hot]), np.array([[state.tables[~is_hot].sum(), 0.0]])),
        ]

    for turn in range(BURN_IN + SAMPLES):
        got, before = _sums(table, lex, after), m.totals[-1]
        salt = np.uint64(mix64(np.array([SEED + turn], np.uint64))[0])
        customers = got[n : n + hot, 0].astype(np.int64)
        tables = seat(customers, np.full(hot, _new_root(m, before)), discounts[2], mix64(lex.hot) ^ salt)
        now = Totals(got[CLASSES:n, 0], got[:CLASSES, 0], got[:CLASSES, 1], float(got[:CLASSES, 1].sum()), float(got[n + hot, 0] + tables.sum()), customers, tables)
        rng = np.random.default_rng([SEED, turn])
        root = (np.array([now.root_customers]), np.array([now.root_tables]))
        levels = ((m.customers, now.tables), (now.class_customers, now.class_tables), root)
        now.strengths = tuple(_strength(c, t, d, s, rng) for (c, t), d, s in zip(levels, discounts, before.strengths, strict=True))
        m.totals.append(now)
    return table, m


class Scorer:
    """Averaged predictive probabilities of a bucket's words after any context."""

    def __init__(self, c: Counts, m: Model):
        self.c, self.m = c, m
        self.samples = m.totals[BURN_IN + 1 :]
        self.own, self.inside, self.root = np.zeros((len(self.samples), len(c.counts))), [], []
        leaf = c.contexts >= CLASSES
        at = c.contexts[leaf] - CLASSES
        for j, (t, raw) in enumerate(zip(self.samples, list(sweeps(c, m, BURN_IN + SAMPLES))[BURN_IN:], strict=True)):
            state = _with_hot(c, m, raw, t)
            root = _root(m, t, np.append(state.customers, 0), np.append(state.tables, 0))  # the last is for unknown words
            self.root.append(root)
            self.inside.append(_in_class(m, t, c.sums(state.entries), state.groups, c.group_class, root[c.group_word]))
            self.own[j, leaf] = (c.counts[leaf] - m.discounts[0] * state.entries[leaf]) / (t.strengths[0] + m.customers[at])
        self.groups = c.group_word * CLASSES + c.group_class
        self.entries = c.index * m.lex.restaurants + c.contexts if len(c.words) else np.zeros(0, np.int64)
        order = np.argsort(self.entries)
        self.entries, self.own = self.entries[order], self.own[:, order]

    def __call__(self, word: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Probabilities of words, by their index (one past the last: unknown), after contexts."""
        m, (d0, d1, _) = self.m, self.m.discounts
        classes = m.lex.class_of(contexts)
        grouped, g = _known(self.groups, word * CLASSES + classes)
        seen, e = _known(self.entries, word * m.lex.restaurants + contexts)
        leaf = contexts >= CLASSES
        at = contexts[leaf] - CLASSES
        total = np.zeros(len(word))
        for j, t in enumerate(self.samples):
            s0, s1, _ = t.strengths
            p = (s1 + d1 * t.class_tables[classes]) / (s1 + t.class_customers[classes]) * self.root[j][word]
            p[grouped] = self.inside[j][g[grouped]]
            p[leaf] *= (s0 + d0 * t.tables[at]) / (s0 + m.customers[at])
            p[leaf & seen] += self.own[j, e[leaf & seen]]
            total += p
        return total / len(self.samples)


@dataclass
class HotPairs:
    """The most frequent pairs of a context and a word: their words, sorted (word, context) keys,
    log10 probabilities and words' counts."""

    words: np.ndarray
    keys: np.ndarray
    logs: np.ndarray
    counts: np.ndarray


def hot_pairs(table: DataFrame, m: Model) -> HotPairs:
    """At most HOT pairs: those with at least 1 / HOT of the training tokens."""
    lex = m.lex
    shared = table.sparkSession.sparkContext.broadcast(m)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in batches:
            for i in range(part.num_rows):
                c = merged(_columns(part.slice(i, 1)), own.lex)
                hot = np.flatnonzero(c.counts * HOT >= own.lex.tokens)
                if len(hot):
                    p = Scorer(c, own)(c.index[hot], c.contexts[hot])
                    yield pa.RecordBatch.from_arrays([pa.array(c.words[c.index[hot]].view(np.int64)), pa.array(c.contexts[hot]), pa.array(np.log10(p))], names=["word", "context", "log"])

    got = table.mapInArrow(emit, "word long, context long, log double").toArrow()
    word, context, logs = (got.column(c).to_numpy() for c in ("word", "context", "log"))
    names = np.unique(word.view(np.uint64))
    keys = np.searchsorted(names, word.view(np.uint64)) * lex.restaurants + context
    order = np.argsort(keys)
    return HotPairs(names, keys[order], logs[order], lex.hot_counts[np.searchsorted(lex.hot, names)])


def _base(counts: np.ndarray, lex: Lexicon) -> np.ndarray:
    return np.log10((counts + 0.1) / (lex.tokens + 0.1 * (lex.types + 1)))


def tokens_to_buckets(docs: DataFrame, m: Model, hot: HotPairs) -> DataFrame:
    """Packed tokens per step and bucket (numbers: the text's place in its step), and a local row
    per step: doc_ids, tokens per text, and the partial sums of its hot pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((m.lex, hot))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, own = shared.value
        base = _base(own.counts, lex)
        for nth, part in enumerate(chunks(batches, "text", STEP_BYTES)):
            chunk = (TaskContext.get().partitionId() << 24) + nth
            t = step(part.column("text"), lex)
            there, word = _known(own.words, t.hashes)
            paired, at = _known(own.keys, np.where(there, word, -1)[t.codes] * lex.restaurants + t.contexts)
            n = part.num_rows
            r, w = t.rows[paired], word[t.codes[paired]]
            sums = [np.bincount(r, x, n) for x in (own.logs[at[paired]], base[w] if len(w) else w, np.ones(len(w)))]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            local = {"bucket": int(lex.buckets[(TaskContext.get().partitionId() + 7919 * nth) % len(lex.buckets)]), "kind": LOCAL, "chunk": chunk, "words": ids.tobytes(), "per": np.bincount(t.rows, minlength=n).astype(np.uint32).tobytes(), "contexts": sums[2].astype(np.uint32).tobytes(), "numbers": np.concatenate(sums[:2]).tobytes()}
            yield _batch([local, *_split(t, lex, np.flatnonzero(~paired), t.rows, TOKENS, chunk)])

    return docs.select("doc_id", "text").mapInArrow(emit, PACKED)


PARTIAL = "chunk long, ids binary, lengths binary, rows binary, score binary, base binary, known binary"
_PARTIAL = pa.schema([("chunk", pa.int64())] + [(c, pa.binary()) for c in ("ids", "lengths", "rows", "score", "base", "known")])


def scored_in_buckets(table: DataFrame, tokens: DataFrame, m: Model) -> DataFrame:
    """Partial sums per step of a scan: the texts' places with the sums of one bucket's words."""
    shared = table.sparkSession.sparkContext.broadcast(m)

    def score(rows: pa.Table) -> pa.Table:
        own, kinds = shared.value, rows.column("kind").to_numpy()
        lex, out = own.lex, []
        for r in rows.filter(pa.array(kinds == LOCAL)).to_pylist():
            n = len(r["per"]) // 4
            sums = np.frombuffer(r["numbers"], np.float64)
            out.append({"chunk": r["chunk"], "ids": r["words"], "lengths": r["per"], "rows": np.arange(n, dtype=np.uint32).tobytes(), "score": sums[:n].tobytes(), "base": sums[n:].tobytes(), "known": r["contexts"]})
        c = merged(_columns(rows, kinds == MODEL), lex, lex.hot)
        probability = Scorer(c, own)
        totals = np.append(np.bincount(c.index, c.counts, len(c.words)), 0)
        totals[np.searchsorted(c.words, lex.hot)] = lex.hot_counts
        base = _base(totals, lex)
        for r in rows.filter(pa.array(kinds == TOKENS)).to_pylist():
            mine, per, contexts, texts = unpacked({x: [r[x]] for x in ("words", "per", "contexts", "numbers")})
            known, at = _known(c.words, mine)
            at = np.repeat(np.where(known, at, len(c.words)), per)
            logs = np.log10(probability(at, contexts.astype(np.int64)))
            place, inverse = np.unique(texts, return_inverse=True)
            out.append({
                "chunk": r["chunk"], "ids": None, "lengths": None, "rows": place.astype(np.uint32).tobytes(), "score": np.bincount(inverse, logs).tobytes(),
                "base": np.bincount(inverse, base[at]).tobytes(), "known": np.bincount(inverse, totals[at] > 0).astype(np.uint32).tobytes(),
            })
        return pa.Table.from_pylist(out, schema=_PARTIAL)

    return table.unionByName(tokens).groupBy("bucket").applyInArrow(score, PARTIAL)


def gathered(partial: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every text."""

    def gather(table: pa.Table) -> pa.Table:
        local = table.filter(pc.is_valid(table.column("ids"))).to_pylist()[0]
        ids, lengths = np.frombuffer(local["ids"], np.int64), np.frombuffer(local["lengths"], np.uint32)
        sums = np.zeros((3, len(ids)))
        for r in table.to_pylist():
            at = np.frombuffer(r["rows"], np.uint32)
            for i, (c, t) in enumerate((("score", np.float64), ("base", np.float64), ("known", np.uint32))):
                sums[i, at] += np.frombuffer(r[c], t)
        return pa.table({"doc_id": ids, "n_tokens": lengths.astype(np.int64), "n_known": sums[2].astype(np.int64), "base_score": sums[1], "score": sums[0]})

    return partial.groupBy("chunk").applyInArrow(gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def scores(docs: DataFrame, training: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Model]:
    """Scores of ``docs`` (doc_id, text without nulls) under the model of ``training`` (text)."""
    with arrow_bytes(docs.sparkSession):
        table, m = fit(training, buckets)
    return gathered(scored_in_buckets(table, tokens_to_buckets(docs, m, hot_pairs(table, m)), m)), m


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the model learns from nine folds of ten."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(doc_id(), text_or_empty().alias("text"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    got, m = scores(docs, docs.where(~held))
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(m.lex.tokens).cast("long").alias("train_tokens"), "base_score", "score")
