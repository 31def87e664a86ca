"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every term has a sparse random index vector that follows from its hash. A term's word vector is the
sum of the index vectors that stand next to it in all documents; terms share a bounded number of
slots, so the table that tasks receive has a fixed size, and each task adds up its own table before
the shuffle. A document is
pooled into the directions of the means of its terms' word and index vectors, the means' lengths,
which tell repetition as do its largest and summed squared shares, and the shares of character classes. A two-layer network over these is
trained on a bounded sample of labelled documents on the driver, where only one vector per sampled
document arrives; its temperature is set on a part of the sample that the weights have not seen.
Scoring reads each text once where it lies and shuffles nothing.

Terms are runs of letters, digits or symbols, in lower case, and one mark for each run's case and
kind, so that the form of a text counts as well as its words.

Defined cases: a null or empty text is scored from a zero vector; a long text is read whole; equal
texts score alike, and repeated rows are rows of their own; of several labels of one doc_id the
highest counts, and ties in the sample's order go by doc_id; documents without a label are scored
like others; without labelled rows of both classes every score is 0.5; only ``doc_id`` and
``text`` are read of documents, and ``doc_id`` decides the fold only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.text import arrow_bytes, chunks, doc_id, hash_words, mix64, text_or_empty

#: Bound of the labelled rows that the network is fitted to: the first by a hash of their id.
SAMPLE = 6000
#: Slots of the term table and the vectors' length; the table is SLOTS x DIM x 4 bytes.
SLOTS, DIM = 1 << 14, 48
#: Entries of an index vector that are not zero; neighbours on each side.
NONZERO, WINDOW = 4, 2
HIDDEN, EPOCHS, RATE, DECAY = 16, 300, 0.01, 3e-2
#: Standardised features are cut off here, so that one odd word cannot outweigh all others.
CLIP = 5.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_TERM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def terms(text: str) -> list[str]:
    return _TERM.findall(text)


def _marked(distinct: list[str]) -> tuple[list[str], np.ndarray]:
    """The lower-case forms and a small number for each term's case and kind."""
    kinds = [
        (0 if t.islower() else 1 if t.istitle() else 2 if t.isupper() else 3) if t[0].isalpha() else 4 if t[0].isdigit() else 5 if len(t) == 1 else 6
        for t in distinct
    ]
    return [t.lower() for t in distinct], np.array(kinds, np.int64)


KINDS = 7


def index_parts() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each slot's index vector (NONZERO x SLOTS), which follow from
    the slot's number; entries that share a place add up."""
    slot = np.arange(SLOTS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.stack([mix64(slot * np.uint64(2 * NONZERO) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for j in range(NONZERO)])
    return (h >> np.uint64(32)).astype(np.int64) % DIM, np.where(h & np.uint64(1), 1.0, -1.0)


def index_vectors() -> np.ndarray:
    """The index vectors in full: SLOTS x DIM."""
    out = np.zeros((SLOTS, DIM), np.float32)
    for place, sign in zip(*index_parts(), strict=True):
        out[np.arange(SLOTS), place] += sign
    return out


@dataclass
class Coded:
    """Slots and kinds of the terms of some texts, in a row, with the texts' offsets."""

    slots: np.ndarray
    kinds: np.ndarray
    offsets: np.ndarray


def coded(texts: list[str]) -> Coded:
    lists = [terms(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = pa.array([t for x in lists for t in x], pa.string()).dictionary_encode()
    lowered, kinds = _marked(flat.dictionary.to_pylist())
    slots = (hash_words(pa.array(lowered, pa.string())) % np.uint64(SLOTS)).astype(np.int64)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    return Coded(slots[codes] if len(codes) else codes.astype(np.int64), kinds[codes] if len(codes) else codes.astype(np.int64), offsets)


def context_counts(c: Coded, parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sum over the terms of a slot of the index vectors that stand next to them."""
    out = np.zeros(SLOTS * DIM)
    doc = np.repeat(np.arange(len(c.offsets) - 1), np.diff(c.offsets))
    for d in range(1, WINDOW + 1):
        same = doc[d:] == doc[:-d]
        left, right = c.slots[:-d][same], c.slots[d:][same]
        for place, sign in zip(*parts, strict=True):
            out += np.bincount(left * DIM + place[right], sign[right], SLOTS * DIM)
            out += np.bincount(right * DIM + place[left], sign[left], SLOTS * DIM)
    return out.reshape(SLOTS, DIM)


def pooled(c: Coded, index: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A feature row per text."""
    rows = len(c.offsets) - 1
    out = np.zeros((rows, 2 * DIM + KINDS + 6), np.float32)
    for i, (a, b) in enumerate(zip(c.offsets[:-1], c.offsets[1:], strict=True)):
        if b == a:
            continue
        slots, n = np.unique(c.slots[a:b], return_counts=True)
        share = (n / (b - a)).astype(np.float32)
        for at, table in ((0, vectors), (DIM, index)):
            mean = share @ table[slots]
            length = float(np.linalg.norm(mean))
            out[i, at : at + DIM] = mean / max(length, 1e-9)
            out[i, -1 if at else -2] = length
        out[i, 2 * DIM : 2 * DIM + KINDS] = np.bincount(c.kinds[a:b], minlength=KINDS) / (b - a)
        out[i, -3] = np.log((share * share).sum())
        out[i, -4] = np.log(len(slots) / (b - a))
        out[i, -5] = np.log1p(b - a)
        out[i, -6] = np.log(share.max())
    return out


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network | None:
    """The network fitted by Adam on four fifths of the rows with classes weighted alike, and the
    temperature by its likelihood on the last fifth. None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[fit].tolist())) < 2:
        fit = order
    xf, yf = x[fit].astype(np.float64), y[fit].astype(np.float64)
    net = Network(xf.mean(0), xf.std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = np.clip((xf - net.mean) / net.scale, -CLIP, CLIP)
    weight = np.where(yf == 1, 0.5 / max(yf.mean(), 1e-9), 0.5 / max(1 - yf.mean(), 1e-9)) / len(yf)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -40, 40)))
        g = (p - yf) * weight
        gh = np.outer(g, params[2]) * (1 - hidden**2)
        grads = [z.T @ gh + DECAY * params[0], gh.sum(0), hidden.T @ g + DECAY * params[2], np.array([g.sum()])]
        for i, gradient in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * gradient
            second[i] = 0.999 * second[i] + 0.001 * gradient**2
            params[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held) >= 20:
        logit, target = net.logits(x[held].astype(np.float64)), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(4), 49))
        loss = [np.logaddexp(0, -np.where(target == 1, 1, -1) * logit / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None

    def score(self, texts: list[str], index: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.probability(pooled(coded(texts), index, self.vectors).astype(np.float64))


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit word vectors of all slots, from the neighbours of terms in all documents."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = index_parts(), np.zeros((SLOTS, DIM))
        for part in chunks(batches, "text"):
            total += context_counts(coded(part.column("text").to_pylist()), parts)
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["slot", "sums"])

    summed = (
        docs.select(text_or_empty().alias("text")).mapInArrow(contexts, "slot long, sums array<double>").groupBy("slot")
        .agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"v{i}") for i in range(DIM)])
    )
    vectors = np.zeros((SLOTS, DIM))
    for r in summed.collect():
        vectors[r[0]] = r[1:]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the word vectors of all ``docs`` and a network learnt from at most ``sample``
    labelled rows outside the held-out fold, which are chosen by a list of at most ``sample`` ids."""
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
        .groupBy(doc_id()).agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    wanted = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, quality int")
    with arrow_bytes(spark):
        return _fitted(docs, wanted)


def _fitted(docs: DataFrame, wanted: DataFrame) -> Model:
    rows = docs.select(doc_id(), text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id")
    # one text of each id, however many rows share it
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for part in chunks(batches, "text"):
            x = pooled(coded(part.column("text").to_pylist()), index, shared.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    got = sorted(rows.mapInArrow(features, "doc_id long, quality int, x array<float>").collect(), key=lambda r: (r[0], r[1], r[2]))
    if not got:
        return Model(vectors, None)
    return Model(vectors, train(np.array([r[2] for r in got], np.float32), np.array([r[1] for r in got])))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with ``score``, a number from 0 to 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = index_vectors(), shared.value
        for part in chunks(batches, "text"):
            got = own.score([t or "" for t in part.column("text").to_pylist()], index)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(score, schema)


def verdicts(docs: DataFrame, model: Model, reject_below: float) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores ``reject_below`` or more. Only the column
    named ``text`` is looked at, whatever the others are called."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = index_vectors(), shared.value
        for part in chunks(batches, "text"):
            yield part.filter(pa.array(own.score([t or "" for t in part.column("text").to_pylist()], index) >= reject_below))

    return docs.mapInArrow(judge, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(doc_id(), "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
