"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into classes by the reciprocals of the capacity: class m holds pieces of capacity // m
tokens and its bins take m of them each. Documents may be cut, so a document gives whole sequences
first, and then, while at least ``LEAST`` tokens are left, a piece of the largest class that they
fill. What each cut leaves is quadratically less, so a document is cut a few times at most; what is
left in the end (shorter than ``LEAST``) joins the class of its own length, whose bins waste less
than one piece. A bin's number and a piece's place in it follow from the piece's number in its class
alone. That number is a rank inside a bucket of documents plus the bucket's offset, so workers fill
bins independently of each other. Buckets are dealt by hash, or, where documents have a ``place``, by
ranges of it: then the pieces of each class follow the places, and so do the sequences, which are
numbered bucket by bucket.

Defined cases: a null or empty text has the end id only and gives one piece of length 1; repeated
doc_ids are told apart by their text, and equal rows have equal pieces in places of their own; a long
text is encoded whole; an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.text import arrow_bytes, chunks, doc_id, text_or_empty, words
from tessella.plans import materialise

CAPACITY = 2048
#: The shortest piece that a cut makes on purpose.
LEAST = 64
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Distinct word parts whose ids a Python worker remembers; bounds its memory, not what is encoded.
REMEMBERED = 400_000
#: Bytes of text that one step encodes together.
STEP_BYTES = 6_000_000

# The pattern by which the vocabulary file splits words (written for the plain
# characters below), and its special tokens.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
# A word outside these ranges may be changed by composition, odd case rules or classes that the
# pattern above does not share, and goes to the tokenizer as it is.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u012f\u0131-\u0148\u014a-\u017f]*")

PIECES = "doc_id long, nth long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints,
    else the next unused one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts, word by word, as little-endian 32-bit integers.

    The tokenizer drops white space and never merges across it, and composition and special tokens
    do not reach over it either, so a text's ids are those of its words in a row. Each distinct
    word of a batch is encoded once and the ids are laid out by its occurrences."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        """Ids of one part of the splitting pattern."""
        if (ids := self.known.get(part)) is None:
            spelt = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = self.known[part] = packed([t.id for t in self.model.tokenize(spelt)])
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a word without white space."""
        if _PLAIN.fullmatch(word) and not any(s in word for s in _SPECIAL):
            return b"".join(map(self.part, _PART.findall(word.lower())))
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offsets where each text's begin and end."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        codes, distinct, offsets = words(texts, lower=False)
        own = list(map(self.word, distinct.to_pylist()))
        flat = np.frombuffer(b"".join(own), "<u4")
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        begin = np.cumsum(lengths) - lengths
        per = lengths[codes]
        after = np.concatenate([[0], np.cumsum(per)])
        ids = flat[np.repeat(begin[codes] - after[:-1], per) + np.arange(after[-1])]
        return ids, after[offsets]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(vocabulary: str = VOCABULARY) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file, loaded once per Python process."""
    if vocabulary not in _tokenizers:
        path = vocabulary
        if not os.path.isabs(vocabulary):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _tokenizers[vocabulary] = WordTokenizer(path)
    return _tokenizers[vocabulary]


def cuts(tokens: int, capacity: int = CAPACITY, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: the longest reciprocal of the capacity that fits,
    again and again, while ``least`` tokens are left, then the rest."""
    start = 0
    while tokens - start >= least:
        left = tokens - start
        length = capacity // max(1, -(-capacity // left))
        yield start, length
        start += length
    if tokens > start:
        yield start, tokens - start


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, nth, start, length, ids_crc32, doc_tokens and, if asked for, the
    ids themselves as little-endian 32-bit words; with the document's place, where it has one."""
    placed = "place" in docs.columns
    schema = PIECES + (", ids binary" if with_ids else "") + (", place long" if placed else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", END_ID)
        encoder = tokenizer(vocabulary)
        for part in chunks(batches, "text", STEP_BYTES):
            out: list[tuple] = []
            every, offsets = encoder.encode(part.column("text"))
            places = [(x,) for x in part.column("place").to_pylist()] if placed else [()] * part.num_rows
            for doc_id, place, a, b in zip(part.column("doc_id").to_pylist(), places, offsets[:-1], offsets[1:], strict=True):
                ids = every[a:b].tobytes() + end
                n = len(ids) // 4
                for nth, (a, length) in enumerate(cuts(n, capacity)):
                    own = ids[4 * a : 4 * (a + length)]
                    out.append((doc_id, nth, a, length, zlib.crc32(own), n) + ((own,) if with_ids else ()) + place)
            names = ["doc_id", "nth", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids + ["place"] * placed
            types = [pa.int64()] * 6 + [pa.binary()] * with_ids + [pa.int64()] * placed
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.select(doc_id(), text_or_empty().alias("text"), *["place"] * placed).mapInArrow(cut, schema)


def arrange(cut: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """Pieces with their sequence_id and offset. ``cut`` is read twice, so it should be a written
    table; its columns are kept."""
    spark = cut.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key, order = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)), ["doc_id", "start", "ids_crc32"]
    if "place" in cut.columns:
        end = (cut.agg(F.max("place")).first()[0] or 0) + 1
        key, order = F.floor(F.col("place") * buckets / end), ["place", *order]
    dealt = cut.withColumn("bucket", key.cast("int"))
    # bounded: lengths below LEAST and at most capacity / LEAST reciprocals, times buckets
    counts = {(r["bucket"], r["length"]): r["n"] for r in dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, used, seen, unfilled = [], 0, {}, {}
    for bucket, length in sorted(counts):
        fits, before, n = capacity // length, seen.get(length, 0), counts[bucket, length]
        # a bin belongs to the bucket of its first piece; pieces that fill an earlier one go there
        own = -(-(before + n) // fits) - -(-before // fits)
        table.append((length, bucket, before, used - -(-before // fits), unfilled.get(length, -1)))
        if own:
            unfilled[length] = used + own - 1
        used, seen[length] = used + own, before + n
    offsets = spark.createDataFrame(table, "length long, bucket int, before long, first long, unfilled long")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    fits = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    number = F.col("before") + F.col("rank") - 1
    bin_ = F.floor(number / fits).cast("long")
    return (
        dealt.withColumn("rank", rank)
        .join(F.broadcast(offsets), ["length", "bucket"])
        .withColumn("sequence_id", F.when(bin_ * fits < F.col("before"), F.col("unfilled")).otherwise(F.col("first") + bin_))
        .withColumn("offset", (number % fits * F.col("length")).cast("long"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece of every document with its sequence and the place in it. Where ``docs`` has a
    column ``place`` (long, from 0), sequences follow it."""
    with arrow_bytes(docs.sparkSession):
        cut = materialise(pieces(docs, vocabulary, capacity, with_ids), "pieces")
    return arrange(cut, capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
