"""Packing along a space-filling curve: similar documents become neighbours, and neighbours share sequences.

A document's hashed byte 4-grams make a vector, projected to a few dimensions by fixed random directions. The Hilbert
key of the quantised point orders documents; the corpus is range-sorted by it (ties by id), and every partition
tokenises its documents in that order and fills sequences one after the other, cutting documents freely. Only the last
sequence of a partition is not full, so that padding depends on the number of partitions and not on the documents.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS, BITS, BUCKETS = 4, 12, 2048
REACH = 4.0  # coordinates beyond this many standard deviations share the outermost cell
SEPARATOR = 0


@lru_cache(1)
def directions() -> np.ndarray:
    return np.random.default_rng(20_240_101).standard_normal((BUCKETS, DIMS))


def point(text: bytes) -> np.ndarray:
    """The projected unit vector of a text's 4-gram counts; texts of under four bytes are padded with zero bytes."""
    data = np.frombuffer(text.ljust(4, b"\0"), dtype=np.uint8)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(data) - 3, 1 << 20):
        part = data[at : at + (1 << 20) + 3].astype(np.uint32)
        grams = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        counts += np.bincount((grams * np.uint32(2_654_435_761)) >> np.uint32(21), minlength=BUCKETS)
    return counts @ directions() / np.sqrt((counts * counts).sum())


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Positions on the Hilbert curve through a grid of 2^BITS cells in each of the points' dimensions (Skilling's transform)."""
    cells = np.clip((points + REACH) * ((1 << BITS) / (2 * REACH)), 0, (1 << BITS) - 1).astype(np.int64)
    x = [cells[:, d].copy() for d in range(cells.shape[1])]
    q = 1 << (BITS - 1)
    while q > 1:
        low = q - 1
        for d in range(len(x)):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    flip, q = np.zeros_like(x[0]), 1 << (BITS - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for d in range(len(x)):
            key = (key << 1) | ((x[d] ^ flip) >> bit & 1)
    return key


class Encoder:
    """Token ids as the tokenizers library gives them; the same vocabulary's faster ranks serve where they can't differ."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None) -> None:
        with open(tokenizer, "rb") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.file, self.fast = tokenizer, None
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def slow(self):
        """The library's own tokenizer, loaded when a text first asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or len(text) > 1_000_000 or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


@lru_cache(2)
def encoder(tokenizer: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(tokenizer, ranks, pattern)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = np.array([point(x.as_py() or b"") for x in batch.column(1)]).reshape(-1, DIMS)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(points))], ["id", "text", "key"])


PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids and then id 0, so that a null or empty text has one token. sequence_id holds the
    partition in its upper bits. Repeated rows are documents of their own, next to each other; an empty table gives an
    empty result; other columns play no part. A copy that a third of all documents share is split over partitions, as
    ids take part in the range. `tokenizer`, and `ranks` and `pattern` of the same vocabulary for speed, are paths (and
    a regular expression) that executors can read. One document's ids are in memory at a time.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    keyed = source.mapInArrow(_keyed, "id long, text binary, key long")
    ranged = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks, pattern).ids
        sequence, used = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode((text.as_py() or b"").decode("utf-8", "replace")), np.uint32(SEPARATOR)).astype("<u4")
                at = 0
                while at < len(ids):
                    n = min(size - used, len(ids) - at)
                    rows.append((one, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), sequence, used))
                    at, used = at + n, used + n
                    if used == size:
                        sequence, used = sequence + 1, 0
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECE.split(", ")])

    return ranged.select("id", "text").mapInArrow(packed, PIECE)


def byte_bpe_50k() -> dict[str, str]:
    """Arguments of pack() for the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return {"tokenizer": str(public_tokenizers.path("byte_bpe_50k.json")), "ranks": str(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN}


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), **byte_bpe_50k()).withColumnRenamed("id", "doc_id")
