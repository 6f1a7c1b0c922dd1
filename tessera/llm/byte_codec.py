"""Byte-level BPE encoding and decoding, with long texts cut into overlapping chunks.

A text of one chunk is pre-tokenised and encoded where it lies. A longer one is dealt out as chunks that each run on into
the next: every chunk is pre-tokenised by itself, from its own first character, which may be in the midst of a token. Two
neighbours resynchronise at the first place in their overlap where both have a boundary, since a match depends only on
what follows it. There they are stitched, and each chunk encodes its own pieces. Where neighbours find no such place (one
token fills the overlap), the text is put together again and pre-tokenised as a whole. Decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK, OVERLAP = 1 << 15, 512  # characters
LOOK = 4  # characters before a chunk's end that can still change how a match before them ended
MEMO, MEMO_CHARS = 250_000, 64
SHORT, NONE, SHIFT = 64, 1 << 62, 24  # bytes of a piece that is merged beside others; no rank; bits of an id in a pair
ROWS = 256  # of a batch that is worked on at a time


class Codec:
    """Encoder and decoder by the ranks of a file. Ids of pieces are little-endian unsigned 32-bit integers, packed.

    The pieces of a few texts are looked up together: those met before are remembered, in two generations (when the younger
    is full it becomes the older), and new ones of one length are merged side by side as the rows of a matrix.
    """

    def __init__(self, ranks: str, pattern: str) -> None:
        import regex

        with open(ranks, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        joints = {}
        for piece, i in self.ranks.items():
            self.bytes_of[i] = piece
            for at in range(1, len(piece)):
                left, right = self.ranks.get(piece[:at]), self.ranks.get(piece[at:])
                if left is not None and right is not None:
                    joints[left << SHIFT | right] = i
        self.keys = np.array(sorted(joints), dtype=np.int64)
        self.joints = np.array([joints[k] for k in self.keys.tolist()], dtype=np.int64)
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pieces_of = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        found = self.pieces_of(text)
        if sum(map(len, found)) != len(text):
            raise ValueError("the pattern has to match every character")
        return found

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts given by their pieces."""
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older, new = self.memo, self.older, []
        for piece in set().union(*texts).difference(memo):
            known = older.get(piece)
            if known is None:
                new.append(piece)
            else:
                memo[piece] = known
        memo.update(zip(new, self.merged([p.encode() for p in new]), strict=True))
        out = [b"".join(map(memo.__getitem__, t)) for t in texts]
        for piece in new:
            if len(piece) > MEMO_CHARS:
                del memo[piece]
        return out

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Merges the adjacent parts of each piece whose joint bytes have the lowest rank, the leftmost first, until none have one."""
        out, by_length = [b""] * len(pieces), {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = struct.pack("<I", whole)
            elif len(piece) > SHORT:
                out[i] = np.array(self.merged_long(piece), dtype="<u4").tobytes()
            else:
                by_length.setdefault(len(piece), []).append(i)
        for places in by_length.values():
            for at, ids in self.merged_together([pieces[i] for i in places]):
                packed, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for n, i in enumerate(at.tolist()):
                    out[places[i]] = packed[n * size : n * size + size]
        return out

    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts, NONE where they have none."""
        keys = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.joints[at], NONE)

    def merged_together(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, ids) of pieces of one length of two bytes and more, in groups of as many ids.

        Every piece that isn't done loses one part in a turn, so that the rows stay of one length.
        """
        parts = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)].reshape(len(pieces), -1)
        places, ranks = np.arange(len(pieces)), self.joint(parts[:, :-1], parts[:, 1:])
        while len(places):
            if parts.shape[1] == 1:
                yield places, parts
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            done = best == NONE
            if done.any():
                yield places[done], parts[done]
                places, parts, ranks, at, best = (x[~done] for x in (places, parts, ranks, at, best))
            rows, width = np.arange(len(at)), parts.shape[1]
            parts[rows, at] = best
            kept = np.ones(parts.shape, dtype=bool)
            kept[rows, at + 1] = False
            parts = parts[kept].reshape(len(rows), width - 1)
            kept = np.ones(ranks.shape, dtype=bool)
            kept[rows, at] = False
            ranks = ranks[kept].reshape(len(rows), width - 2)
            some = np.flatnonzero(at < width - 2)
            ranks[some, at[some]] = self.joint(parts[some, at[some]], parts[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.joint(parts[some, at[some] - 1], parts[some, at[some]])

    def merged_long(self, data: bytes) -> list[int]:
        """Ids of one piece, merged with a queue, so that one of any length takes little more time than its length."""
        n, rank = len(data), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next part starts, and the one before
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        ends = list(range(1, n + 1))  # of the part that starts at each place; 0 once it is merged into another
        while queue:
            _, i, end = heapq.heappop(queue)
            j = after[i] if ends[i] else n
            if j >= n or ends[j] != end or not ends[i]:
                continue  # one of the two has been merged since
            ends[i], ends[j], after[i] = end, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(data[i : ends[after[i]]])) is not None:
                    heapq.heappush(queue, (r, i, ends[after[i]]))
            if before[i] >= 0 and (r := rank(data[before[i] : end])) is not None:
                heapq.heappush(queue, (r, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def text_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(ranks: str, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def boundaries(text: str, start: int, pieces: list[str], last: bool) -> np.ndarray:
    """Places in the whole text where a piece of this chunk starts or ends, as far as what follows the chunk can't move them."""
    places = np.cumsum([0, *map(len, pieces)])
    return start + (places if last else places[places <= len(text) - LOOK])


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task makes of them stays small whatever Arrow's batch size is."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _split(chunk: int, overlap: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py()
                many = -(-len(text) // chunk)
                for at in range(0, many, 64):  # few chunks at a time, so that a very long text isn't there twice
                    some = range(at, min(many, at + 64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column(0)[row].as_py()] * len(some), pa.int64()), pa.array([batch.column(1)[row].as_py()] * len(some), pa.int64()), pa.array(some, pa.int64()),
                            pa.array([n + 1 == many for n in some]), pa.array([text[n * chunk : (n + 1) * chunk + overlap] for n in some], pa.string()),
                        ],
                        ["key", "id", "n", "last", "text"],
                    )

    return split


def _long(docs: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int, finish, schema: str) -> DataFrame:
    """(id, ids) of texts of more than one chunk, as `finish` leaves them."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(ranks, pattern)
        for batch in few(batches):
            cuts, head, tail = [], [], []
            for n, last, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                text, start = text.as_py(), n * chunk
                places = boundaries(text, start, one.pieces(text), last)
                cuts.append((places - start).astype(np.int32))
                head.append(places[places < start + overlap])
                tail.append(places[places >= start + chunk] if not last else places[:0])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.list_(pa.int32())), pa.array(head, longs), pa.array(tail, longs)], ["key", "id", "n", "last", "text", "cuts", "head", "tail"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(ranks, pattern)
        for batch in few(batches):
            out = []
            for text, cuts, a, b in zip(batch.column(3), batch.column(4), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                text, cuts = text.as_py(), cuts.values.to_numpy()
                own = cuts[(cuts >= a) & (cuts <= (len(text) if b is None else b))].tolist()
                out.append([text[x:y] for x, y in zip(own, own[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(one.ids(out), pa.binary())], ["key", "id", "n", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(ranks, pattern)
        for batch in batches:
            for i, texts in zip(batch.column(0), batch.column(1), strict=True):
                text = "".join(t[:chunk] for t in (x.as_py() for x in texts.values))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array(one.ids([one.pieces(text)]), pa.binary())], ["id", "ids"])

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = [b"".join(x.as_py() for x in parts.values) for parts in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "ids"])

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "id", "text")
    chunks = keyed.mapInArrow(_split(chunk, overlap), "key long, id long, n long, last boolean, text string").repartition("key", "n")
    chunks = written(chunks.mapInArrow(tokenised, "key long, id long, n long, last boolean, text string, cuts array<int>, head array<long>, tail array<long>"), "chunks")
    left = chunks.where("NOT last").select("key", (F.col("n") + 1).alias("n"), "tail")
    met = left.join(chunks.select("key", "n", "head"), ["key", "n"]).select("key", "n", F.array_min(F.array_intersect("tail", "head")).alias("at"))
    met = written(met, "stitches")
    apart = met.where("at IS NULL").select("key").distinct()
    sides = met.select("key", "n", F.col("at").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(met.select("key", (F.col("n") - 1).alias("n"), F.lit(None).cast("long").alias("a"), F.col("at").alias("b")))
    sides = sides.groupBy("key", "n").agg(F.max("a").alias("a"), F.max("b").alias("b")).join(apart, "key", "left_anti")
    shift = F.col("n") * chunk
    parts = chunks.join(sides, ["key", "n"]).select("key", "id", "n", "text", "cuts", F.coalesce(F.col("a") - shift, F.lit(0)).alias("a"), (F.col("b") - shift).alias("b"))
    parts = parts.mapInArrow(encoded, "key long, id long, n long, ids binary")
    ordered = lambda name: F.sort_array(F.collect_list(F.struct("n", name)))[name].alias("parts")  # noqa: E731  one document's
    stitched = parts.groupBy("key", "id").agg(ordered("ids")).select("id", "parts").mapInArrow(lambda x: finish(joint(x)), schema)
    rest = chunks.join(apart, "key", "left_semi").groupBy("key", "id").agg(ordered("text")).select("id", "parts").mapInArrow(lambda x: finish(whole(x)), schema)
    return stitched.unionByName(rest)


def encode(
    docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, packed: bool = False, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids): the token ids of each row's whole text, as an array or, `packed`, as little-endian unsigned 32-bit integers.

    `decoded` adds what decode() gives as `data`, in the same pass. Each match of the pattern, which has to match every
    character, is encoded by itself; there are no special tokens. Null and empty texts have no ids. Repeated rows come
    back repeated, an empty table gives an empty result, a null id stays null, and other columns play no part. Texts of
    over `chunk` characters are pre-tokenised in pieces; the overlap is at most a chunk. `ranks` is a path that executors
    can read. One document is in memory at a time.
    """
    if not LOOK < overlap <= chunk:
        raise ValueError("the overlap has to be over LOOK and at most a chunk")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(ranks, pattern)
        for batch in few(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one.ids([one.pieces(t.as_py()) for t in batch.column(1)]), pa.binary())], ["id", "ids"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = _decoder(ranks, pattern)(batches) if decoded else batches
        return batches if packed else _unpacked(batches)

    schema = f"id long, ids {'binary' if packed else 'array<long>'}" + ", data binary" * decoded
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(lambda x: finish(encoded(x)), schema)
    return short.unionByName(_long(rows.where(F.length("text") > chunk), ranks, pattern, chunk, overlap, finish, schema))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pa.array([np.frombuffer(x.as_py(), dtype="<u4").astype(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, *batch.columns[2:]], batch.schema.names)


def _decoder(ranks: str, pattern: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(ranks, pattern)
        for batch in few(batches):
            rows = [None if x is None else one.text_bytes(np.frombuffer(x, dtype="<u4") if isinstance(x, bytes) else np.array(x, dtype=np.int64)) for x in (v.as_py() for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], ["id", "ids", "data"])

    return decoded


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(id, ids, data): the raw bytes of ids, an array or packed; null ids give null. Bytes needn't be whole characters."""
    kind = encoded.schema["ids"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(_decoder(ranks, pattern), f"id long, ids {kind}, data binary")


def byte_bpe_50k() -> dict[str, str]:
    """Arguments of encode() and decode() for the public byte-level ranks of 50,256 ids."""
    import public_tokenizers

    return {"ranks": str(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN}


def op11(spark, sf_dir: str) -> DataFrame:
    done = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), packed=True, decoded=True, **byte_bpe_50k())
    return done.select(
        F.col("id").alias("doc_id"), F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )
