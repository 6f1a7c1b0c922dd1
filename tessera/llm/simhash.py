"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

Each 64-bit fingerprint has segments of 23, 23 and 18 bits. Two fingerprints that differ in at most four bits either
(a) have two segments with at most one error each, or (b) agree in one segment and have two errors in both others.
(a) The first of the two segments is decoded by the perfect binary Golay code [23, 12]: the codewords within distance
four of a word, one or six of them, include the nearest codeword of every word at distance one. The second segment has
an intact half. A key is (pair, half, half's bits, codeword index).
(b) The agreeing segment and the intact third of another make an exact key.
Candidates of a key are verified on the whole fingerprints. Within a key, rows first meet only the key's smallest and
largest fingerprint, and what they link becomes one component. A key left with several components is settled by what
does not belong to its largest one: where that is few rows, they meet the key's other rows; where it is more, the key is
lengthened: of the bits it does not fix, cut into five parts, two fingerprints within four bits agree in one, so that
each row goes on under five longer keys. Keys are lengthened until few rows are left over, whatever the corpus' size, so
that no link is missed and neither a dense cloud nor a crowded key ever becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_anew
from .components import connected_components

SEED = 42
MAX_BITS = 4
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the binary Golay code
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))  # (decoded segment, halved segment)
EXACT = ((0, 1), (1, 0), (2, 0))  # (agreeing segment, segment cut in three)
LANES = np.uint64(0x0101010101010101)
BLOCK = 1 << 16
FEW = 32  # rows of a key outside its largest component that meet all its rows
PARTS = MAX_BITS + 1


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set among unsigned 64-bit hashes."""
    total = np.zeros(64, dtype=np.int64)
    cuts = np.arange(0, len(hashes), 255)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)  # byte lanes, at most 255 each
        total[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, words_per_shingle: int = 4) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half of the hashes of its word shingles."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()  # for bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - words_per_shingle + 1
    if n < 1:
        hashes = [digest(joined, SEED)]
        counts, n = bit_counts(np.array(hashes, dtype=np.uint64)), 1
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts, ends = (ends - sizes)[:n], ends[words_per_shingle - 1 :]
        counts = np.zeros(64, dtype=np.int64)
        for i in range(0, n, BLOCK):
            spans = zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist(), strict=True)
            counts += bit_counts(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64))
    value = sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials modulo the generator."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


@lru_cache(1)
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each of 2048 syndromes its error patterns of at most four bits, lightest first, in six columns; their number."""
    patterns = np.zeros((2048, 6), dtype=np.int64)
    number = np.zeros(2048, dtype=np.int64)
    for weight in range(MAX_BITS + 1):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            s = int(syndromes(np.array([word]))[0]) if weight < 2 else _syndrome_of(bits)
            patterns[s, number[s]] = word
            number[s] += 1
    return patterns, number


@lru_cache(1)
def _unit_syndromes() -> list[int]:
    return syndromes(1 << np.arange(23)).tolist()


def _syndrome_of(bits: tuple[int, ...]) -> int:
    s = 0
    for b in bits:
        s ^= _unit_syndromes()[b]
    return s


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of int64 fingerprints: (key, row of the fingerprint, True where the key is one under which it is looked up)."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    rows = np.arange(len(prints))
    patterns, number = error_patterns()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for tag, (a, b) in enumerate(PAIRS):
        s = syndromes(parts[a])
        half = SEGMENTS[b][1] // 2
        for column in range(6):
            use = np.flatnonzero(number[s] > column)
            index = (parts[a][use] ^ patterns[s[use], column]) >> 11  # systematic: the message is on top
            low, high = parts[b][use] & ((1 << half) - 1), parts[b][use] >> half
            for which, piece in enumerate((low, high)):
                out.append((((tag * 2 + which) << 48) | (piece << 12) | index, use, np.full(len(use), column == 0)))
    for tag, (a, b) in enumerate(EXACT):
        size = SEGMENTS[b][1]
        third = -(-size // 3)
        for which in range(3):
            piece = (parts[b] >> (which * third)) & ((1 << min(third, size - which * third)) - 1)
            out.append((((8 + tag * 3 + which) << 48) | (parts[a] << 8) | piece, rows, np.full(len(rows), True)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _with_prints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            prints = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            key, row, index = keys_of(np.ascontiguousarray(prints, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row]), pa.array(index)], ["key", "fp", "index"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row for each row of docs. A null text counts as empty and has fingerprint zero."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(lambda batches: _with_prints(batches, shingle), "id long, fp long")


def _fixed_bits(keys: np.ndarray) -> np.ndarray:
    """The fingerprint bits that all rows of a key of keys_of() agree in; a codeword fixes none for certain."""
    by_tag = np.zeros(17, dtype=np.uint64)
    for tag, (_, b) in enumerate(PAIRS):
        at, size = SEGMENTS[b]
        low = (1 << size // 2) - 1
        by_tag[2 * tag], by_tag[2 * tag + 1] = low << at, ((1 << size) - 1 - low) << at
    for tag, (a, b) in enumerate(EXACT):
        at, size = SEGMENTS[b]
        third = -(-size // 3)
        for which in range(3):
            piece = ((1 << min(third, size - which * third)) - 1) << (at + which * third)
            by_tag[8 + tag * 3 + which] = ((1 << SEGMENTS[a][1]) - 1) << SEGMENTS[a][0] | piece
    return by_tag[keys >> 48]


@lru_cache(4096)
def _five_parts(fixed: int) -> list[int]:
    """The bits that are not fixed, dealt into five parts as even as they go."""
    free = [b for b in range(64) if not fixed >> b & 1]
    return [sum(1 << b for b in free[i::PARTS]) for i in range(PARTS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _longer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Five rows for each: under its key and one of five parts of the bits that the key does not fix."""
    for batch in batches:
        key, fp, fixed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        fixed = np.where(fixed == 0, _fixed_bits(np.where(fixed == 0, key, 0)), fixed.view(np.uint64))
        for one in np.unique(fixed).tolist():
            rows = np.flatnonzero(fixed == one)
            at = pa.array(rows)
            for part in _five_parts(one):
                longer = _mixed(_mixed(key[rows].view(np.uint64) ^ np.uint64(part)) ^ (fp[rows].view(np.uint64) & np.uint64(part)))
                now = np.full(len(rows), one | part, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(longer.view(np.int64)), *(batch.column(i).take(at) for i in (1, 2)), pa.array(now.view(np.int64)), batch.column(4).take(at)], ["key", "fp", "index", "fixed", "root"]
                )


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def _unsettled(rows: DataFrame, bound: int) -> DataFrame:
    """The rows (key, fp, index, fixed, root) of keys with several roots, and the key's commonest root and all others' number."""
    counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max("index").alias("index"))
    keys = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.max("index").alias("index"))
    keys = keys.where("roots > 1 AND index").select("key", F.col("top.root").alias("main"), (F.col("n") - F.col("top.n")).alias("others"))
    return cut(rows.join(dealt_anew(keys, "key"), "key"), bound)


def link_fingerprints(prints: DataFrame, rows_known: int | None = None) -> DataFrame:
    """Distinct (fp) -> (node, root) of all fingerprints that have another within four bits, directly or through others.

    rows_known, a bound on the fingerprints, only sets numbers of files.
    """
    keys = prints.select("fp").mapInArrow(_with_keys, "key long, fp long, index boolean")
    pivots = (
        keys.where("index").groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("n"))
    )
    # Keys are 41 rows a fingerprint, of which Spark's estimate knows nothing: unasked it would broadcast them.
    met = keys.join(dealt_anew(pivots, "key").hint("merge"), "key").where((F.col("n") > 2) | ((F.col("fp") != F.col("low")) & _near("fp", "low")) | ((F.col("fp") != F.col("high")) & _near("fp", "high")))
    met = cut(met, rows_known and 4 * rows_known, dealt=True)
    n_met = met.count()
    stars = met.select("fp", F.explode(F.array("low", "high")).alias("v")).where((F.col("fp") != F.col("v")) & _near("fp", "v"))
    roots = cut(connected_components(stars.select(F.col("fp").alias("u"), "v"), 2 * n_met), n_met)
    # The rest: keys with more fingerprints than the two pivots, where the stars left several components.
    rows = met.where("n > 2").join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "index", F.lit(0).cast("long").alias("fixed"), F.coalesce("root", "fp").alias("root"))
    joined: DataFrame | None = None  # (part, whole) of the roots linked since
    edges: DataFrame | None = None
    while True:
        rows = _unsettled(rows, n_met)
        few = rows.where(F.col("others") <= FEW)
        odd = few.where("root <> main").select(F.col("key").alias("k"), F.col("fp").alias("u"), F.col("root").alias("ru"), F.col("index").alias("iu"))
        links = few.join(odd, (F.col("key") == F.col("k")) & (F.col("root") != F.col("ru")) & (F.col("index") | F.col("iu")) & _near("fp", "u"))
        links = links.select(F.col("ru").alias("u"), F.col("root").alias("v"))
        many = rows.where(F.col("others") > FEW)
        left = many.count()
        if left:
            longer = cut(many.select("key", "fp", "index", "fixed", "root").mapInArrow(_longer_keys, "key long, fp long, index boolean, fixed long, root long"), PARTS * left)
            ends = longer.where("index").groupBy("key").agg(F.min(F.struct("fp", "root")).alias("low"), F.max(F.struct("fp", "root")).alias("high"))
            starred = longer.join(dealt_anew(ends, "key"), "key").select("fp", "root", F.explode(F.array("low", "high")).alias("end")).select(F.col("fp"), F.col("root").alias("u"), F.col("end.fp").alias("fv"), F.col("end.root").alias("v"))
            links = links.unionByName(starred.where((F.col("u") != F.col("v")) & _near("fp", "fv")).select("u", "v"))
        edges = links if edges is None else edges.unionByName(links)
        edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n_met)
        joined = cut(connected_components(edges, n_met).withColumnsRenamed({"node": "part", "root": "whole"}), n_met)
        if not left:
            break
        rows = longer.join(dealt_anew(joined, "part"), F.col("root") == F.col("part"), "left").select("key", "fp", "index", "fixed", F.coalesce("whole", "root").alias("root"))
        n_met = PARTS * left
    known = roots.join(joined, F.col("root") == F.col("part"), "left").select("node", F.coalesce("whole", "root").alias("root"))
    alone = joined.join(roots, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("root"))
    return known.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over fingerprints at four or fewer differing bits.

    One row for each row of docs, so repeated rows come back repeated, in one component. Null and empty texts, and those
    of white space only, have fingerprint zero and are linked like any other. Rows of a null id are linked but never name
    a component, unless nothing else is in it (then it is null). An empty table gives an empty result; other columns of
    docs play no part, whatever their names. Long texts are hashed whole, in blocks of shingles.
    """
    n = docs.count()
    prints = cut(fingerprints(docs, id_col, text_col, shingle), n, dealt=True)
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first")), n)
    roots = link_fingerprints(distinct, n)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut(named, n)
    names = named.groupBy("root").agg(F.min("first").alias("component"))
    known = cut(named.join(dealt_anew(names, "root"), "root").select("fp", "component"), n)
    return prints.join(known, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The rows of docs that name their component, each once: one document of every group of near-duplicates.

    Rows with a null id are kept, as nothing could name them; of rows repeated under one id, all with the first text stay
    as one row.
    """
    groups = near_duplicates(docs, id_col, text_col, shingle)
    gone = groups.where(F.col("id") != F.col("component")).select(F.col("id").alias("__tessera_gone")).distinct()
    left = docs.join(gone, F.col(id_col).cast("long") == F.col("__tessera_gone"), "left_anti")
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.where(F.col(id_col).isNull()))


def op1(spark, sf_dir: str) -> DataFrame:
    groups = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
