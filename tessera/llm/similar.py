"""Near-duplicates by exact Jaccard similarity of word-shingle sets, with candidates from SimHash and the Golay code.

At a similarity of 0.8 about 15 in 100 bits of two SimHashes differ, too many for the segments of one 64-bit fingerprint.
Fingerprints here are longer, cut into segments of 23 bits, and each bit comes with its weight (how far the shingles'
vote for it was from even), since the bits that differ are mostly those of small weight. A segment is decoded to the two
nearest of the 4096 Golay codewords by weighted distance. Pairs of segments make tables; a text has a key for each
combination of its segments' codewords in a table. By the pigeonhole of many tables two texts of similarity 0.8 share a
key with probability 0.99, and likelier ones more often. Of two texts that are alone under a key the first 64 bits, and
of all candidates the whole fingerprints, may not differ by more than 3.5 standard deviations over what they do at 0.8
(two pairs in 10,000 do, unrelated texts differ in half the bits); the others are verified on whole sets. Within a key
texts first meet its smallest and largest; then what is outside a key's largest component meets one text of that
component; and what is outside still meets all the key's texts. The last step is what texts of similarity 0.67 to 0.8 to
many others cost: nothing but comparing them tells that they are no near-duplicates.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_anew, one_thread
from .components import connected_components
from .simhash import LANES, SEED, _mixed, syndromes

WIDTH = 23  # bits of a segment
NEAREST = 2  # codewords of a segment
LANES_KEPT = 18  # of 64 bits each, of the fingerprint that candidates are compared by; twice the bits pass half as many pairs at 0.7
SIGNS = [f"s{i}" for i in range(LANES_KEPT)]
TURNS = 1
SENT = 500_000  # names of 16 bytes that may be broadcast
BLOCK = 1 << 12
NO_ID = -(1 << 63)


def shingles(text: bytes | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word shingles; of all its words where they are fewer."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()  # as in simhash.fingerprint
    joined = b" ".join(words)
    n = len(words) - words_per_shingle + 1
    if n < 2:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[:n].tolist(), ends[words_per_shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n))


def name_of(hashes: np.ndarray) -> int:
    """Signed 64-bit hash that stands for a whole set."""
    from xxhash import xxh64_intdigest as digest

    value = digest(hashes.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def tables_for(texts: int) -> tuple[int, int]:
    """(segments of a key, number of tables) for so many texts: keys of 24 bits, beyond 2^26 texts of 36 bits."""
    return (2, 13) if texts <= 1 << 26 else (3, 27)


def weights(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each bit of the SimHash of a set: how many more hashes have it set than not."""
    lanes = -(-bits // 64)
    salts = _mixed(np.arange(1, lanes + 1, dtype=np.uint64))[:, None]
    counts = np.zeros((lanes, 64), dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = _mixed(hashes[None, at : at + BLOCK] ^ salts)
        cuts = np.arange(0, block.shape[1], 255)  # sums of byte lanes stay under 256
        for k in range(8):
            sums = np.add.reduceat((block >> np.uint64(k)) & LANES, cuts, axis=1)
            counts[:, k::8] += sums.view(np.uint8).reshape(lanes, -1, 8).sum(axis=1, dtype=np.int64)
    return (2 * counts - len(hashes)).reshape(-1)


def most_bits(n: int) -> int:
    """How many of n bits may differ: 3.5 standard deviations over the mean at similarity 0.8, where a bit's chance is 0.1515."""
    return math.floor(0.1515 * n + 3.5 * math.sqrt(n * 0.1515 * 0.8485))


@lru_cache(1)
def _half_of_the_code() -> np.ndarray:
    """Codewords that have the top bit of their message clear, as signs in columns; the others are their complements."""
    messages = np.arange(2048) << 11
    words = messages ^ syndromes(messages)
    return (2.0 * ((words[:, None] >> np.arange(WIDTH)) & 1) - 1).astype(np.float32).T.copy()


def codewords(votes: np.ndarray) -> np.ndarray:
    """Indices of the NEAREST codewords of each segment (rows of votes), best first."""
    match = votes.astype(np.float32) @ _half_of_the_code()
    strength, rows, out = np.abs(match), np.arange(len(votes)), []
    for _ in range(NEAREST):
        best = strength.argmax(axis=1)
        out.append(2 * best + (match[rows, best] < 0))
        strength[rows, best] = -1
    return np.stack(out, axis=1)


def keys_of(votes: np.ndarray, per_key: int, tables: int) -> np.ndarray:
    """The keys (columns) of texts (rows) from their weights."""
    found, out = [codewords(votes[:, s * WIDTH : (s + 1) * WIDTH]) for s in range(per_key * tables)], []
    for t in range(tables):
        for choice in product(range(NEAREST), repeat=per_key):
            key = np.full(len(votes), t, dtype=np.int64)
            for segment, c in zip(found[t * per_key : (t + 1) * per_key], choice, strict=True):
                key = key << 12 | segment[:, c]
            out.append(key)
    return np.stack(out, axis=1)


def _with_keys(batches: Iterator[pa.RecordBatch], shingle: int, per_key: int, tables: int) -> Iterator[pa.RecordBatch]:
    one_thread()
    bits = max(per_key * tables * WIDTH, 64 * LANES_KEPT)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(x.as_py(), shingle) for x in part.column(1)]
            votes = np.stack([weights(s, bits) for s in sets])
            signs = np.packbits(votes[:, : 64 * LANES_KEPT] > 0, axis=1).view(np.int64)
            keys = keys_of(votes, per_key, tables)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name_of(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in signs.T), lists], ["id", "fp", *SIGNS, "keys"])


def _with_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The sets of texts, of those that have the name they are asked for by."""
    for batch in batches:
        sets = [shingles(x.as_py(), shingle) for x in batch.column(1)]
        right = [name_of(s) == fp for s, fp in zip(sets, batch.column(0).to_pylist(), strict=True)]
        hashes = pa.array([s.view(np.int64) for s, ok in zip(sets, right, strict=True) if ok], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right, pa.bool_())), hashes], ["fp", "hashes"])


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (u, v) pairs whose sets have a Jaccard similarity of at least so many hundredths."""
    sets = dealt_anew(sets, "fp")
    one = sets.select(F.col("fp").alias("u"), F.col("hashes").alias("hu"))
    two = sets.select(F.col("fp").alias("v"), F.col("hashes").alias("hv"))
    both = F.size(F.array_intersect("hu", "hv"))
    sizes = F.size("hu") + F.size("hv")
    hopeful = 100 * F.least(F.size("hu"), F.size("hv")) >= percent * F.greatest(F.size("hu"), F.size("hv"))
    return pairs.join(one, "u").join(two, "v").where(hopeful).where(100 * both >= percent * (sizes - both)).select("u", "v")


def _near(other: str):
    """The signs of a row and those whose names have `other` put in front."""
    apart = [F.bit_count(F.col(x).bitwiseXOR(F.col(other + x))) for x in SIGNS]
    return reduce(operator.add, apart) <= most_bits(64 * LANES_KEPT)


def _pair(u: str, v: str) -> list:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def link_sets(named: DataFrame, sets_of, percent: int, n: int) -> DataFrame:
    """(fp, signs, keys) -> (node, root) of all sets with another of that similarity, directly or through others.

    sets_of gives the (fp, hashes) of those (fp) it is asked for.
    """
    signs = named.select("fp", *SIGNS)
    theirs = lambda name: signs.select(F.col("fp").alias(name), *(F.col(x).alias("o" + x) for x in SIGNS))
    rows = named.select("fp", SIGNS[0], F.explode("keys").alias("key"))
    apart = F.bit_count(F.bit_xor(SIGNS[0]))  # of the two, where a key has two
    shared = rows.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("n"), apart.alias("apart"))
    shared = shared.where((F.col("low") != F.col("high")) & ((F.col("n") > 2) | (F.col("apart") <= most_bits(64))))
    shared = cut(shared.select("key", "low", "high", "n"), 4 * n)
    couples = shared.where("n = 2").select(F.col("low").alias("fp"), F.col("high").alias("end"))
    # Only keys of three texts and more ask for their rows again.
    met = rows.select("key", "fp").join(dealt_anew(shared.where("n > 2").select("key", "low", "high"), "key"), "key")
    met = cut(met.join(signs, "fp"), 4 * n, dealt=True)
    n_met = met.count() + couples.count()
    ends = met.select("fp", *SIGNS, F.explode(F.array("low", "high")).alias("end")).where("fp <> end")
    ends = ends.unionByName(couples.join(signs, "fp")).distinct().join(theirs("end"), "end")
    asked = cut(ends.where(_near("o")).select(*_pair("fp", "end")).distinct(), n_met)
    sets = cut(sets_of(asked.select(F.explode(F.array("u", "v")).alias("fp")).distinct()), n_met)
    links = cut(alike(asked, sets, percent), n_met)
    for turn in range(TURNS + 1):
        roots = cut(connected_components(links, n_met), n_met)
        rows = met.join(dealt_anew(roots, "node"), F.col("fp") == F.col("node"), "left")
        rows = cut(rows.select("key", "fp", F.coalesce("root", "fp").alias("root"), *SIGNS), n_met)
        # The largest component of each key with several, and a text of it; what is outside of it is all that is joined.
        counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(turn))).alias("one"))
        main = counts.groupBy("key").agg(F.max(F.struct("n", "root", "one")).alias("top"), F.count(F.lit(1)).alias("roots"))
        main = cut(dealt_anew(main.where("roots > 1").select("key", F.col("top.root").alias("main"), F.col("top.one").alias("one")), "key"), n_met)
        outside = rows.join(main.select("key", "main"), "key").where("root <> main")
        odd = outside.select(F.col("key").alias("k"), F.col("fp").alias("u"), F.col("root").alias("ru"), "main", *(F.col(x).alias("o" + x) for x in SIGNS))
        if turn < TURNS:
            others, once = main.select("key", F.col("main").alias("root"), F.col("one").alias("fp")).join(signs, "fp"), F.lit(True)
        else:  # two that are both outside meet once
            others, once = rows.join(main.select("key"), "key", "left_semi"), (F.col("root") == F.col("main")) | (F.col("fp") < F.col("u"))
        met_there = (F.col("key") == F.col("k")) & (F.col("root") != F.col("ru")) & once & _near("o")
        pairs = others.join(odd, met_there).select(*_pair("fp", "u")).distinct()
        pairs = cut(pairs.join(asked, ["u", "v"], "left_anti"), n_met)
        asked = asked.unionByName(pairs)
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct().join(sets.select("fp"), "fp", "left_anti")
        sets = sets.unionByName(cut(sets_of(wanted), n_met))
        links = links.unionByName(cut(alike(pairs, sets, percent), n_met))
    return connected_components(links, n_met)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of every group of near-duplicates, that of the smallest id; rows with a null id all stay.

    Groups are decided by (id, set), so that of two different texts under one id each counts in its own group. Rows with
    a null id link others. Null texts count as empty, and empty ones as copies of each other. An empty table gives an
    empty result; other columns play no part, whatever their names but those that start with `__tessera_`. Long texts are
    hashed whole. A row is cut to its set only where a candidate asks for it.
    """
    n = docs.count()
    per_key, tables = tables_for(n)
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")
    found = docs.select(key.alias("id"), text.alias("text")).mapInArrow(lambda x: _with_keys(x, shingle, per_key, tables), f"id long, fp long, {', '.join(f'{x} long' for x in SIGNS)}, keys array<long>")
    found = cut(found)
    # Equal sets have equal keys. A null id is the least, so that it only stands for a set if nothing else does.
    named = cut(found.groupBy("fp").agg(F.min("id").alias("first"), *(F.min(x).alias(x) for x in SIGNS), F.min("keys").alias("keys")), n)

    def sets_of(asked: DataFrame) -> DataFrame:
        reps = cut(named.join(asked, "fp", "left_semi").select(F.col("fp"), F.coalesce("first", F.lit(NO_ID)).alias("first")), n)
        reps = F.broadcast(reps) if reps.count() <= SENT else reps
        texts = docs.select(F.coalesce(key, F.lit(NO_ID)).alias("id"), text.alias("text"))
        wanted = texts.join(reps, F.col("id") == F.col("first")).select("fp", "text")
        return wanted.mapInArrow(lambda x: _with_sets(x, shingle), "fp long, hashes array<long>").dropDuplicates(["fp"])

    roots = link_sets(named, sets_of, percent, n)
    groups = named.select("fp", "first").join(dealt_anew(roots, "node"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    kept = groups.where("first IS NOT NULL").groupBy("root").agg(F.min(F.struct("first", "fp")).alias("x")).select(F.col("x.first").alias("id"), F.col("x.fp").alias("fp"))
    alone = found.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("alone"))
    kept = cut(kept.join(alone, "id").select(F.col("id").alias("__tessera_id"), F.col("fp").alias("__tessera_kept"), F.col("alone").alias("__tessera_alone")), n)
    ids = docs.where(F.col(id_col).isNotNull())
    once = ids.join(kept.where("__tessera_alone").select("__tessera_id"), key == F.col("__tessera_id"), "left_semi")
    # Ids of several rows: the texts tell which of them are the one that stays.
    repeated = cut(ids.join(kept.where("NOT __tessera_alone").select("__tessera_id", "__tessera_kept"), key == F.col("__tessera_id")))

    @F.arrow_udf("long")
    def name(texts: pa.Array) -> pa.Array:
        return pa.array([name_of(shingles(x.as_py(), shingle)) for x in texts], pa.int64())

    repeated = repeated.where(name(text) == F.col("__tessera_kept")).dropDuplicates(["__tessera_id", "__tessera_kept"]).select(*docs.columns)
    return once.unionByName(repeated).unionByName(docs.where(F.col(id_col).isNull()))
