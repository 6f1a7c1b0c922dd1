"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled rows, beside a short fixed one. Features are densities
of both, how many of their words stand near the second person, and rates of capitals, punctuation and obfuscated
spelling. Trees and calibration are fitted in numpy on other labelled rows than the lexicon.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSULTS = frozenset("idiot moron stupid loser trash scum pathetic worthless disgusting dumb imbecile filth filthy vermin shut hate ugly clown".split())
SECOND = frozenset("you your yours you're u ur du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti tus usted ustedes vosotros eres es".split())
LEET = str.maketrans("013457@$!", "oieastasi")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[^\W\d_](?:[*@$!#+._]|\d)+[^\W\d_]")
NOT_LETTER = re.compile(r"[\W\d_]+")
STEM = 5
SEED, LEARNED, STEMMED, PERSON, HIDDEN = 1, 2, 4, 8, 16
MEMO = 1 << 19
FEATURES = ["seed", "learned", "stemmed", "seed_log", "learned_log", "stemmed_log", "near_person", "person", "capitals", "marks", "hidden", "hidden_hits", "log_words"]


def plain(token: str) -> tuple[str, bool]:
    """A lower-case token as letters only, with digits and signs inside read as the letters they stand for; was it so spelled?"""
    token = EDGES.sub("", token)
    if token.isalpha() or not INNER.search(token):
        return NOT_LETTER.sub("", token), False
    return NOT_LETTER.sub("", token.translate(LEET)), True


def terms(text: str | None) -> set[str]:
    """Words, and word beginnings marked by a hyphen, that a lexicon may take up."""
    words = {plain(t)[0] for t in set((text or "").lower().split())}
    return {w for w in words if len(w) >= 3} | {w[:STEM] + "-" for w in words if len(w) > STEM}


class Reader:
    """Features of texts for one lexicon, with the meaning of recent tokens kept."""

    def __init__(self, lexicon: frozenset[str]) -> None:
        reader = self

        class Memo(dict):
            def __missing__(self, token: str) -> int:
                if len(self) >= MEMO:
                    self.clear()
                code = self[token] = reader.code(token)
                return code

        self.lexicon, self.memo = lexicon, Memo()

    def code(self, token: str) -> int:
        word, hidden = plain(token)
        return (
            SEED * (word in INSULTS)
            | LEARNED * (word in self.lexicon)
            | STEMMED * (len(word) > STEM and word[:STEM] + "-" in self.lexicon)
            | PERSON * (word in SECOND)
            | HIDDEN * hidden
        )

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.lower().split()
        codes = np.fromiter(map(self.memo.__getitem__, tokens), dtype=np.uint8, count=len(tokens))
        n = max(1, len(tokens))
        number = [int(np.count_nonzero(codes & bit)) for bit in (SEED, LEARNED, STEMMED)]
        hits = np.flatnonzero(codes & (SEED | LEARNED | STEMMED))
        people = np.flatnonzero(codes & PERSON)
        near = 0
        if len(hits) and len(people):
            at = np.searchsorted(people, hits)
            right = people[np.minimum(at, len(people) - 1)] - hits
            left = hits - people[np.maximum(at - 1, 0)]
            near = int(np.count_nonzero((np.abs(right) <= 5) | (np.abs(left) <= 5)))
        ascii_text = text.encode("utf-8", "replace")
        capitals = len(ascii_text) - len(ascii_text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = text.count("!") + text.count("?")
        hidden = codes & HIDDEN != 0
        return [
            *(100 * x / n for x in number),
            *(math.log1p(x) for x in number),
            math.log1p(near),
            100 * len(people) / n,
            capitals / max(1, len(text)),
            marks / n,
            float(hidden.mean()) if len(codes) else 0.0,
            float(np.count_nonzero(hidden[hits])),
            math.log1p(len(tokens)),
        ]


@dataclass
class Trees:
    """Boosted trees of equal depth: for node i of a tree, features[i] > cuts[i] goes to 2i + 2, else to 2i + 1."""

    start: float
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.splits:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms."""
    base = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(math.log(base / (1 - base)), [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # Rare values above the upper quantiles would share a bin otherwise.
    edges = [np.unique(np.append(e, [x[:, j].min(), *np.quantile(x[x[:, j] > x[:, j].min(), j], np.linspace(0, 1, 9)[:-1])] if (x[:, j] > x[:, j].min()).any() else [x[:, j].min()])) for j, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        inner = 2**depth - 1
        feature, cut, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(2**depth)
        node = np.zeros(len(y), dtype=np.int64)
        for k in range(inner):
            inside = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf, 0)
            if len(inside) > 1:
                gs, hs = g[inside].sum(), h[inside].sum()
                for j, e in enumerate(edges):
                    gl = np.cumsum(np.bincount(binned[inside, j], g[inside], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[inside, j], h[inside], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < 0.1) | (hs - hl < 0.1)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, e[int(gain.argmax())], int(gain.argmax()))
            feature[k], cut[k] = best[1], best[2]
            node[inside] = 2 * k + 1 + (x[inside, best[1]] > best[2])
        place = node - inner
        leaf = -rate * np.bincount(place, g, 2**depth) / (np.bincount(place, h, 2**depth) + ridge)
        margin += leaf[place]
        model.splits.append((feature, cut, leaf))
    return model


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to scores, by pooling adjacent violators; equal scores are pooled first."""
    values, at = np.unique(scores, return_inverse=True)
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for v, s, n in zip(values, np.bincount(at, y), np.bincount(at), strict=True):
        blocks.append([s / n, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n2, _, last = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + m * n2) / (a[1] + n2), a[1] + n2, last
    x = np.array([p for b in blocks for p in (b[2], b[3])])
    return x, np.array([m for b in blocks for m in (b[0], b[0])])


@dataclass
class Model:
    lexicon: frozenset[str]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(features):
            return np.zeros(len(features))
        return np.clip(np.interp(self.trees.margin(features), *self.knots), 0, 1)


def _texts(docs: DataFrame, lexicon: frozenset[str], extra: list[str]) -> DataFrame:
    """extra columns and the features of the first column, `text`."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            rows = [reader.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], [*extra, "features"])

    kinds = dict(docs.dtypes)
    return docs.select("text", *extra).mapInArrow(featured, ", ".join([*(f"{c} {kinds[c]}" for c in extra), "features array<double>"]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 20_000, lexicon_size: int = 1000) -> Model:
    """Fits on at most `rows` labelled rows (also where documents repeat an id), those of the smallest hashes of their id:
    the lexicon on one half, the trees and their calibration on the other.

    Labels that are null, or whose document is missing, are left out. Without both labels the model scores 0 throughout.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("y"))
    chosen = chosen.withColumn("h", F.xxhash64(F.lit("toxic"), "_id")).orderBy("h", "y").limit(rows)
    both = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    half = F.pmod(F.shiftright("h", 8), F.lit(2))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = sorted(terms(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(["", *found], pa.string()), pa.array([y] * (len(found) + 1), pa.int64())], ["term", "y"])

    first = both.where(half == 0).select("text", F.col("y").cast("long").alias("y"))
    counted = first.mapInArrow(spread, "term string, y long").groupBy("term").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    total = counted.where("term = ''").first()
    if total is None or not 0 < total["bad"] < total["n"]:
        return Model(frozenset(), None, (np.zeros(1), np.zeros(1)))
    bad, good = total["bad"], total["n"] - total["bad"]
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    strong = counted.where((F.col("term") != "") & (F.col("bad") >= max(2, min(8, bad // 150)))).withColumn("w", ratio).where("w > 2.5")
    lexicon = frozenset(r["term"] for r in strong.orderBy(F.desc(F.col("w") * F.sqrt("bad")), "term").limit(lexicon_size).collect())
    got = _texts(both.where(half == 1), lexicon, ["y", "h"]).orderBy("h", "y").limit(rows).collect()
    y = np.array([r["y"] for r in got], dtype=float)
    x = np.array([r["features"] for r in got]).reshape(len(got), len(FEATURES))
    if not 0 < y.sum() < len(y):
        return Model(lexicon, None, (np.zeros(1), np.zeros(1)))
    fold = np.arange(len(y)) % 4
    margins = np.zeros(len(y))
    for k in range(4):
        margins[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicon, boost(x, y), isotonic(margins, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs: the calibrated probability that its whole text is toxic.

    Null and empty texts are scored as texts without words. Repeated rows come back repeated, an empty table gives an
    empty result, a null id stays null, and other columns play no part.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for batch in batches:
            rows = np.array([reader.features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows), pa.float64())], ["id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scored, "id long, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(docs, labels.where(fold != 2))
    done = score(docs, model).withColumnRenamed("id", "doc_id")
    return done.select("doc_id", (F.coalesce(fold, F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
