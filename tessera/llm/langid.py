"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's lower-cased bytes give hashed n-grams of one to four bytes. Each hash has an embedding; their mean goes through
a linear layer and a softmax. Both layers are trained together by stochastic gradient descent in numpy. A temperature,
and a least probability under which a prediction is marked as rejected, are set on held-back training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, WIDTH = 4096, 16
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def subword_counts(text: str) -> np.ndarray:
    """How many of the text's byte n-grams fall into each bucket."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(data), 1 << 20):
        part = data[at : at + (1 << 20) + 3].astype(np.uint32)
        value = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, 5):
            if len(part) >= n:
                value = (value[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
                new = value[: min(len(value), 1 << 20)]
                counts += np.bincount((new * np.uint32(2_654_435_761) + np.uint32(n) * np.uint32(40_503)) >> np.uint32(20), minlength=BUCKETS)
    return counts


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embeddings times output weights: each bucket's contribution to each language
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        if not self.langs or not text or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        counts = subword_counts(text)
        p = softmax((counts @ self.table / counts.sum() + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.least)


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that hold some of the text's subwords, and their shares of all."""
    counts = subword_counts(text)
    held = np.flatnonzero(counts)
    return held.astype(np.uint16), (counts[held] / max(1.0, counts.sum())).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 30, rate: float = 1.0, seed: int = 1) -> Model:
    """Trains on four fifths of the rows, given by their shares(), calibrates on the rest (on all, if that is none)."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, (held, share) in enumerate(rows):
        x[i, held] = share
    y = np.array([names.index(v) for v in langs])
    order = rng.permutation(len(y))
    train, held = order[len(y) // 5 :], order[: len(y) // 5]
    held = held if len(held) else order
    scale = (1 / np.sqrt(x[train].mean(axis=0) + 1e-5)).astype(np.float32)  # rare subwords move as far as common ones
    scale /= np.sqrt(((x[train] * scale) ** 2).sum(axis=1).mean())
    embed = rng.standard_normal((BUCKETS, WIDTH)).astype(np.float32) * 0.1
    weights = np.zeros((WIDTH, len(names)), dtype=np.float32)
    weights += rng.standard_normal(weights.shape).astype(np.float32) * 0.1
    bias = np.zeros(len(names), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        shuffled = rng.permutation(train)
        for at in range(0, len(shuffled), 64):
            rows = shuffled[at : at + 64]
            inputs = x[rows] * scale
            hidden = inputs @ embed
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ weights.T
            weights -= step * (hidden.T @ error)
            bias -= step * error.sum(axis=0)
            embed -= step * (inputs.T @ back)
    logits = (x[held] * scale) @ embed @ weights + bias
    right = y[held]
    grid = np.geomspace(0.1, 20, 40)
    loss = [-np.log(softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(logits / t)
    good = p.max(axis=1)[p.argmax(axis=1) == right]
    least = float(np.quantile(good, 0.01)) if len(good) else 0.0
    return Model(names, (scale[:, None] * (embed @ weights)).astype(np.float64), bias.astype(np.float64), t, least)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 800, rows: int = 4800) -> Model:
    """Fits on a sample of about per_lang rows of each language and `rows` in all at most, chosen by a hash of id and text.

    Rows without text, without letters or without a language take no part. No such rows: the model knows no language and
    predicts `und` alone. Subwords are counted where the rows lie; six bytes for each bucket in use, of BUCKETS, come to the
    driver for a row.
    """
    usable = docs.select(*dict.fromkeys((id_col, text_col, lang_col))).where(F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    named = usable.withColumn("__tessera_lang", F.col(lang_col).cast("string"))
    counts = named.groupBy("__tessera_lang").agg(F.count(F.lit(1)).alias("__tessera_n"))
    quota = min(per_lang, max(1, rows // max(1, counts.count())))
    hashed = F.pmod(F.xxhash64(F.lit("lang"), id_col, text_col), F.lit(1_000_003)) / 1_000_003
    # As many rows as the model has languages; texts stay where they lie.
    sample = named.join(F.broadcast(counts), "__tessera_lang").where(hashed < F.least(F.lit(1.0), F.lit(quota) / F.col("__tessera_n")))
    sample = sample.select(F.col(text_col).alias("t"), F.col("__tessera_lang").alias("l"), F.xxhash64(text_col, id_col).alias("h"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shares(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))], ["l", "held", "share"])

    picked = sample.orderBy("h", "l", "t").limit(rows).mapInArrow(counted, "l string, held binary, share binary").collect()
    return fit([(np.frombuffer(r["held"], dtype=np.uint16), np.frombuffer(r["share"], dtype=np.float32)) for r in picked], [r["l"] for r in picked])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row of docs, from its whole text.

    `und`, score 0 and rejected where the text is null or has no letter. Otherwise the likeliest learned language, its
    calibrated probability, and whether that is under the probability that 99 in 100 right answers reach. Repeated rows
    come back repeated, an empty table gives an empty result, and other columns play no part.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.predict(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, (pa.string(), pa.float64(), pa.bool_()))], ["id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(predicted, "id long, lang_pred string, score double, rejected boolean")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs.where(fold != 0))
    done = identify(docs, model).withColumnRenamed("id", "doc_id")
    return done.select("doc_id", (F.coalesce(fold, F.lit(1)) == 0).alias("held_out"), "lang_pred", "score", "rejected")
