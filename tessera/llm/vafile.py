"""Exact top-k search by inner product over a vector-approximation file.

Every component is quantised to a cell of a few bits; the cells are written beside the exact vectors. A first scan reads
cells only and bounds every score from below: a query's kth best lower bound, over all rows, is a threshold no result
falls under. A second scan of the cells gives the rows whose upper bound reaches it. Of these, exact vectors are read in
the order of their bounds: the first few of each query, which give a kth exact score, and then those whose bound reaches
that score, until the kth result is certain. Queries are sent to the scans in blocks of bounded size.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, one_thread, written

CELLS = 64
ROWS, ASKED = 2048, 512  # of a block of bounds
FIRST = 2  # times as many exact vectors as results are read before the bounds are looked at again
LARGEST, WHOLE = 1 << 55, "O"  # components under this, and whole numbers of any size
MERGED = 64  # groups of tasks whose best bounds are merged first


def bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products (rows by queries) of vectors between low and high."""
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    return low @ up + high @ down, high @ up + low @ down


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


class Grid:
    """Cell edges of each dimension: cell c holds the integers from edges[c] to below edges[c + 1]."""

    def __init__(self, least: list[int], most: list[int]) -> None:
        span = np.array(most, dtype=np.int64) - np.array(least, dtype=np.int64) + 1
        self.edges = np.array(least, dtype=np.int64)[:, None] + -(-span[:, None] * np.arange(CELLS + 1) // CELLS)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(vectors.shape, dtype=np.uint8)
        for d, e in enumerate(self.edges):
            out[:, d] = np.searchsorted(e[:-1], vectors[:, d], side="right") - 1
        return out

    def corners(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.arange(cells.shape[1])
        return self.edges[d, cells].astype(np.float64), (self.edges[d, cells.astype(np.int64) + 1] - 1).astype(np.float64)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> tuple[DataFrame, int]:
    """(id, v): floor(scale * x) as little-endian 64-bit integers, shorter vectors padded with zeros; their width."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = vectors.where(x.isNotNull() & whole & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(scale))).alias("v"))
    width = usable.agg(F.max(F.size("v"))).first()[0] or 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(v, dtype="<i8").tobytes().ljust(8 * width, b"\0") for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "v"])

    return usable.mapInArrow(packed, "id long, v binary"), width


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, chunk: int = 8192
) -> DataFrame:
    """(query, rank, id, score): the k rows of vectors with the greatest inner products with each row of queries.

    Inner products are of the components floor(scale * x), and exact: where one could take more than 53 bits they are
    worked out in longs or in whole numbers of any size, and the bounds are widened by what rounding can do to them. The
    score is a long or, where one could take more than 63 bits, a decimal of 38 digits; only components of 2^55 and more
    raise ValueError. A row of the query's own id is no result of it; ties go to the smaller id; fewer rows give fewer results. Vectors that are null or hold null or
    non-finite components, and null ids, take no part. Vectors of different lengths meet as if padded with zeros. Of
    equal vectors only the k + 1 smallest ids are held against a query, since no other can be among its results, and
    equal queries are asked once; repeated rows of one id are one row. Empty tables give an empty result. Other columns
    play no part. A chunk of distinct queries, `chunk` in the mean, is broadcast at a time.
    """
    spark = vectors.sparkSession
    rows, width = integers(vectors.select(id_col, vector_col), id_col, vector_col, scale)
    asked, asked_width = integers(queries.select(id_col, vector_col), id_col, vector_col, scale)
    if not width or not asked_width:
        return spark.createDataFrame([], "query long, rank int, id long, score long")
    if asked_width != width:
        width = max(width, asked_width)
        rows, asked = (x.withColumn("v", F.rpad("v", 8 * width, F.lit(b"\0"))) for x in (rows, asked))
    want = k + 1
    asked = cut(asked.distinct())
    first = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= want).select("id", "v")
    few = cut(few)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(batch.schema.get_field_index("v")), "<i8", width)
                yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(m.min(axis=0)), pa.array(m.max(axis=0))], ["d", "a", "b"])

    limits = few.mapInArrow(ranges, "d int, a long, b long").groupBy("d").agg(F.min("a").alias("a"), F.max("b").alias("b")).orderBy("d").collect()
    most = max((abs(x) for r in limits for x in (r["a"], r["b"])), default=0)
    if most >= LARGEST:
        raise ValueError("components of 2^55 and more are not served")
    grid = Grid([r["a"] for r in limits], [r["b"] for r in limits])

    def approximated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = grid.cells(_matrix(batch.column(1), "<i8", width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary())], ["id", "v", "cells"])

    file = written(few.mapInArrow(approximated, "id long, v binary, cells binary"), "vafile")
    distinct = cut(asked.groupBy("v").agg(F.min("id").alias("query")))
    chunks = max(1, -(-distinct.count() // chunk))
    in_queries = distinct.mapInArrow(ranges, "d int, a long, b long").agg(F.max(F.greatest(F.abs("a"), F.abs("b"))).alias("most")).first()["most"] or 0
    score = "decimal(38,0)" if arithmetic(width, max(most, in_queries)) == WHOLE else "long"
    found = None
    for i in range(chunks):
        part = distinct.where(F.pmod(F.xxhash64("v"), F.lit(chunks)) == i).orderBy("query").collect()
        if part:
            asked_now = np.array([np.frombuffer(r["v"], dtype="<i8") for r in part])
            largest = max(most, int(np.abs(asked_now).max()))
            if largest >= LARGEST:
                raise ValueError("components of 2^55 and more are not served")
            some = _search_chunk(file, grid, [r["query"] for r in part], asked_now, want, width, most, arithmetic(width, largest), score)
            found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], f"query long, rank int, id long, score {score}")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= want)
    copies = asked.join(distinct.withColumnRenamed("query", "like"), "v").select(F.col("id").alias("query"), "like")
    results = copies.join(best.select(F.col("query").alias("like"), "id", "score"), "like").where("id <> query")
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "id", "score")


def arithmetic(width: int, most: int) -> str:
    """The numbers in which inner products of components up to `most` are exact."""
    largest = width * most * most
    return "f8" if largest < 1 << 53 else "i8" if largest < 1 << 63 else WHOLE


def _search_chunk(file: DataFrame, grid: Grid, names: list[int], queries: np.ndarray, want: int, width: int, most: int, kind: str, score: str) -> DataFrame:
    """(query, id, score): rows among which are the `want` best of each query."""
    sent = file.sparkSession.sparkContext.broadcast(queries.astype(np.float64))
    exact_queries = file.sparkSession.sparkContext.broadcast(queries)
    # What rounding can add to or take from a bound: nothing where all sums are whole numbers under 2^53.
    slack = 0.0 if kind == "f8" else (width + 8) * 2.0**-51 * most * np.abs(queries.astype(np.float64)).sum(axis=1)[None, :]

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        q = sent.value
        top = np.full((len(q), want), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                low, high = grid.corners(_matrix(batch.column(0).slice(at, ROWS), "u1", width))
                for b in range(0, len(q), ASKED):
                    least = bounds(low, high, q[b : b + ASKED])[0] - at_queries(slack, b)
                    both = np.concatenate([top[b : b + ASKED], least.T], axis=1)
                    top[b : b + ASKED] = -np.partition(-both, want - 1, axis=1)[:, :want]
        part = [TaskContext.get().partitionId() % MERGED] * len(q)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(q)), pa.int32()), pa.array(part, pa.int32()), pa.array(list(top), pa.list_(pa.float64()))], ["q", "part", "top"])

    best = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, want).alias("top")
    tops = file.select("cells").mapInArrow(lower, "q int, part int, top array<double>").groupBy("q", "part").agg(best).groupBy("q").agg(best)
    threshold = np.full(len(names), -np.inf)
    for r in tops.select("q", F.element_at("top", want).alias("least")).collect():
        threshold[r["q"]] = r["least"]

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        q = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, ROWS):
                low, high = grid.corners(_matrix(batch.column(1).slice(at, ROWS), "u1", width))
                for b in range(0, len(q), ASKED):
                    upper = bounds(low, high, q[b : b + ASKED])[1] + at_queries(slack, b)
                    row, j = np.nonzero(upper >= threshold[b : b + ASKED])
                    yield pa.RecordBatch.from_arrays([pa.array((j + b).astype(np.int32)), pa.array(ids[at + row]), pa.array(upper[row, j])], ["q", "id", "most"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = exact_queries.value
        for batch in batches:
            if batch.num_rows:
                asked = q[batch.column(0).to_numpy(zero_copy_only=False)]
                v = _matrix(batch.column(2), "<i8", width)
                if kind == WHOLE:
                    found = [sum(map(operator.mul, x, y)) for x, y in zip(v.tolist(), asked.tolist(), strict=True)]
                    column = pa.array(list(map(Decimal, found)), pa.decimal128(38, 0))
                else:
                    column = pa.array(np.einsum("ij,ij->i", v.astype(kind), asked.astype(kind)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column if score == "long" or kind == WHOLE else column.cast(pa.decimal128(38, 0))], ["q", "id", "score"])

    # Exact vectors are read in the order of their bounds: the first of each query, then those that can still be among its best.
    found = cut(file.select("id", "cells").mapInArrow(hopeful, "q int, id long, most double"))
    exact = lambda rows: rows.select("q", "id").join(file.select("id", "v"), "id").select("q", "id", "v").mapInArrow(scored, f"q int, id long, score {score}")
    # Ranks are asked for up to a limit alone, so that tasks pass on no more rows of a query than that.
    early = cut(top(found, F.desc("most"), FIRST * want))
    first = cut(exact(early))
    kth = top(first, F.desc("score"), want).groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == want).select(F.col("q").alias("asked"), F.col("least").cast("double").alias("least"))
    rest = found.join(early.select("q", "id"), ["q", "id"], "left_anti").join(kth, (F.col("q") == F.col("asked")) & (F.col("most") >= F.col("least")), "left_semi")
    known = file.sparkSession.createDataFrame(list(enumerate(names)), "asked int, query long")
    return first.unionByName(exact(rest)).join(F.broadcast(known), F.col("q") == F.col("asked")).select("query", "id", "score")


def at_queries(slack, at: int):
    """The part of a block of queries of a slack by queries."""
    return slack if isinstance(slack, float) else slack[:, at : at + ASKED]


def top(rows: DataFrame, first, most: int) -> DataFrame:
    """The first rows of each query, ties by id."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(first, "id"))).where(F.col("n") <= most).drop("n")


def op9(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("score").try_cast("long").alias("score"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.c, r.c)::BIGINT AS score
      FROM v q, v r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
