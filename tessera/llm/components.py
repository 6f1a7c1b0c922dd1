"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_anew


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(u, v) pairs of longs -> (node, root), root being the smallest node of its component.

    Only nodes with an edge to another node come back. Loops, repeated and mirrored edges are fine; no edges give an
    empty result; rows with a null end are dropped. Each round costs two joins on the node, whose large groups adaptive
    execution splits, and ends in a written table; nothing but a row count and a checksum reaches the driver.
    `rows` is a bound on the edges, if one is known.
    """
    edges = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), rows
    )
    before = _signature(edges)
    for _ in range(max_rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(dealt_anew(low, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(dealt_anew(down, "u"), "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = cut(small, before[0])  # there are never more edges than before
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
