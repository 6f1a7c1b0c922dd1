"""Upsert tables and mergeable sketches."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import usage as U
from tessera.operators.upserts import UpsertTable
from tessera.streaming import flows as S

SCHEMA = "id long, version long, value string"


def files(path):
    return {p.relative_to(path) for p in Path(path).rglob("*.parquet")}


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "version", buckets=8)
    first = spark.createDataFrame([(i, 1, f"v{i}") for i in range(200)], SCHEMA)
    assert table.merge(first) == list(range(8))
    before = files(table.path)
    assert table.merge(first) == [] and files(table.path) == before  # a repeated batch
    changes = spark.createDataFrame([(5, 2, "new"), (5, 3, "newest"), (5, 0, "late"), (9, 1, "same version"), (10, 0, "late"), (None, 9, "x"), (11, None, "x")], SCHEMA)
    touched = table.merge(changes)
    assert len(touched) == 1
    kept = {f for f in before if f.parts[0] != f"bucket={touched[0]}"}
    assert kept <= files(table.path) and files(table.path) - kept and not (files(table.path) - kept) & before
    got = {r.id: (r.version, r.value) for r in table.rows().collect()}
    assert got == {i: (1, f"v{i}") for i in range(200)} | {5: (3, "newest")}
    assert table.merge(changes) == []


def test_stream_in_many_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(30), i, f"v{i}") for i in range(400)]
    rng.shuffle(rows)
    for n in range(5):
        spark.createDataFrame(rows[n * 80 : n * 80 + 80], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "version", buckets=4)
    out = S.upserted(S.stream(spark, str(tmp_path), "in", files_per_trigger=1), table)
    assert {r.id: r.version for r in out.collect()} == {i: max(v for k, v, _ in rows if k == i) for i in {r[0] for r in rows}}


def test_sketches_unite_over_any_hours(spark):
    """Within four standard errors of the exact count, and the same however hours are put together."""
    users = spark.range(120_000).select((F.col("id") * 7919 % 50_000).alias("user_id"), (F.col("id") % 3).cast("string").alias("tenant_id"), F.timestamp_seconds(F.col("id") % 36_000).cast("timestamp_ntz").alias("ts"))
    users = users.unionByName(users.limit(5).withColumn("user_id", F.lit(None).cast("long")))
    sketches = U.hourly_sketches(users, "user_id").cache()
    for keys in ([], ["tenant_id"]):
        exact = {tuple(r)[:-1]: r.n for r in users.groupBy(*keys).agg(F.count_distinct("user_id").alias("n")).collect()}
        got = {tuple(r)[:-1]: r.estimate for r in U.distinct_from(sketches, keys).collect()}
        assert exact.keys() == got.keys() and all(abs(got[k] - n) <= 0.026 * n for k, n in exact.items())
    few = U.distinct_from(U.hourly_sketches(users.where("user_id < 40"), "user_id"), ["tenant_id"])
    exact = {r.tenant_id: r.n for r in users.where("user_id < 40").groupBy("tenant_id").agg(F.count_distinct("user_id").alias("n")).collect()}
    assert {r.tenant_id: r.estimate for r in few.collect()} == exact
    assert U.distinct_from(sketches.where("false"), ["tenant_id"]).collect() == []
