"""Tables that take repeated and late rows: a merge by key that rewrites only the hash partitions in which something changes.

A row of a batch counts if its key is new or its version greater than the one there. The partitions of such rows are read,
merged and put in place of the old ones by dynamic overwriting; the others keep their files. A batch that comes again
changes nothing, so that a stream's sink may repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.storage import exists, removed, scratch

PARTITION = "bucket"


class UpsertTable:
    """A Parquet folder with one row for each key, dealt into a fixed number of partitions by the key's hash."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], version: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.version, self.buckets = spark, path, schema, keys, version, buckets

    def read(self) -> DataFrame:
        stored = f"{self.schema}, {PARTITION} int"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.read().drop(PARTITION)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row of each key: that of the greatest version, and of equal ones the first by all columns."""
        rest = [c for c in rows.columns if c not in (*self.keys, self.version)]
        order = Window.partitionBy(*self.keys).orderBy(F.desc(self.version), *(F.col(c).cast("string") for c in rest))
        return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

    def merge(self, batch: DataFrame) -> list[int]:
        """Takes a batch in, and gives the partitions that were rewritten; rows with a null key or version are left out."""
        whole = F.col(self.version).isNotNull()
        for k in self.keys:
            whole = whole & F.col(k).isNotNull()
        columns = [c.split()[0] for c in self.schema.split(", ")]
        new = self._newest(batch.where(whole).select(*columns)).withColumn(PARTITION, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        there = self.read().select(*self.keys, F.col(self.version).alias("_there"))
        staged = scratch(self.spark, "upsert")
        new.join(there, self.keys, "left").where(F.col("_there").isNull() | (F.col(self.version) > F.col("_there"))).drop("_there").write.parquet(f"{staged}/new")
        new = self.spark.read.schema(f"{self.schema}, {PARTITION} int").parquet(f"{staged}/new")
        touched = sorted(r[0] for r in new.select(PARTITION).distinct().collect())  # no more than there are partitions
        if touched:
            kept = self.read().where(F.col(PARTITION).isin(touched)).join(new.select(*self.keys), self.keys, "left_anti")
            kept.select(*columns, PARTITION).unionByName(new.select(*columns, PARTITION)).write.parquet(f"{staged}/merged")
            merged = self.spark.read.schema(f"{self.schema}, {PARTITION} int").parquet(f"{staged}/merged")
            merged.repartition(PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(self.path)
        removed(self.spark, staged)
        return touched
