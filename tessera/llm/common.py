"""Helpers shared by the training-data operators: scratch storage, lineage cuts and text as bytes."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; unset, a local master gets a fresh one."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir(context.applicationId)


@lru_cache(1)
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def files_for(rows: int) -> int:
    """Into how many files so many rows go: small tables in few, but never under 64 before a file holds 500,000."""
    return max(1, -(-rows // 500_000), min(64, -(-rows // 20_000)))


def cut(df: DataFrame, rows: int | None = None, dealt: bool = False) -> DataFrame:
    """Computes df once into a table in the shared folder, so that a lost executor costs a reread and not a recomputation.

    Where a bound on the rows is known, they go to a number of files that grows with it, not to one for each task: with
    `dealt` by a shuffle of the (narrow) rows after a heavy stage that keeps all its tasks, otherwise in fewer tasks.
    A table is read without what checkpoint() remembers of the plan before it, which grows from round to round.
    """
    if rows is not None:
        df = df.repartition(files_for(rows)) if dealt else df.coalesce(files_for(rows))
    return written(df, "cut")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, of which later passes read the columns they ask for."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Buckets:
    """Tables of the shared folder that lie in the same buckets of their long column `row`: they join without a shuffle."""

    def __init__(self, spark: SparkSession, number: int) -> None:
        self.spark, self.number, self.kept = spark, number, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df, which has the column `row`, as the table `name`; the table that had this name before goes."""
        table = f"tessera_{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{table}"
        # No more writers than buckets, so that no more files are written than these two multiplied.
        df.repartition(self.number, "row").coalesce(self.number).write.bucketBy(self.number, "row").option("path", path).saveAsTable(table)
        self.forget(name)
        self.kept[name] = (table, path, df.schema)
        return self.spark.table(table)

    def forget(self, name: str) -> None:
        if name in self.kept:
            table, path, _ = self.kept.pop(name)
            self.spark.sql(f"DROP TABLE {table}")
            removed(self.spark, path)

    def released(self, name: str) -> DataFrame:
        """The table `name` as plain files, which stay; nothing of it is left in the catalogue."""
        table, path, schema = self.kept.pop(name)
        self.spark.sql(f"DROP TABLE {table}")
        return self.spark.read.schema(schema).parquet(path)


@lru_cache(1)
def one_thread() -> None:
    """Keeps numpy's matrix products in this process on one thread: tasks already fill the cores, and idle threads wait busily."""
    import ctypes
    from pathlib import Path

    import numpy

    for path in (Path(numpy.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        put = getattr(ctypes.CDLL(str(path)), "scipy_openblas_set_num_threads64_", None)
        if put is not None:
            put(1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; texts of ASCII alone go by the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """df with its long column `key` written so that Spark no longer takes the rows as dealt by it.

    After an aggregation by the key a join would take its rows as they lie, and adaptive execution could not split the
    other side's rows of a frequent key. Dealing the (smaller) aggregate again lets it.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))
