"""Tables that the engine keeps for itself, below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, a local master gets a fresh one and a cluster an error."""
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


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path that no later plan reads."""
    files, place = _files(spark, path)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def state_of(spark: SparkSession, path: str) -> tuple:
    """What a file or folder is known by: names, sizes and times of change of the files right below it."""
    files, place = _files(spark, path)
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in files.listStatus(place)))


def kept(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], options: Callable | None = None) -> DataFrame:
    """The table `name` made from source files: written once in an application and read again until a source changes."""
    key = (spark.sparkContext.applicationId, name, *(state_of(spark, s) for s in sources))
    if key not in _KEPT:
        path, df = scratch(spark, name), make()
        writer = df.write if options is None else options(df.write)
        writer.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])
